"""Mixing sources to target weights by entropy balancing.

Sizes of documents are words. Each source has a target, and document rates are the exponentially tilted weights
exp(lambda of the source) that meet all targets: the dual, sum of size * exp(lambda) less lambda * target, is
convex, and Newton's iterations solve it (balanced(), which takes several families of constraints, such as source and
language). Documents of one cell have one rate, so one aggregation over documents gathers the cells, and each
iteration is an aggregation over cells. Rates are rounded into copies: every document is taken floor(rate) times, and the fraction is met by taking whole
documents once more, in an order drawn by hash, until the source's rest is used up as nearly as may be.

Nothing passes through one task but tables of one row a source or of one row a bucket: a source of n rows, a third of
all maybe, is cut by hash into about sqrt(n) buckets of sqrt(n) rows, and the running sums within buckets and over
buckets are found apart. What is known of a source comes to its rows by bucket, so no join brings the source together.

A null text, or one without words, has size 0 and takes 0. A null source is a source, the last. Sources without
words have target 0. Rows that repeat a doc_id count as rows; those of one id, source and size get the same place
by chance, which changes no sum. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, drop, keep

#: Rounds of filling a source's rest: each takes those documents that still fit.
ROUNDS = 3
NEAR, STALLS = 0.005, 5


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size)"""
    return docs.select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).cast("long").alias("size")).na.fill(0, ["size"])


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(source, source_size, n_docs, target), one row a source. Source number i by code point, null last, weighs weights[i % len].

    No target is over most times its source's size; the excess goes to the others by weight. Sources are filled in
    the order in which they reach that limit, size over weight, so one pass over running sums gives the level.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    everything, ranked = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(ranked) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("limit", most * F.col("source_size")).withColumn("total", share * F.sum("source_size").over(everything))
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level)
    # the level of the first source that stays under its limit holds for all after it
    upto = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    held = F.first(F.when(F.col("weight") * F.col("level") < F.col("limit"), F.col("level")), ignorenulls=True).over(upto)
    target = F.coalesce(F.col("weight") * held, F.col("limit"))
    return rows.select("source", F.row_number().over(ranked).alias("source_no"), "source_size", "n_docs", target.alias("target"))


def balanced(cells: DataFrame, families: list[str], tolerance: float = 1e-9) -> DataFrame:
    """cells with rate: entropy balancing by Newton's iterations on the convex dual.

    cells: one row for each combination of the families' values, with size (the documents' sum) and <family>_target for
    each family. rate is exp(sum of a dual number for each family's value), and the rates' sizes meet all targets. The
    dual's gradient is mass - target, and within a family its Hessian is the diagonal of the masses, so each step is a sum
    over cells by family; families take turns until no mass is off its target by more than tolerance of it, or, where
    targets contradict each other, until turns get no nearer (one, or STALLS while some mass is over a tenth off). A step is at most 1 up, which keeps it from overshooting.
    """
    size = F.col("size").cast("double")
    live = (size > 0) & F.lit(True)
    for f in families:
        live = live & (F.col(f"{f}_target") > 0)
    cells, before, stalls, last = cells.withColumn("rate", F.when(live, 1.0).otherwise(0.0)), float("inf"), 0, None
    while True:
        for f in families:
            mass = F.sum(size * F.col("rate")).over(Window.partitionBy(f))
            step = F.least(F.lit(1.0), F.col(f"{f}_target") / F.col("_mass") - 1)
            cells = cells.withColumn("_mass", mass).withColumn("rate", F.when(F.col("rate") > 0, F.col("rate") * F.exp(step)).otherwise(0.0)).drop("_mass")
        cells = keep(cells, "mix-newton")
        if last is not None:
            drop(last)
        last = cells
        off = [F.max(F.when(F.col("rate") > 0, F.abs(F.col(f"_{f}") / F.col(f"{f}_target") - 1))).alias(f) for f in families]
        masses = cells.select("*", *[F.sum(size * F.col("rate")).over(Window.partitionBy(f)).alias(f"_{f}") for f in families])
        now = max([x for x in masses.agg(*off).first() if x is not None], default=0.0)
        stalls = stalls + 1 if now >= before * (1 - 1e-3) else 0
        if now <= tolerance or stalls and now < 0.1 or stalls >= STALLS:
            return cells
        before = min(before, now)


def tilted(rows: DataFrame) -> DataFrame:
    """rows of targets() with rate: one family, so that each source is a cell."""
    named = rows.select("*", F.col("source_size").alias("size"), F.col("target").alias("source_no_target"))
    return balanced(named, ["source_no"]).drop("size", "source_no_target")


_STATE = ("doc_id", "source_no", "place", "bucket", "size", "target", "whole", "rest", "more")
_BUCKET = ("source_no", "bucket")


def _spend(rows: DataFrame) -> DataFrame:
    """Rows with now (bool): one more copy where it is set, and the source's rest lowered by their sizes."""
    rows = keep(rows.select(*_STATE, "now"), "mix-round")
    spent = rows.groupBy(*_BUCKET).agg(F.sum(F.when(F.col("now"), F.col("size")).otherwise(0)).alias("spent"))
    spent = spent.select(*_BUCKET, F.sum("spent").over(Window.partitionBy("source_no")).alias("spent"))
    rest, more = F.col("rest") - F.col("spent"), F.col("more") + F.col("now").cast("int")
    return rows.join(spent, list(_BUCKET)).select(*_STATE[:-2], rest.alias("rest"), more.alias("more"))


def _fill(rows: DataFrame, most: Column) -> DataFrame:
    """One more copy of the documents, in order of place, that together still fit their source's rest and have under most copies more."""
    within = Window.partitionBy(*_BUCKET).orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    fits = (F.col("more") < most) & (F.col("size") > 0) & (F.col("size") <= F.col("rest"))
    rows = rows.withColumn("running", F.sum(F.when(fits, F.col("size")).otherwise(0)).over(within))
    over = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*_BUCKET).agg(F.max("running").alias("filled")).select(*_BUCKET, F.coalesce(F.sum("filled").over(over), F.lit(0)).alias("before"))
    return _spend(rows.join(ends, list(_BUCKET)).withColumn("now", fits & (F.col("before") + F.col("running") <= F.col("rest"))))


def _nearest(rows: DataFrame, most: Column) -> DataFrame:
    """One more copy of a source's smallest document left if that takes the source nearer to its target."""
    item = F.struct("size", "place", "doc_id")
    least = rows.groupBy(*_BUCKET).agg(F.min(F.when((F.col("more") < most) & (F.col("size") > 0), item)).alias("least"))
    least = least.select(*_BUCKET, F.min("least").over(Window.partitionBy("source_no")).alias("least"))
    now = F.coalesce((item == F.col("least")) & (2 * F.col("rest") > F.col("size")) & (F.col("more") < most), F.lit(False))
    return _spend(rows.join(least, list(_BUCKET)).withColumn("now", now))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, copies) of each row; taken = copies * size.

    Where whole documents leave a source over NEAR of its target short, its small ones are taken further times, up
    to most copies.
    """
    sizes = keep(sized(docs), "mix-sizes")
    plan = keep(tilted(targets(sizes, weights, share, most)), "mix-plan")
    whole = F.floor(F.col("rate") + 1e-9)
    # a document's place is drawn by its id alone; its leading 32 bits cut the source into buckets of consecutive places
    place = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    lead = F.conv(F.substring("place", 1, 8), 16, 10).cast("long")
    bucket = F.floor(lead * F.ceil(F.sqrt("n_docs")) / 2**32).cast("int")
    rows = sizes.join(plan, sizes["source"].eqNullSafe(plan["source"])).select("doc_id", "source_no", "n_docs", "size", place.alias("place"), "target", whole.alias("whole"), (F.col("target") - whole * F.col("source_size")).alias("rest"))
    rows = rows.select("doc_id", "source_no", "place", bucket.alias("bucket"), "size", "target", "whole", "rest", F.lit(0).alias("more"))
    one, up = F.least(F.lit(1), F.lit(int(most)) - F.col("whole")), F.lit(int(most)) - F.col("whole")
    for turn in range(2 * ROUNDS):
        if turn >= ROUNDS and (rows.agg(F.max(F.col("rest") / F.greatest("target", F.lit(1.0)))).first()[0] or 0) <= NEAR:
            break
        rows = _fill(rows, one if turn < ROUNDS else up)
    rows = _nearest(rows, up)
    copies = (F.col("whole") + F.col("more")).cast("long")
    named = plan.select("source_no", "source", "source_size")
    return rows.join(named, "source_no").select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def op7_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")
