"""Calendar features, leak-free splits, sliding windows and normalization over an explicit time axis t."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import calendar_label, cyclic
from .numbering import numbered


def temporal_features(times: DataFrame, slots_per_day: int | None = None) -> DataFrame:
    """(t, month_sin, month_cos, weekday_sin, weekday_cos, slot_sin, slot_cos). slots_per_day: the last slot of these rows plus one unless given."""
    rows = times.crossJoin(F.broadcast(times.agg((F.max("slot") + 1).alias("spd")))) if slots_per_day is None else times.withColumn("spd", F.lit(slots_per_day))
    parts = (("month", F.month("date") - 1, F.lit(12)), ("weekday", F.col("day_of_week"), F.lit(7)), ("slot", F.col("slot"), F.col("spd")))
    return rows.select("t", *[c.alias(f"{n}_{w}") for n, x, p in parts for w, c in zip(("sin", "cos"), cyclic(x, p), strict=True)])


def with_calendar(rows: DataFrame, times: DataFrame, slots_per_day: int | None = None) -> DataFrame:
    """rows (t, ...) with the six calendar channels of their step: the same for every node, so they are joined by t."""
    return rows.join(temporal_features(times, slots_per_day), "t")


def split_labels(times: DataFrame) -> DataFrame:
    return times.select("t", "date", calendar_label(F.col("date")).alias("split"))


def split_windows(times: DataFrame, hist: int = 12, horizon: int = 3) -> DataFrame:
    """(idx, split): window starts whose target rows share one label. Frames run over the time axis alone, which is one row a step."""
    by = Window.orderBy("t")
    ahead = by.rowsBetween(0, horizon - 1)
    rows = split_labels(times).select(F.row_number().over(by).alias("rn"), F.min("split").over(ahead).alias("a"), F.max("split").over(ahead).alias("b"), F.count(F.lit(1)).over(ahead).alias("n"))
    return rows.where((F.col("rn") > hist) & (F.col("n") == horizon) & (F.col("a") == F.col("b"))).select((F.col("rn") - 1 - hist).alias("idx"), F.col("a").alias("split"))


def shuffled(rows: DataFrame, batch: int, seed: int = 0) -> DataFrame:
    """(epoch, idx, position, batch) of rows (epoch, idx): each epoch's rows in the order of a keyed hash, so many a batch.

    The order depends on seed, epoch and idx alone, so reruns agree however rows are dealt; positions are exact, and
    are found without a task that sees a whole epoch.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"), F.lit(":"), F.col("idx").cast("string")))
    # the hash as whole numbers in its own order
    part = lambda i: F.conv(F.substring("_key", 8 * i + 1, 8), 16, 10).cast("long") - (1 << 31)
    hashed = rows.select("epoch", "idx", key.alias("_key")).select("epoch", "idx", *[part(i).cast("int").alias(f"_h{i}") for i in range(4)])
    placed = numbered(hashed, ["epoch", "_h0"], "_place", ["_h1", "_h2", "_h3", "idx"])
    first = placed.groupBy("epoch").agg(F.min("_place").alias("_first"))
    out = placed.join(F.broadcast(first), "epoch").withColumn("position", F.col("_place") - F.col("_first"))
    return out.select("epoch", "idx", "position", F.floor(F.col("position") / batch).alias("batch"))


def stepped(rows: DataFrame, keys: list[str], share: float = 0.9, more: float = 0.05) -> DataFrame:
    """rows (keys, t, target) that have a step before, with pred: share of that step's target, plus more."""
    before = rows.select(*keys, (F.col("t") + 1).alias("t"), (share * F.col("target") + more).alias("pred"))
    return rows.join(before, [*keys, "t"])


def history_and_target(series: DataFrame, key: str, values: list[str], hist: int = 12, horizon: int = 3) -> DataFrame:
    """(key, idx, history, target): arrays of structs of the hist steps before a start and the horizon steps from it."""
    by = Window.partitionBy(key).orderBy("t")
    item = F.struct("t", *values)
    rows = series.select(key, F.row_number().over(by).alias("rn"), F.collect_list(item).over(by.rowsBetween(-hist, -1)).alias("history"), F.collect_list(item).over(by.rowsBetween(0, horizon - 1)).alias("target"))
    return rows.where((F.size("history") == hist) & (F.size("target") == horizon)).select(key, (F.col("rn") - 1 - hist).alias("idx"), "history", "target")


def count_stats(rows: DataFrame, columns: tuple[str, ...] = ("demand", "supply")) -> DataFrame:
    """One row: mean and population deviation, at least 1e-6, of ln(1 + x) of each column over train rows. A negative count in any row is an error."""
    train = F.col("split") == "train"
    safe = lambda c: F.when(F.col(c) >= 0, F.col(c)).otherwise(F.when(F.col(c).isNotNull(), F.raise_error(F.lit(f"{c} is negative"))))
    logs = rows.select("split", *[F.log1p(safe(c).cast("double")).alias(c) for c in columns])
    return logs.agg(*[x for c in columns for x in (F.avg(F.when(train, F.col(c))).alias(f"{c}_mean"), F.greatest(F.stddev_pop(F.when(train, F.col(c))), F.lit(1e-6)).alias(f"{c}_std"))])


def speed_stats(rows: DataFrame) -> DataFrame:
    """(edge_id, mean, std) over train rows; a deviation under 1e-6 counts as 1."""
    out = rows.where("split = 'train'").groupBy("edge_id").agg(F.avg("speed").alias("mean"), F.stddev_pop("speed").alias("std"))
    return out.withColumn("std", F.when(F.col("std") < 1e-6, 1.0).otherwise(F.col("std")))


def normalize_counts(rows: DataFrame, stats: DataFrame | None, columns: tuple[str, ...] = ("demand", "supply")) -> DataFrame:
    if stats is None:
        return rows
    joined = rows.crossJoin(F.broadcast(stats))
    return joined.withColumns({c: (F.log1p(F.col(c).cast("double")) - F.col(f"{c}_mean")) / F.col(f"{c}_std") for c in columns}).select(rows.columns)


def denormalize_counts(rows: DataFrame, stats: DataFrame | None, columns: tuple[str, ...] = ("demand", "supply")) -> DataFrame:
    if stats is None:
        return rows
    joined = rows.crossJoin(F.broadcast(stats))
    return joined.withColumns({c: F.expm1(F.col(c) * F.col(f"{c}_std") + F.col(f"{c}_mean")) for c in columns}).select(rows.columns)


def normalize_speed(rows: DataFrame, stats: DataFrame | None, inverse: bool = False) -> DataFrame:
    if stats is None:
        return rows
    value = F.col("speed") * F.col("std") + F.col("mean") if inverse else (F.col("speed") - F.col("mean")) / F.col("std")
    return rows.join(stats, "edge_id").withColumn("speed", value).select(rows.columns)


def write_stats(stats: DataFrame, path: str) -> None:
    """Statistics as JSON lines, one file: they are one row, or one an edge."""
    stats.coalesce(1).write.json(path)


def read_stats(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """What write_stats wrote, None if that is no row; a row that does not fit the schema is an error. By edge, a deviation under 1e-6 counts as 1."""
    out = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if out.isEmpty():
        return None
    return out.withColumn("std", F.when(F.col("std") < 1e-6, 1.0).otherwise(F.col("std"))) if "std" in out.columns else out
