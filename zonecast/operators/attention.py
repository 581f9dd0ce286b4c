"""Graph attention and losses as joins and sums."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

LEAK, MASKED, LEAST_SUM = 0.2, -1e9, 1e-12
#: Parts of a receiver's edges, so that one with a third of all edges meets in no one task.
SALTS = 32
#: Receivers and senders each fall into so many parts, a cell being one of each; a cell sums so many pairs at a time.
GRID, ROWS = 16, 20_000


def leaky(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(LEAK * x)


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.expm1(x))


def segment_softmax(scores: DataFrame, key: str = "recv", value: str = "score") -> DataFrame:
    """scores with weight: softmax within key, less the maximum first.

    A key's rows are cut into SALTS parts by hash; what meets of a key is one row a part.
    """
    part = Window.partitionBy(key, "_salt")
    grown = scores.withColumn("_salt", F.pmod(F.xxhash64(*scores.columns), F.lit(SALTS))).withColumn("_m", F.max(value).over(part)).withColumn("_e", F.exp(F.col(value) - F.col("_m")))
    parts = grown.groupBy(key, "_salt").agg(F.max("_m").alias("_m"), F.sum("_e").alias("_s"))
    whole = Window.partitionBy(key)
    scaled = parts.withColumn("_f", F.exp(F.col("_m") - F.max("_m").over(whole)))
    scaled = scaled.withColumn("_f", F.col("_f") / F.greatest(F.sum(F.col("_s") * F.col("_f")).over(whole), F.lit(LEAST_SUM)))
    return grown.join(scaled.select(key, "_salt", "_f"), [key, "_salt"]).select(*scores.columns, (F.col("_e") * F.col("_f")).alias("weight"))


def _cell_sums(kind: pa.DataType, width: int):
    """A cell's pairs and nodes to (recv, m, s, x): of each receiver the highest score, and sums of exponentials less it, alone and times v."""
    fields = pa.schema([("recv", kind), ("m", pa.float64()), ("s", pa.float64()), ("x", pa.list_(pa.float64()))])

    def run(pairs: pa.Table, ends: pa.Table) -> pa.Table:
        receivers, senders = (ends.filter(x) for x in (pc.invert(ends["sends"]), ends["sends"]))
        one = pd.DataFrame({"recv": receivers["node"].to_pandas(), "q": receivers["score"].to_numpy()})
        two = pd.DataFrame({"send": senders["node"].to_pandas(), "k": senders["score"].to_numpy(), "at": np.arange(senders.num_rows)})
        met = pairs.select(["recv", "send", "e"]).to_pandas().merge(one, on="recv").merge(two, on="send").sort_values(["recv", "send"], kind="stable")
        if met.empty:
            return fields.empty_table()
        recv, at, score = met["recv"], met["at"].to_numpy(), (met["q"] + met["k"] + met["e"]).to_numpy(np.float64)
        score = np.where(score > 0, score, LEAK * score)
        starts = np.flatnonzero(np.append(True, recv.to_numpy()[1:] != recv.to_numpy()[:-1]))
        sizes = np.diff(np.append(starts, len(met)))
        most = np.maximum.reduceat(score, starts)
        grown = np.exp(score - np.repeat(most, sizes))
        flat = pa.concat_arrays(senders["v"].chunks).flatten()
        known = pc.is_valid(flat).to_numpy(zero_copy_only=False).reshape(-1, width)
        v = np.where(known, flat.fill_null(0.0).to_numpy().reshape(-1, width), 0.0)
        x, seen = np.empty((len(starts), width)), np.ones((len(starts), width), bool)
        low = 0
        while low < len(starts):  # about ROWS pairs at a time, a receiver's together
            high = max(low + 1, int(np.searchsorted(starts, starts[low] + ROWS)))
            own = slice(starts[low], starts[high] if high < len(starts) else len(met))
            x[low:high] = np.add.reduceat(grown[own, None] * v[at[own]], starts[low:high] - starts[low], axis=0)
            if not known.all():
                seen[low:high] = np.logical_or.reduceat(known[at[own]], starts[low:high] - starts[low], axis=0)
            low = high
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width, dtype=np.int32) if width else np.zeros(len(x) + 1, np.int32)), pa.array(x.ravel(), mask=~seen.ravel()))
        return pa.table([pa.array(recv.to_numpy()[starts], kind), most, np.add.reduceat(grown, starts), lists], schema=fields)

    return run


def _averages(nodes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(recv, out): the attention's average of the senders' v, an array of width components, each a sum of its own.

    Pairs and nodes meet in GRID x GRID cells by hash of receiver and sender: a node goes to GRID cells as a receiver and
    to GRID as a sender, and a cell gives one row a receiver. So v is shuffled by nodes, whose cost pairs do not raise,
    and of a receiver with a third of all pairs a cell has one in GRID.
    """
    key = dict(pairs.dtypes)["recv"]
    side = lambda x: F.pmod(F.xxhash64(x), F.lit(GRID)).cast("int")
    extra = F.col("e").cast("double") if "e" in pairs.columns else F.lit(0.0)
    edges = pairs.select("recv", F.col("send").cast(key).alias("send"), extra.alias("e")).where("recv IS NOT NULL AND send IS NOT NULL AND e IS NOT NULL")
    edges = edges.withColumn("cell", side("recv") * GRID + side("send"))
    every = nodes.select(F.col("node").cast(key).alias("node"), "q", "k", F.transform(F.expr(f"slice(sequence(0, {width}), 1, {width})"), lambda i: F.get("v", i).cast("double")).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("other")).where("node IS NOT NULL")
    receivers = every.select((side("node") * GRID + F.col("other")).alias("cell"), "node", F.lit(False).alias("sends"), F.col("q").cast("double").alias("score"), F.lit(None).cast("array<double>").alias("v"))
    senders = every.select((F.col("other") * GRID + side("node")).alias("cell"), "node", F.lit(True).alias("sends"), F.col("k").cast("double").alias("score"), "v")
    ends = receivers.union(senders).where("score IS NOT NULL")
    run = _cell_sums(to_arrow_schema(edges.schema).field("recv").type, width)
    sums = edges.groupBy("cell").cogroup(ends.groupBy("cell")).applyInArrow(lambda a, b: run(a, b), f"recv {key}, m double, s double, x array<double>")
    scaled = sums.withColumn("_f", F.exp(F.col("m") - F.max("m").over(Window.partitionBy("recv"))))
    total = F.greatest(F.sum(F.col("s") * F.col("_f")), F.lit(LEAST_SUM))
    return scaled.groupBy("recv").agg(F.array(*[F.sum(F.get("x", F.lit(d)) * F.col("_f")) / total for d in range(width)]).alias("out"))


def width_of(nodes: DataFrame) -> int:
    """The number of components of v: one aggregation."""
    return nodes.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]


def sparse_attention(nodes: DataFrame, pairs: DataFrame, width: int | None = None) -> DataFrame:
    """(node, d, out) from nodes (node, q, k, v: v an array) and pairs (recv, send[, e]). A node that receives nothing gets zeros."""
    width = width_of(nodes) if width is None else width
    found = nodes.select("node").join(_averages(nodes, pairs, width).withColumnRenamed("recv", "node"), "node", "left")
    out = F.coalesce("out", F.array_repeat(F.lit(0.0), width))
    return found.select("node", F.posexplode(out).alias("d", "x")).select("node", "d", elu(F.col("x")).alias("out"))


def dense_attention(nodes: DataFrame, pairs: DataFrame, width: int | None = None) -> DataFrame:
    """As sparse_attention over all pairs of nodes, those not in pairs masked: a node without neighbours averages all nodes.

    Masked scores are MASKED, so far below any other that their weights are 0 beside a neighbour, and all alike without
    one: no pair but those given is made.
    """
    width = width_of(nodes) if width is None else width
    every = nodes.agg(F.array(*[F.avg(F.get("v", F.lit(d))) for d in range(width)]).alias("all"))
    found = nodes.select("node").join(_averages(nodes, pairs.select("recv", "send").distinct(), width).withColumnRenamed("recv", "node"), "node", "left").crossJoin(F.broadcast(every))
    return found.select("node", F.posexplode(F.coalesce("out", "all")).alias("d", "x")).select("node", "d", elu(F.col("x")).alias("out"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def gated_convolution(series: DataFrame, key: str, x: str, first: list[float], second: list[float], gate: list[float], dilation: int = 1) -> DataFrame:
    """series with out: two causal dilated convolutions, blended by a third through a sigmoid. Weights run from the oldest step to now, the bias last."""
    by = Window.partitionBy(key).orderBy("t")
    steps = len(gate) - 1
    past = [F.coalesce(F.lag(x, (steps - 1 - i) * dilation).over(by), F.lit(0.0)) for i in range(steps)]
    conv = lambda w: sum((w[i] * p for i, p in enumerate(past)), F.lit(w[-1]))
    g = sigmoid(conv(gate))
    return series.withColumn("out", g * conv(first) + (1 - g) * conv(second))


def task_loss(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row: the weighted sum of mean squared errors, as the mean of batch means. rows: (task, batch, pred, target)."""
    batch = rows.groupBy("task", "batch").agg(F.avg((F.col("pred") - F.col("target")) ** 2).alias("mse"))
    task = batch.groupBy("task").agg(F.avg("mse").alias("mse"))
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return task.agg(F.sum(F.col("mse") * F.element_at(weight, F.col("task"))).alias("loss"))


def raw_metrics(rows: DataFrame) -> DataFrame:
    """(task, mse, rmse, mae, n) over all elements."""
    error = F.col("pred") - F.col("target")
    sums = rows.groupBy("task").agg(F.sum(error * error).alias("se"), F.sum(F.abs(error)).alias("ae"), F.count(error).alias("n"))
    n = F.greatest(F.col("n"), F.lit(1))
    return sums.select("task", (F.col("se") / n).alias("mse"), F.sqrt(F.col("se") / n).alias("rmse"), (F.col("ae") / n).alias("mae"), "n")


def raw_scale(rows: DataFrame, counts: DataFrame, speeds: DataFrame) -> DataFrame:
    """rows (task, edge_id, pred, target) in normalized space, back on the raw scale: both sides, by task.

    counts: one row of count_stats(), for demand and supply; speeds: speed_stats(), by edge, for the task speed.
    """
    joined = rows.join(speeds.select("edge_id", F.col("mean").alias("_mean"), F.col("std").alias("_std")), "edge_id", "left").crossJoin(F.broadcast(counts))
    of = lambda x: F.when(F.col("task") == "demand", F.expm1(x * F.col("demand_std") + F.col("demand_mean"))).when(F.col("task") == "supply", F.expm1(x * F.col("supply_std") + F.col("supply_mean"))).when(F.col("task") == "speed", x * F.col("_std") + F.col("_mean"))
    return joined.withColumns({"pred": of(F.col("pred")), "target": of(F.col("target"))}).select(rows.columns)


def write_metrics(loss: DataFrame, raw: DataFrame, path: str) -> None:
    """One JSON document, committed once: the loss in normalized space and the metrics of raw_metrics() by task."""
    by_task = F.map_from_entries(F.collect_list(F.struct("task", F.struct("mse", "rmse", "mae", "n").alias("metrics"))))
    raw.agg(by_task.alias("raw")).crossJoin(F.broadcast(loss.select(F.col("loss").alias("normalized_loss")))).coalesce(1).write.mode("overwrite").json(path)
