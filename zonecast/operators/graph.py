"""Graphs as edge tables: (edge_id, src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import DEFAULT_LENGTH_KM, DEFAULT_SPEED, MILE_KM, at_least, mean_speed, null_if_nan
from .numbering import numbered

MIN_PAIR_TRIPS, MIN_SLOT_TRIPS = 5, 2


def pair_counts(trips: DataFrame) -> DataFrame:
    return trips.groupBy(F.col("orig").alias("src"), F.col("dest").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def adjacency(trips: DataFrame, over: int = MIN_PAIR_TRIPS) -> DataFrame:
    """(src, dst, n) with more than over trips and two ends."""
    return pair_counts(trips).where((F.col("n") > over) & (F.col("src") != F.col("dst")))


def edge_list(cells: DataFrame, weight: str | None = None) -> DataFrame:
    """Edges of adjacency cells (of positive weight), numbered row by row."""
    kept = cells if weight is None else cells.where(F.col(weight) > 0)
    return numbered(kept.select("src", "dst"), ["src", "dst"], "edge_id").select(F.col("edge_id").cast("int").alias("edge_id"), "src", "dst")


def lengths(edges: DataFrame, *tables: DataFrame) -> DataFrame:
    """edges with length_km from the first table (src, dst, length_km) given that is not None, as a source takes the next one's place as a whole; 0 where it has none."""
    found = next((x for x in tables if x is not None), None)
    if found is None:
        raise ValueError("no table of lengths")
    return edges.join(found.select("src", "dst", "length_km"), ["src", "dst"], "left").na.fill(0.0, ["length_km"]).select("edge_id", "src", "dst", "length_km")


def trip_lengths(edges: DataFrame, trips: DataFrame) -> DataFrame:
    """edges with length_km: the mean trip distance, at least 0.1, or a default where there is no trip."""
    means = trips.groupBy(F.col("orig").alias("src"), F.col("dest").alias("dst")).agg(F.count(F.lit(1)).alias("n"), F.avg(null_if_nan(F.col("distance"))).alias("mean"))
    length = F.when(F.col("n").isNull(), F.lit(DEFAULT_LENGTH_KM)).otherwise(at_least(F.col("mean") * MILE_KM, 0.1))
    return edges.join(means, ["src", "dst"], "left").select("edge_id", "src", "dst", length.alias("length_km"))


def trip_speeds(edges: DataFrame, trips: DataFrame, slots: DataFrame) -> DataFrame:
    """(slot, edge_id, speed) for every slot (of slots) and edge; a default under MIN_SLOT_TRIPS trips."""
    found = trips.groupBy(F.col("orig").alias("src"), F.col("dest").alias("dst"), "slot").agg(F.count(F.lit(1)).alias("n"), mean_speed(null_if_nan(F.col("distance")), F.col("minutes")).alias("speed")).where(F.col("n") >= MIN_SLOT_TRIPS)
    # the grid is what is asked for: one row a slot and edge
    every = edges.join(F.broadcast(slots.agg(F.max("slot").alias("last"))), F.lit(True)).select("edge_id", "src", "dst", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("slot"))
    speed = F.when(F.col("n").isNull(), F.lit(DEFAULT_SPEED)).otherwise(F.col("speed"))
    return every.join(found, ["src", "dst", "slot"], "left").select("slot", "edge_id", speed.alias("speed"))


def line_graph(edges: DataFrame) -> DataFrame:
    """(recv, send) of edges that follow each other: recv ends where send starts; turning back counts."""
    a, b = edges.select(F.col("edge_id").alias("recv"), F.col("dst").alias("at")), edges.select(F.col("edge_id").alias("send"), F.col("src").alias("at"))
    return a.join(b, "at").select("recv", "send")


def with_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(recv, send): the edges and a loop at each node (column node), each once."""
    return edges.select(F.col("src").alias("recv"), F.col("dst").alias("send")).union(nodes.select("node", "node")).distinct()


def fixed_features(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs (recv, send) with has_road and length_km, 0 where there is no road."""
    road = edges.select(F.col("src").alias("recv"), F.col("dst").alias("send"), F.lit(1).alias("has_road"), "length_km")
    return pairs.join(road, ["recv", "send"], "left").na.fill(0, ["has_road"]).na.fill(0.0, ["length_km"])


def features_by_step(fixed: DataFrame, edges: DataFrame, speeds: DataFrame, steps: DataFrame) -> DataFrame:
    """(t, recv, send, has_road, length_km, speed) at each step (of steps: t): the edge's speed at that step, 0 where there is no road.

    fixed: fixed_features(); edges: (edge_id, src, dst); speeds: (t, edge_id, speed). Steps without a speed have 0.
    """
    road = edges.select(F.col("src").alias("recv"), F.col("dst").alias("send"), "edge_id")
    every = fixed.join(road, ["recv", "send"], "left").crossJoin(F.broadcast(steps.select("t")))
    return every.join(speeds.select("t", "edge_id", "speed"), ["t", "edge_id"], "left").na.fill(0.0, ["speed"]).select("t", "recv", "send", "has_road", "length_km", "speed")


def select_zones(zones: DataFrame, most: int) -> DataFrame:
    """Zones whose locationid is at most most; all if most is not positive."""
    return zones if most <= 0 else zones.where(F.col("locationid") <= most)


def checked(selected: DataFrame) -> DataFrame:
    """selected, written zones; an error if there are none."""
    if selected.isEmpty():
        raise ValueError("no zone is selected")
    return selected


def induced(edges: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mapping (full, sub) of the selected nodes (column node), and edges between them with new ends and sub_edge_id."""
    mapping = numbered(selected.select(F.col("node").alias("full")), ["full"], "sub").select("full", F.col("sub").cast("int").alias("sub"))
    ends = edges.join(mapping.toDF("src", "sub_src"), "src").join(mapping.toDF("dst", "sub_dst"), "dst")
    return mapping, numbered(ends.select("edge_id", "sub_src", "sub_dst"), ["edge_id"], "sub_edge_id").select("edge_id", F.col("sub_edge_id").cast("int").alias("sub_edge_id"), "sub_src", "sub_dst")
