"""Feature bundles and routing graphs: tables read together, checked against each other, and composed.

A contract that does not hold is an error. Of arrays in files the headers tell all shapes, so the error comes before any
job; of tables, one aggregation a table finds their extents, and the error comes from the plan that reads the bundle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.arrays import header, read_array
from ..sources.tables import time_meta, zones_of
from . import graph as G
from . import routing as R
from . import series as S
from .numbering import numbered


def _extent(table: DataFrame, name: str, *axes: str) -> DataFrame:
    return table.agg(*[F.coalesce(F.max(a).cast("long") + 1, F.lit(0)).alias(f"{name}_{i}") for i, a in enumerate(axes)], F.count(F.lit(1)).alias(f"{name}_n"))


def _stops(*rules: tuple[Column, Column]) -> Column:
    """Null, or an error with the message of the first rule that holds."""
    out = F.lit(None).cast("boolean")
    for bad, said in reversed(rules):
        out = F.when(bad, F.raise_error(said).cast("boolean")).otherwise(out)
    return out


def features(nodes: DataFrame, edges: DataFrame, demand: DataFrame, supply: DataFrame, speeds: DataFrame, steps: int = 0, times: DataFrame | None = None) -> dict[str, DataFrame]:
    """node_features (t, node, demand, supply[, calendar channels]), edge_speeds (t, edge_id, speed) and edges, checked.

    nodes: (node), 0, 1, ...; edges: (edge_id, ...), 0, 1, ...; demand: (t, node, demand) and supply: (t, node, supply),
    whole; speeds: (i, j, speed), by step and edge, or by edge and step where only that fits the number of edges. steps:
    so many first steps only. times: (t, date, slot, day_of_week), for the calendar channels.
    """
    sizes = _extent(nodes, "nodes", "node").crossJoin(_extent(edges, "edges", "edge_id")).crossJoin(_extent(demand, "demand", "t", "node")).crossJoin(_extent(supply, "supply", "t", "node")).crossJoin(_extent(speeds, "speeds", "i", "j"))
    if times is not None:
        sizes = sizes.crossJoin(_extent(times, "times", "t"))
    c = F.col
    told = lambda text, *names: F.concat(F.lit(text), *[x for n in names for x in (F.lit(" "), c(n).cast("string"))])
    straight, turned = c("speeds_1") == c("edges_n"), c("speeds_0") == c("edges_n")
    t = F.when(straight, c("speeds_0")).otherwise(c("speeds_1"))
    rules = [
        ((c("demand_0") != c("supply_0")) | (c("demand_1") != c("supply_1")), told("demand and supply differ in shape:", "demand_0", "demand_1", "supply_0", "supply_1")),
        (~straight & ~turned, told("no axis of the speeds is the number of edges:", "speeds_0", "speeds_1", "edges_n")),
        (t != c("demand_0"), told("speeds and demand differ in steps:", "speeds_0", "speeds_1", "demand_0")),
        (c("demand_1") != c("nodes_n"), told("demand does not have the number of nodes:", "demand_1", "nodes_n")),
        *[(c(f"{x}_n") != c(f"{x}_0") * c(f"{x}_1"), told(f"{x} has gaps or repeats:", f"{x}_n")) for x in ("demand", "supply", "speeds")],
    ]
    if times is not None:
        needed = F.least(c("demand_0"), F.lit(steps)) if steps > 0 else c("demand_0")
        rules.append((c("times_0") < needed, told("time metadata has too few steps:", "times_0", "demand_0")))
    checked = F.broadcast(sizes.select(_stops(*rules).alias("_bad"), straight.alias("_straight")))
    cut = lambda rows: rows.where(c("t") < steps) if steps > 0 else rows
    both = cut(demand).select("t", "node", "demand").join(cut(supply).select("t", "node", "supply"), ["t", "node"])
    both = both.crossJoin(checked).where(c("_bad").isNull()).drop("_bad", "_straight")
    if times is not None:
        kept = cut(times)
        # without a limit the times may run on after the last step, and only those before it count
        both = S.with_calendar(both, kept if steps > 0 else kept.join(F.broadcast(demand.agg(F.max("t").alias("_last"))), c("t") <= c("_last"), "left_semi"))
    put = speeds.crossJoin(checked).where(c("_bad").isNull())
    put = put.select(F.when(c("_straight"), c("i")).otherwise(c("j")).alias("t"), F.when(c("_straight"), c("j")).otherwise(c("i")).alias("edge_id"), "speed")
    return {"node_features": both, "edge_speeds": cut(put), "edges": edges}


def _edges(spark: SparkSession, folder: str, source: str) -> tuple[int, int, DataFrame]:
    """Numbers of nodes and edges, and (edge_id, src, dst, length_km), of a folder of arrays."""
    found = lambda name: _header_if(f"{folder}/{name}.npy")
    adjacency = found("adjacency_matrix")
    if adjacency is None:
        raise FileNotFoundError(f"{folder}/adjacency_matrix.npy")
    if len(adjacency.shape) != 2 or adjacency.shape[0] != adjacency.shape[1]:
        raise ValueError(f"the adjacency is not square: {adjacency.shape}")
    names = ["edge_lengths_osrm", "edge_lengths"] if source == "osrm" else ["edge_lengths"]
    lengths = next((x for x in names if found(x) is not None), None)
    if lengths is None:
        raise FileNotFoundError(f"{folder}: none of {', '.join(names)}")
    if (index := found("edge_index")) is not None:
        ends = read_array(spark, f"{folder}/edge_index.npy", ("edge_id", "end"), "node")
        edges, number = ends.groupBy("edge_id").agg(*[F.max(F.when(F.col("end") == i, F.col("node"))).cast("int").alias(x) for i, x in enumerate(("src", "dst"))]), index.shape[0]
    else:
        cells = read_array(spark, f"{folder}/adjacency_matrix.npy", ("src", "dst"), "w").where("w > 0")
        edges = numbered(cells.select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst")), ["src", "dst"], "edge_id")
        number = edges.count()
    table = read_array(spark, f"{folder}/{lengths}.npy", ("src", "dst"), "length_km").select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), F.col("length_km").cast("double").alias("length_km"))
    return adjacency.shape[0], number, G.lengths(edges, table)


def _header_if(path: str):
    try:
        return header(path)
    except FileNotFoundError:
        return None


def turned(shape: tuple[int, ...], edges: int, edge_axis: int, name: str) -> bool:
    """Whether an array's edges lie along the other axis than edge_axis, which wins where both fit."""
    if len(shape) == 1 and edge_axis == 0 and shape[0] == edges:
        return False
    if len(shape) != 2:
        raise ValueError(f"{name} should have two dimensions: {shape}")
    if edges not in shape:
        raise ValueError(f"no axis of {name} {shape} is the number of edges, {edges}")
    return shape[edge_axis] != edges


def load_features(spark: SparkSession, folder: str, steps: int = 0, source: str = "osrm", times: DataFrame | None = None) -> dict[str, DataFrame]:
    """features() of a folder of arrays; times: time metadata with an explicit t, for the calendar channels."""
    nodes, number, edges = _edges(spark, folder, source)
    shapes = {x: header(f"{folder}/{x}.npy").shape for x in ("node_demand", "node_supply", "edge_speeds")}
    if shapes["node_demand"] != shapes["node_supply"]:
        raise ValueError(f"demand and supply differ in shape: {shapes}")
    other = turned(shapes["edge_speeds"], number, 1, "edge_speeds")
    if shapes["edge_speeds"][1 if other else 0] != shapes["node_demand"][0]:
        raise ValueError(f"speeds and demand differ in steps: {shapes}")
    if shapes["node_demand"][1:] != (nodes,):
        raise ValueError(f"demand does not have the number of nodes, {nodes}: {shapes}")
    used = min(shapes["node_demand"][0], steps) if steps > 0 else shapes["node_demand"][0]
    whole = lambda x, value: read_array(spark, f"{folder}/{x}.npy", ("t", "node"), value, used)
    both = whole("node_demand", "demand").join(whole("node_supply", "supply"), ["t", "node"])
    if times is not None:
        both = S.with_calendar(both, time_meta(times, used))
    speeds = read_array(spark, f"{folder}/edge_speeds.npy", ("edge_id", "t") if other else ("t", "edge_id"), "speed", 0 if other else used)
    return {"node_features": both, "edge_speeds": speeds.where(F.col("t") < used).select("t", "edge_id", "speed"), "edges": edges}


def routing_graph(edges: DataFrame, averaged: DataFrame | None, raw: DataFrame | None, zones: DataFrame, noise: DataFrame, most: int = 63) -> dict[str, DataFrame]:
    """The part of a road graph that zones with a locationid of at most most span (all for 0), with its speeds.

    edges: (edge_id, src, dst, length_km). averaged, raw: profiles (edge_id, slot, speed); the averaged one is taken if
    it is given. zones: (index, locationid, ...). noise: (edge_id, slot, noise). Returned: edges (edge_id, sub_edge_id, sub_src,
    sub_dst, length_km, predicted, real), the means of the profiles; profile (sub_edge_id, slot, predicted, real); zones
    with sub_index, in its order; nodes (full, sub); slots, one row: their number and minutes.
    """
    chosen = averaged if averaged is not None else raw
    if chosen is None:
        raise ValueError("a profile of averaged or of raw speeds is needed")
    profile = R.floored(chosen).join(noise, ["edge_id", "slot"]).select("edge_id", "slot", F.col("speed").alias("predicted"), (F.col("speed") * F.col("noise")).alias("real"))
    selected = G.checked(G.select_zones(zones, most))
    mapping, kept = G.induced(edges, selected.select(F.col("index").alias("node")))
    own = profile.join(kept.select("edge_id", "sub_edge_id"), "edge_id")
    means = own.groupBy("edge_id").agg(F.avg("predicted").alias("predicted"), F.avg("real").alias("real"))
    slots = chosen.agg((F.coalesce(F.max("slot"), F.lit(-1)) + 1).alias("slots"))
    return {
        "edges": kept.join(edges.select("edge_id", "length_km"), "edge_id").join(means, "edge_id", "left"),
        "profile": own.select("sub_edge_id", "slot", "predicted", "real"),
        "zones": selected.join(mapping.withColumnsRenamed({"full": "index", "sub": "sub_index"}), "index").orderBy("sub_index"),
        "nodes": mapping,
        "slots": slots.select("slots", R.slot_length(F.col("slots"), averaged is not None).alias("minutes")),
    }


def load_routing(spark: SparkSession, folder: str, zones: DataFrame | None, noise_of, source: str = "osrm", most: int = 63) -> dict[str, DataFrame]:
    """routing_graph() of a folder of arrays. noise_of: the noise table for a number of edges and slots. zones may be None for most 0."""
    nodes, number, edges = _edges(spark, folder, source)
    tables, slots = {}, 0
    for name in ("edge_speeds_avg", "edge_speeds"):
        if tables or (found := _header_if(f"{folder}/{name}.npy")) is None:
            continue
        names = ("slot", "edge_id") if turned(found.shape, number, 0, name) else ("edge_id", "slot")[: len(found.shape)]
        table = read_array(spark, f"{folder}/{name}.npy", names, "speed")
        tables[name] = table if len(names) == 2 else table.withColumn("slot", F.lit(0).cast("long"))
        slots = 1 if len(names) == 1 else found.shape[names.index("slot")]
    if most <= 0:
        zones = zones_of(spark, nodes)
    return routing_graph(edges, tables.get("edge_speeds_avg"), tables.get("edge_speeds"), zones, noise_of(number, slots), most)
