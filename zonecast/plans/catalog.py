"""Queries by name over the star-schema tables, and the same in SQL.

The tables that stand in for trips, zones and time metadata are described in FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import duration_minutes, rounded
from ..operators import attention as A
from ..operators import graph as G
from ..operators import routing as R
from ..operators import series as S
from ..operators import trips as T
from ..sources.kept import once
from ..sources.tables import event_times, event_trips

ZONES, GRAPH_ZONES, SLOT, DAY = 10, 20, 60, 1440


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _timed(spark, d, rule="mod20", zones=GRAPH_ZONES):
    """Trips without slots: one scan of the events."""
    return T.timed(T.in_zones(event_trips(_read(spark, d, "events"), rule), zones))


def _trips(spark, d, rule="tens", zones=ZONES, slot=SLOT):
    return T.slotted(once(_timed(spark, d, rule, zones), "trips"), slot)


def _edges(trips):
    """The cells are one row a pair of zones; numbering reads them several times."""
    return G.edge_list(once(G.adjacency(trips), "cells"))


def _graph(spark, d, slot=DAY):
    trips = once(_timed(spark, d), "trips")
    return T.slotted(trips, slot), _edges(trips)


def _times(spark, d):
    return event_times(_read(spark, d, "events"), SLOT)


# ---- trips ----


def trip_filter(spark, d):
    return T.in_zones(event_trips(_read(spark, d, "events"), "all"), 63).select("pickup_ts", "orig", "dest", "distance")


def trip_duration(spark, d):
    out = T.timed(event_trips(_read(spark, d, "events")))
    return out.select("pickup_ts", "orig", "dest", rounded(F.col("minutes")).alias("minutes"))


def demand_by_slot_zone(spark, d):
    return T.counts(_trips(spark, d), "orig", "demand")


def dropoff_by_slot_zone(spark, d):
    return T.counts(_trips(spark, d), "dest", "dropoffs")


def vacant_supply(spark, d):
    return T.demand_supply(_trips(spark, d), ZONES).select("slot", "zone", "demand", "supply")


def node_features(spark, d):
    return T.demand_supply(_trips(spark, d), ZONES).select("slot", "zone", F.explode(F.array(F.struct(F.lit(0).alias("channel"), F.col("demand").alias("value")), F.struct(F.lit(1).alias("channel"), F.col("supply").alias("value")))).alias("x")).select("slot", "zone", "x.channel", "x.value")


_EVENTS = """
e AS (SELECT user_id, ts, event_id, value, CAST(json_extract(props, '$.k') AS INT) AS k FROM events),
ez AS (SELECT *, CAST({zone} AS INT) AS zone FROM e),
raw AS (SELECT ts AS pickup_ts, lead(ts) OVER w AS dropoff_ts, zone AS orig, lead(zone) OVER w AS dest, value AS distance
        FROM ez WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
inz AS (SELECT * FROM raw WHERE orig >= 0 AND orig < {zones} AND dest >= 0 AND dest < {zones}),
timed AS (SELECT * FROM (SELECT *, (epoch_us(dropoff_ts) - epoch_us(pickup_ts)) / 6e7 AS minutes FROM inz) WHERE minutes > 1 AND minutes < 180),
trips AS (SELECT *, CAST(floor((epoch_us(pickup_ts) - (SELECT min(epoch_us(pickup_ts)) FROM timed)) / ({slot} * 6e7)) AS INT) AS slot FROM timed)
"""
_RULES = {"tens": "floor(k / 10)", "mod20": "k % 20", "all": "k"}


def _with_trips(rule="tens", zones=ZONES, slot=SLOT) -> str:
    return "WITH " + _EVENTS.format(zone=_RULES[rule], zones=zones, slot=slot)


def _r(x: str) -> str:
    return f"floor(({x}) * 1000000.0 + 0.5001) / 1000000.0"


_SUPPLY = """,
axis AS (SELECT s.slot, z.zone FROM (SELECT CAST(unnest(range(0, (SELECT max(slot) + 1 FROM trips))) AS INT) AS slot) s, (SELECT CAST(unnest(range(0, 10)) AS INT) AS zone) z),
flows AS (SELECT slot, zone, sum(p) AS p, sum(q) AS q FROM (SELECT slot, orig AS zone, 1 AS p, 0 AS q FROM trips UNION ALL SELECT slot, dest, 0, 1 FROM trips) GROUP BY ALL),
full_ AS (SELECT slot, zone, coalesce(p, 0) AS demand, coalesce(q, 0) AS dropoffs FROM axis LEFT JOIN flows USING (slot, zone)),
free AS (SELECT *, 5 + coalesce(sum(dropoffs - demand) OVER (PARTITION BY zone ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM full_),
supply AS (SELECT slot, zone, CAST(demand AS BIGINT) AS demand, CAST(x - least(0, min(x) OVER (PARTITION BY zone ORDER BY slot ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS supply FROM free)
"""

# ---- graph ----


def od_pair_counts(spark, d):
    return G.pair_counts(_timed(spark, d))


def od_adjacency(spark, d):
    return G.adjacency(_timed(spark, d))


def edge_list(spark, d):
    return _edges(_timed(spark, d))


def edge_lengths(spark, d):
    trips, edges = _graph(spark, d)
    return G.trip_lengths(edges, trips).withColumn("length_km", rounded(F.col("length_km")))


def edge_speeds(spark, d):
    trips, edges = _graph(spark, d)
    return G.trip_speeds(edges, trips, trips).withColumn("speed", rounded(F.col("speed")))


def line_graph(spark, d):
    return G.line_graph(_edges(_timed(spark, d)))


def _nodes(spark):
    return spark.range(GRAPH_ZONES).select(F.col("id").cast("int").alias("node"))


def fixed_graph_self_loops(spark, d):
    return G.with_loops(_edges(_timed(spark, d)), _nodes(spark))


def fixed_edge_features(spark, d):
    trips, edges = _graph(spark, d)
    out = G.fixed_features(G.with_loops(edges, _nodes(spark)), G.trip_lengths(edges, trips))
    return out.select("recv", "send", "has_road", rounded(F.col("length_km")).alias("length_km"))


def induced_subgraph(spark, d):
    return G.induced(_edges(_timed(spark, d)), _nodes(spark).where("node % 3 <> 1"))[1]


def zone_select_by_id(spark, d):
    zones = _read(spark, d, "nation").select(F.col("n_nationkey").alias("index"), F.col("n_name").alias("zone_name"), (F.col("n_nationkey") + 1).cast("long").alias("locationid"))
    return G.select_zones(zones, 10)


def nation_od_counts(spark, d):
    """The pair counts over lineitem, orders, customer and supplier: customer's nation to supplier's nation."""
    line = _read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    supplier = _read(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    orders = _read(spark, d, "orders").select("o_orderkey", "o_custkey")
    customer = _read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    joined = line.join(supplier, line.l_suppkey == supplier.s_suppkey).join(orders, line.l_orderkey == orders.o_orderkey).join(customer, orders.o_custkey == customer.c_custkey)
    return joined.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")).where("n > 5 AND src <> dst")


_EDGES = """,
adj AS (SELECT orig AS src, dest AS dst, count(*) AS n FROM trips GROUP BY ALL HAVING count(*) > 5 AND orig <> dest),
edges AS (SELECT CAST(row_number() OVER (ORDER BY src, dst) - 1 AS INT) AS edge_id, src, dst FROM adj),
lens AS (SELECT edge_id, src, dst, greatest(avg(distance) * 1.609, 0.1) AS length_km FROM edges JOIN trips ON orig = src AND dest = dst GROUP BY ALL),
speeds AS (SELECT a.slot, edge_id, coalesce(speed, 30.0) AS speed FROM edges CROSS JOIN (SELECT CAST(unnest(range(0, (SELECT max(slot) + 1 FROM trips))) AS INT) AS slot) a
  LEFT JOIN (SELECT orig, dest, slot, least(greatest(avg(distance) * 1.609 / (avg(minutes) / 60 + 1e-5), 5), 130) AS speed FROM trips GROUP BY ALL HAVING count(*) >= 2) t ON orig = src AND dest = dst AND t.slot = a.slot)
"""
_GRAPH = _with_trips("mod20", GRAPH_ZONES, DAY) + _EDGES
_LOOPS = ", loops AS (SELECT src AS recv, dst AS send FROM edges UNION SELECT x, x FROM (SELECT CAST(unnest(range(0, 20)) AS INT) AS x))"

# ---- calendar, normalization, windows ----


def temporal_features(spark, d):
    out = S.temporal_features(_times(spark, d))
    return out.select("t", *[rounded(F.col(c)).alias(c) for c in out.columns if c != "t"])


def node_calendar_channels(spark, d):
    """Demand and supply of each step and zone with the calendar channels of the step."""
    out = S.with_calendar(T.demand_supply(_trips(spark, d), ZONES).select(F.col("slot").alias("t"), "zone", "demand", "supply"), _times(spark, d))
    return out.select("t", "zone", "demand", "supply", *[rounded(F.col(c)).alias(c) for c in out.columns if c.endswith(("_sin", "_cos"))])


def calendar_split(spark, d):
    return S.split_labels(_times(spark, d))


def split_windows(spark, d):
    return S.split_windows(_times(spark, d))


def split_counts(spark, d):
    return S.split_windows(_times(spark, d)).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def _series(spark, d):
    """The demand and supply grid with the label of the day its slot falls on."""
    grid = T.demand_supply(_trips(spark, d), ZONES)
    return grid.join(S.split_labels(_times(spark, d)), F.col("slot") == F.col("t")).select("t", "zone", "demand", "supply", "split")


def _speeds(spark, d):
    trips, edges = _graph(spark, d)
    days = _times(spark, d).where("slot = 0").select((F.col("t") / 24).cast("int").alias("t"), "date")
    return G.trip_speeds(edges, trips, trips).join(S.split_labels(days), F.col("slot") == F.col("t")).select("t", "edge_id", "speed", "split")


def norm_stats_counts(spark, d):
    out = S.count_stats(_series(spark, d))
    return out.select(*[rounded(F.col(c)).alias(c) for c in out.columns])


def norm_stats_speed(spark, d):
    return S.speed_stats(_speeds(spark, d)).select("edge_id", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"))


def normalize_counts(spark, d):
    rows = once(_series(spark, d), "series")
    return S.normalize_counts(rows, S.count_stats(rows)).select("t", "zone", rounded(F.col("demand")).alias("demand"), rounded(F.col("supply")).alias("supply"))


def normalize_speed(spark, d):
    rows = once(_speeds(spark, d), "speeds")
    return S.normalize_speed(rows, S.speed_stats(rows)).select("t", "edge_id", rounded(F.col("speed")).alias("speed"))


def denormalize_speed(spark, d):
    """Speeds normalized and back."""
    rows = once(_speeds(spark, d), "speeds")
    stats = S.speed_stats(rows)
    return S.normalize_speed(S.normalize_speed(rows, stats), stats, inverse=True).select("t", "edge_id", rounded(F.col("speed")).alias("speed"))


def denormalize_roundtrip(spark, d):
    rows = once(_series(spark, d), "series")
    stats = S.count_stats(rows)
    return S.denormalize_counts(S.normalize_counts(rows, stats), stats).select("t", "zone", F.round("demand").cast("long").alias("demand"), F.round("supply").cast("long").alias("supply"))


def history_windows(spark, d):
    out = S.history_and_target(_series(spark, d), "zone", ["demand", "supply"])
    return out.select("zone", "idx", F.posexplode("history").alias("step", "x")).select("zone", "idx", "step", "x.t", "x.demand", "x.supply")


def target_windows(spark, d):
    out = S.history_and_target(_series(spark, d), "zone", ["demand", "supply"])
    return out.select("zone", "idx", F.posexplode("target").alias("step", "x")).select("zone", "idx", "step", "x.t", "x.demand", "x.supply")


_TIMES = """
days AS (SELECT min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events),
times AS (SELECT CAST(t AS INT) AS t, CAST(a + CAST(t // 24 AS INT) AS DATE) AS date, CAST(t % 24 AS INT) AS slot, isodow(a + CAST(t // 24 AS INT)) - 1 AS dow
          FROM (SELECT a, unnest(range(0, (date_diff('day', a, b) + 1) * 24)) AS t FROM days)),
labels AS (SELECT t, date, CASE WHEN day(date) <= 20 THEN 'train' WHEN day(date) <= 24 THEN 'val' ELSE 'test' END AS split FROM times),
wins AS (SELECT rn - 13 AS idx, a AS split FROM (SELECT row_number() OVER (ORDER BY t) AS rn, min(split) OVER w AS a, max(split) OVER w AS b, count(*) OVER w AS n
         FROM labels WINDOW w AS (ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE rn > 12 AND n = 3 AND a = b)
"""
_SERIES = _with_trips() + _SUPPLY + "," + _TIMES + """,
series AS (SELECT t, zone, demand, supply, split FROM supply JOIN labels ON slot = t),
stats AS (SELECT avg(ln(1 + demand)) AS dm, greatest(stddev_pop(ln(1 + demand)), 1e-6) AS ds, avg(ln(1 + supply)) AS sm, greatest(stddev_pop(ln(1 + supply)), 1e-6) AS ss FROM series WHERE split = 'train'),
wind AS (SELECT zone, t, rn - 13 AS idx, n FROM (SELECT zone, t, row_number() OVER (PARTITION BY zone ORDER BY t) AS rn, count(*) OVER (PARTITION BY zone) AS n FROM series) WHERE rn > 12 AND rn + 2 <= n),
pos AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY t) - 1 AS p FROM series)
"""
_SPEEDS = _GRAPH + "," + _TIMES + """,
sp AS (SELECT s.slot AS t, edge_id, speed, split FROM speeds s JOIN labels l ON l.t = s.slot * 24),
sst AS (SELECT edge_id, avg(speed) AS mean, CASE WHEN stddev_pop(speed) < 1e-6 THEN 1.0 ELSE stddev_pop(speed) END AS std FROM sp WHERE split = 'train' GROUP BY edge_id)
"""

# ---- routing, attention, metrics ----


def _profile(spark, d):
    trips, edges = _graph(spark, d)
    return R.floored(G.trip_speeds(edges, trips, trips))


def profile_floor(spark, d):
    return _profile(spark, d).withColumn("speed", rounded(F.col("speed")))


def speed_profile_mean(spark, d):
    return R.edge_means(_profile(spark, d)).withColumn("speed", rounded(F.col("speed")))


def perturbed_profile(spark, d):
    profile = once(_profile(spark, d), "profile")
    size = profile.agg((F.coalesce(F.max("edge_id"), F.lit(-1)) + 1).alias("e"), (F.coalesce(F.max("slot"), F.lit(-1)) + 1).alias("s")).first()
    return R.perturbed(profile, size.e, size.s)


def _attending_all(spark, d):
    """All embeddings as nodes, all but two components as values; (part, supplier) of all line items, by place among the nodes, as edges."""
    v = _read(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("e"))
    nodes = v.select("node", F.col("e")[0].alias("q"), F.col("e")[1].alias("k"), F.slice("e", 3, F.greatest(F.size("e") - 2, F.lit(0))).alias("v"))
    size = v.agg(F.greatest(F.max("node") + 1, F.lit(1)).alias("n")).first().n or 1
    edges = _read(spark, d, "lineitem").select((F.col("l_partkey") % size).alias("src"), (F.col("l_suppkey") % size).alias("dst"))
    return nodes, G.with_loops(edges, nodes)


def segment_softmax_all(spark, d):
    nodes, pairs = _attending_all(spark, d)
    scored = pairs.join(nodes.select(F.col("node").alias("recv"), "q"), "recv").join(nodes.select(F.col("node").alias("send"), "k"), "send")
    out = A.segment_softmax(scored.select("recv", "send", A.leaky(F.col("q") + F.col("k")).alias("score")))
    return out.select("recv", "send", rounded(F.col("weight")).alias("weight"))


def sparse_attention_all(spark, d):
    return A.sparse_attention(*_attending_all(spark, d)).withColumn("out", rounded(F.col("out")))


def gated_temporal_conv_lag(spark, d):
    rows = _series(spark, d).withColumn("x", F.log1p(F.col("demand").cast("double")))
    out = A.gated_convolution(rows, "zone", "x", [0.2, -0.1, 0.5, 0.05], [0.1, 0.3, -0.2, 0.0], [0.4, 0.2, -0.6, 0.1], 2)
    return out.select("zone", "t", rounded(F.col("out")).alias("out"))


def _persistence(spark, d):
    """The last value before each target step's start as its forecast."""
    w = S.history_and_target(_series(spark, d), "zone", ["demand", "supply"])
    rows = w.select("zone", "idx", F.element_at("history", -1).alias("h"), F.posexplode("target").alias("step", "x"))
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("task"), F.col(f"h.{c}").cast("double").alias("pred"), F.col(f"x.{c}").cast("double").alias("target")) for c in ("demand", "supply")]))
    return rows.select("idx", (F.col("idx") / 32).cast("int").alias("batch"), both.alias("r")).select("idx", "batch", "r.*")


def multi_task_loss(spark, d):
    return A.task_loss(_persistence(spark, d), {"demand": 1.0, "supply": 0.5}).select(rounded(F.col("loss")).alias("loss"))


def raw_metrics(spark, d):
    out = A.raw_metrics(_persistence(spark, d))
    return out.select("task", "n", *[rounded(F.col(c)).alias(c) for c in ("mse", "rmse", "mae")])


_ATT_ALL = """
WITH nd AS (SELECT vec_id AS node, CAST(embedding[1] AS DOUBLE) AS q, CAST(embedding[2] AS DOUBLE) AS k, embedding AS e FROM embeddings),
sz AS (SELECT max(node) + 1 AS n FROM nd),
prs AS (SELECT l_partkey % n AS recv, l_suppkey % n AS send FROM lineitem, sz UNION SELECT node, node FROM nd),
sc AS (SELECT recv, send, CASE WHEN a.q + b.k > 0 THEN a.q + b.k ELSE 0.2 * (a.q + b.k) END AS s, b.e AS v FROM prs JOIN nd a ON a.node = recv JOIN nd b ON b.node = send),
w AS (SELECT recv, send, v, exp(s - max(s) OVER (PARTITION BY recv)) AS e FROM sc),
sm AS (SELECT recv, send, v, e / sum(e) OVER (PARTITION BY recv) AS weight FROM w),
dim AS (SELECT CAST(unnest(range(0, (SELECT max(len(e)) - 2 FROM nd))) AS INT) AS d)
"""
_ELU = "CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END"
_PERSIST = _SERIES + """,
per AS (SELECT b.zone, b.idx, h.demand AS hd, h.supply AS hs, x.demand AS xd, x.supply AS xs FROM wind b JOIN pos h ON h.zone = b.zone AND h.p = b.idx + 11
        JOIN pos x ON x.zone = b.zone AND x.p BETWEEN b.idx + 12 AND b.idx + 14),
err AS (SELECT 'demand' AS task, idx // 32 AS batch, CAST(hd - xd AS DOUBLE) AS e FROM per UNION ALL SELECT 'supply', idx // 32, CAST(hs - xs AS DOUBLE) FROM per)
"""


def _conv(w: list[float]) -> str:
    return f"({w[0]} * x4 + {w[1]} * x2 + {w[2]} * x0 + {w[3]})"


QUERIES = {f.__name__: f for f in (
    trip_filter, trip_duration, demand_by_slot_zone, dropoff_by_slot_zone, vacant_supply, node_features,
    od_pair_counts, od_adjacency, edge_list, edge_lengths, edge_speeds, line_graph, fixed_graph_self_loops, fixed_edge_features, induced_subgraph, zone_select_by_id, nation_od_counts,
    temporal_features, node_calendar_channels, calendar_split, split_windows, split_counts,
    norm_stats_counts, norm_stats_speed, normalize_counts, normalize_speed, denormalize_speed, denormalize_roundtrip, history_windows, target_windows,
    profile_floor, speed_profile_mean, perturbed_profile,
    segment_softmax_all, sparse_attention_all, gated_temporal_conv_lag, multi_task_loss, raw_metrics,
)}

ORACLE_SQL = {
    "trip_filter": _with_trips("all", 63) + "SELECT pickup_ts, orig, dest, distance FROM inz",
    "trip_duration": _with_trips("tens", 1000) + f"SELECT pickup_ts, orig, dest, {_r('minutes')} AS minutes FROM (SELECT *, (epoch_us(dropoff_ts) - epoch_us(pickup_ts)) / 6e7 AS minutes FROM raw) WHERE minutes > 1 AND minutes < 180",
    "demand_by_slot_zone": _with_trips() + "SELECT slot, orig AS zone, count(*) AS demand FROM trips GROUP BY ALL",
    "dropoff_by_slot_zone": _with_trips() + "SELECT slot, dest AS zone, count(*) AS dropoffs FROM trips GROUP BY ALL",
    "vacant_supply": _with_trips() + _SUPPLY + "SELECT slot, zone, demand, supply FROM supply",
    "node_features": _with_trips() + _SUPPLY + "SELECT slot, zone, 0 AS channel, demand AS value FROM supply UNION ALL SELECT slot, zone, 1, supply FROM supply",
    "od_pair_counts": _with_trips("mod20", GRAPH_ZONES, DAY) + "SELECT orig AS src, dest AS dst, count(*) AS n FROM trips GROUP BY ALL",
    "od_adjacency": _GRAPH + "SELECT src, dst, n FROM adj",
    "edge_list": _GRAPH + "SELECT edge_id, src, dst FROM edges",
    "edge_lengths": _GRAPH + f"SELECT edge_id, src, dst, {_r('length_km')} AS length_km FROM lens",
    "edge_speeds": _GRAPH + f"SELECT slot, edge_id, {_r('speed')} AS speed FROM speeds",
    "line_graph": _GRAPH + "SELECT a.edge_id AS recv, b.edge_id AS send FROM edges a JOIN edges b ON a.dst = b.src",
    "fixed_graph_self_loops": _GRAPH + _LOOPS + "SELECT recv, send FROM loops",
    "fixed_edge_features": _GRAPH + _LOOPS + f"SELECT recv, send, CASE WHEN length_km IS NULL THEN 0 ELSE 1 END AS has_road, {_r('coalesce(length_km, 0)')} AS length_km FROM loops LEFT JOIN lens ON src = recv AND dst = send",
    "induced_subgraph": _GRAPH + ", m AS (SELECT x AS f, CAST(row_number() OVER (ORDER BY x) - 1 AS INT) AS s FROM (SELECT CAST(unnest(range(0, 20)) AS INT) AS x) WHERE x % 3 <> 1) SELECT edge_id, CAST(row_number() OVER (ORDER BY edge_id) - 1 AS INT) AS sub_edge_id, a.s AS sub_src, b.s AS sub_dst FROM edges JOIN m a ON a.f = src JOIN m b ON b.f = dst",
    "zone_select_by_id": 'SELECT n_nationkey AS "index", n_name AS zone_name, CAST(n_nationkey + 1 AS BIGINT) AS locationid FROM nation WHERE n_nationkey + 1 <= 10',
    "nation_od_counts": "SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL HAVING count(*) > 5 AND c_nationkey <> s_nationkey",
    "temporal_features": "WITH " + _TIMES + "SELECT t, " + ", ".join(f"{_r(f'{w}(2 * pi() * {x})')} AS {n}_{w}" for n, x in (("month", "(month(date) - 1) / 12.0"), ("weekday", "dow / 7.0"), ("slot", "slot / (SELECT max(slot) + 1.0 FROM times)")) for w in ("sin", "cos")) + " FROM times",
    "node_calendar_channels": _with_trips() + _SUPPLY + "," + _TIMES + "SELECT t, zone, demand, supply, " + ", ".join(f"{_r(f'{w}(2 * pi() * {x})')} AS {n}_{w}" for n, x in (("month", "(month(date) - 1) / 12.0"), ("weekday", "dow / 7.0"), ("slot", "times.slot / (SELECT max(slot) + 1.0 FROM times)")) for w in ("sin", "cos")) + " FROM supply JOIN times ON supply.slot = t",
    "calendar_split": "WITH " + _TIMES + "SELECT t, date, split FROM labels",
    "split_windows": "WITH " + _TIMES + "SELECT CAST(idx AS INT) AS idx, split FROM wins",
    "split_counts": "WITH " + _TIMES + "SELECT split, count(*) AS n FROM wins GROUP BY split",
    "norm_stats_counts": _SERIES + f"SELECT {_r('dm')} AS demand_mean, {_r('ds')} AS demand_std, {_r('sm')} AS supply_mean, {_r('ss')} AS supply_std FROM stats",
    "norm_stats_speed": _SPEEDS + f"SELECT edge_id, {_r('mean')} AS mean, {_r('std')} AS std FROM sst",
    "normalize_counts": _SERIES + f"SELECT t, zone, {_r('(ln(1 + demand) - dm) / ds')} AS demand, {_r('(ln(1 + supply) - sm) / ss')} AS supply FROM series, stats",
    "normalize_speed": _SPEEDS + f"SELECT t, edge_id, {_r('(speed - mean) / std')} AS speed FROM sp JOIN sst USING (edge_id)",
    "denormalize_speed": _SPEEDS + f"SELECT t, edge_id, {_r('speed')} AS speed FROM sp JOIN sst USING (edge_id)",
    "denormalize_roundtrip": _SERIES + "SELECT t, zone, demand, supply FROM series",
    "history_windows": _SERIES + "SELECT b.zone, CAST(b.idx AS INT) AS idx, CAST(h.p - b.idx AS INT) AS step, h.t, h.demand, h.supply FROM wind b JOIN pos h ON h.zone = b.zone AND h.p BETWEEN b.idx AND b.idx + 11",
    "target_windows": _SERIES + "SELECT b.zone, CAST(b.idx AS INT) AS idx, CAST(h.p - b.idx - 12 AS INT) AS step, h.t, h.demand, h.supply FROM wind b JOIN pos h ON h.zone = b.zone AND h.p BETWEEN b.idx + 12 AND b.idx + 14",
    "profile_floor": _GRAPH + f"SELECT slot, edge_id, {_r('greatest(speed, 1.0)')} AS speed FROM speeds",
    "speed_profile_mean": _GRAPH + f"SELECT edge_id, {_r('avg(greatest(speed, 1.0))')} AS speed FROM speeds GROUP BY edge_id",
    "segment_softmax_all": _ATT_ALL + f"SELECT recv, send, {_r('weight')} AS weight FROM sm",
    "sparse_attention_all": _ATT_ALL + f"SELECT node, d, {_r(_ELU)} AS out FROM (SELECT node, d, coalesce(sum(weight * sm.v[d + 3]), 0) AS x FROM nd CROSS JOIN dim LEFT JOIN sm ON recv = node GROUP BY ALL)",
    "gated_temporal_conv_lag": _SERIES + f", xs AS (SELECT zone, t, ln(1 + demand) AS x0, coalesce(lag(ln(1 + demand), 2) OVER w, 0) AS x2, coalesce(lag(ln(1 + demand), 4) OVER w, 0) AS x4 FROM series WINDOW w AS (PARTITION BY zone ORDER BY t)), g AS (SELECT *, 1 / (1 + exp(-{_conv([0.4, 0.2, -0.6, 0.1])})) AS g FROM xs) SELECT zone, t, {_r(f'g * {_conv([0.2, -0.1, 0.5, 0.05])} + (1 - g) * {_conv([0.1, 0.3, -0.2, 0.0])}')} AS out FROM g",
    "multi_task_loss": _PERSIST + f", b AS (SELECT task, batch, avg(e * e) AS mse FROM err GROUP BY ALL), m AS (SELECT task, avg(mse) AS mse FROM b GROUP BY task) SELECT {_r('sum(mse * CASE WHEN task = $$demand$$ THEN 1.0 ELSE 0.5 END)')} AS loss FROM m",
    "raw_metrics": _PERSIST + f"SELECT task, count(*) AS n, {_r('sum(e * e) / count(*)')} AS mse, {_r('sqrt(sum(e * e) / count(*))')} AS rmse, {_r('sum(abs(e)) / count(*)')} AS mae FROM err GROUP BY task",
}
