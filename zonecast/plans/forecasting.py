"""Queries of the forecaster's layers, bundles, routing graph, batches and evaluation, and the same in SQL.

Weights are fixed small numbers of a rule, so that both engines have the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import attention as A
from ..operators import bundle as B
from ..operators import graph as G
from ..operators import layers as L
from ..operators import noise as N
from ..operators import series as S
from ..operators import trips as T
from ..operators.numbering import numbered
from . import catalog as C

HEADS, WIDTH, INPUTS, BATCH, STEPS, ROUTED = 3, 4, 64, 32, 21, 12


def _w(rows: int, columns: int, seed: int) -> list[list[float]]:
    return [[((i * 7 + j * 5 + seed * 3) % 11 - 5) / 10 for j in range(columns)] for i in range(rows)]


def _b(size: int, seed: int) -> list[float]:
    return _w(1, size, seed)[0]


# ---- attention of several heads, over all embeddings ----

ATTENTION = L.Heads(WIDTH, _w(HEADS * WIDTH, INPUTS, 1), _w(HEADS * WIDTH, INPUTS, 2), _w(HEADS * WIDTH, INPUTS, 3), _w(HEADS, WIDTH, 4), _w(HEADS, WIDTH, 5))
OTHER = L.Heads(WIDTH, _w(HEADS * WIDTH, INPUTS, 6), _w(HEADS * WIDTH, INPUTS, 7), _w(HEADS * WIDTH, INPUTS, 8), _w(HEADS, WIDTH, 9), _w(HEADS, WIDTH, 10), concat=False)
STEPPED = L.Heads(2, _w(4, 2, 1), _w(4, 2, 2), _w(4, 2, 3), _w(2, 2, 4), _w(2, 2, 5), _w(4, 2, 6), _w(2, 2, 7), concat=False)
FUSION = [(_w(WIDTH, WIDTH, s), _b(WIDTH, s)) for s in (1, 2, 3)]


def _vectors(spark, d) -> DataFrame:
    return C._read(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").cast("array<double>").alias("x"))


def _pairs(spark, d, nodes: DataFrame, table: str, a: str, b: str) -> DataFrame:
    """(recv, send), each once: two keys of a table by place among the nodes."""
    size = nodes.agg(F.coalesce(F.max("node"), F.lit(0)) + 1).first()[0]
    return C._read(spark, d, table).select((F.col(a) % size).alias("recv"), (F.col(b) % size).alias("send")).distinct()


def _cells(rows: DataFrame, *keys: str) -> DataFrame:
    # the outer form: the other one filters by size first, below all projections, where layers would be computed anew for each use
    return rows.select(*keys, F.posexplode_outer("out").alias("d", "out")).withColumn("out", rounded(F.col("out")))


def multi_head_attention(spark, d):
    """All embeddings as nodes, (part, supplier) of all line items as edges: nodes that no edge reaches have zeros."""
    nodes = _vectors(spark, d)
    return _cells(L.attend(nodes, _pairs(spark, d, nodes, "lineitem", "l_suppkey", "l_partkey"), ATTENTION), "node")


def segment_softmax(spark, d):
    """Weights of all (customer, order) edges, by place among all embeddings."""
    nodes = _vectors(spark, d).select("node", F.col("x")[0].alias("q"), F.col("x")[1].alias("k"))
    pairs = _pairs(spark, d, nodes, "orders", "o_custkey", "o_orderkey")
    scored = pairs.join(nodes.select(F.col("node").alias("recv"), "q"), "recv").join(nodes.select(F.col("node").alias("send"), "k"), "send")
    out = A.segment_softmax(scored.select("recv", "send", A.leaky(F.col("q") + F.col("k")).alias("score")))
    return out.select("recv", "send", rounded(F.col("weight")).alias("weight"))


def _single(spark, d) -> DataFrame:
    return _vectors(spark, d).select("node", F.col("x")[0].alias("q"), F.col("x")[1].alias("k"), F.slice("x", 3, F.greatest(F.size("x") - 2, F.lit(0))).alias("v"))


def sparse_attention(spark, d):
    nodes = _single(spark, d)
    return A.sparse_attention(nodes, _pairs(spark, d, nodes, "orders", "o_custkey", "o_orderkey")).withColumn("out", rounded(F.col("out")))


def dense_attention(spark, d):
    """All embeddings, masked but for (supplier, part) of all line items: nodes that no edge reaches average all."""
    nodes = _single(spark, d)
    return A.dense_attention(nodes, _pairs(spark, d, nodes, "lineitem", "l_suppkey", "l_partkey")).withColumn("out", rounded(F.col("out")))


def attention_by_step(spark, d):
    """Attention at each day over the trip graph, with loops: an edge's length, and its speed of that day, are its features."""
    trips, edges = C._graph(spark, d)
    series = T.demand_supply(trips, C.GRAPH_ZONES)
    nodes = series.select(F.col("slot").alias("t"), F.col("zone").alias("node"), F.array(F.log1p(F.col("demand").cast("double")), F.log1p(F.col("supply").cast("double"))).alias("x"))
    fixed = G.fixed_features(G.with_loops(edges, C._nodes(spark)), G.trip_lengths(edges, trips))
    pairs = G.features_by_step(fixed, edges, G.trip_speeds(edges, trips, trips).withColumnRenamed("slot", "t"), nodes.select("t").distinct())
    return _cells(L.attend(nodes, pairs.select("t", "recv", "send", F.array("length_km", "speed").alias("e")), STEPPED, ("t",)), "t", "node")


def gated_fusion(spark, d):
    """Two node paths, over line items and over orders, weighed by a gate."""
    nodes = _vectors(spark, d)
    one = L.attend(nodes, _pairs(spark, d, nodes, "lineitem", "l_suppkey", "l_partkey"), OTHER).withColumnRenamed("out", "a")
    two = L.attend(nodes, _pairs(spark, d, nodes, "orders", "o_custkey", "o_orderkey"), OTHER).withColumnRenamed("out", "b")
    return _cells(L.fused(one.join(two, "node"), "a", "b", "out", *FUSION), "node")


def _convolution(inputs: int, outputs: int, dilation: int, seed: int) -> L.Convolution:
    m = [_w(outputs, inputs * 3, seed + i) for i in range(3)]
    return L.Convolution(3, dilation, *m, tuple(_b(outputs, seed + 3 + i) for i in range(3)))


STACK = L.Stack([_convolution(2, 4, 1, 1), _convolution(4, 3, 2, 11)], [[1.1, 0.9, 1.0, 1.2], [0.8, 1.0, 1.3]], [[0.1, 0.0, -0.1, 0.2], [0.0, 0.1, 0.05]], _w(3, 2, 8), _b(3, 9))


def gated_stack(spark, d):
    """The last step of two gated layers over the histories of all zones and starts."""
    w = S.history_and_target(C._series(spark, d), "zone", ["demand", "supply"])
    x = F.transform("history", lambda s: F.array(F.log1p(s["demand"].cast("double")), F.log1p(s["supply"].cast("double"))))
    return _cells(STACK(w.select("zone", "idx", x.alias("x")), "x", "out").select("zone", "idx", F.try_element_at("out", F.lit(-1)).alias("out")), "zone", "idx")


# ---- bundle, routing graph ----


def _bundle(spark, d) -> dict[str, DataFrame]:
    """Demand, supply and speeds of the trip graph by day; the speeds come by edge and step, as files may have them."""
    trips, edges = C._graph(spark, d)
    series = T.demand_supply(trips, C.GRAPH_ZONES).select(F.col("slot").alias("t"), F.col("zone").alias("node"), "demand", "supply")
    speeds = G.trip_speeds(edges, trips, trips).select(F.col("edge_id").alias("i"), F.col("slot").alias("j"), "speed")
    times = C._times(spark, d).where("slot = 0").select((F.col("t") / 24).cast("int").alias("t"), "date", "slot", "day_of_week")
    return B.features(C._nodes(spark), edges, series.select("t", "node", "demand"), series.select("t", "node", "supply"), speeds, STEPS, times)


def bundle_node_features(spark, d):
    out = _bundle(spark, d)["node_features"]
    return out.select("t", "node", "demand", "supply", *[rounded(F.col(c)).alias(c) for c in out.columns if c.endswith(("_sin", "_cos"))])


def bundle_edge_speeds(spark, d):
    return _bundle(spark, d)["edge_speeds"].select("t", "edge_id", rounded(F.col("speed")).alias("speed"))


def _routing(spark, d) -> dict[str, DataFrame]:
    trips, edges = C._graph(spark, d)
    profile = G.trip_speeds(edges, trips, trips)
    size = profile.agg((F.coalesce(F.max("edge_id"), F.lit(-1)) + 1).alias("e"), (F.coalesce(F.max("slot"), F.lit(-1)) + 1).alias("s")).first()
    zones = C._read(spark, d, "nation").select(F.col("n_nationkey").alias("index"), F.col("n_name").alias("zone_name"), (F.col("n_nationkey") + 1).cast("long").alias("locationid"))
    return B.routing_graph(G.trip_lengths(edges, trips), profile, None, zones, N.uniform(spark, size.e, size.s), ROUTED)


def routing_edges(spark, d):
    out = _routing(spark, d)["edges"]
    return out.select("edge_id", "sub_edge_id", "sub_src", "sub_dst", *[rounded(F.col(c)).alias(c) for c in ("length_km", "predicted", "real")])


def routing_profile(spark, d):
    return _routing(spark, d)["profile"].select("sub_edge_id", "slot", *[rounded(F.col(c)).alias(c) for c in ("predicted", "real")])


def routing_zones(spark, d):
    return _routing(spark, d)["zones"].select("sub_index", "index", "zone_name", "locationid")


def profile_slot_minutes(spark, d):
    """The number of slots of the profile and their minutes: a day's part if it came averaged and parts a day evenly, else 15."""
    return _routing(spark, d)["slots"]


# ---- batches, evaluation ----


def training_batches(spark, d):
    """Train windows in the shuffled order of two epochs, 32 a batch, the last one shorter."""
    windows = S.split_windows(C._times(spark, d)).where("split = 'train'").select("idx")
    return S.shuffled(windows.crossJoin(spark.range(2).select(F.col("id").cast("int").alias("epoch"))), BATCH)


def shuffled_batch_loss(spark, d):
    """The loss of the last value as forecast, as the mean over the shuffled batches of each epoch."""
    errors = C._persistence(spark, d).drop("batch")
    rows = errors.join(training_batches(spark, d), "idx").select("task", F.concat("epoch", F.lit("/"), "batch").alias("batch"), "epoch", "pred", "target")
    every = [A.task_loss(rows.where(F.col("epoch") == e), {"demand": 1.0, "supply": 0.5}).select(F.lit(e).alias("epoch"), rounded(F.col("loss")).alias("loss")) for e in range(2)]
    return every[0].union(every[1])


def _forecast(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forecasts of three tasks in normalized space, by day: nine tenths of the value before, plus 0.05; and the statistics."""
    trips, edges = C._graph(spark, d)
    days = C._times(spark, d).where("slot = 0").select((F.col("t") / 24).cast("int").alias("t"), "date")
    labels = S.split_labels(days).select("t", "split")
    series = T.demand_supply(trips, C.GRAPH_ZONES).select(F.col("slot").alias("t"), "zone", "demand", "supply").join(labels, "t")
    speeds = G.trip_speeds(edges, trips, trips).withColumnRenamed("slot", "t").join(labels, "t")
    counts, by_edge = S.count_stats(series), S.speed_stats(speeds)
    z, v = S.normalize_counts(series, counts), S.normalize_speed(speeds, by_edge)
    every = z.select(F.explode(F.array(*[F.struct(F.lit(x).alias("task"), F.col("zone").alias("key"), F.lit(None).cast("int").alias("edge_id"), F.col("t"), F.col(x).alias("target")) for x in ("demand", "supply")])).alias("r")).select("r.*")
    every = every.union(v.select(F.lit("speed"), "edge_id", "edge_id", "t", "speed"))
    return S.stepped(every, ["task", "key"]), counts, by_edge


def three_task_loss(spark, d):
    rows = _forecast(spark, d)[0].withColumn("batch", F.floor(F.col("t") / 8))
    return A.task_loss(rows, {"demand": 1.0, "supply": 0.5, "speed": 0.25}).select(rounded(F.col("loss")).alias("loss"))


def raw_metrics_three_tasks(spark, d):
    """Errors on the raw scale: forecasts and targets are both brought back from normalized space, by task and edge."""
    out = A.raw_metrics(A.raw_scale(*_forecast(spark, d)))
    return out.select("task", "n", *[rounded(F.col(c)).alias(c) for c in ("mse", "rmse", "mae")])


def denormalized_forecast(spark, d):
    """The forecasts themselves on the raw scale."""
    return A.raw_scale(*_forecast(spark, d)).select("task", "key", "t", rounded(F.col("pred")).alias("pred"), rounded(F.col("target")).alias("target"))


QUERIES = {f.__name__: f for f in (
    multi_head_attention, segment_softmax, sparse_attention, dense_attention, attention_by_step, gated_fusion, gated_stack,
    bundle_node_features, bundle_edge_speeds, routing_edges, routing_profile, routing_zones, profile_slot_minutes,
    training_batches, shuffled_batch_loss, three_task_loss, raw_metrics_three_tasks, denormalized_forecast,
)}


def _l(values: list) -> str:
    kind = "DOUBLE[][]" if isinstance(values[0], list) else "DOUBLE[]"
    return f"CAST({values} AS {kind})"


_VECTORS = "nd AS (SELECT vec_id AS node, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings), sz AS (SELECT max(node) + 1 AS n FROM nd)"
_LINES = "SELECT DISTINCT l_suppkey % n AS recv, l_partkey % n AS send FROM lineitem, sz"
_ORDERS = "SELECT DISTINCT o_custkey % n AS recv, o_orderkey % n AS send FROM orders, sz"
_SINGLE = """, sc AS (SELECT recv, send, CASE WHEN a.x[1] + b.x[2] > 0 THEN a.x[1] + b.x[2] ELSE 0.2 * (a.x[1] + b.x[2]) END AS s, b.x AS v FROM prs JOIN nd a ON a.node = recv JOIN nd b ON b.node = send),
w AS (SELECT recv, send, v, exp(s - max(s) OVER (PARTITION BY recv)) AS e FROM sc),
sm AS (SELECT recv, send, v, e / sum(e) OVER (PARTITION BY recv) AS weight FROM w),
dim AS (SELECT CAST(unnest(range(0, (SELECT max(len(x)) - 2 FROM nd))) AS INT) AS d)
"""


def _heads(name: str, nodes: str, pairs: str, heads: L.Heads, by: str = "") -> str:
    """CTEs of attention: <name>(by, node, d, x) before the last function. nodes: (by, node, x), pairs: (by, recv, send[, e])."""
    n, w, k = heads.number, heads.width, f"{by}, " if by else ""
    fold = lambda a, b: _l(heads.folded(a, b))
    same = lambda x: f"{x}.{by} = p.{by} AND " if by else ""
    edge = f" + list_dot_product({fold(heads.edge, heads.a_edge)}[h + 1], p.e)" if heads.edge else ""
    head, cells = ("h * " + str(w) + " + d", f"GROUP BY {k}recv, h, d") if heads.concat else ("d", f"GROUP BY {k}recv, d")
    return f"""{name}_n AS (SELECT {k}node, list_transform({fold(heads.query, heads.a_query)}, lambda r: list_dot_product(r, x)) AS q, list_transform({fold(heads.key, heads.a_key)}, lambda r: list_dot_product(r, x)) AS k,
  list_transform({_l(heads.value)}, lambda r: list_dot_product(r, x)) AS v FROM {nodes}),
{name}_s AS (SELECT {f"p.{by}, " if by else ""}recv, h, b.v, a.q[h + 1] + b.k[h + 1]{edge} AS s FROM {pairs} p JOIN {name}_n a ON {same("a")}a.node = recv JOIN {name}_n b ON {same("b")}b.node = send CROSS JOIN (SELECT CAST(unnest(range(0, {n})) AS INT) AS h)),
{name}_e AS (SELECT {k}recv, h, v, exp(s - max(s) OVER (PARTITION BY {k}recv, h)) AS e FROM (SELECT {k}recv, h, v, CASE WHEN s > 0 THEN s ELSE 0.2 * s END AS s FROM {name}_s)),
{name}_w AS (SELECT {k}recv, h, v, e / sum(e) OVER (PARTITION BY {k}recv, h) AS weight FROM {name}_e),
{name}_o AS (SELECT {k}recv, {head} AS d, sum(weight * v[h * {w} + d + 1]){"" if heads.concat else f" / {n}"} AS x FROM {name}_w CROSS JOIN (SELECT CAST(unnest(range(0, {w})) AS INT) AS d) {cells}),
{name} AS (SELECT {f"n.{by}, " if by else ""}n.node, c.d, CASE WHEN coalesce(o.x, 0) > 0 THEN o.x ELSE exp(coalesce(o.x, 0)) - 1 END AS x FROM {name}_n n CROSS JOIN (SELECT CAST(unnest(range(0, {n * w if heads.concat else w})) AS INT) AS d) c
  LEFT JOIN {name}_o o ON {f"o.{by} = n.{by} AND " if by else ""}o.recv = n.node AND o.d = c.d)"""


_DAYS = ", dl AS (SELECT CAST(t // 24 AS INT) AS t, date, dow, split FROM times JOIN labels USING (t, date) WHERE slot = 0)"
_DAILY = C._GRAPH + C._SUPPLY.replace("range(0, 10)", "range(0, 20)") + "," + C._TIMES + _DAYS
_CALENDAR = ", ".join(f"{C._r(f'{w}(2 * pi() * {x})')} AS {n}_{w}" for n, x in (("month", "(month(date) - 1) / 12.0"), ("weekday", "dow / 7.0"), ("slot", "0 / 1.0")) for w in ("sin", "cos"))
#: The legacy generator: its state from the seed, its words 227 at a time, and two tempered words a number.
_NOISE = """, RECURSIVE_
seeds(i, x) AS (SELECT 0, CAST(42 AS UBIGINT) UNION ALL SELECT i + 1, (1812433253 * xor(x, x >> 30) + i + 1) & 4294967295 FROM seeds WHERE i < 623),
words(n, s) AS (SELECT 624, (SELECT list(x ORDER BY i) FROM seeds) UNION ALL
  SELECT n + 227, list_concat(s, list_transform(range(1, 228), lambda k: xor(s[n - 624 + k + 397], xor(((s[n - 624 + k] & 2147483648) | (s[n - 623 + k] & 2147483647)) >> 1, (s[n - 623 + k] & 1) * 2567483615)))) FROM words WHERE n < 624 + 2 * (SELECT count(*) FROM speeds)),
raw AS (SELECT unnest(s) AS y, unnest(range(0, len(s))) - 624 AS i FROM (SELECT s FROM words ORDER BY n DESC LIMIT 1)),
t1 AS (SELECT i, xor(y, y >> 11) AS y FROM raw WHERE i >= 0), t2 AS (SELECT i, xor(y, (y << 7) & 2636928640) AS y FROM t1), t3 AS (SELECT i, xor(y, (y << 15) & 4022730752) AS y FROM t2), t4 AS (SELECT i, xor(y, y >> 18) AS y FROM t3),
noise AS (SELECT a.i // 2 AS place, 0.7 + (CAST(1.3 AS DOUBLE) - CAST(0.7 AS DOUBLE)) * ((CAST(a.y >> 5 AS DOUBLE) * 67108864 + CAST(b.y >> 6 AS DOUBLE)) / 9007199254740992) AS noise FROM t4 a JOIN t4 b ON b.i = a.i + 1 WHERE a.i % 2 = 0),
noisy AS (SELECT slot, edge_id, greatest(speed, 1.0) AS predicted, greatest(speed, 1.0) * noise AS real FROM speeds JOIN noise ON place = edge_id * (SELECT max(slot) + 1 FROM speeds) + slot)
""".replace("RECURSIVE_\n", "")
_NOISY = C._GRAPH.replace("WITH ", "WITH RECURSIVE ", 1).replace("raw AS (", "hops AS (", 1).replace("FROM raw", "FROM hops") + _NOISE.replace(", \n", ",\n", 1)
_ROUTED = _NOISY + f""", sel AS (SELECT n_nationkey AS "index", n_name AS zone_name, CAST(n_nationkey + 1 AS BIGINT) AS locationid, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS sub FROM nation WHERE n_nationkey + 1 <= {ROUTED}),
own AS (SELECT edge_id, CAST(row_number() OVER (ORDER BY edge_id) - 1 AS INT) AS sub_edge_id, a.sub AS sub_src, b.sub AS sub_dst, length_km FROM lens JOIN sel a ON a."index" = src JOIN sel b ON b."index" = dst)
"""
_BATCHES = f""", bt AS (SELECT epoch, idx, row_number() OVER (PARTITION BY epoch ORDER BY md5('0:' || epoch || ':' || idx), idx) - 1 AS position FROM wins CROSS JOIN (SELECT unnest([0, 1]) AS epoch) WHERE split = 'train'),
batches AS (SELECT CAST(epoch AS INT) AS epoch, CAST(idx AS INT) AS idx, position, CAST(position // {BATCH} AS BIGINT) AS batch FROM bt)
"""
_FORECAST = _DAILY + """, sr AS (SELECT s.slot AS t, zone, demand, supply, split FROM supply s JOIN dl ON s.slot = dl.t),
st AS (SELECT avg(ln(1 + demand)) AS dm, greatest(stddev_pop(ln(1 + demand)), 1e-6) AS ds, avg(ln(1 + supply)) AS sm, greatest(stddev_pop(ln(1 + supply)), 1e-6) AS ss FROM sr WHERE split = 'train'),
spd AS (SELECT s.slot AS t, edge_id, speed, split FROM speeds s JOIN dl ON s.slot = dl.t),
sst AS (SELECT edge_id, avg(speed) AS mean, CASE WHEN stddev_pop(speed) < 1e-6 THEN 1.0 ELSE stddev_pop(speed) END AS std FROM spd WHERE split = 'train' GROUP BY edge_id),
z AS (SELECT 'demand' AS task, zone AS key, t, (ln(1 + demand) - dm) / ds AS z, dm AS m, ds AS s FROM sr, st UNION ALL SELECT 'supply', zone, t, (ln(1 + supply) - sm) / ss, sm, ss FROM sr, st
  UNION ALL SELECT 'speed', edge_id, t, (speed - mean) / std, mean, std FROM spd JOIN sst USING (edge_id)),
fc AS (SELECT a.task, a.key, a.t, 0.9 * b.z + 0.05 AS pred, a.z AS target, a.m, a.s FROM z a JOIN z b ON b.task = a.task AND b.key = a.key AND b.t = a.t - 1),
rw AS (SELECT task, key, t, CASE task WHEN 'speed' THEN pred * s + m ELSE exp(pred * s + m) - 1 END AS pred, CASE task WHEN 'speed' THEN target * s + m ELSE exp(target * s + m) - 1 END AS target FROM fc)
"""


def _layer(name: str, source: str, column: str, layer: L.Convolution, gain: list[float], shift: list[float], outputs: int) -> str:
    """CTEs of one gated layer with normalization: <name>(zone, idx, x, y), y by time step."""
    d, taps = layer.dilation, ", ".join(f"p[i + {s * layer.dilation}][{c + 1}]" for c in range(layer.inputs) for s in range(layer.steps))
    at = lambda w, b: f"(list_dot_product({_l(w)}[o], v) + {_l(b)}[o])"
    gate = f"(1 / (1 + exp(-{at(layer.gate, layer.biases[2])})))"
    return f"""{name}_t AS (SELECT zone, idx, x, list_transform(range(1, 13), lambda i: [{taps}]) AS taps FROM (SELECT *, list_concat(CAST({[[0.0] * layer.inputs] * (2 * d)} AS DOUBLE[][]), {column}) AS p FROM {source})),
{name}_g AS (SELECT zone, idx, x, list_transform(taps, lambda v: list_transform(range(1, {outputs + 1}), lambda o: {gate} * {at(layer.first, layer.biases[0])} + (1 - {gate}) * {at(layer.second, layer.biases[1])})) AS g FROM {name}_t),
{name} AS (SELECT zone, idx, x, list_transform(g, lambda v: list_transform(range(1, {outputs + 1}), lambda o: greatest((v[o] - list_avg(v)) / sqrt(list_var_pop(v) + 1e-5) * {_l(gain)}[o] + {_l(shift)}[o], 0))) AS y FROM {name}_g)"""


_STACKED = C._SERIES + f""",
hist AS (SELECT b.zone, b.idx, list([ln(1 + h.demand), ln(1 + h.supply)] ORDER BY h.p) AS x FROM wind b JOIN pos h ON h.zone = b.zone AND h.p BETWEEN b.idx AND b.idx + 11 GROUP BY ALL),
{_layer("one", "hist", "x", STACK.layers[0], STACK.gains[0], STACK.shifts[0], 4)},
{_layer("two", "one", "y", STACK.layers[1], STACK.gains[1], STACK.shifts[1], 3)}
"""
_FUSE = lambda i, v: f"(list_dot_product({_l(FUSION[i][0])}[d + 1], {v}) + {_l(FUSION[i][1])}[d + 1])"

ORACLE_SQL = {
    "multi_head_attention": f"WITH {_VECTORS}, prs AS ({_LINES}), {_heads('mh', 'nd', 'prs', ATTENTION)} SELECT node, CAST(d AS INT) AS d, {C._r('x')} AS out FROM mh",
    "segment_softmax": f"WITH {_VECTORS}, prs AS ({_ORDERS}){_SINGLE} SELECT recv, send, {C._r('weight')} AS weight FROM sm",
    "sparse_attention": f"WITH {_VECTORS}, prs AS ({_ORDERS}){_SINGLE} SELECT node, d, {C._r(C._ELU)} AS out FROM (SELECT node, d, coalesce(sum(weight * sm.v[d + 3]), 0) AS x FROM nd CROSS JOIN dim LEFT JOIN sm ON recv = node GROUP BY ALL)",
    "dense_attention": f"WITH {_VECTORS}, prs AS ({_LINES}){_SINGLE}, dn AS (SELECT a.node AS recv, b.node AS send, coalesce(sc.s, -1e9) AS s FROM nd a CROSS JOIN nd b LEFT JOIN sc ON sc.recv = a.node AND sc.send = b.node), dw AS (SELECT *, exp(s - max(s) OVER (PARTITION BY recv)) AS e FROM dn), ds AS (SELECT recv, send, e / sum(e) OVER (PARTITION BY recv) AS weight FROM dw) SELECT node, d, {C._r(C._ELU)} AS out FROM (SELECT recv AS node, d, sum(weight * nd.x[d + 3]) AS x FROM ds JOIN nd ON nd.node = send CROSS JOIN dim WHERE weight > 0 GROUP BY ALL)",
    "attention_by_step": f"{_DAILY}{C._LOOPS}, nt AS (SELECT slot AS t, zone AS node, [ln(1 + demand), ln(1 + supply)] AS x FROM supply), pt AS (SELECT t, recv, send, [coalesce(length_km, 0), coalesce(speed, 0)] AS e FROM loops CROSS JOIN (SELECT DISTINCT t FROM nt) LEFT JOIN lens ON src = recv AND dst = send LEFT JOIN speeds s ON s.edge_id = lens.edge_id AND s.slot = t), {_heads('mh', 'nt', 'pt', STEPPED, 't')} SELECT t, node, CAST(d AS INT) AS d, {C._r('x')} AS out FROM mh",
    "gated_fusion": f"WITH {_VECTORS}, pa AS ({_LINES}), pb AS ({_ORDERS}), {_heads('ma', 'nd', 'pa', OTHER)}, {_heads('mb', 'nd', 'pb', OTHER)}, va AS (SELECT node, list(x ORDER BY d) AS a FROM ma GROUP BY node), vb AS (SELECT node, list(x ORDER BY d) AS b FROM mb GROUP BY node), f AS (SELECT node, CAST(unnest(range(0, {WIDTH})) AS INT) AS d, a, b, list_transform(list_zip(a, b), lambda p: p[1] + p[2]) AS c FROM va JOIN vb USING (node)), g AS (SELECT *, 1 / (1 + exp(-{_FUSE(0, 'c')})) AS g FROM f) SELECT node, d, {C._r(f'tanh(g * {_FUSE(1, chr(97))} + (1 - g) * {_FUSE(2, chr(98))})')} AS out FROM g",
    "gated_stack": f"{_STACKED} SELECT zone, CAST(idx AS INT) AS idx, CAST(d AS INT) AS d, {C._r(f'y[12][d + 1] + list_dot_product({_l(STACK.skip)}[d + 1], x[12]) + {_l(STACK.skip_bias)}[d + 1]')} AS out FROM two CROSS JOIN (SELECT unnest(range(0, 3)) AS d)",
    "bundle_node_features": f"{_DAILY} SELECT s.slot AS t, zone AS node, demand, supply, {_CALENDAR} FROM supply s JOIN dl ON s.slot = dl.t WHERE s.slot < {STEPS}",
    "bundle_edge_speeds": f"{C._GRAPH} SELECT slot AS t, edge_id, {C._r('speed')} AS speed FROM speeds WHERE slot < {STEPS}",
    "routing_edges": f"{_ROUTED} SELECT edge_id, sub_edge_id, sub_src, sub_dst, {C._r('any_value(length_km)')} AS length_km, {C._r('avg(predicted)')} AS predicted, {C._r('avg(real)')} AS real FROM own LEFT JOIN noisy USING (edge_id) GROUP BY edge_id, sub_edge_id, sub_src, sub_dst",
    "routing_profile": f"{_ROUTED} SELECT sub_edge_id, slot, {C._r('predicted')} AS predicted, {C._r('real')} AS real FROM own JOIN noisy USING (edge_id)",
    "routing_zones": f'SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INT) AS sub_index, n_nationkey AS "index", n_name AS zone_name, CAST(n_nationkey + 1 AS BIGINT) AS locationid FROM nation WHERE n_nationkey + 1 <= {ROUTED}',
    "profile_slot_minutes": f"{C._GRAPH} SELECT n AS slots, CAST(CASE WHEN n > 0 AND 1440 % n = 0 THEN 1440 // n ELSE 15 END AS INT) AS minutes FROM (SELECT coalesce(max(slot), -1) + 1 AS n FROM speeds)",
    "perturbed_profile": f"{_NOISY} SELECT edge_id, slot, real AS speed FROM noisy",
    "training_batches": f"WITH {C._TIMES}{_BATCHES} SELECT epoch, idx, position, batch FROM batches",
    "shuffled_batch_loss": f"{C._PERSIST}{_BATCHES}, tw AS (SELECT 'demand' AS task, idx, CAST(hd - xd AS DOUBLE) AS e FROM per UNION ALL SELECT 'supply', idx, CAST(hs - xs AS DOUBLE) FROM per), bm AS (SELECT epoch, task, batch, avg(e * e) AS mse FROM tw JOIN batches USING (idx) GROUP BY ALL), em AS (SELECT epoch, task, avg(mse) AS mse FROM bm GROUP BY ALL) SELECT epoch, {C._r('sum(mse * CASE WHEN task = $$demand$$ THEN 1.0 ELSE 0.5 END)')} AS loss FROM em GROUP BY epoch",
    "three_task_loss": f"{_FORECAST}, b AS (SELECT task, t // 8 AS batch, avg((pred - target) ** 2) AS mse FROM fc GROUP BY ALL), m AS (SELECT task, avg(mse) AS mse FROM b GROUP BY task) SELECT {C._r('sum(mse * CASE task WHEN $$demand$$ THEN 1.0 WHEN $$supply$$ THEN 0.5 ELSE 0.25 END)')} AS loss FROM m",
    "raw_metrics_three_tasks": f"{_FORECAST} SELECT task, count(*) AS n, {C._r('sum((pred - target) ** 2) / count(*)')} AS mse, {C._r('sqrt(sum((pred - target) ** 2) / count(*))')} AS rmse, {C._r('sum(abs(pred - target)) / count(*)')} AS mae FROM rw GROUP BY task",
    "denormalized_forecast": f"{_FORECAST} SELECT task, key, t, {C._r('pred')} AS pred, {C._r('target')} AS target FROM rw",
}
