"""Bundles and routing graphs from tables and from arrays in files: contracts, orientation, and results against NumPy."""

import datetime as dt
import json

import numpy as np
import pytest

from zonecast.operators import attention, bundle, graph, noise, routing, series

T, N, E = 6, 3, 4
EDGES = [(0, 1), (1, 0), (1, 2), (2, 0)]


def tables(spark, speeds=None, demand=None, supply=None, nodes=N):
    r = np.random.default_rng(1)
    demand = r.integers(0, 9, (T, N)) if demand is None else demand
    supply = r.integers(0, 9, demand.shape) if supply is None else supply
    speeds = r.uniform(5, 90, (T, E)) if speeds is None else speeds
    grid = lambda x, names: spark.createDataFrame([(*i, float(v)) for i, v in np.ndenumerate(x)], ", ".join(f"{n} {k}" for n, k in zip(names, ("int", "int", "double"), strict=True)))
    edges = spark.createDataFrame([(i, *e) for i, e in enumerate(EDGES)], "edge_id int, src int, dst int")
    return spark.range(nodes).selectExpr("CAST(id AS int) AS node"), edges, grid(demand, ("t", "node", "demand")), grid(supply, ("t", "node", "supply")), grid(speeds, ("i", "j", "speed"))


def calendar(spark, steps):
    return spark.createDataFrame([(t, dt.date(2024, 1, 1 + t // 2), t % 2, t // 2) for t in range(steps)], "t int, date date, slot int, day_of_week int")


def test_either_orientation_and_first_steps(spark):
    speeds = np.random.default_rng(2).uniform(5, 90, (T, E))
    for given in (speeds, speeds.T):
        out = bundle.features(*tables(spark, given), steps=4)
        assert {(r.t, r.edge_id): r.speed for r in out["edge_speeds"].collect()} == {i: v for i, v in np.ndenumerate(speeds[:4])}
    square = np.arange(E * E, dtype=float).reshape(E, E)  # both fit: steps come first
    out = bundle.features(*tables(spark, square, np.ones((E, N))))
    assert {(r.t, r.edge_id): r.speed for r in out["edge_speeds"].collect()} == {i: v for i, v in np.ndenumerate(square)}


def test_calendar_channels_of_the_steps_that_are_kept(spark):
    out = bundle.features(*tables(spark), steps=3, times=calendar(spark, 9))["node_features"].collect()
    whole = bundle.features(*tables(spark), times=calendar(spark, 9))["node_features"].collect()
    assert len(out) == 3 * N and len(whole) == T * N
    one = {(r.t, r.node): r for r in out}
    assert abs(one[1, 0].slot_sin - np.sin(np.pi)) < 1e-9 and one[2, 1].weekday_sin == pytest.approx(np.sin(2 * np.pi / 7))


@pytest.mark.parametrize(
    ("changed", "said"),
    [
        ({"supply": np.ones((T, N + 1))}, "differ in shape"),
        ({"supply": np.ones((T - 1, N))}, "differ in shape"),
        ({"speeds": np.ones((T, E + 1))}, "number of edges"),
        ({"speeds": np.ones((T + 1, E))}, "differ in steps"),
        ({"speeds": np.ones((E, T + 2))}, "differ in steps"),
        ({"nodes": N + 1}, "number of nodes"),
    ],
)
def test_contracts_fail_in_the_plan(spark, changed, said):
    out = bundle.features(*tables(spark, **changed))
    for name in ("node_features", "edge_speeds"):
        with pytest.raises(Exception, match=said):
            out[name].collect()


def test_gaps_and_short_calendars(spark):
    nodes, edges, demand, supply, speeds = tables(spark)
    with pytest.raises(Exception, match="demand has gaps"):
        bundle.features(nodes, edges, demand.where("t <> 2 OR node <> 1"), supply, speeds)["node_features"].collect()
    with pytest.raises(Exception, match="too few steps"):
        bundle.features(*tables(spark), times=calendar(spark, 5))["node_features"].collect()
    assert bundle.features(*tables(spark), steps=5, times=calendar(spark, 5))["node_features"].count() == 5 * N


def arrays(folder, **changed):
    r = np.random.default_rng(3)
    adjacency = np.zeros((N, N), np.float32)
    for a, b in EDGES:
        adjacency[a, b] = 1
    found = {"adjacency_matrix": adjacency, "edge_index": np.array(EDGES, np.int32), "edge_lengths": r.uniform(1, 9, (N, N)).astype(np.float32), "edge_lengths_osrm": r.uniform(1, 9, (N, N)).astype(np.float32), "node_demand": r.integers(0, 9, (T, N)).astype(np.float32), "node_supply": r.integers(0, 9, (T, N)).astype(np.float32), "edge_speeds": r.uniform(0, 90, (T, E)).astype(np.float32)} | changed
    for name, x in found.items():
        if x is not None:
            np.save(f"{folder}/{name}.npy", x)
    return found


@pytest.mark.parametrize("index", [True, False])
def test_bundle_of_a_folder(spark, tmp_path, index):
    found = arrays(tmp_path, **({} if index else {"edge_index": None, "edge_lengths_osrm": None, "edge_speeds": np.random.default_rng(4).uniform(0, 90, (E, T)).astype(np.float32)}))
    out = bundle.load_features(spark, str(tmp_path), 5)
    rows = {(r.t, r.node): (r.demand, r.supply) for r in out["node_features"].collect()}
    assert rows == {(t, n): (found["node_demand"][t, n], found["node_supply"][t, n]) for t in range(5) for n in range(N)}
    speeds = found["edge_speeds"] if index else found["edge_speeds"].T
    assert {(r.t, r.edge_id): r.speed for r in out["edge_speeds"].collect()} == {(t, e): speeds[t, e] for t in range(5) for e in range(E)}
    lengths = found["edge_lengths_osrm"] if index else found["edge_lengths"]
    assert {(r.edge_id, r.src, r.dst): r.length_km for r in out["edges"].collect()} == {(i, *e): float(lengths[e]) for i, e in enumerate(EDGES)}


def test_contracts_of_a_folder_need_no_job(spark, tmp_path):
    for i, (changed, said) in enumerate([({"node_supply": np.ones((T, 2))}, "differ in shape"), ({"edge_speeds": np.ones((T, E + 1))}, "number of edges"), ({"edge_speeds": np.ones((T + 1, E))}, "differ in steps"), ({"edge_speeds": np.ones(E)}, "two dimensions"), ({"node_demand": np.ones((T, 2)), "node_supply": np.ones((T, 2))}, "number of nodes"), ({"adjacency_matrix": np.ones((2, 3))}, "not square")]):
        (tmp_path / str(i)).mkdir()
        arrays(tmp_path / str(i), **changed)
        with pytest.raises(ValueError, match=said):
            bundle.load_features(spark, str(tmp_path / str(i)))
    for i, gone in enumerate(({"adjacency_matrix": None}, {"edge_lengths": None, "edge_lengths_osrm": None}, {"node_demand": None})):
        (tmp_path / f"x{i}").mkdir()
        arrays(tmp_path / f"x{i}", **gone)
        with pytest.raises(FileNotFoundError):
            bundle.load_features(spark, str(tmp_path / f"x{i}"))


@pytest.mark.parametrize("averaged", [None, np.linspace(0, 50, E * 24).reshape(E, 24).astype(np.float32), np.linspace(0, 50, E * 7).reshape(7, E).astype(np.float32), np.linspace(0, 50, E).astype(np.float32)])
@pytest.mark.parametrize("most", [2, 0])
def test_routing_graph_of_a_folder(spark, tmp_path, averaged, most):
    found = arrays(tmp_path, **({} if averaged is None else {"edge_speeds_avg": averaged}))
    zones = spark.createDataFrame([(2, 1, "c"), (0, 2, "a"), (1, 9, "b")], "index int, locationid long, zone_name string")
    out = bundle.load_routing(spark, str(tmp_path), zones, lambda e, s: noise.uniform(spark, e, s), most=most)
    profile = found["edge_speeds"] if averaged is None else averaged
    profile = profile.reshape(E, 1) if profile.ndim == 1 else profile if profile.shape[0] == E else profile.T
    predicted = np.maximum(profile.astype(float), 1)
    real = predicted * np.random.RandomState(42).uniform(0.7, 1.3, predicted.shape)
    chosen = [0, 2] if most else [0, 1, 2]
    own = [i for i, (a, b) in enumerate(EDGES) if a in chosen and b in chosen]
    edges = {r.edge_id: r for r in out["edges"].collect()}
    assert [edges[i].sub_edge_id for i in own] == list(range(len(own))) and len(edges) == len(own)
    for i in own:
        r = edges[i]
        assert (r.sub_src, r.sub_dst) == tuple(chosen.index(x) for x in EDGES[i]) and np.allclose([r.predicted, r.real, r.length_km], [predicted[i].mean(), real[i].mean(), found["edge_lengths_osrm"][EDGES[i]]])
    got = {(r.sub_edge_id, r.slot): (r.predicted, r.real) for r in out["profile"].collect()}
    assert len(got) == len(own) * predicted.shape[1] and all(np.allclose(got[k, s], (predicted[i, s], real[i, s])) for k, i in enumerate(own) for s in range(predicted.shape[1]))
    assert [r["index"] for r in out["zones"].collect()] == chosen
    slots = out["slots"].first()
    assert (slots.slots, slots.minutes) == (predicted.shape[1], routing.slot_minutes(predicted.shape[1], averaged is not None))


def test_routing_needs_a_profile_and_zones(spark, tmp_path):
    arrays(tmp_path, edge_speeds=None)
    zones = spark.createDataFrame([(0, 99, "a")], "index int, locationid long, zone_name string")
    with pytest.raises(ValueError, match="profile"):
        bundle.load_routing(spark, str(tmp_path), zones, lambda e, s: noise.uniform(spark, e, s))
    arrays(tmp_path)
    with pytest.raises(ValueError, match="no zone"):
        bundle.load_routing(spark, str(tmp_path), zones, lambda e, s: noise.uniform(spark, e, s))


def test_speed_of_an_edge_by_step(spark):
    edges = spark.createDataFrame([(0, 0, 1, 2.5)], "edge_id int, src int, dst int, length_km double")
    fixed = graph.fixed_features(graph.with_loops(edges, spark.range(2).selectExpr("CAST(id AS int) AS node")), edges)
    speeds = spark.createDataFrame([(0, 0, 30.0), (1, 0, 40.0)], "t int, edge_id int, speed double")
    got = {(r.t, r.recv, r.send): (r.length_km, r.speed) for r in graph.features_by_step(fixed, edges, speeds, speeds.select("t").distinct()).collect()}
    assert got == {(t, a, b): (2.5, 30.0 + 10 * t) if (a, b) == (0, 1) else (0.0, 0.0) for t in range(2) for a, b in ((0, 1), (0, 0), (1, 1))}


def test_batches_do_not_depend_on_how_rows_are_dealt(spark):
    rows = spark.createDataFrame([(e, i) for e in range(3) for i in range(0, 100, 3)], "epoch int, idx int")
    one, two = ({(r.epoch, r.idx): (r.position, r.batch) for r in series.shuffled(x, 8).collect()} for x in (rows.repartition(7), rows.coalesce(1)))
    assert one == two and len(one) == 102
    for e in range(3):
        own = sorted((p, b) for (x, _), (p, b) in one.items() if x == e)
        assert own == [(p, p // 8) for p in range(34)]
    orders = [tuple(i for _, i in sorted((p, i) for (x, i), (p, _) in one.items() if x == e)) for e in range(3)]
    assert len(set(orders)) == 3 and orders[0] != tuple(sorted(orders[0]))


def test_errors_on_the_raw_scale_and_their_sink(spark, tmp_path):
    rows = spark.createDataFrame([("demand", None, 0.5, 1.0), ("supply", None, -1.0, 0.0), ("speed", 3, 1.0, 2.0), ("speed", 4, 0.0, -1.0)], "task string, edge_id int, pred double, target double")
    counts = spark.createDataFrame([(1.0, 2.0, 0.5, 1.5)], "demand_mean double, demand_std double, supply_mean double, supply_std double")
    speeds = spark.createDataFrame([(3, 30.0, 5.0), (4, 60.0, 1.0)], "edge_id int, mean double, std double")
    back = attention.raw_scale(rows, counts, speeds)
    got = {(r.task, r.edge_id): (r.pred, r.target) for r in back.collect()}
    assert np.allclose(got["demand", None], np.expm1([2.0, 3.0])) and np.allclose(got["supply", None], np.expm1([-1.0, 0.5])) and got["speed", 3] == (35.0, 40.0) and got["speed", 4] == (60.0, 59.0)
    loss = spark.createDataFrame([(0.25,)], "loss double")
    for _ in range(2):
        attention.write_metrics(loss, attention.raw_metrics(back), f"file://{tmp_path}/metrics")
    files = list((tmp_path / "metrics").glob("*.json"))
    said = json.loads(files[0].read_text())
    assert len(files) == 1 and said["normalized_loss"] == 0.25 and said["raw"]["speed"] == {"mse": 13.0, "rmse": 13**0.5, "mae": 3.0, "n": 2}


def test_statistics_read_with_their_rules(spark, tmp_path):
    series.write_stats(spark.createDataFrame([(0, 1.0, 1e-9), (1, 2.0, 3.0)], "edge_id int, mean double, std double"), f"file://{tmp_path}/s")
    assert {r.edge_id: r["std"] for r in series.read_stats(spark, f"file://{tmp_path}/s", "edge_id int, mean double, std double").collect()} == {0: 1.0, 1: 3.0}
    series.write_stats(spark.createDataFrame([], "edge_id int, mean double, std double"), f"file://{tmp_path}/e")
    assert series.read_stats(spark, f"file://{tmp_path}/e", "edge_id int, mean double, std double") is None


def test_a_hub_meets_in_no_one_task(spark):
    r = np.random.default_rng(6)
    n = 300
    nodes = spark.createDataFrame([(i, float(r.normal()), float(r.normal() * 50), [float(i), 1.0]) for i in range(n)], "node int, q double, k double, v array<double>")
    pairs = [(0, s) for s in range(n)] + [(int(a), int(b)) for a, b in r.integers(1, n - 1, (200, 2))]
    table = spark.createDataFrame(pairs, "recv int, send int").distinct()
    own = {x.node: x for x in nodes.collect()}
    scored = {p: (lambda s: s if s > 0 else 0.2 * s)(own[p[0]].q + own[p[1]].k) for p in set(pairs)}
    want = {}
    for node in {a for a, _ in scored}:
        mine = {b: s for (a, b), s in scored.items() if a == node}
        e = {b: np.exp(s - max(mine.values())) for b, s in mine.items()}
        want |= {(node, b): x / sum(e.values()) for b, x in e.items()}
    scores = spark.createDataFrame([(*p, float(s)) for p, s in scored.items()], "recv int, send int, score double")
    got = {(x.recv, x.send): x.weight for x in attention.segment_softmax(scores).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[p], want[p]) for p in want)
    alone = n - 1 if not any(a == n - 1 for a, _ in pairs) else None
    assert alone is not None
    sums = {(x.node, x.d): x.out for x in attention.dense_attention(nodes, table).collect()}
    assert np.isclose(sums[alone, 0], np.mean(range(n))) and np.isclose(sums[0, 0], sum(w * b for (a, b), w in want.items() if a == 0))
    assert {(x.node, x.d): x.out for x in attention.sparse_attention(nodes, table).collect()}[alone, 0] == 0
