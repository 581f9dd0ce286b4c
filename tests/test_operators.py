"""Hand-made fixtures for the traps of each operator, recomputed without Spark."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from zonecast.functions import scalars
from zonecast.operators import attention, graph, routing, series, trips
from zonecast.sources import tables

START = dt.datetime(2024, 1, 1)


def make_trips(spark, rows):
    """rows: (start minute, minutes, orig, dest, distance)"""
    data = [(START + dt.timedelta(minutes=a), None if m is None else START + dt.timedelta(minutes=a + m), o, d, x) for a, m, o, d, x in rows]
    return spark.createDataFrame(data, "pickup_ts timestamp_ntz, dropoff_ts timestamp_ntz, orig int, dest int, distance double")


def test_strict_bounds_and_missing_times(spark):
    t = make_trips(spark, [(0, 1, 0, 1, 1.0), (0, 180, 0, 1, 1.0), (0, 1.5, 0, 1, 1.0), (0, None, 0, 1, 1.0), (0, 9, 5, 1, 1.0), (0, 9, -1, 1, 1.0)])
    assert [r.minutes for r in trips.timed(trips.in_zones(t, 5)).collect()] == [1.5]


def walk(nets):
    s, out = 5, []
    for x in nets:
        out.append(s)
        s = max(s + x, 0)
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-6, 6), min_size=2, max_size=12))
def test_supply_is_the_clamped_walk(spark, nets):
    rows = []
    for i, x in enumerate(nets):
        rows += [(i * 15 + 1, 5, 0 if x < 0 else 1, 1 if x < 0 else 0, 1.0)] * abs(x)
    rows += [(0, 5, 2, 2, 1.0), (len(nets) * 15 - 15, 5, 2, 2, 1.0)]
    got = trips.demand_supply(trips.prepared(make_trips(spark, rows), 3), 3).where("zone = 0").orderBy("slot").collect()
    assert [r.supply for r in got] == walk(nets)


def test_line_graph_counts_turning_back(spark):
    edges = spark.createDataFrame([(0, 0, 1), (1, 1, 0), (2, 1, 2), (3, 2, 0)], "edge_id int, src int, dst int")
    assert {tuple(r) for r in graph.line_graph(edges).collect()} == {(0, 1), (0, 2), (1, 0), (2, 3), (3, 0)}


def test_pairs_need_more_than_five_trips(spark):
    t = trips.prepared(make_trips(spark, [(0, 5, 0, 1, 1.0)] * 5 + [(0, 5, 1, 2, None)] * 6 + [(0, 5, 3, 3, 1.0)] * 9), 5)
    edges = graph.edge_list(graph.adjacency(t))
    assert [(r.src, r.dst) for r in edges.collect()] == [(1, 2)]
    assert graph.trip_lengths(edges, t).first().length_km is None  # trips without a distance are not a default


def test_windows_do_not_mix_target_labels(spark):
    rows = [(i, (START + dt.timedelta(hours=i)).date(), i % 24, 0) for i in range(24 * 33)]
    times = spark.createDataFrame(rows, "t int, date date, slot int, day_of_week int")
    label = lambda i: "train" if rows[i][1].day <= 20 else "val" if rows[i][1].day <= 24 else "test"
    want = {(i, label(i + 12)) for i in range(len(rows) - 14) if len({label(i + 12 + k) for k in range(3)}) == 1}
    assert {tuple(r) for r in series.split_windows(times).collect()} == want


def test_deviation_rules_and_inverse(spark):
    rows = spark.createDataFrame([(0, 0, 4, 4, "train"), (1, 0, 4, 0, "train"), (2, 0, 9, 1, "test")], "t int, zone int, demand int, supply int, split string")
    stats = series.count_stats(rows)
    assert stats.first().demand_std == 1e-6
    back = series.denormalize_counts(series.normalize_counts(rows, stats), stats).orderBy("t").collect()
    assert np.allclose([(r.demand, r.supply) for r in back], [(4, 4), (4, 0), (9, 1)])
    speeds = spark.createDataFrame([(0, 7, 30.0, "train"), (1, 7, 30.0, "train")], "t int, edge_id int, speed double, split string")
    assert series.speed_stats(speeds).first()["std"] == 1.0
    assert series.normalize_counts(rows, None) is rows
    with pytest.raises(Exception, match="negative"):
        series.count_stats(rows.selectExpr("t", "zone", "-demand AS demand", "supply", "split")).collect()


def test_attention_shuffles_vectors_by_node_not_by_pair(spark):
    rng, n, width = np.random.default_rng(5), 240, 62
    q, k, v = rng.normal(0, 2, n), rng.normal(0, 2, n), rng.normal(0, 1, (n, width))
    v[7, 1:] = 0.0
    nodes = spark.createDataFrame([(i, float(q[i]), float(k[i]), v[i, : 1 if i == 7 else width].tolist()) for i in range(n)] + [(None, 1.0, 1.0, [1.0]), (n, None, None, None)], "node int, q double, k double, v array<double>").localCheckpoint()
    pairs = spark.range(n * n).selectExpr(f"id div {n} AS recv", f"id % {n} AS send").where("recv != 3").union(spark.createDataFrame([(None, 1), (1, None), (1, n), (n, 1), (1, n + 5)], "recv long, send long")).localCheckpoint()
    out = attention.sparse_attention(nodes, pairs, width)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "CoGroup" in plan  # nodes come to pairs by cells, so that no row of a pair has a vector
    got = {(r.node, r.d): r.out for r in out.collect()}
    score = q[:, None] + k[None]
    grown = np.exp(np.where(score > 0, score, 0.2 * score))
    want = grown @ v / grown.sum(axis=1, keepdims=True)
    want[3] = 0
    assert np.allclose([[got[i, d] for d in range(width)] for i in range(n)], np.where(want > 0, want, np.expm1(want)), rtol=1e-9, atol=1e-12)
    assert {got[n, d] for d in range(width)} == {0.0}


def test_isolated_node_is_zero_in_sparse_and_mean_in_dense_attention(spark):
    nodes = spark.createDataFrame([(i, 0.1 * i, 0.2, [float(i), 1.0]) for i in range(3)], "node int, q double, k double, v array<double>")
    pairs = spark.createDataFrame([(0, 1), (0, 0)], "recv int, send int")
    sparse = {(r.node, r.d): r.out for r in attention.sparse_attention(nodes, pairs).collect()}
    dense = {(r.node, r.d): r.out for r in attention.dense_attention(nodes, pairs).collect()}
    assert sparse[(2, 0)] == 0 and np.isclose(dense[(2, 0)], 1.0) and np.isclose(sparse[(0, 0)], 0.5) and np.isclose(dense[(0, 0)], 0.5)


def test_clips_keep_nan_and_null(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(float("nan"),), (None,), (1.0,), (999.0,)], "x double").select(scalars.clip(F.col("x"), 5, 130)).collect()
    assert np.isnan(rows[0][0]) and rows[1][0] is None and [rows[2][0], rows[3][0]] == [5, 130]


def test_loss_is_the_mean_of_batch_means_and_metrics_are_not(spark):
    rows = spark.createDataFrame([("d", 0, 1.0, 0.0), ("d", 0, 1.0, 0.0), ("d", 0, 1.0, 0.0), ("d", 1, 3.0, 0.0)], "task string, batch int, pred double, target double")
    assert attention.task_loss(rows, {"d": 1.0}).first().loss == 5.0 and attention.raw_metrics(rows).first().mse == 3.0


def test_readers_and_orientation(spark, tmp_path):
    (tmp_path / "z.csv").write_text("﻿Index , zone_name,BOROUGH,LocationID\n0,A,Q,1\n1,B,Q,\n", encoding="utf-8")
    zones = tables.zones_csv(spark, f"file://{tmp_path}/z.csv")
    assert zones.columns == ["index", "zone_name", "borough", "locationid"] and graph.select_zones(zones, 5).count() == 1
    square = np.arange(4).reshape(2, 2)
    assert (tables.oriented(square, 2, 0) == square).all() and tables.oriented(np.zeros((3, 2)), 3, 1).shape == (2, 3)
    with pytest.raises(ValueError):
        tables.oriented(np.zeros((3, 2)), 5, 0)
    bad = spark.createDataFrame([(0, "2024-01-01", "3"), (1, "never", "4")], "t int, date string, slot string")
    assert tables.time_meta(bad, 1).first().day_of_week == 0
    with pytest.raises(Exception, match="parse"):
        tables.time_meta(bad, 2).collect()


def test_zones_are_filled_by_place(spark, tmp_path):
    (tmp_path / "z.csv").write_text("index,borough\n7,Q\n3,R\n5,S\n")
    shapes = spark.createDataFrame([(1, 20, "B", "x"), (0, 10, "A", "x"), (2, None, "C", "x")], "index int, locationid int, zone string, borough string")
    got = tables.zones_csv(spark, f"file://{tmp_path}/z.csv", shapes).orderBy("locationid")
    assert sorted(got.columns) == ["borough", "index", "locationid", "zone_name"]
    assert {(r["index"], r.borough, r.locationid, r.zone_name) for r in got.collect()} == {(7, "Q", 10, "A"), (3, "R", 20, "B"), (5, "S", None, "C")}
    with pytest.raises(ValueError, match="lookup of 2"):
        tables.zones_csv(spark, f"file://{tmp_path}/z.csv", shapes.limit(2))


def test_noise_is_the_legacy_generators(spark):
    profile = spark.createDataFrame([(e, s, 2.0) for e in range(2) for s in range(3)], "edge_id int, slot int, speed double")
    got = {(r.edge_id, r.slot): r.speed for r in routing.perturbed(profile, 2, 3).collect()}
    want = 2 * np.random.RandomState(42).uniform(0.7, 1.3, (2, 3))
    assert all(np.isclose(got[k], want[k]) for k in np.ndindex(2, 3)) and routing.slot_minutes(24, True) == 60


def test_whole_attention_reads_every_node_and_edge(spark, tmp_path):
    from zonecast.plans import catalog

    r = np.random.default_rng(4)
    e = r.normal(size=(30, 5)).astype(np.float32)
    spark.createDataFrame([(i, e[i].tolist()) for i in range(30)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    edges = [(int(a), int(b)) for a, b in r.integers(0, 24, (60, 2))]  # the last nodes have no neighbours
    spark.createDataFrame(edges, "l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    pairs = {*edges, *((i, i) for i in range(30))}
    weights = {}
    for i in range(30):
        own = {b: float(e[i, 0]) + float(e[b, 1]) for a, b in pairs if a == i}
        grown = {b: np.exp(x if x > 0 else 0.2 * x) for b, x in own.items()}
        weights |= {(i, b): x / sum(grown.values()) for b, x in grown.items()}
    got = {(x.recv, x.send): x.weight for x in catalog.segment_softmax_all(spark, str(tmp_path)).collect()}
    assert got.keys() == weights.keys() and all(abs(got[x] - weights[x]) < 1e-4 for x in got)
    out = {(x.node, x.d): x.out for x in catalog.sparse_attention_all(spark, str(tmp_path)).collect()}
    sums = {(i, d): sum(w * float(e[b, d + 2]) for (a, b), w in weights.items() if a == i) for i in range(30) for d in range(3)}
    assert out.keys() == sums.keys() and all(abs(out[x] - (s if s > 0 else np.expm1(s))) < 1e-4 for x, s in sums.items())


def test_lengths_fall_back_and_empty_selections_fail(spark):
    edges = spark.createDataFrame([(0, 1, 2), (1, 2, 1)], "edge_id int, src int, dst int")
    roads = spark.createDataFrame([(1, 2, 3.5)], "src int, dst int, length_km double")
    assert [r.length_km for r in graph.lengths(edges, None, roads).orderBy("edge_id").collect()] == [3.5, 0.0]
    with pytest.raises(ValueError):
        graph.lengths(edges, None)
    zones = tables.zones_of(spark, 3)
    assert graph.checked(graph.select_zones(zones, 2)).count() == 2
    with pytest.raises(ValueError):
        graph.checked(graph.select_zones(zones.where("index > 5"), 2))


def test_statistics_survive_a_file(spark, tmp_path):
    stats = spark.createDataFrame([(0, 1.25, 0.1), (1, float(2**0.5), 1.0)], "edge_id int, mean double, std double")
    series.write_stats(stats, f"file://{tmp_path}/stats")
    assert sorted(series.read_stats(spark, f"file://{tmp_path}/stats", "edge_id int, mean double, std double").collect()) == sorted(stats.collect())


def test_calendar_channels_join_by_step(spark):
    times = spark.createDataFrame([(t, dt.date(2024, 1, 1 + t // 2), t % 2, t // 2) for t in range(4)], "t int, date date, slot int, day_of_week int")
    rows = spark.createDataFrame([(t, z, 10 * t + z) for t in range(4) for z in range(2)], "t int, zone int, demand int")
    got = {(r.t, r.zone): r for r in series.with_calendar(rows, times).collect()}
    assert len(got) == 8 and all(r.demand == 10 * t + z for (t, z), r in got.items())
    assert abs(got[3, 0].slot_cos - np.cos(np.pi)) < 1e-12 and abs(got[2, 1].weekday_sin - np.sin(2 * np.pi / 7)) < 1e-12
