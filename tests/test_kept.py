import os

import pytest

from zonecast.plans import catalog
from zonecast.sources import kept

SMALL = "/root/testdata/sf0.001"


def test_a_table_is_derived_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = kept.once(spark.range(40).mapInArrow(counted, "id long"), "rows")
    assert rows.alias("a").join(rows.alias("b"), "id").count() == 40 and rows.selectExpr("sum(id) s").first().s == 780
    assert seen.value == 40
    empty = kept.once(spark.range(0).selectExpr("id", "cast(null AS array<string>) AS x"), "empty")
    assert empty.count() == 0 and empty.dtypes == [("id", "bigint"), ("x", "array<string>")]


def test_without_a_shared_folder_nothing_is_written(spark, monkeypatch):
    monkeypatch.setattr(kept, "shared_folder", lambda spark: None)
    rows = spark.range(3)
    assert kept.once(rows, "rows") is rows


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
@pytest.mark.parametrize("name", ["vacant_supply", "edge_list", "edge_lengths", "edge_speeds", "normalize_counts", "normalize_speed", "denormalize_speed", "perturbed_profile"])
def test_plans_scan_the_events_twice_at_most(spark, monkeypatch, name):
    plans = []
    write = kept.once

    def noted(df, of):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, of)

    monkeypatch.setattr(catalog, "once", noted)
    out = catalog.QUERIES[name](spark, SMALL)
    plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert 1 <= sum(x.count("event_id#") > 0 for x in plans) <= 2
    own = {tuple(r) for r in out.collect()}
    monkeypatch.setattr(catalog, "once", lambda df, of: df)
    assert own == {tuple(r) for r in catalog.QUERIES[name](spark, SMALL).collect()}
