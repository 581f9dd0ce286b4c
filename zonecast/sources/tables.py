"""Readers of trips, zones, time metadata and arrays, and adapters from the star-schema tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.numbering import in_file_order

TRIPS = T.StructType([T.StructField("tpep_pickup_datetime", T.TimestampNTZType()), T.StructField("tpep_dropoff_datetime", T.TimestampNTZType()), T.StructField("PULocationID", T.IntegerType()), T.StructField("DOLocationID", T.IntegerType()), T.StructField("trip_distance", T.DoubleType())])


def trips_csv(spark: SparkSession, path: str) -> DataFrame:
    """(pickup_ts, dropoff_ts, orig, dest, distance) of a trip file; columns are found by their header."""
    raw = spark.read.csv(path, header=True, enforceSchema=False)
    wanted = [F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})") for f in TRIPS]
    return raw.select(*wanted).toDF("pickup_ts", "dropoff_ts", "orig", "dest", "distance")


def zones_csv(spark: SparkSession, path: str, lookup: DataFrame | None = None) -> DataFrame:
    """Zones with header names stripped and lower-cased. index is the row's place if absent.

    Where locationid is absent, it is that of lookup, whose index is the place of a row, from 0: (index, locationid), and
    zone and borough, which fill zone_name and borough if these are absent. Both must have as many rows.
    """
    raw = spark.read.csv(path, header=True)
    out = raw.toDF(*[c.strip().lower() for c in raw.columns])
    if "index" not in out.columns:
        out = in_file_order(out, "index")
    out = out.withColumn("index", F.col("index").cast("int"))
    if "locationid" in out.columns:
        return out.withColumn("locationid", F.col("locationid").cast("double").cast("long"))
    if lookup is None:
        raise ValueError("zones have no locationid: give a lookup of index and locationid")
    filled = {"locationid": F.col("locationid").cast("long")}
    filled |= {name: F.col(c) for name, c in (("zone_name", "zone"), ("borough", "borough")) if name not in out.columns and c in lookup.columns}
    given, known = out.count(), lookup.count()
    if given != known:
        raise ValueError(f"{given} zones, but a lookup of {known}")
    placed, by_place = in_file_order(out, "_place"), lookup.select(F.col("index").cast("long").alias("_place"), *[c.alias(n) for n, c in filled.items()])
    return placed.join(by_place, "_place").drop("_place")


def zones_of(spark: SparkSession, n: int) -> DataFrame:
    """The table of n zones where no file gives one: locationid = index + 1."""
    return spark.range(n).select(F.col("id").cast("int").alias("index"), (F.col("id") + 1).alias("locationid"))


def time_meta(df: DataFrame, steps: int) -> DataFrame:
    """(t, date, slot, day_of_week) of the first steps of time metadata with an explicit t; a date, slot or weekday that does not parse is an error."""
    day = F.expr("try_cast(day_of_week AS int)") if "day_of_week" in df.columns else F.weekday("date_")
    out = df.where(F.col("t") < steps).withColumn("date_", F.expr("try_cast(date AS date)")).withColumn("slot_", F.expr("try_cast(slot AS int)")).withColumn("day_", day)
    ok = lambda c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.concat(F.lit("time metadata does not parse at t = "), F.col("t"))))
    return out.select("t", ok("date_").alias("date"), ok("slot_").alias("slot"), ok("day_").alias("day_of_week"))


def array_rows(spark: SparkSession, array: np.ndarray, names: tuple[str, ...], value: str) -> DataFrame:
    """A small array as rows (one index column a dimension, value). For ingestion; keep what it returns as Parquet."""
    index = np.indices(array.shape).reshape(array.ndim, -1)
    frame = {n: index[i] for i, n in enumerate(names)} | {value: array.ravel().astype(float)}
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(frame))


def oriented(array: np.ndarray, edges: int, edge_axis: int) -> np.ndarray:
    """A profile or speed matrix with edges along edge_axis; that axis wins where both fit."""
    if array.ndim == 1 and len(array) == edges:
        array = array.reshape((edges, 1) if edge_axis == 0 else (1, edges))
    if array.ndim != 2:
        raise ValueError("one or two dimensions are expected")
    if array.shape[edge_axis] == edges:
        return array
    if array.shape[1 - edge_axis] == edges:
        return array.T
    raise ValueError(f"no dimension of {array.shape} is the number of edges, {edges}")


def zone_rule(k: Column, rule: str) -> Column:
    return {"tens": F.floor(k / 10), "mod20": k % 20, "all": k}[rule].cast("int")


def event_trips(events: DataFrame, rule: str = "tens") -> DataFrame:
    """Trips from events: each user's row to the next, ordered by time and id."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    zone = zone_rule(F.get_json_object("props", "$.k").cast("int"), rule)
    return events.select(F.col("ts").alias("pickup_ts"), F.lead("ts").over(by).alias("dropoff_ts"), zone.alias("orig"), F.lead(zone).over(by).alias("dest"), F.col("value").alias("distance"))


def event_times(events: DataFrame, minutes: int = 60) -> DataFrame:
    """(t, date, slot, day_of_week): a clock-aligned axis over all days of the events."""
    slots = 1440 // minutes
    days = events.agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b"))
    axis = days.select("a", F.explode(F.sequence(F.lit(0), (F.datediff("b", "a") + 1) * slots - 1)).alias("t"))
    date = F.expr(f"date_add(a, CAST(floor(t / {slots}) AS INT))")
    return axis.select("t", date.alias("date"), (F.col("t") % slots).alias("slot"), F.weekday(date).alias("day_of_week"))
