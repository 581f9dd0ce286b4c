"""Trips to demand and vacant supply on a zone by slot grid. Nothing here starts a job."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import duration_minutes, micros

VACANT_AT_START = 5


def in_zones(trips: DataFrame, zones: int) -> DataFrame:
    """Both ends are zone numbers under zones."""
    return trips.where((F.col("orig") >= 0) & (F.col("orig") < zones) & (F.col("dest") >= 0) & (F.col("dest") < zones))


def timed(trips: DataFrame, low: float = 1, high: float = 180) -> DataFrame:
    """Trips of more than low and less than high minutes, with minutes; trips without a time drop out."""
    minutes = duration_minutes(F.col("pickup_ts"), F.col("dropoff_ts"))
    return trips.withColumn("minutes", minutes).where((F.col("minutes") > low) & (F.col("minutes") < high))


def slotted(trips: DataFrame, slot_minutes: int = 15) -> DataFrame:
    """trips with slot, counted from the first pick-up of these trips."""
    first = trips.agg(F.min(micros(F.col("pickup_ts"))).alias("first_us"))
    return trips.crossJoin(F.broadcast(first)).withColumn("slot", F.floor((micros(F.col("pickup_ts")) - F.col("first_us")) / (slot_minutes * 6e7)).cast("int")).drop("first_us")


def prepared(trips: DataFrame, zones: int, slot_minutes: int = 15) -> DataFrame:
    return slotted(timed(in_zones(trips, zones)), slot_minutes)


def counts(trips: DataFrame, end: str, name: str) -> DataFrame:
    """(slot, zone, name) for pick-ups (end orig) or drop-offs (end dest). Drop-offs count in the slot of their pick-up."""
    return trips.groupBy("slot", F.col(end).alias("zone")).agg(F.count(F.lit(1)).alias(name))


def grid(trips: DataFrame, zones: int) -> DataFrame:
    """(slot, zone): every slot up to the last, every zone. The axis comes from one row."""
    axis = trips.agg(F.max("slot").alias("last")).where("last IS NOT NULL").select(F.explode(F.sequence(F.lit(0), F.col("last"))).alias("slot"))
    return axis.select("slot", F.explode(F.sequence(F.lit(0), F.lit(zones - 1))).alias("zone"))


def demand_supply(trips: DataFrame, zones: int) -> DataFrame:
    """(slot, zone, demand, dropoffs, supply). supply: vacant taxis, never under 0, before the slot's trips.

    supply follows s = max(s + dropoffs - demand, 0) from slot to slot; that is the free running sum less its
    running minimum where that is under 0, so two window sums give it.
    """
    flows = trips.select("slot", F.explode(F.array(F.struct(F.col("orig").alias("zone"), F.lit(1).alias("p"), F.lit(0).alias("d")), F.struct(F.col("dest").alias("zone"), F.lit(0).alias("p"), F.lit(1).alias("d")))).alias("x"))
    sums = flows.groupBy("slot", "x.zone").agg(F.sum("x.p").alias("demand"), F.sum("x.d").alias("dropoffs"))
    full = grid(trips, zones).join(sums, ["slot", "zone"], "left").na.fill(0, ["demand", "dropoffs"])
    before = Window.partitionBy("zone").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("zone").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    free = full.withColumn("free", VACANT_AT_START + F.coalesce(F.sum(F.col("dropoffs") - F.col("demand")).over(before), F.lit(0)))
    return free.select("slot", "zone", "demand", "dropoffs", (F.col("free") - F.least(F.lit(0), F.min("free").over(upto))).alias("supply"))
