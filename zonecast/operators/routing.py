"""Speed profiles (edge_id, slot, speed) for routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import at_least
from .noise import uniform


def floored(profile: DataFrame, low: float = 1.0) -> DataFrame:
    return profile.withColumn("speed", at_least(F.col("speed"), low))


def edge_means(profile: DataFrame) -> DataFrame:
    return profile.groupBy("edge_id").agg(F.avg("speed").alias("speed"))


def slot_minutes(slots: int, averaged: bool) -> int:
    """The slot length in minutes: a day over an averaged profile's slots if whole, else 15."""
    return 1440 // slots if averaged and slots and 1440 % slots == 0 else 15


def slot_length(slots: Column, averaged: bool) -> Column:
    """slot_minutes() of a column."""
    return F.when(F.lit(averaged) & (slots > 0) & (F.try_mod(F.lit(1440), slots) == 0), F.floor(1440 / slots)).otherwise(15).cast("int")


def perturbed(profile: DataFrame, edges: int, slots: int, seed: int = 42, low: float = 0.7, high: float = 1.3) -> DataFrame:
    """profile times uniform noise of one seeded legacy generator over all edges and slots in order, drawn in tasks."""
    noise = uniform(profile.sparkSession, edges, slots, seed=seed, low=low, high=high)
    return profile.join(noise, ["edge_id", "slot"]).select("edge_id", "slot", (F.col("speed") * F.col("noise")).alias("speed"))
