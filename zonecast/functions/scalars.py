"""Column functions with the null and NaN rules of array code: NaN is kept by clips and null skips nothing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MILE_KM = 1.609
DEFAULT_LENGTH_KM, DEFAULT_SPEED = 2.0, 30.0


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def duration_minutes(start: Column, end: Column) -> Column:
    return (micros(end) - micros(start)) / 6e7


def null_if_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null and NaN stay."""
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def at_least(x: Column, low: float) -> Column:
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.greatest(x, F.lit(low)))


def mean_speed(distance_miles: Column, minutes: Column) -> Column:
    """Kilometres an hour as a ratio of means, clipped to 5 to 130."""
    return clip(F.avg(distance_miles) * MILE_KM / (F.avg(minutes) / 60 + 1e-5), 5.0, 130.0)


def cyclic(x: Column, period: Column | float) -> tuple[Column, Column]:
    angle = 2 * math.pi * x / period
    return F.sin(angle), F.cos(angle)


def calendar_label(date: Column) -> Column:
    """Days 1 to 20 train, 21 to 24 val, the rest test."""
    day = F.dayofmonth(date)
    return F.when(day <= 20, "train").when(day <= 24, "val").otherwise("test")


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounding whose ties fall alike in engines that differ in their last bit."""
    return F.floor(x * 10.0**digits + 0.5001) / 10.0**digits
