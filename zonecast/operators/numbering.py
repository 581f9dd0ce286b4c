"""Dense numbers in a global order without a task that sees all rows.

Keys are whole numbers. They are cut into digits of 16 bits, and the number of a row is a sum over the digits: how many
rows share its earlier digits and have a smaller one here. Each of those counts is a running sum over at most 65,536
counters, so no window is larger, whatever the skew of the keys; where rows of equal keys are distinct in the tie
columns only, they share a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 16


def _digits(key: Column, kind: T.DataType) -> list[Column]:
    """The key's digits, the highest first; the sign is turned so that negative keys come first."""
    wide = 4 if isinstance(kind, T.LongType) else 2
    whole = key.cast("long")
    low = [F.shiftright(whole, BITS * i).bitwiseAND((1 << BITS) - 1).cast("int") for i in range(wide - 1, -1, -1)]
    return [low[0].bitwiseXOR(1 << (BITS - 1)), *low[1:]]


def numbered(rows: DataFrame, keys: list[str], name: str, ties: list[str] | None = None) -> DataFrame:
    """rows with name (long): 0, 1, ... in the order of keys (int or long columns, not null), then of ties."""
    kinds = {f.name: f.dataType for f in rows.schema}
    digits = [x for k in keys for x in _digits(F.col(k), kinds[k])]
    names = [f"_{name}{i}" for i in range(len(digits))]
    out = rows.withColumns(dict(zip(names, digits, strict=True)))
    counts, level = [], out.groupBy(*names[:-1]).agg(F.count(F.lit(1)).alias("_n"))
    for i in range(len(names) - 1, 0, -1):
        before = Window.partitionBy(*names[: i - 1]).orderBy(names[i - 1]).rowsBetween(Window.unboundedPreceding, -1)
        counts.append((names[:i], level.select(*names[:i], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(f"_before{i}"))))
        level = level.groupBy(*names[: i - 1]).agg(F.sum("_n").alias("_n"))
    within = Window.partitionBy(*names[:-1]).orderBy(names[-1], *(ties or []))
    out = out.withColumn(name, F.row_number().over(within).cast("long") - 1)
    for on, table in counts:
        out = out.join(table, on)
    total = F.col(name)
    for i in range(1, len(names)):
        total = total + F.col(f"_before{i}")
    return out.select(*rows.columns, total.alias(name))


def in_file_order(rows: DataFrame, name: str) -> DataFrame:
    """rows as read from files, with name (long): 0, 1, ... by partition and place. What is gathered is one count a partition."""
    marked = rows.withColumn("_at", F.monotonically_increasing_id())
    part = F.shiftright("_at", 33)
    counts = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return marked.withColumn("_part", part).join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).alias(name))
