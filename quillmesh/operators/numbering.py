"""Positions over a whole table without a task that sees it whole, and windows of neighbours by position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Keys that one task numbers.
WIDTH = 65_536


def numbered(df: DataFrame, key: str, name: str = "pos", width: int = WIDTH) -> DataFrame:
    """df with name: the rank of the unique integer key, from 0, by counting within ranges of keys and then over the ranges."""
    part = F.floor(F.col(key) / width)
    rows = df.withColumn("__part", part)
    before = rows.groupBy("__part").count().withColumn("__before", F.coalesce(F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(W.partitionBy("__part").orderBy(key)) - 1
    ranked = rows.withColumn("__within", within).join(before.select("__part", "__before"), "__part")
    return ranked.withColumn(name, (F.col("__within") + F.col("__before")).cast("bigint")).drop("__part", "__within", "__before")


def row_windows(units: DataFrame, size: int = 3, overlap: int = 1) -> DataFrame:
    """chunk_idx, pos over units(pos, …) numbered from 0: windows of size neighbours that share overlap of them.

    The last window may be short; no window starts after one that reached the end.
    """
    step = max(1, size - overlap)
    total = units.agg(F.count(F.lit(1)).alias("n")).scalar()
    last = F.floor(F.col("pos") / step)
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - size + 1) / step))
    each = units.select("*", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("chunk_idx"))
    start = F.col("chunk_idx") * step
    return each.filter((start == 0) | (start + size - step < total))
