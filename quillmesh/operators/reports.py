"""Measures of a report, and a store of reports as a Parquet table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def status(value: Column, poor: Column, warning: Column) -> Column:
    del value
    return F.when(poor, "poor").when(warning, "warning").otherwise("good")


def health(measures: DataFrame) -> DataFrame:
    """measures(sentences, concepts, axis_variance, solo_concepts) with a status for each metric and the overall score."""
    density = F.col("sentences") / F.when(F.col("concepts") == 0, 1).otherwise(F.col("concepts"))
    solo = F.when(F.col("concepts") > 0, F.col("solo_concepts") / F.col("concepts")).otherwise(0.0)
    rows = measures.withColumns({"density": density, "solo_ratio": solo})
    d, v, s = F.col("density"), F.col("axis_variance"), F.col("solo_ratio")
    states = {
        "density_status": status(d, (d < 5) | (d > 30), (d < 8) | (d > 20)), "size_status": status(d, d < 4, d < 7),
        "variance_status": status(v, v < 0.6, v < 0.75), "solo_status": status(s, s > 0.4, s > 0.2),
    }
    rows = rows.withColumns(states)
    points = [F.when(F.col(c) == "good", 1.0).when(F.col(c) == "warning", 0.6).otherwise(0.2) * 0.25 for c in states]
    return rows.withColumn("score", points[0] + points[1] + points[2] + points[3])


def newest(reports: DataFrame, keep: int, key: str = "id", at: str = "updated_at") -> DataFrame:
    """The newest keep reports, ties by key; a top-k, so no task sees the whole store."""
    return reports.orderBy(F.desc(at), key).limit(keep)


def upserted(reports: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """reports with the rows of changes in place of those of the same key, of changes the last by updated_at."""
    last = changes.withColumn("__place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("updated_at")))).filter("__place = 1").drop("__place")
    return reports.join(last.select(key), key, "left_anti").unionByName(last)


def save(reports: DataFrame, path: str) -> None:
    """Write the store; a reader sees the old or the new one, as the folder is replaced only once it is complete."""
    reports.write.mode("overwrite").parquet(path)


def apportioned(shares: DataFrame, group: str, seats: int) -> DataFrame:
    """shares(group, item, weight) with seats: whole numbers that sum to seats in each group, by the largest remainders, ties by item."""
    by = W.partitionBy(group)
    exact = F.col("weight") / F.sum("weight").over(by) * seats
    rows = shares.withColumn("exact", exact).withColumn("low", F.floor("exact").cast("bigint")).withColumn("rest", F.round(F.col("exact") - F.floor("exact"), 9))
    left = seats - F.sum("low").over(by)
    place = F.row_number().over(by.orderBy(F.desc("rest"), "item"))
    return rows.withColumn("seats", F.col("low") + F.when(place <= left, 1).otherwise(0)).drop("exact", "low", "rest")
