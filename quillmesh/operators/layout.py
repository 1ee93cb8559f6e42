"""Axes, principal components and coordinates of concepts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Dimensions that a covariance matrix may have on the driver.
MOST_DIMENSIONS = 2048


def centred(units: DataFrame) -> DataFrame:
    """unit, dim, x less the dimension's mean."""
    each = units.select("unit", F.posexplode("v").alias("dim", "x"))
    mean = each.groupBy("dim").agg(F.avg("x").alias("mean"))
    return each.join(F.broadcast(mean), "dim").select("unit", "dim", (F.col("x") - F.col("mean")).alias("x"))  # a row per dimension


def axis_vector(high: DataFrame, low: DataFrame) -> DataFrame:
    """One row: axis, the unit vector from the mean of low to the mean of high."""
    mean = lambda d, c: d.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias(c))
    both = mean(high, "h").join(mean(low, "l"), "dim").select("dim", (F.col("h") - F.col("l")).alias("d"))
    norm = both.agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("n")).scalar()
    scaled = both.withColumn("norm", norm).select("dim", (F.col("d") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("x"))
    return scaled.agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("axis"))


def dims_by_threshold(spectrum: DataFrame, share: float) -> DataFrame:
    """One row: dims, how many of spectrum(dim from 1, variance) hold share of the variance. A row per dimension."""
    run = F.sum("variance").over(W.orderBy("dim").rowsBetween(W.unboundedPreceding, W.currentRow)) / F.sum("variance").over(W.partitionBy())
    return spectrum.withColumn("part", run).filter(F.col("part") >= share - 1e-9).agg(F.min("dim").alias("dims"))


def dims_by_elbow(spectrum: DataFrame) -> DataFrame:
    """One row: dims, the dimension farthest from the chord between the first and the last, the first of equals; zeros at the end are cut."""
    rows = spectrum.filter(F.col("variance") > 1e-8)
    whole = W.partitionBy()
    v1, vn, n = F.max_by("variance", -F.col("dim")).over(whole), F.max_by("variance", F.col("dim")).over(whole), F.count(F.lit(1)).over(whole)
    away = F.abs((vn - v1) * (F.col("dim") - 1) - (n - 1) * (F.col("variance") - v1)) / F.sqrt((vn - v1) * (vn - v1) + (n - 1) * (n - 1))
    far = rows.withColumn("away", F.round(away, 9))
    return far.withColumn("most", F.max("away").over(whole)).filter("away = most").agg(F.min("dim").alias("dims"))


def normalized(points: DataFrame, columns: list[str], scale: float) -> DataFrame:
    """points with columns centred on the middle of their range and scaled alike, so that the widest spans plus and minus scale."""
    ends = points.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))])
    rows = points.crossJoin(F.broadcast(ends))  # one row
    width = F.greatest(*[F.col(f"high_{c}") - F.col(f"low_{c}") for c in columns], F.lit(0.0))
    scaled = {c: (F.col(c) - (F.col(f"high_{c}") + F.col(f"low_{c}")) / 2) / F.when(width == 0, 1.0).otherwise(width) * (2 * scale) for c in columns}
    return rows.withColumns(scaled).drop(*[f"{n}_{c}" for c in columns for n in ("low", "high")])


def pca(units: DataFrame, dims: int) -> DataFrame:
    """unit, component (from 0), value, variance: principal components from the covariance matrix.

    The matrix is summed over the units by a distributed aggregate; only its d * d numbers (d at most MOST_DIMENSIONS) reach the driver.
    The sign of a component makes its largest loading positive.
    """
    each = centred(units)
    l, r = each.alias("l"), each.alias("r")
    cov = l.join(r, F.expr("l.unit = r.unit and l.dim <= r.dim")).groupBy(F.col("l.dim").alias("i"), F.col("r.dim").alias("j")).agg(F.sum(F.expr("l.x * r.x")).alias("s"))
    d = (each.agg(F.max("dim")).first()[0] or 0) + 1
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions are more than {MOST_DIMENSIONS}")
    m = np.zeros((d, d))
    for row in cov.collect():
        m[row.i, row.j] = m[row.j, row.i] = row.s
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-values, kind="stable")[:dims]
    loads = vectors[:, order]
    loads *= np.where(loads[np.abs(loads).argmax(0), range(loads.shape[1])] < 0, -1, 1)
    rows = [(int(i), int(c), float(loads[i, c]), float(values[order[c]])) for i in range(d) for c in range(loads.shape[1])]
    table = units.sparkSession.createDataFrame(rows, "dim int, component int, load double, variance double")
    return each.join(F.broadcast(table), "dim").groupBy("unit", "component").agg(F.round(F.sum(F.col("x") * F.col("load")), 6).alias("value"), F.round(F.max("variance"), 6).alias("variance"))


def stable_id(centroid: str | Column, keep: int = 48) -> Column:
    """Twelve hex digits of the hash of every so many values, rounded half up to thousandths."""
    v = F.col(centroid) if isinstance(centroid, str) else centroid
    step = F.greatest(F.lit(1), F.floor(F.size(v) / keep).cast("int"))
    kept = F.filter(v, lambda x, i: i % step == 0)
    return F.substring(F.sha2(F.array_join(F.transform(kept, lambda x: F.floor(x * 1000 + 0.5).cast("bigint").cast("string")), "|"), 256), 1, 12)
