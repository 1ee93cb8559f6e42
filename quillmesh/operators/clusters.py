"""Vectors in clusters: centroids, measures of a clustering, soft membership, assignment.

Vectors are taken apart into rows (unit, cluster, dim, x), so sums run as partial aggregates and no task
holds a cluster. Centroids are few (the concept policy bounds them) and are broadcast only by count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions.numbers import dot

#: Centroids that may be broadcast; the concept policy allows a few dozen.
MOST_CENTROIDS = 4096


def centroids(units: DataFrame, weight: str | None = None) -> DataFrame:
    """cluster, size, centroid (unit length) over units(unit, cluster, v[, weight])."""
    w = F.col(weight) if weight else F.lit(1.0)
    each = units.select("cluster", w.alias("w"), F.posexplode("v").alias("dim", "x")).groupBy("cluster", "dim").agg(F.sum(F.col("x") * F.col("w")).alias("s"), F.count(F.lit(1)).alias("n"))
    norm = F.sqrt(F.sum(F.col("s") * F.col("s")).over(W.partitionBy("cluster")))
    scaled = each.withColumn("x", F.col("s") / F.when(norm == 0, 1.0).otherwise(norm))
    return scaled.groupBy("cluster").agg(F.max("n").alias("size"), F.transform(F.sort_array(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("centroid"))


def small(cents: DataFrame) -> DataFrame:
    """cents marked for broadcast, if they are as few as MOST_CENTROIDS; else unmarked, and the planner shuffles."""
    return F.broadcast(cents) if cents.limit(MOST_CENTROIDS + 1).count() <= MOST_CENTROIDS else cents


def own_similarity(units: DataFrame, cents: DataFrame) -> DataFrame:
    """unit, cluster, similarity to the own centroid."""
    return units.join(small(cents.select("cluster", "centroid")), "cluster").select("unit", "cluster", dot(F.col("v"), F.col("centroid")).alias("similarity"))


def centroid_pairs(cents: DataFrame) -> DataFrame:
    """a, b, similarity of each two centroids, by an equi-join on the dimension."""
    long = cents.select("cluster", F.posexplode("centroid").alias("dim", "x"))
    l, r = long.alias("l"), long.alias("r")
    return l.join(r, F.expr("l.dim = r.dim and l.cluster < r.cluster")).groupBy(F.col("l.cluster").alias("a"), F.col("r.cluster").alias("b")).agg(F.sum(F.expr("l.x * r.x")).alias("similarity"))


def similarities(units: DataFrame, cents: DataFrame) -> DataFrame:
    """unit, cluster, other, similarity of every unit to every centroid: the centroids as one array per unit, not a join of rows."""
    listed = cents.agg(F.sort_array(F.collect_list(F.struct(F.col("cluster").alias("other"), "centroid"))).alias("all"))
    # One row that holds the centroids, MOST_CENTROIDS at most.
    if cents.limit(MOST_CENTROIDS + 1).count() > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids: cut the units into cells first")
    each = units.select("unit", "cluster", "v", listed.scalar().alias("all"))
    sims = F.transform("all", lambda c: F.struct(c["other"].alias("other"), dot(F.col("v"), c["centroid"]).alias("similarity")))
    return each.select("unit", "cluster", F.explode(sims).alias("s")).select("unit", "cluster", "s.other", "s.similarity")


def sizes(units: DataFrame) -> DataFrame:
    """cluster, size, support (speakers), max_share (of one speaker)."""
    by = units.groupBy("cluster", "speaker").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("cluster").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("support"), (F.max("n") / F.sum("n")).alias("max_share"))


def labelability(cluster_sizes: DataFrame) -> DataFrame:
    """One row: clusters, max_share, entropy, micro_ratio, labelability."""
    k = F.count(F.lit(1))
    shares = cluster_sizes.withColumn("p", F.col("size") / F.sum("size").over(W.partitionBy()))
    row = shares.agg(k.alias("clusters"), F.max("p").alias("max_share"), F.when(k > 1, -F.sum(F.col("p") * F.log("p")) / F.log(k)).otherwise(0.0).alias("entropy"), (F.count_if(F.col("size") < 3) / k).alias("micro_ratio"))
    score = 0.5 * (1 - F.abs(F.col("max_share") - 1 / F.col("clusters"))) + 0.3 * (1 - F.col("entropy")) + 0.2 * (1 - F.col("micro_ratio"))
    return row.withColumn("labelability", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def gini(masses: DataFrame, mass: str) -> DataFrame:
    """One row: gini of the masses."""
    order = W.orderBy(mass, *[c for c in masses.columns if c != mass]).rowsBetween(W.unboundedPreceding, W.currentRow)
    run = masses.withColumn("run", F.sum(mass).over(order)).agg(F.count(F.lit(1)).alias("n"), F.sum("run").alias("area"), F.sum(mass).alias("total"))
    value = (F.col("n") + 1) / F.col("n") - 2 * F.col("area") / (F.col("n") * F.col("total"))
    return run.select(F.when(F.col("n") <= 1, 0.0).when(F.col("total") == 0, 1.0).otherwise(value).alias("gini"))


def cut_quality(units: DataFrame, cents: DataFrame, least_mass: float = 3, least_support: int = 2) -> DataFrame:
    """One row: gini, redundancy, support_violations, mass_violations, score, valid."""
    by = sizes(units)
    bad = by.agg(F.count_if(F.col("support") < least_support).alias("support_violations"), F.count_if(F.col("size") < least_mass).alias("mass_violations"))
    most = centroid_pairs(cents).agg(F.coalesce(F.max(F.greatest("similarity", F.lit(0.0))), F.lit(0.0)).alias("redundancy"))
    row = bad.withColumn("gini", gini(by.select("cluster", "size"), "size").scalar()).withColumn("redundancy", most.scalar())
    penalty = F.when(F.col("redundancy") > 0.85, (F.col("redundancy") - 0.85) / 0.15).otherwise(0.0)
    score = F.greatest(F.lit(0.0), 1 - 0.3 * F.col("gini") - 0.2 * penalty)
    return row.select("gini", "redundancy", "support_violations", "mass_violations", score.alias("score"), ((F.col("support_violations") == 0) & (F.col("mass_violations") == 0)).alias("valid"))


def rand_index(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the adjusted Rand index of two labellings."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    both = cells.agg(F.sum(two("n")).alias("s"), F.sum("n").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("s"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("s"))
    row = both.withColumn("r", rows.scalar()).withColumn("c", cols.scalar())
    expected = F.col("r") * F.col("c") / (F.col("n") * (F.col("n") - 1) / 2)
    most = (F.col("r") + F.col("c")) / 2
    return row.select(F.when(most == expected, F.lit(1.0)).otherwise((F.col("s") - expected) / (most - expected)).alias("adjusted_rand"))


def soft_membership(sims: DataFrame, top: int = 3, temperature: float = 1.0, least: float = 0.10, entropy_cap: float = 0.8) -> DataFrame:
    """unit, concept, weight over similarities(unit, other, similarity).

    The top positive similarities as shares; shares below least go unless all do; what is left is
    shared anew; a unit whose entropy is above the cap keeps its first concept alone.
    """
    by = W.partitionBy("unit")
    order = by.orderBy(F.desc("s"), "other")
    first = sims.withColumn("s", F.greatest(F.lit(0.0), F.col("similarity")) / temperature).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    total = F.sum("s").over(by)
    share = first.withColumn("w", F.col("s") / F.when(total == 0, 1.0).otherwise(total))
    kept = share.withColumn("most", F.max("w").over(by)).filter((F.col("w") >= least) | ((F.col("most") < least) & (F.col("place") == 1)))
    again = F.sum("w").over(by)
    kept = kept.withColumn("w", F.col("w") / F.when(again == 0, 1.0).otherwise(again)).withColumn("many", F.count(F.lit(1)).over(by))
    entropy = F.sum(F.when(F.col("w") > 0, -F.col("w") * F.log2("w")).otherwise(0.0)).over(by) / F.log2("many")
    hard = (F.col("many") > 1) & (F.round(entropy, 9) > entropy_cap)
    return kept.withColumn("hard", hard).filter(~F.col("hard") | (F.col("place") == 1)).select("unit", F.col("other").alias("concept"), F.when(F.col("hard"), 1.0).otherwise(F.col("w")).alias("weight"))
