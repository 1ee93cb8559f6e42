"""The concept graph as two tables: nodes(id, type, label, weight, …) and links(id, source, target, kind, weight, …)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions.numbers import clamp

BUILD_CUT = 0.05


def speaker_concept_links(matrix: DataFrame, stances: DataFrame, cut: float = BUILD_CUT) -> DataFrame:
    """id, source, target, kind, weight, stance, evidence for each share above the cut."""
    s, c = F.concat(F.lit("speaker:"), "speaker"), F.col("concept_id")
    rows = matrix.filter(F.col("weight") > cut).join(stances, ["speaker", "concept_id"], "left")
    return rows.select(F.concat(s, F.lit("->"), c).alias("id"), s.alias("source"), c.alias("target"), F.lit("speakerConcept").alias("kind"), "weight", "stance", F.coalesce("evidence", F.lit(0)).alias("evidence"))


def similarity_links(pairs: DataFrame, a: str, b: str, kind: str, prefix: str = "") -> DataFrame:
    """The same columns for pairs(a, b, similarity)."""
    x, y = F.concat(F.lit(prefix), a), F.concat(F.lit(prefix), b)
    return pairs.select(F.concat(F.lit("sim:"), x, F.lit("__"), y).alias("id"), x.alias("source"), y.alias("target"), F.lit(kind).alias("kind"), F.col("similarity").alias("weight"), F.lit(None).cast("string").alias("stance"), F.lit(0).cast("bigint").alias("evidence"))


def weight_bounds(links: DataFrame, *more: Column, times: Column | int = 1) -> DataFrame:
    """kind, low, high, links, more; a row stands for as many links as times says."""
    w = F.when(F.col("weight").isNull() | F.isnan("weight"), 0.0).otherwise(F.col("weight"))
    return links.groupBy("kind").agg(F.min(w).alias("low"), F.max(w).alias("high"), F.sum(F.lit(times)).alias("links"), *more)


def normal_weight(links: DataFrame, power: float = 0.8) -> DataFrame:
    """links with normal (weight between the kind's bounds) and width (normal to the power). Bounds come by a join on the kind."""
    rows = links.join(F.broadcast(weight_bounds(links).drop("links")), "kind")
    flat = F.abs(F.col("high") - F.col("low")) < 1e-6
    normal = F.when(flat, F.when(F.col("high") > 0, 1.0).otherwise(0.0)).otherwise(clamp((F.col("weight") - F.col("low")) / (F.col("high") - F.col("low")), 0.0, 1.0))
    return rows.withColumn("normal", normal).withColumn("width", F.pow("normal", F.lit(power))).drop("low", "high")


def evidence_percentile(links: DataFrame) -> DataFrame:
    """links with percentile: the share of links with as much evidence or less, from the counts per value and not from a sort of all links."""
    counts = links.groupBy("evidence").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy())
    run = counts.withColumn("percentile", F.sum("n").over(W.orderBy("evidence").rowsBetween(W.unboundedPreceding, W.currentRow)) / total)
    return links.join(run.select("evidence", "percentile"), "evidence")


def endpoints(links: DataFrame) -> DataFrame:
    """id, other, link, weight, both ways."""
    return links.select(F.col("source").alias("id"), F.col("target").alias("other"), F.col("id").alias("link"), "weight").unionByName(links.select(F.col("target").alias("id"), F.col("source").alias("other"), F.col("id").alias("link"), "weight"))


def structural_roles(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, role: a link is a bridge if its ends belong to different concepts, else cluster-internal.

    A concept belongs to itself, any other node to the concept of its strongest link (ties: the least id).
    """
    concept = nodes.filter("type = 'concept'").select("id")
    own = concept.select("id", F.col("id").alias("cluster"))
    near = endpoints(links).join(nodes.filter("type <> 'concept'").select("id"), "id", "left_semi").join(concept.withColumnRenamed("id", "other"), "other", "left_semi")
    best = near.groupBy("id").agg(F.max("weight").alias("w"))
    best = near.join(best, "id").filter("weight = w").groupBy("id").agg(F.min("other").alias("cluster"))
    of = own.unionByName(best)
    rows = links.join(of.toDF("source", "a"), "source", "left").join(of.toDF("target", "b"), "target", "left")
    return rows.select("id", F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")), "bridge").otherwise("cluster-internal").alias("role"))


def search(nodes: DataFrame, text: str, *columns: str) -> DataFrame:
    """Nodes whose columns hold text, whatever the case."""
    return nodes.filter(F.lower(F.concat_ws(" ", *columns)).contains(text.lower()))


def one_hop(links: DataFrame, node: Column | str) -> DataFrame:
    """The ids of a node and its neighbours."""
    at = F.lit(node) if isinstance(node, str) else node
    return endpoints(links).filter(F.col("id") == at).select("other").union(endpoints(links).filter(F.col("id") == at).select("id")).distinct().toDF("id")


def without_dangling(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links whose both ends are nodes."""
    return links.join(nodes.select(F.col("id").alias("source")), "source", "left_semi").join(nodes.select(F.col("id").alias("target")), "target", "left_semi")


def visible(nodes: DataFrame, links: DataFrame, chosen: DataFrame, cut: float) -> DataFrame:
    """The ids of the chosen nodes and of their neighbours over links of at least cut."""
    near = endpoints(links.filter(F.col("weight") >= cut)).join(chosen.select("id"), "id", "left_semi").select(F.col("other").alias("id"))
    return nodes.join(chosen.select("id").union(near).distinct(), "id", "left_semi").select("id")


def overlap(df: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Rows that hold a wanted tag; rows without tags are hidden while a filter is on."""
    return df.filter(F.arrays_overlap(F.coalesce(column, F.array().cast("array<string>")), F.array(*[F.lit(w) for w in wanted]))) if wanted else df
