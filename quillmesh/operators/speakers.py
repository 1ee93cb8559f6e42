"""Speakers and concepts: masses, shares, dominant stances, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.lexicons import STANCES, UNATTRIBUTED
from quillmesh.operators import similarity as SM
from quillmesh.session import discard, materialise


def attributed(facts: DataFrame) -> DataFrame:
    """Without unattributed rows, unless no row has a named speaker."""
    named = facts.filter(F.col("speaker") != UNATTRIBUTED).limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
    return facts.filter((F.col("speaker") != UNATTRIBUTED) | (named == 0))


def speaker_concept(members: DataFrame) -> DataFrame:
    """speaker, concept_id, mass, weight (share of the speaker), hard_count (sentences with it on top) over memberships."""
    mass = members.groupBy("speaker", "concept_id").agg(F.sum("weight").alias("mass"), F.count_if("top").alias("hard_count"))
    return mass.withColumn("weight", F.col("mass") / F.sum("mass").over(W.partitionBy("speaker")))


def dominant_stance(members: DataFrame) -> DataFrame:
    """speaker, concept_id, stance, evidence: the most frequent stance, ties in the order of the list of stances."""
    counted = members.groupBy("speaker", "concept_id", "stance").agg(F.count(F.lit(1)).alias("n"))
    rank = F.array_position(F.array(*[F.lit(s) for s in STANCES]), F.col("stance"))
    by = W.partitionBy("speaker", "concept_id")
    first = counted.withColumn("evidence", F.sum("n").over(by)).withColumn("place", F.row_number().over(by.orderBy(F.desc("n"), rank)))
    return first.filter("place = 1").select("speaker", "concept_id", "stance", "evidence")


def distribution_classes(shares: DataFrame, owner: str, item: str, weight: str) -> DataFrame:
    """owner, class_id: owners with the same shares (to nine decimals) are one class, named by its least owner."""
    signature = F.xxhash64(F.sort_array(F.collect_list(F.struct(item, F.round(weight, 9)))))
    signed = shares.groupBy(owner).agg(signature.alias("signature"))
    return signed.select(owner, F.min(owner).over(W.partitionBy("signature")).alias("class_id"))


def entropy_pairs(shares: DataFrame, owner: str, item: str, weight: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """All pairs of owners whose Jensen-Shannon similarity is threshold or more, by classes of owners with the very same shares.

    Pairs by the classes' numbers (a, b, similarity) stand for each owner of a with each of b; a = b for the pairs within
    a class of several owners. And each owner with its class: oid, owner, first (one owner of the class), size.
    """
    vecs = SM.vectors(shares, owner, item, weight)
    alike = W.partitionBy(F.xxhash64("v"), "v")
    each = vecs.select("oid", "owner", "v", F.min("oid").over(alike).alias("least"), F.count(F.lit(1)).over(alike).alias("size"))
    first = F.col("oid") == F.col("least")
    people = materialise(each.select(F.col("least").alias("oid"), "owner", first.alias("first"), "size", F.when(first, F.col("v")).alias("v")), "similar-classes")
    discard(vecs)
    leads = people.filter("first").select("oid", "v", "size")
    self = F.aggregate("v", F.lit(0.0), lambda s, e: s + SM.ENTROPY.part(e["x"], e["x"]))
    within = leads.filter("size > 1").select(F.col("oid").alias("a"), F.col("oid").alias("b"), self.alias("similarity")).filter(F.col("similarity") >= threshold)
    return SM.similar_pairs(leads, SM.ENTROPY, threshold).unionByName(within), people.drop("v")


def entropy_links(shares: DataFrame, owner: str, item: str, weight: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes, to nine decimals, whose Jensen-Shannon similarity is threshold or more: class_a, class_b, similarity; and the classes."""
    vecs = SM.vectors(shares, owner, item, weight)
    signed = vecs.select(F.col("owner").alias(owner), F.xxhash64(F.transform("v", lambda e: F.struct(e["iid"].alias("iid"), F.round(e["x"], 9).alias("x")))).alias("signature"))
    classes = signed.select(owner, F.min(owner).over(W.partitionBy("signature")).alias("class_id"))
    leads = classes.filter(F.col(owner) == F.col("class_id")).select(F.col(owner).alias("owner"))
    pairs = SM.similar_pairs(vecs.join(leads, "owner", "left_semi"), SM.ENTROPY, threshold)
    return SM.with_names(pairs, vecs, "class_a", "class_b"), classes


def cosine_pairs(weights: DataFrame, owner: str, item: str, weight: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Pairs of owners by number (a, b, similarity) at threshold or more, and the owners' unit vectors."""
    unit = weights.withColumn("__u", F.col(weight) / F.sqrt(F.sum(F.col(weight) * F.col(weight)).over(W.partitionBy(owner))))
    vecs = SM.vectors(unit, owner, item, "__u")
    return SM.similar_pairs(vecs, SM.COSINE, threshold), vecs


def cosine_links(weights: DataFrame, owner: str, item: str, weight: str, threshold: float) -> DataFrame:
    """owner_a, owner_b, similarity of pairs at threshold or more."""
    return SM.with_names(*cosine_pairs(weights, owner, item, weight, threshold), "owner_a", "owner_b")


def influence_weights(facts: DataFrame) -> DataFrame:
    """speaker, sentences, influence: the root of the mean number of sentences per speaker over the speaker's own."""
    counts = facts.groupBy("speaker").agg(F.count(F.lit(1)).alias("sentences"))
    mean = counts.agg(F.avg("sentences").alias("mean")).scalar()
    return counts.withColumn("influence", F.sqrt(mean / F.col("sentences")))
