"""Parquet tables of a data folder, and the cleaned facts that the core's queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions.text import stance
from quillmesh.lexicons import UNATTRIBUTED


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table name.parquet (a file or a folder of part files) of folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the last by order; ties must be broken by order."""
    place = F.row_number().over(W.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return df.withColumn("__place", place).filter("__place = 1").drop("__place")


def named(c: str = "speaker") -> object:
    """A speaker; null and blank ones are unattributed."""
    t = F.trim(F.col(c))
    return F.coalesce(F.when(t != "", t), F.lit(UNATTRIBUTED))


def sentence_facts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per sent_id (its greatest sent_idx), named speakers, null or blank sentences left out, stance classified anew."""
    # All that is read from the text comes before the sort by key: a query that drops the text does not shuffle it.
    said = table(spark, folder, "sentences").withColumns({"speaker": named(), "given_stance": F.col("stance"), "stance": stance("sentence"), "__said": F.trim("sentence") != ""})
    return latest(said, "sent_id", "sent_idx").filter("__said").drop("__said")


def comment_facts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per comment_id (its last delivery), named speakers, null and blank texts left out."""
    rows = latest(table(spark, folder, "comments"), "comment_id", "ingested_at", "text").filter("trim(text) <> ''")
    return rows.withColumn("speaker", named())


def concept_facts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per concept_id (its last update)."""
    return latest(table(spark, folder, "concepts"), "concept_id", "updated_at", "label", "summary")


def memberships(facts: DataFrame) -> DataFrame:
    """sent_id, speaker, stance, source_tags, concept_id, weight, top: each concept of a sentence with its share.

    Soft memberships where there are any, else the hard concept at weight one; repeated concepts of
    a sentence are added up; shares of a sentence sum to one; top marks the greatest, ties by concept.
    """
    soft = F.filter(F.coalesce("concept_membership", F.array().cast("array<struct<concept_id:string,weight:double>>")), lambda m: m["concept_id"].isNotNull() & (m["weight"] > 0))
    hard = F.array(F.struct(F.col("concept_id").alias("concept_id"), F.lit(1.0).alias("weight")))
    own = facts.select("sent_id", "speaker", "stance", "source_tags", F.when(F.size(soft) > 0, soft).otherwise(hard).alias("all"))
    each = own.select("sent_id", "speaker", "stance", "source_tags", F.explode_outer("all").alias("m")).select("sent_id", "speaker", "stance", "source_tags", "m.concept_id", "m.weight").filter("concept_id is not null")
    by = W.partitionBy("sent_id")
    summed = each.groupBy("sent_id", "concept_id").agg(F.first("speaker").alias("speaker"), F.first("stance").alias("stance"), F.first("source_tags").alias("source_tags"), F.sum("weight").alias("weight"))
    shared = summed.withColumn("weight", F.col("weight") / F.sum("weight").over(by))
    return shared.withColumn("top", F.row_number().over(by.orderBy(F.desc("weight"), "concept_id")) == 1)
