"""Term models as long tables (record, term, weight): never a dense vocabulary vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def term_counts(records: DataFrame, key: str, terms: str) -> DataFrame:
    """key, term, tf over records(key, terms ARRAY)."""
    return records.select(key, F.explode_outer(terms).alias("term")).filter("term is not null").groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(records: DataFrame, key: str, terms: str) -> DataFrame:
    """key, term, tf, idf, weight: smooth idf ln((1 + N) / (1 + df)) + 1, rows of unit length."""
    tf = term_counts(records, key, terms)
    n = records.agg(F.count(F.lit(1)).alias("n")).scalar()
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)
    raw = tf.join(df, "term").withColumn("raw", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(key)))
    return raw.select(key, "term", "tf", "df", "idf", (F.col("raw") / norm).alias("weight"))


def consensus_scores(texts: DataFrame, speaker: str, terms: str) -> DataFrame:
    """term, df, idf, score: df counts speakers, and agreement is rewarded: idf = ln(1 + df / speakers) + 1, score = idf * df."""
    each = texts.select(speaker, F.explode_outer(terms).alias("term")).filter("term is not null").distinct()
    n = texts.agg(F.countDistinct(speaker).alias("n")).scalar()
    df = each.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log(1 + F.col("df") / n) + 1)
    return df.withColumn("score", F.col("idf") * F.col("df"))


def discriminative_scores(records: DataFrame, key: str, terms: str) -> DataFrame:
    """term, df, idf, score: df counts records, idf = max(0, ln((N - df + 0.5) / (df + 0.5))), score = idf * df."""
    n = records.agg(F.count(F.lit(1)).alias("n")).scalar()
    df = term_counts(records, key, terms).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    df = df.withColumn("idf", F.greatest(F.lit(0.0), F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))))
    return df.withColumn("score", F.col("idf") * F.col("df"))


def bm25_weights(records: DataFrame, key: str, terms: str, idf: DataFrame) -> DataFrame:
    """key, term, weight: idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average)), rows of unit length.

    The length of a record is its number of terms, one at least. Records without a weighted term have no rows.
    """
    size = F.greatest(F.size(terms), F.lit(1))
    mean = records.agg(F.avg(size).alias("mean")).scalar()
    tf = records.select(key, size.alias("length"), F.explode_outer(terms).alias("term")).filter("term is not null").groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    raw = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    weighted = tf.join(idf.select("term", "idf"), "term").withColumn("raw", raw)
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(key)))
    return weighted.filter("raw > 0").select(key, "term", (F.col("raw") / norm).alias("weight"))


def contrastive_terms(weights: DataFrame, groups: DataFrame, key: str, group: str, least: int = 2, share: float = 0.8, least_ratio: float = 1.5) -> DataFrame:
    """group, term, df, ratio, prevalence, score over weights(key, term, weight) and groups(key, group), one group per key.

    A term's mean weight in the group is set against its mean in all other records; the others' sum
    is the total less the group's own, so no record meets another group.
    """
    sizes = groups.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    n = groups.agg(F.count(F.lit(1)).alias("n")).scalar()
    local = weights.join(groups, key).groupBy(group, "term").agg(F.sum("weight").alias("own"), F.count(F.lit(1)).alias("df"))
    total = weights.join(groups, key, "left_semi").groupBy("term").agg(F.sum("weight").alias("all"))
    both = local.join(total, "term").join(sizes, group)
    mine = F.col("own") / F.col("size")
    rest = F.when(n > F.col("size"), F.greatest(F.round(F.col("all") - F.col("own"), 9), F.lit(0.0)) / (n - F.col("size"))).otherwise(0.0)
    scored = both.select(group, "term", "df", "size", mine.alias("mine"), rest.alias("rest"))
    scored = scored.withColumn("prevalence", F.col("df") / F.col("size")).withColumn("ratio", F.when(F.col("rest") > 0, F.col("mine") / F.col("rest")).otherwise(F.col("mine")))
    scored = scored.withColumn("score", (F.col("mine") - F.col("rest")) * F.col("prevalence") * F.log2(F.greatest("ratio", F.lit(1.0)) + 1))
    return scored.filter((F.col("df") >= least) & (F.col("df") <= F.ceil(F.col("size") * share)) & (F.col("score") > 0) & (F.col("ratio") >= least_ratio)).select(group, "term", "df", "ratio", "prevalence", "score")


def cluster_keyphrases(records: DataFrame, group: str, phrases: str) -> DataFrame:
    """group, phrase, count, score: density in the group * ln(1 + count) * ln(1 + lift over the rest) * 1.25 for several words.

    Phrases are taken within each record.
    """
    each = records.select(group, F.explode_outer(phrases).alias("phrase")).filter("phrase is not null")
    sizes = records.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    n = records.agg(F.count(F.lit(1)).alias("n")).scalar()
    mine = each.groupBy(group, "phrase").agg(F.count(F.lit(1)).alias("count"))
    total = mine.groupBy("phrase").agg(F.sum("count").alias("total"))
    density = F.col("count") / F.greatest(F.col("size"), F.lit(1))
    rest = (F.col("total") - F.col("count")) / F.greatest(n - F.col("size"), F.lit(1))
    lift = density / F.greatest(rest, F.lit(1e-6))
    boost = F.when(F.col("phrase").contains(" "), 1.25).otherwise(1.0)
    return mine.join(total, "phrase").join(sizes, group).select(group, "phrase", "count", (density * F.log1p("count") * F.log1p(lift) * boost).alias("score"))


def top_by(df: DataFrame, group: str | list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; order must end in a column without ties."""
    return df.withColumn("__place", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("__place") <= k).drop("__place")
