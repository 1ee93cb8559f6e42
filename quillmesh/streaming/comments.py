"""Comments as a stream: split, classify and count, with a watermark so that late deliveries are counted and state stays bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as T


def classified(comments: DataFrame, delay: str = "2 days") -> DataFrame:
    """comment_id, submitted_at, pos, sentence, stance of a stream or table of comments(comment_id, text, submitted_at); repeated deliveries within the delay count once."""
    once = comments.withWatermark("submitted_at", delay).dropDuplicatesWithinWatermark(["comment_id"]) if comments.isStreaming else comments.dropDuplicates(["comment_id"])
    parts = once.select("comment_id", "submitted_at", F.posexplode_outer(T.sentences("text")).alias("pos", "sentence")).filter("sentence is not null")
    return parts.withColumn("stance", T.stance("sentence"))


def stance_by_window(comments: DataFrame, window: str = "30 days", delay: str = "2 days") -> DataFrame:
    """start, stance, sentences by the window of submission."""
    rows = classified(comments, delay).groupBy(F.window("submitted_at", window).alias("w"), "stance").agg(F.count(F.lit(1)).alias("sentences"))
    return rows.select(F.col("w.start").alias("start"), "stance", "sentences")
