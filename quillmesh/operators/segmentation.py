"""Speaker segmentation of raw text by name lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions.text import name_like, trimmed
from quillmesh.lexicons import UNATTRIBUTED

TINY = 60


def speaker_blocks(texts: DataFrame) -> DataFrame:
    """doc_id, block, speaker, lines, characters, text over texts(doc_id, text).

    A line is a header if it looks like a name and the next line that is not blank does not; the lines
    after it are the speaker's. Lines before the first header are unattributed. A header without
    lines gives a block without lines. Windows run within one text.
    """
    each = texts.filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = each.select("doc_id", "line_no", trimmed(F.regexp_replace("line", "\r", "")).alias("line")).filter("line <> ''").withColumn("name_like", name_like("line"))
    by = W.partitionBy("doc_id").orderBy("line_no")
    head = F.col("name_like") & ~F.coalesce(F.lead("name_like").over(by), F.lit(True))
    rows = lines.withColumn("head", head).withColumn("block", F.sum(F.col("head").cast("bigint")).over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("line_no", "line")))), lambda p: p["line"]), "\n")
    return rows.groupBy("doc_id", "block").agg(
        F.coalesce(F.max(F.when(F.col("head"), F.col("line"))), F.lit(UNATTRIBUTED)).alias("speaker"),
        F.count_if(~F.col("head")).alias("lines"),
        F.coalesce(F.sum(F.when(~F.col("head"), F.length("line"))), F.lit(0)).cast("bigint").alias("characters"),
        body.alias("text"),
    )


def without_tiny(blocks: DataFrame, tiny: int = TINY) -> DataFrame:
    """doc_id, speaker, texts: named blocks shorter than tiny go to the unattributed ones; the rest is grouped by speaker in order."""
    to = F.when((F.col("speaker") != UNATTRIBUTED) & (F.col("characters") < tiny), F.lit(UNATTRIBUTED)).otherwise(F.col("speaker"))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda p: p["text"])
    return blocks.withColumn("speaker", to).groupBy("doc_id", "speaker").agg(texts.alias("texts"))
