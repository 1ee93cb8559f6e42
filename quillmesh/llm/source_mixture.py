"""Problem 8: mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Sizes are token counts of whole texts. A source's supply is its tokens times max_repeats. The mixture
is as long as the scarcest source allows at exact shares: the least supply / share over listed sources
that have tokens, in blocks of BLOCK_TOKENS. Shares of listed sources without tokens fall to the
others in proportion; the report keeps the original target beside the actual share.

Slot k of the mixture gets the source in whose cumulative-weight interval the golden-ratio point
frac((k + 1) / phi) falls, so every run of slots holds each source within a few slots of its share. Slots of
a source are ranked by two-level counting (within ranges of slots, then over the ranges), so no task
sees a whole source. Each epoch of a source is its documents in a hashed order of their own, laid end
to end; the prefix sums are two-level as well. Block r of a source is the token range [r, r + 1) *
BLOCK_TOKENS of that line, so blocks are equal and a document may span several.

Defined results: null and empty texts have no tokens and are never used; documents with a null or
unlisted source are not in the mixture; a repeated doc_id counts once (the greatest source and text); target
rows with null or nonpositive share or repeats have no supply, repeated target rows count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.llm.corpus_encoding import token_counts
from quillmesh.session import materialise

BLOCK_TOKENS = 512
#: Slots, and about so many document copies, that one task ranks.
RANGE = 65_536
GOLDEN = 0.6180339887498949


def sized_documents(documents: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, source, tokens of the documents of listed sources that hold tokens."""
    listed = targets.filter("target_share > 0 and max_repeats > 0").select("source").distinct()
    mine = documents.join(listed, "source", "left_semi").select("doc_id", "source", "text")
    twice = mine.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    once = mine.join(twice, "doc_id", "left_anti").unionByName(
        mine.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.max(F.struct("source", "text")).alias("r")).select("doc_id", "r.source", "r.text")
    )
    # Keys that are null compare as unknown, so such a document is in neither part of the joins above twice.
    counted = token_counts(once, path)
    return materialise(once.select("doc_id", "source").join(counted, "doc_id").filter("tokens > 0"), "p8-sizes")


def plan(sizes: DataFrame, targets: DataFrame, block: int) -> DataFrame:
    """source, target_share, max_repeats, tokens, share (among sources with tokens), low, high (cumulative), slots; a row per listed source."""
    total = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    rows = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    rows = rows.join(total, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("bigint")))
    live = F.when((F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0), F.col("target_share")).otherwise(0.0)
    # One window over the listed sources only, a table of configuration.
    every, so_far = W.partitionBy(), W.orderBy("source").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("live", live).withColumn("share", F.col("live") / F.nullif(F.sum("live").over(every), F.lit(0.0)))
    rows = rows.withColumn("high", F.sum("share").over(so_far)).withColumn("low", F.col("high") - F.col("share"))
    supply = F.when(F.col("share") > 0, F.col("tokens") * F.col("max_repeats") / F.col("share"))
    return materialise(rows.withColumn("slots", F.floor(F.min(supply).over(every) / F.lit(block)).cast("bigint")).drop("live"), "p8-plan")


def schedule(spark: SparkSession, plan_rows: DataFrame, block: int) -> DataFrame:
    """slot, source, rank: the source of each slot of the mixture and the slot's rank within that source."""
    listed = plan_rows.filter("share > 0").orderBy("low").collect()  # the listed sources: configuration
    if not listed or not listed[0].slots:
        return spark.createDataFrame([], "slot bigint, source string, rank bigint")
    point = (F.col("slot") + 1) * F.lit(GOLDEN)
    pick = F.lit(listed[-1].source)
    for row in reversed(listed[:-1]):
        pick = F.when(F.col("point") < F.lit(row.high), F.lit(row.source)).otherwise(pick)
    slots = spark.range(listed[0].slots).withColumnRenamed("id", "slot").withColumn("point", point - F.floor(point)).select("slot", pick.alias("source"), F.floor(F.col("slot") / RANGE).alias("part"))
    before = slots.groupBy("source", "part").count().withColumn("before", F.sum("count").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    within = F.row_number().over(W.partitionBy("source", "part").orderBy("slot")) - 1
    ranked = slots.withColumn("within", within).join(before.select("source", "part", F.coalesce("before", F.lit(0)).alias("before")), ["source", "part"])
    return ranked.select("slot", "source", (F.col("within") + F.col("before")).cast("bigint").alias("rank"))


def lines(sizes: DataFrame, plan_rows: DataFrame, seed: int, block: int) -> DataFrame:
    """source, epoch, doc_id, tokens, start: each copy's place on its source's line of tokens, as far as max_repeats goes."""
    n = sizes.count()
    parts = max(1, -(-n // RANGE)) * 16
    small = plan_rows.filter("share > 0").select("source", "max_repeats", F.col("tokens").alias("supply"), F.ceil(F.col("slots") * F.col("share") * block / F.col("tokens")).alias("likely"))
    # A slot count can exceed its share by a few slots, hence one epoch more than is likely.
    epochs = F.explode(F.sequence(F.lit(0), F.least(F.col("max_repeats"), F.col("likely").cast("int") + 1) - 1))
    copies = sizes.join(F.broadcast(small), "source").select("source", "supply", "doc_id", "tokens", epochs.alias("epoch"))
    copies = copies.withColumn("at", F.xxhash64("doc_id", "epoch", F.lit(seed))).withColumn("part", F.floor((F.col("at") / F.lit(2.0**64) + 0.5) * parts).cast("int"))
    line = ["source", "epoch"]
    before = copies.groupBy(*line, "part").agg(F.sum("tokens").alias("sum")).withColumn("before", F.sum("sum").over(W.partitionBy(*line).orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    within = F.sum("tokens").over(W.partitionBy(*line, "part").orderBy("at", "doc_id").rowsBetween(W.unboundedPreceding, -1))
    placed = copies.withColumn("within", within).join(before.select(*line, "part", "before"), [*line, "part"])
    start = F.col("epoch") * F.col("supply") + F.coalesce("before", F.lit(0)) + F.coalesce("within", F.lit(0))
    return placed.select("source", "epoch", "doc_id", "tokens", start.cast("bigint").alias("start"))


def mixture(documents: DataFrame, targets: DataFrame, block: int = BLOCK_TOKENS, seed: int = 0, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mixture and its report.

    mixture: slot, source, epoch, doc_id, token_from, token_to (of the document); a document's pieces have different slots.
    report: source, target_share, actual_share, tokens_used, tokens_available, slots, most_repeats.
    """
    spark = documents.sparkSession
    sizes = sized_documents(documents, targets, path)
    rows = plan(sizes, targets, block)
    slots = schedule(spark, rows, block)
    end = F.col("start") + F.col("tokens")
    placed = lines(sizes, rows, seed, block).select("*", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("rank"))
    # A block that a line does not fill is not used; block ranks spread evenly, so no key is hot.
    whole = rows.select("source", F.floor(F.col("tokens") * F.col("max_repeats") / block).alias("whole"))
    slots = slots.join(F.broadcast(whole), "source").filter("rank < whole").drop("whole")
    low, high = F.greatest(F.lit(0), F.col("rank") * block - F.col("start")), F.least(F.col("tokens"), (F.col("rank") + 1) * block - F.col("start"))
    pieces = placed.join(slots, ["source", "rank"]).select("slot", "source", "epoch", "doc_id", low.cast("bigint").alias("token_from"), high.cast("bigint").alias("token_to"))
    pieces = materialise(pieces, "p8-mixture")
    size = F.col("token_to") - F.col("token_from")
    used = pieces.groupBy("source").agg(F.sum(size).alias("tokens_used"), F.countDistinct("slot").alias("slots"), (F.max("epoch") + 1).alias("most_repeats"))
    report = rows.select("source", "target_share", F.col("tokens").alias("tokens_available")).join(used, "source", "left")
    none = F.lit(0).cast("bigint")
    actual = F.coalesce(F.col("tokens_used") / F.sum("tokens_used").over(W.partitionBy()), F.lit(0.0))
    return pieces, report.select("source", "target_share", actual.alias("actual_share"), F.coalesce("tokens_used", none).alias("tokens_used"), "tokens_available", F.coalesce("slots", none).alias("slots"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from quillmesh.sources.tables import table

    return mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


QUERIES = {"p8_mixture": p8_mixture, "p8_shares": p8_shares}
ORACLES: dict[str, str] = {}
