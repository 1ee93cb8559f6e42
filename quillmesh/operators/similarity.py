"""Similarity joins of sparse vectors: all pairs of owners at a threshold or more, in passes over the items."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.session import discard, materialise

#: Items of a prefix that an index row carries; longer prefixes are searched by their bounds and checked afterwards.
CARRIED = 64
#: Owners of one item that meet in one block, and pairs of owners by item that one pass goes through.
BLOCK, PASS = 2048, 50_000_000
SLACK = 1e-9
#: Owners whose names are broadcast to the pairs; with more of them the names are joined by a shuffle.
MOST_NAMES = 1_000_000


@dataclass(frozen=True)
class Measure:
    """A similarity that is a sum over shared items.

    part(x, y) is an item's addend by the two values. The addends of items whose masses add up to a and b
    come to bound(a, b) at most; bound grows with both. No owner's masses come to more than one.
    """

    part: Callable[[Column, Column], Column]
    mass: Callable[[Column], Column]
    bound: Callable[[Column, Column], Column]


def _entropy(x: Column, y: Column) -> Column:
    return -(x * F.log2(x / (x + y)) + y * F.log2(y / (x + y))) / 2


#: Jensen-Shannon similarity of shares; its addend is concave and of degree one, so that addends come to that of the sums at most.
ENTROPY = Measure(_entropy, lambda x: x, lambda a, b: F.when((a > 0) & (b > 0), _entropy(a, b)).otherwise(0.0))
#: Cosine of unit vectors, bounded by the inequality of Cauchy and Schwarz.
COSINE = Measure(lambda x, y: x * y, lambda x: x * x, lambda a, b: F.sqrt(a * b))


def vectors(weights: DataFrame, owner: str, item: str, weight: str) -> DataFrame:
    """oid, owner, v: each owner's list of (iid, x, often), frequent items first. iid counts items from the most frequent one on, with gaps; often is an item's number of owners."""
    counted = weights.groupBy(item).agg(F.count(F.lit(1)).alias("often")).orderBy(F.desc("often"), item)
    items = materialise(counted.select(F.col(item).alias("item"), F.monotonically_increasing_id().alias("iid"), "often"), "similar-items")
    coded = weights.select(F.col(owner).alias("owner"), F.col(item).alias("item"), F.col(weight).alias("x")).join(items, "item")
    each = coded.groupBy("owner").agg(F.sort_array(F.collect_list(F.struct("iid", "x", "often"))).alias("v"))
    vecs = materialise(each.withColumn("oid", F.monotonically_increasing_id()), "similar-vectors")
    discard(items)
    return vecs


def similar_pairs(vecs: DataFrame, measure: Measure, threshold: float, pairs_a_pass: int = PASS, block: int = BLOCK, carried: int = CARRIED) -> DataFrame:
    """a, b (oids), similarity of all pairs of vectors(oid, v) at threshold or more.

    The last shared item of a pair, in the order of the vectors, is found by an equi-join on the items. An owner's
    first items are left out of the index while their mass cannot bring threshold against a whole owner: a pair
    of threshold or more shares an item beyond them on either side, so its last shared item is in both indexes.
    There, all shared items lie in the two prefixes that end with it. A pair stays if the item's addend and the bound
    of the rest come to threshold. The rest is bounded by the prefixes' masses and by the number of items that may
    be shared, from 64 bits of each prefix, times the greatest mass. Prefixes of up to carried items come with the
    row and give the similarity at once: that at the last shared item is whole, those at others are parts of it.
    Owners of a frequent item meet in blocks. Items are spread over passes, each of which frees its shuffle files.
    """
    run = W.partitionBy("oid").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy("oid").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    close = W.partitionBy("oid").orderBy("pos").rowsBetween(1 - carried, W.currentRow)
    rows = vecs.select("oid", F.posexplode("v").alias("pos", "e")).select("oid", "pos", "e.iid", "e.x", "e.often").withColumn("m", measure.mass(F.col("x")))
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(iid), 64) as int))")
    keys = rows.withColumns({
        "covered": F.sum("m").over(run),
        "rest": F.coalesce(F.sum("m").over(before), F.lit(0.0)),
        "most": F.coalesce(F.max("m").over(before), F.lit(0.0)),
        "bits": F.coalesce(F.bit_or(bit).over(before), F.lit(0).cast("bigint")),
        "prefix": F.when(F.col("pos") < carried, F.collect_list(F.struct("iid", "x")).over(close)),
    })
    keys = keys.filter(measure.bound(F.col("covered"), F.lit(1.0)) >= threshold - SLACK).withColumn("doubled", F.col("pos") - F.bit_count("bits")).drop("covered", "pos", "x")
    work = vecs.select(F.sum(F.aggregate("v", F.lit(0.0), lambda n, e: n + e["often"] / 2))).first()[0] or 0
    passes = 1 + int(work // pairs_a_pass)
    keys = keys.withColumn("blocks", F.ceil(F.col("often") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("oid"), F.col("blocks")).cast("int"))
    keys = materialise(keys.drop("often").withColumn("pass", F.pmod(F.hash("iid"), F.lit(passes))), "similar-keys", ["pass"])
    found = [materialise(_found(keys.filter(F.col("pass") == n), measure, threshold), "similar-found") for n in range(passes)]
    discard(keys)
    # Each pair once, in parts as well.
    parts, rows = 1 + passes // 5, reduce(DataFrame.unionByName, found)
    each = [_once(rows.filter(F.pmod(F.xxhash64("a"), F.lit(parts)) == n)) for n in range(parts)]
    every = reduce(DataFrame.unionByName, each)
    late = materialise(_checked(every.filter("open"), vecs, measure, threshold), "similar-late")
    discard(*found)
    return every.filter(~F.col("open") & (F.col("similarity") >= threshold)).drop("open").unionByName(late)


def _once(found: DataFrame) -> DataFrame:
    """a, b, similarity, open: whether some row of the pair has no similarity."""
    return materialise(found.groupBy("a", "b").agg(F.max("similarity").alias("similarity"), F.bool_or(F.col("similarity").isNull()).alias("open")), "similar-pairs")


def _found(keys: DataFrame, measure: Measure, threshold: float) -> DataFrame:
    """a, b, similarity: pairs by item; similarity is null where a prefix was not carried."""
    l = keys.withColumn("low", F.col("block")).withColumn("high", F.explode(F.sequence("block", F.col("blocks") - 1))).alias("l")
    r = keys.withColumn("high", F.col("block")).withColumn("low", F.explode(F.sequence(F.lit(0), F.col("block")))).withColumn("prefix", F.map_from_entries("prefix")).alias("r")
    c = F.col
    both = c("l.bits").bitwiseAND(c("r.bits"))
    shared = F.least("l.doubled", "r.doubled") + F.bit_count(both)
    left = lambda s: F.least(c(f"{s}.rest"), shared * c(f"{s}.most"))
    bound = measure.bound(c("l.m"), c("r.m")) + measure.bound(left("l"), left("r"))
    met = F.filter(F.transform("l.prefix", lambda e: F.struct(e["x"].alias("x"), F.element_at("r.prefix", e["iid"]).alias("y"))), lambda e: e["y"].isNotNull())
    similarity = F.when(c("l.prefix").isNotNull() & c("r.prefix").isNotNull(), F.aggregate(met, F.lit(0.0), lambda s, e: s + F.coalesce(measure.part(e["x"], e["y"]), F.lit(0.0))))
    on = (c("l.iid") == c("r.iid")) & (c("l.low") == c("r.low")) & (c("l.high") == c("r.high"))
    once = (c("l.low") < c("l.high")) | (c("l.oid") < c("r.oid"))
    pairs = l.join(r, on & once & (bound >= threshold - SLACK) & F.coalesce(similarity >= threshold - SLACK, F.lit(True)))
    return pairs.select(F.least("l.oid", "r.oid").alias("a"), F.greatest("l.oid", "r.oid").alias("b"), similarity.alias("similarity"))


def _checked(pairs: DataFrame, vecs: DataFrame, measure: Measure, threshold: float) -> DataFrame:
    """a, b, similarity of the pairs(a, b) at threshold or more, by looking up the shorter vector's items in the longer."""
    long = vecs.select("oid", F.size("v").alias("n"))
    sized = pairs.select("a", "b").join(long.toDF("a", "n_a"), "a").join(long.toDF("b", "n_b"), "b")
    few = F.col("n_a") <= F.col("n_b")
    sided = sized.select("a", "b", F.when(few, F.col("a")).otherwise(F.col("b")).alias("oid"), F.when(few, F.col("b")).otherwise(F.col("a")).alias("other"))
    each = sided.join(vecs.select("oid", "v"), "oid").select("a", "b", "other", F.explode("v").alias("e")).select("a", "b", "other", "e.iid", "e.x")
    facing = vecs.select(F.col("oid").alias("other"), F.explode("v").alias("e")).select("other", "e.iid", F.col("e.x").alias("y"))
    met = each.join(facing, ["other", "iid"]).groupBy("a", "b").agg(F.sum(measure.part(F.col("x"), F.col("y"))).alias("similarity"))
    return met.filter(F.col("similarity") >= threshold)


def with_names(pairs: DataFrame, vecs: DataFrame, left: str, right: str) -> DataFrame:
    """left, right, similarity: the owners of pairs(a, b, similarity), the lesser name first. Where several owners have one oid: each of a with each of b, and for a = b each pair once."""
    every = both_ends(pairs, vecs.select("oid", "owner")).filter((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return every.select(F.least("x", "y").alias(left), F.greatest("x", "y").alias(right), "similarity")


def both_ends(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """pairs(a, b, …) with x and y: what the table of two columns, oid and a value, has for a and b."""
    known = F.broadcast(of) if of.count() <= MOST_NAMES else of
    return pairs.join(known.toDF("a", "x"), "a").join(known.toDF("b", "y"), "b")
