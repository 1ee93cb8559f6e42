"""Problem 5: grouping sentence records into clusters of mutually similar ones.

Records with the same set of terms are one class from the start, so copies cost nothing. Each class gets
a vector of hashed features (DIMENSIONS signed slots) weighted by the terms' inverse frequency. Distributed
k-means cuts the classes into cells: seeding is parallel and oversampled (each round samples every class with a
chance in proportion to its distance, for all cells at once; the weighted candidates are then reduced
to the seeds), iterations exchange one partial sum per cell and task. The number of cells follows the
number of classes up to MOST_CELLS, which bounds what is broadcast.

Similar classes are looked for within cells by one shared rare term, and, as the border of a cell may run
between two similar ones, across cells by two shared rare terms, which is complete: two sets of n and m terms with at least
SHARE in common hold their two first common terms, in an order from rare to frequent, among
their first n - ceil(SHARE * n) + 2. An exact count of shared terms follows on both routes, so no pair is lost or
wrong. Clusters are the connected components of the similar classes; a cluster's typical members are those
nearest the centroid of its vectors.

Defined results: records of other languages, null and short texts are in no cluster; repeated deliveries count once
(the latest); an empty table gives no rows; other columns are ignored. concept_id and representative_sentences do not
enter, as the definition of a case does not use them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.llm.term_frequency import words
from quillmesh.operators.components import components
from quillmesh.session import materialise

PERCENT = 65
LEAST_TERMS = 10
TYPICAL = 3
#: Distances that a task holds at once.
BLOCK = 1 << 22
DIMENSIONS, MOST_CELLS, ITERATIONS, SEED_ROUNDS, OVERSAMPLE = 64, 4096, 4, 3, 2.0


def english_records(sentences: DataFrame) -> DataFrame:
    """id (of the class of records with the same terms), sent_id, terms."""
    latest = sentences.groupBy("sent_id").agg(F.max(F.struct("ingested_at", "sentence", "lang")).alias("r"))
    rows = latest.filter("r.lang = 'en' and sent_id is not null").select("sent_id", F.array_sort(F.array_distinct(words(F.col("r.sentence")))).alias("terms"))
    rows = rows.filter(F.size("terms") >= LEAST_TERMS)
    # Two independent 64-bit hashes make the class; the numbers hold for good only once they are written.
    keyed = materialise(rows.select("sent_id", "terms", F.xxhash64("terms").alias("h"), F.xxhash64(F.lit("second"), "terms").alias("g")), "p5-records")
    classes = keyed.groupBy("h", "g").agg(F.min("sent_id").alias("first"))
    classes = materialise(classes.select("h", "g", "first", F.monotonically_increasing_id().alias("id")), "p5-classes")
    return keyed.join(classes, ["h", "g"]).select("id", "sent_id", "terms", (F.col("first") == F.col("sent_id")).alias("leads"))


def ranked_classes(records: DataFrame) -> DataFrame:
    """id, n, ranks (ascending, rare first), weights (of the ranks), low and high (128 hashed bits of the terms)."""
    each = records.filter("leads").select("id", F.explode_outer("terms").alias("term"))
    order = each.groupBy("term").count().orderBy("count", "term")
    order = materialise(order.select("term", F.monotonically_increasing_id().alias("rank"), "count"), "p5-order")
    bit = F.pmod(F.xxhash64("rank"), F.lit(128)).cast("int")
    one = F.lit(1).cast("bigint")
    side = lambda low: F.bit_or(F.when((F.col("bit") < 64) == F.lit(low), F.call_function("shiftleft", one, F.col("bit") % 64)).otherwise(F.lit(0).cast("bigint")))
    weight = (1.0 / F.log2(F.col("count") + 1.5)).cast("float")
    ranked = each.join(order, "term").select("id", "rank", weight.alias("weight"), bit.alias("bit")).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "weight"))).alias("t"), side(True).alias("low"), side(False).alias("high"))
    return materialise(ranked.select("id", F.size("t").alias("n"), F.col("t.rank").alias("ranks"), F.col("t.weight").alias("weights"), "low", "high"), "p5-ranked")


def vectors(ranked: DataFrame) -> DataFrame:
    """id, v: hashed weighted features of unit length."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, weights = batch.column(1), batch.column(2).flatten().to_numpy(zero_copy_only=False)
            ranks, ends = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            mixed = (ranks.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            slot, sign = (mixed >> np.uint64(58)).astype(np.int64) % DIMENSIONS, np.where(mixed >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
            v = np.zeros((len(ends), DIMENSIONS))
            np.add.at(v, (np.repeat(np.arange(len(ends)), ends), slot), sign * weights)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), as_lists(v)], ["id", "v"])

    return materialise(ranked.select("id", "ranks", "weights").mapInArrow(hashed, "id bigint, v array<float>"), "p5-vectors")


def as_lists(v: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(v, dtype=np.float32).reshape(-1), pa.float32())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32)), flat) if v.size else pa.array([], pa.list_(pa.float32()))


def block(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the squared distance; rows go in blocks, so that memory stays small for many centroids."""
    half = (centroids * centroids).sum(1) / 2
    cell, d = np.empty(len(v), dtype=np.int64), np.empty(len(v))
    rows = max(1, BLOCK // max(1, len(centroids)))
    for i in range(0, len(v), rows):
        part = v[i : i + rows]
        away = half[None, :] - part @ centroids.T
        best = away.argmin(1)
        cell[i : i + rows] = best
        d[i : i + rows] = 2 * away[np.arange(len(part)), best] + (part * part).sum(1)
    return cell, np.maximum(d, 0.0)


def assigned(vecs: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, cell, distance (squared) and v."""
    sent = vecs.sparkSession.sparkContext.broadcast(centroids.astype(np.float32))  # at most some times MOST_CELLS * DIMENSIONS * 4 bytes

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, d = nearest(block(batch.column(1)), sent.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), pa.array(d, pa.float64()), batch.column(1)], ["id", "cell", "distance", "v"])

    return vecs.mapInArrow(assign, "id bigint, cell int, distance double, v array<float>")


def cell_sums(vecs: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells, counts and vector sums; each task sends one row per cell that it holds."""
    sent = vecs.sparkSession.sparkContext.broadcast(centroids.astype(np.float32))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        sums, counts = np.zeros(c.shape), np.zeros(len(c), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                v = block(batch.column(1))
                cell, _ = nearest(v, c)
                np.add.at(sums, cell, v)
                counts += np.bincount(cell, minlength=len(c))
        held = np.flatnonzero(counts)
        if len(held):
            rows = held.repeat(c.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(np.tile(np.arange(c.shape[1]), len(held)), pa.int32()), pa.array(counts[rows]), pa.array(sums[held].reshape(-1))], ["cell", "dim", "n", "s"])

    rows = vecs.mapInArrow(partial, "cell int, dim int, n bigint, s double").groupBy("cell", "dim").agg(F.sum("n").alias("n"), F.sum(F.round("s", 6)).alias("s")).orderBy("cell", "dim").toPandas()
    cells = rows["cell"].to_numpy().reshape(-1, centroids.shape[1])[:, 0] if len(rows) else np.zeros(0, int)
    return cells, rows["n"].to_numpy().reshape(len(cells), -1)[:, 0] if len(rows) else cells, rows["s"].to_numpy().reshape(len(cells), -1)


def seeds(vecs: DataFrame, k: int, seed: int = 17) -> np.ndarray:
    """k starting centroids by oversampled parallel seeding; at most about OVERSAMPLE * k * SEED_ROUNDS candidates reach the driver."""
    first = vecs.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1).collect()
    chosen = np.array([r.v for r in first], dtype=np.float64)
    for turn in range(SEED_ROUNDS):
        near = assigned(vecs, chosen)
        cost = near.agg(F.sum("distance")).first()[0]
        if not cost:
            break
        chance = (F.xxhash64("id", F.lit(seed), F.lit(turn)) / F.lit(2.0**64)) + 0.5
        new = near.filter(chance < F.col("distance") * F.lit(OVERSAMPLE * k / cost)).orderBy("id").select("v").collect()
        if new:
            chosen = np.vstack([chosen, np.array([r.v for r in new], dtype=np.float64)])
    cells, weight, _ = cell_sums(vecs, chosen)
    chosen, weight = chosen[cells], weight.astype(float)
    if len(chosen) <= k:
        return chosen
    # Weighted seeding among the candidates.
    draw = np.random.default_rng(seed)
    picked = [int(weight.argmax())]
    far = ((chosen - chosen[picked[0]]) ** 2).sum(1)
    while len(picked) < k and (far * weight).sum() > 0:
        picked.append(int(draw.choice(len(chosen), p=far * weight / (far * weight).sum())))
        far = np.minimum(far, ((chosen - chosen[picked[-1]]) ** 2).sum(1))
    return chosen[picked]


def cells(vecs: DataFrame, k: int | None = None) -> DataFrame:
    """id, cell, distance, v of every class by k-means, written."""
    n = vecs.count()
    if not n:
        return vecs.select("id", F.lit(0).alias("cell"), F.lit(0.0).alias("distance"), "v")
    k = k or int(min(MOST_CELLS, max(1.0, np.sqrt(n / 2.0))))
    centroids = seeds(vecs, k)
    for _ in range(ITERATIONS):
        held, counts, sums = cell_sums(vecs, centroids)
        new = centroids.copy()
        new[held] = sums / counts[:, None]
        if np.abs(new - centroids).max() < 1e-4:
            break
        centroids = new
    return materialise(assigned(vecs, centroids), "p5-cells")


def similar_pairs(ranked: DataFrame, placed: DataFrame) -> DataFrame:
    """a, b, millionths: each pair of similar classes once, a < b, with its similarity."""
    need = F.expr(f"({PERCENT} * n + 99) div 100").cast("int")
    rows = ranked.join(placed.select("id", "cell"), "id").select("id", "n", "low", "high", "cell", F.slice("ranks", 1, F.col("n") - need + 2).alias("first"))
    rows = materialise(rows, "p5-first")
    inner = rows.select("id", "n", "low", "high", "cell", F.explode_outer(F.slice("first", 1, F.size("first") - 1)).alias("x"))
    outer = rows.select("id", "n", "low", "high", "cell", "first", F.posexplode_outer("first").alias("i", "x")).select("id", "n", "low", "high", "cell", "x", F.explode(F.slice("first", F.col("i") + 2, F.size("first"))).alias("y"))
    # The most terms that only one of two similar records may hold.
    most = F.expr(f"l.n + r.n - 2 * (({PERCENT} * (l.n + r.n) + {99 + PERCENT}) div {100 + PERCENT})")
    likely = F.expr(f"100 * least(l.n, r.n) >= {PERCENT} * greatest(l.n, r.n)") & (F.expr("bit_count(l.low ^ r.low) + bit_count(l.high ^ r.high)") <= most)
    pick = [F.col("l.id").alias("a"), F.col("r.id").alias("b")]
    within = inner.alias("l").join(inner.alias("r"), F.expr("l.cell = r.cell and l.x = r.x and l.id < r.id")).filter(likely).select(*pick)
    across = outer.alias("l").join(outer.alias("r"), F.expr("l.x = r.x and l.y = r.y and l.id < r.id and l.cell <> r.cell")).filter(likely).select(*pick)
    maybe = within.unionByName(across).distinct()
    one = lambda c: ranked.select(F.col("id").alias(c), F.col("ranks").alias(f"ranks_{c}"))
    shared = maybe.join(one("a"), "a").join(one("b"), "b").select("a", "b", F.size(F.array_intersect("ranks_a", "ranks_b")).alias("k"), (F.size("ranks_a") + F.size("ranks_b")).alias("both"))
    return materialise(shared.filter(F.expr(f"100 * k >= {PERCENT} * (both - k)")).select("a", "b", F.expr("(1000000L * k) div (both - k)").alias("millionths")), "p5-pairs")


def clustered(sentences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """sent_id, id, cluster of every record that is similar to another; and the classes with cell, distance and v."""
    records = english_records(sentences)
    ranked = ranked_classes(records)
    placed = cells(vectors(ranked))
    labels = components(similar_pairs(ranked, placed)).withColumnRenamed("component", "cluster")
    members = records.select("id", "sent_id").join(labels, "id", "left")
    alone = members.groupBy("id").agg(F.count(F.lit(1)).alias("copies"))
    members = members.join(alone, "id").filter("cluster is not null or copies > 1").select("sent_id", "id", F.coalesce("cluster", "id").alias("cluster"))
    return materialise(members, "p5-members"), placed


def found(sentences: DataFrame) -> DataFrame:
    members, _ = clustered(sentences)
    l, r = members.alias("l"), members.alias("r")
    return l.join(r, F.expr("l.cluster = r.cluster and l.sent_id < r.sent_id")).select(F.col("l.sent_id").alias("sent_a"), F.col("r.sent_id").alias("sent_b"))


def typical_members(members: DataFrame, key: str) -> DataFrame:
    """key, size, typical over members(key, sent_id, v): the TYPICAL members nearest the centroid, ties by sent_id."""
    flat = members.select(key, F.posexplode_outer("v").alias("dim", "x")).groupBy(key, "dim").agg(F.avg("x").alias("c"))
    centre = flat.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "c"))), lambda p: p["c"]).alias("centre"))
    away = F.aggregate(F.zip_with("v", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    far = materialise(members.join(centre, key).select(key, "sent_id", F.round(away, 9).alias("away")), "p5-far")
    # Rows are ranked within hashed parts first, so a cluster with a third of all rows is no single task.
    part = W.partitionBy(key, F.pmod(F.xxhash64("sent_id"), F.lit(64))).orderBy("away", "sent_id")
    few = far.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= TYPICAL)
    few = few.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy("away", "sent_id"))).filter(F.col("place") <= TYPICAL)
    listed = few.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "sent_id"))), lambda p: p["sent_id"]).alias("typical"))
    return far.groupBy(key).agg(F.count(F.lit(1)).alias("size"), F.min("sent_id").alias("least")).join(listed, key)


def clusters(sentences: DataFrame) -> DataFrame:
    """cluster (its least sent_id), size, typical."""
    members, placed = clustered(sentences)
    return typical_members(members.join(placed.select("id", "v"), "id"), "cluster").select(F.col("least").alias("cluster"), "size", "typical")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.sources.tables import table

    return found(table(spark, sf_dir, "sentences"))


def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.sources.tables import table

    return clusters(table(spark, sf_dir, "sentences"))


QUERIES = {"p5_found": p5_found, "p5_clusters": p5_clusters}
ORACLES = {
    "p5_found": r"""
WITH RECURSIVE s AS (SELECT sent_id, max(sentence) AS v FROM sentences WHERE lang = 'en' GROUP BY sent_id),
t AS (SELECT DISTINCT sent_id, unnest(regexp_extract_all(lower(nfc_normalize(regexp_replace(v, '\p{Cf}', '', 'g'))), '[\p{L}\p{M}]{2,}')) AS term FROM s),
n AS (SELECT sent_id, count(*) AS n FROM t GROUP BY sent_id HAVING count(*) >= 10),
k AS (SELECT a.sent_id AS x, b.sent_id AS y, count(*) AS k FROM t a JOIN t b ON a.term = b.term AND a.sent_id <> b.sent_id GROUP BY 1, 2),
e AS (SELECT x, y FROM k JOIN n a ON a.sent_id = x JOIN n b ON b.sent_id = y WHERE 100 * k >= 65 * (a.n + b.n - k)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT x AS sent_a, y AS sent_b FROM r WHERE x < y
""",
}
