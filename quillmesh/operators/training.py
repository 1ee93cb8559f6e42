"""Clusterings that are trained: spherical k-means, sweeps over k and seeds, merging of near-equal concepts, dendrograms.

Units stay distributed; centroids (k * d numbers, k at most MOST_CENTROIDS) go to the driver and back once per iteration.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.clusters import MOST_CENTROIDS
from quillmesh.session import materialise


def _unit_rows(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _block(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def first_centroids(units: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k units with the least hashes: a sample that does not depend on partitions."""
    rows = units.orderBy(F.xxhash64("unit", F.lit(seed)), "unit").limit(k).collect()
    return _unit_rows(np.array([r.v for r in rows])) if rows else np.zeros((0, 0))


def step(units: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, float, int]:
    """New centroids (an empty cluster's is zero), the sum of similarities, the number of units."""
    if len(centroids) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} centroids")
    sent = units.sparkSession.sparkContext.broadcast(centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        sums, total, n = np.zeros(c.shape), 0.0, 0
        for batch in batches:
            if batch.num_rows:
                v = _block(batch.column(0))
                s = v @ c.T
                cell = s.argmax(1)
                np.add.at(sums, cell, v)
                total, n = total + s.max(1).sum(), n + len(v)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.reshape(-1))], ["at", "s"])
            yield pa.RecordBatch.from_arrays([pa.array([-1, -2]), pa.array([total, float(n)])], ["at", "s"])

    rows = units.select("v").mapInArrow(partial, "at bigint, s double").groupBy("at").agg(F.sum(F.round("s", 9)).alias("s")).collect()
    flat = {r.at: r.s for r in rows}
    new = np.array([flat.get(i, 0.0) for i in range(centroids.size)]).reshape(centroids.shape)
    return _unit_rows(new), flat.get(-1, 0.0), int(flat.get(-2, 0))


def spherical_kmeans(units: DataFrame, k: int, seed: int = 42, iterations: int = 25) -> DataFrame:
    """unit, cluster, similarity: the nearest of k centroids by inner product, ties to the lowest number. An empty table gives no rows."""
    rows = materialise(units.select("unit", "v"), "kmeans-units")
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return rows.select("unit", F.lit(0).alias("cluster"), F.lit(0.0).alias("similarity"))
    for _ in range(iterations):
        new, _, _ = step(rows, centroids)
        if np.abs(new - centroids).max() < 1e-9:
            break
        centroids = new
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = _block(batch.column(1)) @ sent.value.T
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s.argmax(1), pa.int32()), pa.array(np.round(s.max(1), 6))], ["unit", "cluster", "similarity"])

    return rows.mapInArrow(assign, "unit bigint, cluster int, similarity double")


def sweep(units: DataFrame, ks: list[int], seeds: list[int], iterations: int = 8, k_penalty: float = 0.001) -> DataFrame:
    """k, seed, coherence, separation, score of each clustering, best first: each fit runs on all units, one after another."""
    rows, out = materialise(units.select("unit", "v"), "sweep-units"), []
    for k in ks:
        for seed in seeds:
            c, total, n = first_centroids(rows, k, seed), 0.0, 0
            for _ in range(iterations):
                c, total, n = step(rows, c)
            sims = (c @ c.T)[np.triu_indices(len(c), 1)]
            coherence, separation = total / max(n, 1), float(((1 - sims) / 2).mean()) if len(sims) else 0.0
            out.append((k, seed, round(float(coherence), 6), round(separation, 6), round(float(0.5 * coherence + 0.5 * separation - k_penalty * k), 6)))
    frame = rows.sparkSession.createDataFrame(out, "k int, seed int, coherence double, separation double, score double")
    return frame.orderBy(F.desc("score"), "k", "seed")


def merged(sizes: DataFrame, pairs: DataFrame, threshold: float, large: float = 0.3) -> DataFrame:
    """cluster, into: clusters whose centroids are more alike than threshold are merged, the most alike first, but never two that each hold more than a share of large.

    Sizes and pairs are of concepts, which the policy bounds; the greedy order needs them in one place.
    """
    size = {r.cluster: r.size for r in sizes.limit(MOST_CENTROIDS).collect()}
    links = sorted(((r.similarity, r.a, r.b) for r in pairs.filter(F.col("similarity") > threshold).collect()), key=lambda x: (-x[0], x[1], x[2]))
    total, root = sum(size.values()) or 1, {c: c for c in size}

    def top(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for _, a, b in links:
        a, b = sorted((top(a), top(b)))
        if a != b and not (size[a] > large * total and size[b] > large * total):
            root[b] = a
            size[a] += size[b]
    return sizes.sparkSession.createDataFrame([(int(c), int(top(c))) for c in sorted(root)], "cluster int, into int")


def dendrogram(cents: DataFrame) -> DataFrame:
    """step, a, b, distance, size: centroid linkage of concepts (a few dozen; more than MOST_CENTROIDS are refused), merged clusters numbered on."""
    rows = cents.select("cluster", "size", "centroid").orderBy("cluster").limit(MOST_CENTROIDS + 1).collect()
    if len(rows) > MOST_CENTROIDS:
        raise ValueError(f"more than {MOST_CENTROIDS} clusters")
    live = {i: (np.array(r.centroid), int(r.size)) for i, r in enumerate(rows)}
    out, number = [], len(rows)
    while len(live) > 1:
        ids = sorted(live)
        m = np.vstack([live[i][0] for i in ids])
        d = 1 - m @ m.T
        d[np.tril_indices(len(ids))] = np.inf
        i, j = divmod(int(d.argmin()), len(ids))
        a, b = ids[i], ids[j]
        (va, na), (vb, nb) = live.pop(a), live.pop(b)
        v = (va * na + vb * nb) / (na + nb)
        live[number] = (v / (np.linalg.norm(v) or 1), na + nb)
        out.append((len(out), a, b, round(float(d[i, j]), 6), na + nb))
        number += 1
    return cents.sparkSession.createDataFrame(out, "step int, a int, b int, distance double, size bigint")
