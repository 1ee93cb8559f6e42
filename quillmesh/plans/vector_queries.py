"""Queries on the vectors of the table embeddings: unit = vec_id, cluster = label, speaker = vec_id modulo 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions import numbers as N
from quillmesh.operators import clusters as C
from quillmesh.operators import layout, training
from quillmesh.sources.tables import table

QUERIES, ORACLES = {}, {}
R = lambda c: F.round(c, 6)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def units(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").filter("embedding is not null and label is not null")
    return rows.select(F.col("vec_id").alias("unit"), F.col("label").alias("cluster"), (F.col("vec_id") % 7).alias("speaker"), F.col("embedding").cast("array<double>").alias("v"))


U = "u AS (SELECT vec_id AS unit, label AS cluster, vec_id % 7 AS speaker, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)"
L = U + ", x AS (SELECT unit, cluster, speaker, generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS x FROM u)"
CT = L + ", cs AS (SELECT cluster, dim, sum(x) AS s FROM x GROUP BY 1, 2), cn AS (SELECT cluster, dim, s / coalesce(nullif(sqrt(sum(s * s) OVER (PARTITION BY cluster)), 0), 1) AS x FROM cs), ct AS (SELECT cluster, list(x ORDER BY dim) AS c FROM cn GROUP BY 1)"
SIM = CT + ", sim AS (SELECT unit, u.cluster, ct.cluster AS other, list_dot_product(v, c) AS similarity FROM u, ct)"
PAIR = CT + ", pr AS (SELECT a.cluster AS a, b.cluster AS b, list_dot_product(a.c, b.c) AS similarity FROM ct a JOIN ct b ON a.cluster < b.cluster)"
SZ = "sz AS (SELECT cluster, sum(n) AS size, count(*) AS support, max(n) / sum(n)::DOUBLE AS max_share FROM (SELECT cluster, speaker, count(*) AS n FROM u GROUP BY 1, 2) GROUP BY 1)"


@query(f"WITH {CT} SELECT cluster, dim, round(x, 6) AS x FROM cn")
def cluster_centroids(spark, folder) -> DataFrame:
    return C.centroids(units(spark, folder)).select("cluster", F.posexplode("centroid").alias("dim", "x")).select("cluster", F.col("dim").cast("bigint").alias("dim"), R("x").alias("x"))


@query(f"WITH {U}, n AS (SELECT speaker, sqrt((SELECT count(*) FROM u) / (SELECT count(DISTINCT speaker) FROM u)::DOUBLE / count(*)) AS w FROM u GROUP BY 1), x AS (SELECT cluster, w, generate_subscripts(v, 1) - 1 AS dim, unnest(v) AS x FROM u JOIN n USING (speaker)), s AS (SELECT cluster, dim, sum(x * w) AS s FROM x GROUP BY 1, 2) SELECT cluster, dim, round(s / sqrt(sum(s * s) OVER (PARTITION BY cluster)), 6) AS x FROM s")
def weighted_centroids(spark, folder) -> DataFrame:
    rows = units(spark, folder)
    counts = rows.groupBy("speaker").agg(F.count(F.lit(1)).alias("n"))
    weight = counts.withColumn("w", F.sqrt(counts.agg(F.avg("n").alias("m")).scalar() / F.col("n"))).select("speaker", "w")
    cents = C.centroids(rows.join(weight, "speaker"), "w")
    return cents.select("cluster", F.posexplode("centroid").alias("dim", "x")).select("cluster", F.col("dim").cast("bigint").alias("dim"), R("x").alias("x"))


@query(f"WITH {SIM} SELECT cluster, round(avg(similarity), 6) AS coherence FROM sim WHERE cluster = other GROUP BY 1")
def cluster_coherence(spark, folder) -> DataFrame:
    rows = units(spark, folder)
    return C.own_similarity(rows, C.centroids(rows)).groupBy("cluster").agg(R(F.avg("similarity")).alias("coherence"))


@query(f"WITH {PAIR} SELECT round(avg((1 - similarity) / 2), 6) AS separation, count(*) AS pairs FROM pr")
def cluster_separation(spark, folder) -> DataFrame:
    return C.centroid_pairs(C.centroids(units(spark, folder))).agg(R(F.avg((1 - F.col("similarity")) / 2)).alias("separation"), F.count(F.lit(1)).alias("pairs"))


@query(f"WITH {PAIR} SELECT a, b, round(similarity, 6) AS similarity FROM pr WHERE similarity >= 0.85 * 0.1")
def concept_cosine_links(spark, folder) -> DataFrame:
    return C.centroid_pairs(C.centroids(units(spark, folder))).filter(F.col("similarity") >= 0.85 * 0.1).withColumn("similarity", R("similarity"))


@query(f"WITH {U}, {SZ} SELECT cluster, CAST(size AS BIGINT) AS size, support, round(max_share, 6) AS max_share FROM sz")
def cluster_sizes_dominance(spark, folder) -> DataFrame:
    return C.sizes(units(spark, folder)).withColumn("max_share", R("max_share"))


@query(f"WITH {U}, {SZ}, p AS (SELECT size / sum(size) OVER () AS p, size FROM sz), r AS (SELECT count(*) AS k, max(p) AS m, -sum(p * ln(p)) / ln(count(*)) AS e, count(*) FILTER (size < 3) / count(*)::DOUBLE AS mi FROM p) SELECT k AS clusters, round(m, 6) AS max_share, round(e, 6) AS entropy, round(mi, 6) AS micro_ratio, round(0.5 * (1 - abs(m - 1.0 / k)) + 0.3 * (1 - e) + 0.2 * (1 - mi), 6) AS labelability FROM r")
def cluster_labelability(spark, folder) -> DataFrame:
    row = C.labelability(C.sizes(units(spark, folder)))
    return row.select("clusters", R("max_share").alias("max_share"), R("entropy").alias("entropy"), R("micro_ratio").alias("micro_ratio"), R("labelability").alias("labelability"))


@query(f"WITH {SIM} SELECT round(avg(own - best), 6) AS silhouette, count(*) AS units FROM (SELECT unit, max(similarity) FILTER (cluster = other) AS own, max(similarity) FILTER (cluster <> other) AS best FROM sim GROUP BY 1)")
def cluster_silhouette_lite(spark, folder) -> DataFrame:
    rows = units(spark, folder)
    own = F.col("cluster") == F.col("other")
    each = C.similarities(rows, C.centroids(rows)).groupBy("unit").agg(F.max(F.when(own, F.col("similarity"))).alias("own"), F.max(F.when(~own, F.col("similarity"))).alias("best"))
    return each.agg(R(F.avg(F.col("own") - F.col("best"))).alias("silhouette"), F.count(F.lit(1)).alias("units"))


@query(f"WITH {PAIR}, {SZ}, g AS (SELECT (n + 1)::DOUBLE / n - 2 * area / (n * total) AS gini FROM (SELECT count(*) AS n, sum(run) AS area, sum(size) AS total FROM (SELECT size, sum(size) OVER (ORDER BY size, cluster ROWS UNBOUNDED PRECEDING) AS run FROM sz))), r AS (SELECT greatest(max(similarity), 0) AS red FROM pr) SELECT round(gini, 6) AS gini, round(red, 6) AS redundancy, (SELECT count(*) FILTER (support < 2) FROM sz) AS support_violations, (SELECT count(*) FILTER (size < 3) FROM sz) AS mass_violations, round(greatest(0, 1 - 0.3 * gini - 0.2 * CASE WHEN red > 0.85 THEN (red - 0.85) / 0.15 ELSE 0 END), 6) AS score, (SELECT count(*) FILTER (support < 2 OR size < 3) = 0 FROM sz) AS valid FROM g, r")
def cluster_cut_quality(spark, folder) -> DataFrame:
    rows = units(spark, folder)
    q = C.cut_quality(rows, C.centroids(rows))
    return q.withColumns({c: R(c) for c in ("gini", "redundancy", "score")})


@query(f"WITH {U}, c AS (SELECT cluster, speaker, count(*) AS n FROM u GROUP BY 1, 2), t AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM c), r AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY cluster)), k AS (SELECT sum(n * (n - 1) / 2) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY speaker)) SELECT round((t.s - r.s * k.s / (t.n * (t.n - 1) / 2)) / ((r.s + k.s) / 2 - r.s * k.s / (t.n * (t.n - 1) / 2)), 6) AS adjusted_rand FROM t, r, k")
def adjusted_rand_index(spark, folder) -> DataFrame:
    return C.rand_index(units(spark, folder), "cluster", "speaker").withColumn("adjusted_rand", R("adjusted_rand"))


@query(f"WITH {SIM} SELECT unit, arg_max(other, (similarity, -other)) AS nearest, round(max(similarity), 6) AS similarity FROM sim GROUP BY 1")
def lloyd_step(spark, folder) -> DataFrame:
    rows = units(spark, folder)
    best = F.max(F.struct("similarity", (-F.col("other")).alias("o"))).alias("b")
    return C.similarities(rows, C.centroids(rows)).groupBy("unit").agg(best).select("unit", (-F.col("b.o")).alias("nearest"), R("b.similarity").alias("similarity"))


@query(f"WITH {U} SELECT cluster, row_number() OVER (ORDER BY min(unit)) - 1 AS relabelled FROM u GROUP BY 1")
def relabel_first_seen(spark, folder) -> DataFrame:
    first = units(spark, folder).groupBy("cluster").agg(F.min("unit").alias("first"))
    return first.select("cluster", (F.row_number().over(W.orderBy("first")) - 1).cast("bigint").alias("relabelled"))


@query(
    f"""WITH {SIM}, a AS (SELECT unit, other, greatest(0, similarity) AS s, row_number() OVER (PARTITION BY unit ORDER BY greatest(0, similarity) DESC, other) AS place FROM sim), b AS (SELECT unit, other, place, s / coalesce(nullif(sum(s) OVER (PARTITION BY unit), 0), 1) AS w FROM a WHERE place <= 3),
 c AS (SELECT *, max(w) OVER (PARTITION BY unit) AS most FROM b), d AS (SELECT unit, other, place, w / coalesce(nullif(sum(w) OVER (PARTITION BY unit), 0), 1) AS w, count(*) OVER (PARTITION BY unit) AS many FROM c WHERE w >= 0.1 OR (most < 0.1 AND place = 1)),
 e AS (SELECT *, many > 1 AND round(sum(CASE WHEN w > 0 THEN -w * log2(w) ELSE 0 END) OVER (PARTITION BY unit) / log2(many), 9) > 0.8 AS hard FROM d) SELECT unit, other AS concept, round(CASE WHEN hard THEN 1.0 ELSE w END, 6) AS weight FROM e WHERE NOT hard OR place = 1"""
)
def soft_membership(spark, folder) -> DataFrame:
    rows = units(spark, folder)
    return C.soft_membership(C.similarities(rows, C.centroids(rows))).withColumn("weight", R("weight"))


@query(f"WITH {SIM} SELECT other AS cluster, unit, round(similarity, 6) AS similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY other ORDER BY round(similarity, 9) DESC, unit) AS place FROM sim) WHERE place <= 5")
def nearest_units_topk(spark, folder) -> DataFrame:
    rows = units(spark, folder)
    order = W.partitionBy("other").orderBy(F.desc(F.round("similarity", 9)), "unit")
    first = C.similarities(rows, C.centroids(rows)).withColumn("place", F.row_number().over(order)).filter("place <= 5")
    return first.select(F.col("other").alias("cluster"), "unit", R("similarity").alias("similarity"), "place")


_AXIS = L + ", ap AS (SELECT dim, avg(x) FILTER (cluster = 0) - avg(x) FILTER (cluster = 1) AS d FROM x GROUP BY 1), av AS (SELECT list(d / (SELECT sqrt(sum(d * d)) FROM ap) ORDER BY dim) AS axis FROM ap)"


@query(f"WITH {_AXIS} SELECT cluster, round(avg(list_dot_product(v, axis)), 6) AS score FROM u, av GROUP BY 1")
def anchor_projection(spark, folder) -> DataFrame:
    rows = units(spark, folder)
    axis = layout.axis_vector(rows.filter("cluster = 0"), rows.filter("cluster = 1"))
    scored = rows.withColumn("axis", axis.scalar())
    return scored.groupBy("cluster").agg(R(F.avg(N.dot(F.col("v"), F.col("axis")))).alias("score"))


@query(f"WITH {_AXIS}, sc AS (SELECT unit, round(list_dot_product(v, axis), 9) AS s FROM u, av) SELECT 'low' AS pole, unit, round(s, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY s, unit) AS p FROM sc) WHERE p <= 3 UNION ALL SELECT 'high', unit, round(s, 6) FROM (SELECT *, row_number() OVER (ORDER BY s DESC, unit) AS p FROM sc) WHERE p <= 3")
def axis_extremes(spark, folder) -> DataFrame:
    rows = units(spark, folder)
    axis = layout.axis_vector(rows.filter("cluster = 0"), rows.filter("cluster = 1"))
    scored = rows.withColumn("axis", axis.scalar()).select("unit", F.round(N.dot(F.col("v"), F.col("axis")), 9).alias("s"))
    side = lambda pole, o: scored.orderBy(o, "unit").limit(3).select(F.lit(pole).alias("pole"), "unit", R("s").alias("score"))
    return side("low", F.asc("s")).union(side("high", F.desc("s")))


@query(f"WITH {L}, m AS (SELECT dim, avg(x) AS m FROM x GROUP BY 1) SELECT x.dim, round(sum((x - m) * (x - m)), 6) AS variance FROM x JOIN m USING (dim) GROUP BY 1")
def centred_variance(spark, folder) -> DataFrame:
    return layout.centred(units(spark, folder)).groupBy("dim").agg(R(F.sum(F.col("x") * F.col("x"))).alias("variance")).select(F.col("dim").cast("bigint").alias("dim"), "variance")


_VAR = f"WITH {L}, m AS (SELECT dim, avg(x) AS m FROM x GROUP BY 1), va AS (SELECT row_number() OVER (ORDER BY sum((x - m) * (x - m)) DESC, x.dim) AS dim, sum((x - m) * (x - m)) AS variance FROM x JOIN m USING (dim) GROUP BY x.dim)"


def _spectrum(spark, folder) -> DataFrame:
    v = layout.centred(units(spark, folder)).groupBy("dim").agg(F.sum(F.col("x") * F.col("x")).alias("variance"))
    return v.select(F.row_number().over(W.orderBy(F.desc("variance"), "dim")).alias("dim"), "variance")


@query(_VAR + " SELECT CAST(min(dim) AS INT) AS dims FROM (SELECT dim, sum(variance) OVER (ORDER BY dim) / sum(variance) OVER () AS part FROM va) WHERE part >= 0.9 - 1e-9")
def dims_by_threshold(spark, folder) -> DataFrame:
    return layout.dims_by_threshold(_spectrum(spark, folder), 0.9)


@query(_VAR + ", e AS (SELECT (SELECT variance FROM va WHERE dim = 1) AS v1, (SELECT variance FROM va ORDER BY dim DESC LIMIT 1) AS vn, (SELECT count(*) FROM va) AS n), d AS (SELECT dim, round(abs((vn - v1) * (dim - 1) - (n - 1) * (variance - v1)) / sqrt((vn - v1) * (vn - v1) + (n - 1.0) * (n - 1)), 9) AS away FROM va, e) SELECT CAST(min(dim) AS INT) AS dims FROM d WHERE away = (SELECT max(away) FROM d)")
def dims_by_elbow(spark, folder) -> DataFrame:
    return layout.dims_by_elbow(_spectrum(spark, folder))


@query("WITH i AS (SELECT unnest(range(12)) AS i), d AS (SELECT i, 1 - 2.0 * i / 11 AS y FROM i) SELECT i AS dim, round(cos(i * pi() * (3 - sqrt(5))) * sqrt(greatest(0, 1 - y * y)), 6) AS x, round(y, 6) AS y, round(sin(i * pi() * (3 - sqrt(5))) * sqrt(greatest(0, 1 - y * y)), 6) AS z FROM d")
def axis_directions(spark, folder) -> DataFrame:
    x, y, z = N.sphere_direction(F.col("id"), F.lit(12))
    return spark.range(12).select(F.col("id").alias("dim"), R(x).alias("x"), R(y).alias("y"), R(z).alias("z"))


@query(f"WITH {U}, p AS (SELECT unit, v[1] AS x, v[2] AS y, v[3] AS z FROM u), b AS (SELECT greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS r, (max(x) + min(x)) / 2 AS cx, (max(y) + min(y)) / 2 AS cy, (max(z) + min(z)) / 2 AS cz FROM p) SELECT unit, round((x - cx) / r * 20, 6) AS x, round((y - cy) / r * 20, 6) AS y, round((z - cz) / r * 20, 6) AS z FROM p, b")
def coordinate_normalize(spark, folder) -> DataFrame:
    p = units(spark, folder).select("unit", *[F.get("v", F.lit(i)).alias(c) for i, c in enumerate("xyz")])
    return layout.normalized(p, ["x", "y", "z"], 10.0).select("unit", *[R(c).alias(c) for c in "xyz"])


@query(f"WITH {U} SELECT n AS corpus, k, CASE WHEN n < 100 THEN least(k, 8) ELSE least(k, 12) END AS adjusted, n >= 200 AS hierarchy, CAST(greatest(4, round(sqrt(n))) AS INT) AS k_min, CAST(greatest(greatest(4, round(sqrt(n))) + 1, least(20, floor(n / 4))) AS INT) AS k_max FROM (SELECT cluster, count(*) AS n, CAST(6 + cluster % 10 AS INT) AS k FROM u GROUP BY 1)")
def concept_policy(spark, folder) -> DataFrame:
    n = units(spark, folder).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).select("n", (6 + F.col("cluster") % 10).cast("int").alias("k"))
    adjusted, hierarchy = N.concept_policy(F.col("k"), F.col("n"))
    low, high = N.k_range(F.col("n"))
    return n.select(F.col("n").alias("corpus"), "k", adjusted.alias("adjusted"), hierarchy.alias("hierarchy"), low.alias("k_min"), high.alias("k_max"))


@query(f"WITH {CT}, q AS (SELECT cluster, list_transform(list_filter(list_zip(range(len(c)), c), p -> p[1] % 1 = 0), p -> floor(p[2] * 1000 + 0.5)::BIGINT) AS k FROM ct) SELECT cluster, substr(sha256(array_to_string(k, '|')), 1, 12) AS stable_id FROM q".replace("p -> ", "lambda p: "))
def stable_concept_ids(spark, folder) -> DataFrame:
    return C.centroids(units(spark, folder)).select("cluster", layout.stable_id("centroid").alias("stable_id"))


@query()
def kmeans_cosine(spark, folder) -> DataFrame:
    return training.spherical_kmeans(units(spark, folder).select("unit", "v"), 10, seed=42)


@query()
def auto_k(spark, folder) -> DataFrame:
    return training.sweep(units(spark, folder).select("unit", "v"), [4, 8, 12], [42, 43])


@query()
def semantic_merge(spark, folder) -> DataFrame:
    rows = units(spark, folder)
    return training.merged(C.sizes(rows).select("cluster", "size"), C.centroid_pairs(C.centroids(rows)), 0.1)


@query()
def agglomerative_merges(spark, folder) -> DataFrame:
    return training.dendrogram(C.centroids(units(spark, folder)))


@query()
def pca_positions(spark, folder) -> DataFrame:
    return layout.pca(C.centroids(units(spark, folder)).select(F.col("cluster").alias("unit"), F.col("centroid").alias("v")), 3)
