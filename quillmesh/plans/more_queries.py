"""Queries on axes, alignment, evidence and visibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.operators import clusters as C
from quillmesh.operators import graph as G
from quillmesh.operators import speakers as SP
from quillmesh.operators import term_statistics as TS
from quillmesh.plans import graph_queries as GQ
from quillmesh.plans import oracle as O
from quillmesh.plans import text_queries as TQ
from quillmesh.plans import vector_queries as VQ
from quillmesh.sources.tables import memberships, sentence_facts, table

QUERIES, ORACLES = {}, {}
R = lambda c: F.round(c, 6)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {VQ.L} SELECT dim, round(max(abs(x)), 6) AS extent, min(unit) FILTER (x = lo) AS lowest, min(unit) FILTER (x = hi) AS highest FROM (SELECT *, min(x) OVER (PARTITION BY dim) AS lo, max(x) OVER (PARTITION BY dim) AS hi FROM x) GROUP BY 1")
def axis_extent(spark, folder) -> DataFrame:
    """Per dimension the greatest absolute value and the units at both ends, ties to the least unit."""
    each = VQ.units(spark, folder).select("unit", F.posexplode("v").alias("dim", "x"))
    low, high = F.min(F.struct("x", "unit")), F.max(F.struct("x", (-F.col("unit")).alias("u")))
    rows = each.groupBy("dim").agg(R(F.max(F.abs("x"))).alias("extent"), low["unit"].alias("lowest"), (-high["u"]).alias("highest"))
    return rows.select(F.col("dim").cast("bigint").alias("dim"), "extent", "lowest", "highest")


@query(f"WITH {VQ.L}, e AS (SELECT dim, max(abs(x)) AS extent FROM x GROUP BY 1) SELECT speaker, x.dim, round(greatest(-1.0, least(1.0, avg(x) / extent)), 6) AS profile FROM x JOIN e USING (dim) GROUP BY speaker, x.dim, extent")
def speaker_axis_profile(spark, folder) -> DataFrame:
    """A speaker's mean on each axis over the axis's extent."""
    each = VQ.units(spark, folder).select("speaker", F.posexplode("v").alias("dim", "x"))
    both = each.groupBy("dim", "speaker").agg(F.avg("x").alias("mean"), F.max(F.abs("x")).alias("most"))
    part = F.col("mean") / F.max("most").over(W.partitionBy("dim"))
    return both.select("speaker", F.col("dim").cast("bigint").alias("dim"), R(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), part))).alias("profile"))


@query(VQ._VAR + " SELECT CAST(dim AS INT) AS dim, round(variance / sum(variance) OVER (), 6) AS share, round(sum(variance) OVER (ORDER BY dim) / sum(variance) OVER (), 6) AS cumulative, round(variance - lag(variance) OVER (ORDER BY dim), 6) AS step FROM va")
def variance_share(spark, folder) -> DataFrame:
    """Share, cumulative share and first difference of the variances, greatest first; a row per dimension."""
    v, by, all_ = F.col("variance"), W.orderBy("dim"), F.sum("variance").over(W.partitionBy())
    run = F.sum("variance").over(by.rowsBetween(W.unboundedPreceding, W.currentRow))
    return VQ._spectrum(spark, folder).select("dim", R(v / all_).alias("share"), R(run / all_).alias("cumulative"), R(v - F.lag("variance").over(by)).alias("step"))


_HALF = VQ.L + ", cs AS (SELECT unit % 2 AS side, cluster, dim, sum(x) AS s FROM x GROUP BY 1, 2, 3), cn AS (SELECT side, cluster, dim, s / sqrt(sum(s * s) OVER (PARTITION BY side, cluster)) AS x FROM cs)"


@query(f"WITH {_HALF} SELECT a.cluster AS a, b.cluster AS b, round(sum(a.x * b.x), 6) AS similarity FROM cn a JOIN cn b ON a.dim = b.dim AND a.side = 0 AND b.side = 1 GROUP BY 1, 2 HAVING sum(a.x * b.x) >= 0.1")
def alignment_links(spark, folder) -> DataFrame:
    """Concepts of two corpora (units of even and of odd number) that are alike, in the space of the vectors."""
    rows = VQ.units(spark, folder)
    long = lambda side: C.centroids(rows.filter(F.col("unit") % 2 == side)).select("cluster", F.posexplode("centroid").alias("dim", "x"))
    l, r = long(0).alias("l"), long(1).alias("r")
    sims = l.join(r, F.expr("l.dim = r.dim")).groupBy(F.col("l.cluster").alias("a"), F.col("r.cluster").alias("b")).agg(F.sum(F.expr("l.x * r.x")).alias("similarity"))
    return sims.filter("similarity >= 0.1").withColumn("similarity", R("similarity"))


@query(f"WITH {VQ.SIM} SELECT u.unit, count(o.other) AS attached, min(o.other) AS first FROM u LEFT JOIN (SELECT unit, other FROM sim WHERE similarity >= 0.25) o ON o.unit = u.unit GROUP BY 1")
def item_attach_left_outer(spark, folder) -> DataFrame:
    """Every item with the concepts it is as near to as 0.25; items without any stay."""
    rows = VQ.units(spark, folder)
    near = F.col("similarity") >= 0.25
    return C.similarities(rows, C.centroids(rows)).groupBy("unit").agg(F.count_if(near).alias("attached"), F.min(F.when(near, F.col("other"))).alias("first"))


@query(f"{GQ._M}, b AS (SELECT DISTINCT s.sent_id, c FROM (SELECT sent_id, unnest(x.chunk_ids) AS c FROM s JOIN sentences x USING (sent_idx, sent_id)) s WHERE c IS NOT NULL), l AS (SELECT c, count(*) AS n FROM b GROUP BY 1), cc AS (SELECT c, concept_id, sum(weight) / sum(sum(weight)) OVER (PARTITION BY c) AS w FROM b JOIN m USING (sent_id) GROUP BY 1, 2), p AS (SELECT sent_id, concept_id, sum(w / n) AS w FROM b JOIN l USING (c) JOIN cc USING (c) GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY round(w, 9) DESC, concept_id) AS place FROM p) SELECT sent_id, concept_id, round(w / sum(w) OVER (PARTITION BY sent_id), 8) AS weight FROM t WHERE place <= 3".replace("USING (sent_idx, sent_id)", "ON x.sent_idx = s.sent_idx").replace("SELECT sent_id, unnest(x.chunk_ids)", "SELECT s.sent_id, unnest(x.chunk_ids)"))
def membership_back_projection(spark, folder) -> DataFrame:
    """Memberships of chunks, spread over their sentences in equal parts; the top three of a sentence as shares."""
    facts = SP.attributed(sentence_facts(spark, folder))
    bridge = facts.select("sent_id", F.explode("chunk_ids").alias("c")).filter("c is not null").distinct()
    size = bridge.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    mass = bridge.join(memberships(facts).select("sent_id", "concept_id", "weight"), "sent_id").groupBy("c", "concept_id").agg(F.sum("weight").alias("w"))
    chunk = mass.withColumn("w", F.col("w") / F.sum("w").over(W.partitionBy("c")))
    back = bridge.join(size, "c").join(chunk, "c").groupBy("sent_id", "concept_id").agg(F.sum(F.col("w") / F.col("n")).alias("w")).withColumn("o", F.round("w", 9))
    top = TS.top_by(back, "sent_id", [F.desc("o"), "concept_id"], 3)
    return top.select("sent_id", "concept_id", F.round(F.col("w") / F.sum("w").over(W.partitionBy("sent_id")), 8).alias("weight"))


@query(
    f"{TQ._DISCRIM}, {O.M}, sg AS (SELECT concept_id, term FROM (SELECT concept_id, term, row_number() OVER (PARTITION BY concept_id ORDER BY count(*) DESC, term) AS p FROM n JOIN (SELECT sent_id, concept_id FROM m WHERE top) USING (sent_id) GROUP BY 1, 2) WHERE p <= 12), "
    "f AS (SELECT m.concept_id, m.sent_id, avg(i.idf * i.df) AS salience FROM m JOIN n USING (sent_id) JOIN sg ON sg.concept_id = m.concept_id AND sg.term = n.term JOIN i ON i.term = n.term WHERE m.top GROUP BY 1, 2), "
    "r AS (SELECT m.concept_id, m.sent_id, 0.7 * m.weight + 0.3 * coalesce(salience, 0) AS score FROM m LEFT JOIN f USING (concept_id, sent_id) WHERE m.top) "
    "SELECT concept_id, sent_id, round(score, 5) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY round(score, 7) DESC, sent_id) AS place FROM r) WHERE place <= 3"
)
def evidence_ranking(spark, folder) -> DataFrame:
    """The three sentences of a concept with the best sum of membership (0.7) and mean score of its signature phrases (0.3)."""
    grams = TQ._grams(spark, folder)
    own = memberships(sentence_facts(spark, folder)).filter("top").select("sent_id", "concept_id", "weight")
    each = grams.select("sent_id", F.explode_outer("terms").alias("term")).filter("term is not null").join(own, "sent_id")
    counted = each.groupBy("concept_id", "term").agg(F.count(F.lit(1)).alias("c"))
    signature = TS.top_by(counted, "concept_id", [F.desc("c"), "term"], 12).select("concept_id", "term")
    scores = TS.discriminative_scores(grams, "sent_id", "terms").select("term", F.col("score").alias("s"))
    salience = each.join(signature, ["concept_id", "term"], "left_semi").join(scores, "term").groupBy("concept_id", "sent_id").agg(F.avg("s").alias("salience"))
    ranked = own.join(salience, ["concept_id", "sent_id"], "left").withColumn("score", 0.7 * F.col("weight") + 0.3 * F.coalesce("salience", F.lit(0.0)))
    place = F.row_number().over(W.partitionBy("concept_id").orderBy(F.desc(F.round("score", 7)), "sent_id"))
    return ranked.withColumn("place", place).filter("place <= 3").select("concept_id", "sent_id", F.round("score", 5).alias("score"), "place")


@query(f"{GQ._LK} SELECT id, kind = 'speakerConcept' AND stance IN ('critique', 'suggestion') AND weight >= 0.1 AS visible FROM lk")
def visibility_toggles(spark, folder) -> DataFrame:
    """Links with whether the chosen kinds, stances and least weight show them."""
    shown = (F.col("kind") == "speakerConcept") & F.col("stance").isin("critique", "suggestion") & (F.col("weight") >= 0.1)
    return GQ.links(spark, folder).select("id", shown.alias("visible"))


@query("WITH t AS (SELECT DISTINCT lower(trim(t)) AS tag FROM (SELECT unnest(tags) AS t FROM comments) WHERE trim(t) <> ''), c AS (SELECT tag FROM t ORDER BY tag LIMIT 1) SELECT tag FROM t WHERE contains(tag, 'a') AND tag NOT IN (SELECT tag FROM c)")
def tag_autocomplete(spark, folder) -> DataFrame:
    """Tags that hold the typed text and are not chosen yet."""
    tags = table(spark, folder, "comments").select(F.explode("tags").alias("t")).filter("trim(t) <> ''").select(F.lower(F.trim("t")).alias("tag")).distinct()
    return tags.filter(F.col("tag").contains("a")).join(tags.orderBy("tag").limit(1), "tag", "left_anti")


@query(f"{GQ._SC}, p AS (SELECT concept_id, CAST(sum(hard_count) AS DOUBLE) AS x, sum(mass) AS y FROM sc GROUP BY 1) SELECT speaker, round(sum(weight * x) / sum(weight), 6) AS x, round(sum(weight * y) / sum(weight), 6) AS y FROM sc JOIN p USING (concept_id) GROUP BY 1")
def speaker_positions(spark, folder) -> DataFrame:
    """Speakers at the weighted mean of their concepts' coordinates (here hard count and mass)."""
    m = SP.speaker_concept(GQ.members(spark, folder))
    at = m.groupBy("concept_id").agg(F.sum("hard_count").cast("double").alias("x"), F.sum("mass").alias("y"))
    mean = lambda c: R(F.sum(F.col("weight") * F.col(c)) / F.sum("weight")).alias(c)
    return m.join(at, "concept_id").groupBy("speaker").agg(mean("x"), mean("y"))


@query(f"WITH {O.K} SELECT concept_id, base || CASE WHEN n = 0 THEN '' ELSE '-' || n END AS unique_label FROM (SELECT concept_id, lower(trim(label)) AS base, row_number() OVER (PARTITION BY lower(trim(label)) ORDER BY concept_id) - 1 AS n FROM k)")
def duplicate_suffixes(spark, folder) -> DataFrame:
    """Labels made unique by a number behind repeats."""
    from quillmesh.sources.tables import concept_facts

    base = F.lower(F.trim("label"))
    rows = concept_facts(spark, folder).select("concept_id", base.alias("base")).withColumn("n", F.row_number().over(W.partitionBy("base").orderBy("concept_id")) - 1)
    return rows.select("concept_id", F.concat("base", F.when(F.col("n") == 0, "").otherwise(F.concat(F.lit("-"), "n"))).alias("unique_label"))


@query(f"{GQ._LK}, {GQ._ND}, {GQ._EP} SELECT nd.id, arg_max(other, (ep.weight, other)) AS strongest, round(max(ep.weight), 8) AS weight FROM nd JOIN ep ON ep.id = nd.id WHERE type = 'speaker' GROUP BY 1")
def strongest_concept(spark, folder) -> DataFrame:
    """A speaker's strongest link, ties to the greatest id."""
    best = F.max(F.struct("weight", "other"))
    rows = G.endpoints(GQ.links(spark, folder)).filter(F.col("id").startswith("speaker:")).groupBy("id").agg(best.alias("b"))
    return rows.select("id", F.col("b.other").alias("strongest"), F.round("b.weight", 8).alias("weight"))
