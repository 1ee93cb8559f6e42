"""Queries on speakers, concepts, the graph of both, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions import numbers as N
from quillmesh.functions import text as T
from quillmesh.operators import graph as G
from quillmesh.operators import reports as RP
from quillmesh.operators import speakers as SP
from quillmesh.operators import term_statistics as TS
from quillmesh.plans import oracle as O
from quillmesh.session import materialise
from quillmesh.sources.tables import concept_facts, memberships, sentence_facts, table

QUERIES, ORACLES = {}, {}
# Ten digits, as shares of few sentences often end in a five at the seventh.
R = lambda c: F.round(c, 10)
SIMILAR = 0.35


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def members(spark: SparkSession, folder: str) -> DataFrame:
    return memberships(SP.attributed(sentence_facts(spark, folder)))


_S = O.S.replace("WHERE rn = 1 AND", "WHERE coalesce(nullif(trim(speaker), ''), 'Unattributed') <> 'Unattributed' AND rn = 1 AND")
_M = f"WITH {_S}, {O.M}"
_SC = f"{_M}, {O.SC}"
_DS = "ds AS (SELECT speaker, concept_id, stance, evidence FROM (SELECT *, row_number() OVER (PARTITION BY speaker, concept_id ORDER BY n DESC, list_position(['praise', 'critique', 'suggestion', 'neutral'], stance)) AS p, CAST(sum(n) OVER (PARTITION BY speaker, concept_id) AS BIGINT) AS evidence FROM (SELECT speaker, concept_id, stance, count(*) AS n FROM m GROUP BY 1, 2, 3)) WHERE p = 1)"
_LK = f"{_SC}, {_DS}, lk AS (SELECT 'speaker:' || speaker || '->' || concept_id AS id, 'speaker:' || speaker AS source, concept_id AS target, 'speakerConcept' AS kind, weight, stance, coalesce(evidence, 0) AS evidence FROM sc LEFT JOIN ds USING (speaker, concept_id) WHERE weight > 0.05)"
_ND = "nd AS (SELECT id, 'speaker' AS type, sum(mass) AS weight FROM (SELECT 'speaker:' || speaker AS id, mass FROM sc) GROUP BY 1 UNION ALL SELECT concept_id, 'concept', sum(mass) FROM sc GROUP BY 1)"
_EP = "ep AS (SELECT source AS id, target AS other, weight FROM lk UNION ALL SELECT target, source, weight FROM lk)"


@query(f"{_M} SELECT sent_id, concept_id, round(weight, 10) AS weight, top FROM m")
def sentence_memberships(spark, folder) -> DataFrame:
    return members(spark, folder).select("sent_id", "concept_id", R("weight").alias("weight"), "top")


@query(f"{_SC} SELECT speaker, concept_id, round(mass, 10) AS mass, hard_count, round(weight, 10) AS weight FROM sc")
def speaker_concept_matrix(spark, folder) -> DataFrame:
    m = SP.speaker_concept(members(spark, folder))
    return m.select("speaker", "concept_id", R("mass").alias("mass"), "hard_count", R("weight").alias("weight"))


@query(f"{_M} SELECT concept_id, round(sum(weight), 10) AS mass, count(*) FILTER (top) AS hard_count, count(DISTINCT speaker) AS speakers FROM m GROUP BY 1")
def concept_mass(spark, folder) -> DataFrame:
    return members(spark, folder).groupBy("concept_id").agg(R(F.sum("weight")).alias("mass"), F.count_if("top").alias("hard_count"), F.countDistinct("speaker").alias("speakers"))


@query(f"{_M} SELECT concept_id, round(count(*) FILTER (stance = 'praise') / count(*)::DOUBLE, 10) AS praise, round(count(*) FILTER (stance = 'critique') / count(*)::DOUBLE, 10) AS critique, round(count(*) FILTER (stance = 'suggestion') / count(*)::DOUBLE, 10) AS suggestion, round(count(*) FILTER (stance = 'neutral') / count(*)::DOUBLE, 10) AS neutral FROM m GROUP BY 1")
def concept_stance_mix(spark, folder) -> DataFrame:
    share = lambda s: R(F.count_if(F.col("stance") == s) / F.count(F.lit(1))).alias(s)
    return members(spark, folder).groupBy("concept_id").agg(*[share(s) for s in ("praise", "critique", "suggestion", "neutral")])


def links(spark, folder) -> DataFrame:
    m = members(spark, folder)
    return G.speaker_concept_links(SP.speaker_concept(m), SP.dominant_stance(m))


def nodes(spark, folder) -> DataFrame:
    m = SP.speaker_concept(members(spark, folder))
    s = m.groupBy(F.concat(F.lit("speaker:"), "speaker").alias("id")).agg(F.lit("speaker").alias("type"), F.sum("mass").alias("weight"))
    return s.unionByName(m.groupBy(F.col("concept_id").alias("id")).agg(F.lit("concept").alias("type"), F.sum("mass").alias("weight")))


@query(f"{_LK} SELECT id, source, target, kind, round(weight, 10) AS weight, stance, evidence FROM lk")
def dominant_stance_links(spark, folder) -> DataFrame:
    return links(spark, folder).withColumn("weight", R("weight"))


_CLS = "sg AS (SELECT speaker, list((concept_id, round(weight, 9)) ORDER BY concept_id) AS g FROM sc GROUP BY 1), cl AS (SELECT speaker, min(speaker) OVER (PARTITION BY g) AS class_id FROM sg)"


@query(f"{_SC}, {_CLS} SELECT speaker, class_id FROM cl")
def speaker_similarity_classes(spark, folder) -> DataFrame:
    return SP.distribution_classes(SP.speaker_concept(members(spark, folder)), "speaker", "concept_id", "weight")


@query(
    f"{_SC}, {_CLS}, r AS (SELECT speaker AS c, concept_id, weight AS p FROM sc JOIN cl USING (speaker) WHERE speaker = class_id), j AS (SELECT a.c AS class_a, b.c AS class_b, sum(-(a.p * log2(a.p / (a.p + b.p)) + b.p * log2(b.p / (a.p + b.p))) / 2) AS similarity FROM r a JOIN r b ON a.concept_id = b.concept_id AND a.c < b.c GROUP BY 1, 2) SELECT class_a, class_b, round(similarity, 10) AS similarity FROM j WHERE similarity >= {SIMILAR}"
)
def speaker_js_similarity(spark, folder) -> DataFrame:
    m = materialise(SP.speaker_concept(members(spark, folder)), "speaker-concept")
    return SP.entropy_links(m, "speaker", "concept_id", "weight", SIMILAR)[0].withColumn("similarity", R("similarity"))


@query(f"{_SC}, n AS (SELECT concept_id, speaker, weight / sqrt(sum(weight * weight) OVER (PARTITION BY concept_id)) AS u FROM sc), j AS (SELECT a.concept_id AS owner_a, b.concept_id AS owner_b, sum(a.u * b.u) AS similarity FROM n a JOIN n b ON a.speaker = b.speaker AND a.concept_id < b.concept_id GROUP BY 1, 2) SELECT owner_a, owner_b, round(similarity, 10) AS similarity FROM j WHERE similarity >= {SIMILAR} * 0.7")
def concept_similarity_speaker_space(spark, folder) -> DataFrame:
    m = materialise(SP.speaker_concept(members(spark, folder)), "speaker-concept")
    return SP.cosine_links(m, "concept_id", "speaker", "weight", SIMILAR * 0.7).withColumn("similarity", R("similarity"))


@query(f"{_LK}, {_ND} SELECT id, type, round(weight, 10) AS weight, round(least(6 + log2(weight + 1) * 8.4, 48), 10) AS size FROM nd")
def graph_nodes(spark, folder) -> DataFrame:
    return nodes(spark, folder).select("id", "type", R("weight").alias("weight"), R(N.node_size(F.col("weight"))).alias("size"))


@query(f"{_SC}, c AS (SELECT concept_id, sum(mass) AS mass, count(*) AS speakers, CAST(sum(hard_count) AS BIGINT) AS n FROM sc GROUP BY 1), a AS (SELECT avg(mass) AS mean FROM c) SELECT concept_id, CASE WHEN n >= 10 AND speakers >= 3 THEN 'high' WHEN n >= 5 AND speakers >= 2 THEN 'medium' ELSE 'low' END AS confidence, n < 5 AS low_volume, speakers = 1 AS single_speaker, mass < 0.3 * mean AS small_concept FROM c, a")
def concept_quality_flags(spark, folder) -> DataFrame:
    c = SP.speaker_concept(members(spark, folder)).groupBy("concept_id").agg(F.sum("mass").alias("mass"), F.count(F.lit(1)).alias("speakers"), F.sum("hard_count").alias("n"))
    mean = c.agg(F.avg("mass").alias("mean")).scalar()
    level = F.when((F.col("n") >= 10) & (F.col("speakers") >= 3), "high").when((F.col("n") >= 5) & (F.col("speakers") >= 2), "medium").otherwise("low")
    return c.select("concept_id", level.alias("confidence"), (F.col("n") < 5).alias("low_volume"), (F.col("speakers") == 1).alias("single_speaker"), (F.col("mass") < 0.3 * mean).alias("small_concept"))


@query(f"{_SC} SELECT speaker, concept_id, round(weight / sqrt(sum(mass) OVER (PARTITION BY concept_id)), 10) AS dampened FROM sc")
def popularity_dampening(spark, folder) -> DataFrame:
    m = SP.speaker_concept(members(spark, folder))
    return m.select("speaker", "concept_id", R(F.col("weight") / F.sqrt(F.sum("mass").over(W.partitionBy("concept_id")))).alias("dampened"))


@query(f"{_LK}, b AS (SELECT kind, min(weight) AS lo, max(weight) AS hi FROM lk GROUP BY 1), z AS (SELECT id, CASE WHEN abs(hi - lo) < 1e-6 THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END ELSE greatest(0.0, least(1.0, (weight - lo) / (hi - lo))) END AS normal FROM lk JOIN b USING (kind)) SELECT id, round(normal, 10) AS normal, round(pow(normal, 0.8), 10) AS width FROM z")
def link_weight_minmax(spark, folder) -> DataFrame:
    return G.normal_weight(links(spark, folder)).select("id", R("normal").alias("normal"), R("width").alias("width"))


@query(f"{_LK} SELECT id, round(cume_dist() OVER (ORDER BY evidence), 10) AS percentile FROM lk")
def evidence_percentile(spark, folder) -> DataFrame:
    return G.evidence_percentile(links(spark, folder)).select("id", R("percentile").alias("percentile"))


@query(f"{_LK}, {_ND}, {_EP}, own AS (SELECT id, id AS c FROM nd WHERE type = 'concept' UNION ALL SELECT id, min(other) FROM (SELECT ep.id, other, ep.weight AS weight, max(ep.weight) OVER (PARTITION BY ep.id) AS w FROM ep JOIN nd n ON n.id = ep.id AND n.type <> 'concept' JOIN nd o ON o.id = other AND o.type = 'concept') WHERE weight = w GROUP BY 1) SELECT lk.id, CASE WHEN a.c IS NOT NULL AND b.c IS NOT NULL AND a.c <> b.c THEN 'bridge' ELSE 'cluster-internal' END AS role FROM lk LEFT JOIN own a ON a.id = source LEFT JOIN own b ON b.id = target")
def structural_roles(spark, folder) -> DataFrame:
    return G.structural_roles(nodes(spark, folder), materialise(links(spark, folder), "links"))


@query(f"WITH {O.K} SELECT concept_id, label FROM k WHERE contains(lower(concat_ws(' ', label, array_to_string(top_terms, ' '))), 'light')")
def graph_search_filter(spark, folder) -> DataFrame:
    return G.search(concept_facts(spark, folder).withColumn("terms", F.array_join("top_terms", " ")), "light", "label", "terms").select("concept_id", "label")


@query(f"WITH {O.S}, t AS (SELECT DISTINCT unnest(source_tags) AS t FROM s), w AS (SELECT list(t) AS w FROM (SELECT t FROM t WHERE t IS NOT NULL ORDER BY t LIMIT 2)) SELECT sent_id FROM s, w WHERE list_has_any(source_tags, w)")
def tag_overlap_filter(spark, folder) -> DataFrame:
    facts = sentence_facts(spark, folder)
    wanted = facts.select(F.explode("source_tags").alias("t")).filter("t is not null").distinct().orderBy("t").limit(2)
    return facts.select("sent_id", F.explode("source_tags").alias("t")).join(F.broadcast(wanted), "t", "left_semi").select("sent_id").distinct()


@query(f"{_LK}, {_EP}, b AS (SELECT id FROM (SELECT id, count(*) AS n FROM ep GROUP BY 1 ORDER BY n DESC, id LIMIT 1)) SELECT DISTINCT unnest([ep.id, other]) AS id FROM ep JOIN b ON b.id = ep.id")
def one_hop_network(spark, folder) -> DataFrame:
    lk = materialise(links(spark, folder), "links")
    hub = G.endpoints(lk).groupBy("id").count().orderBy(F.desc("count"), "id").limit(1)
    return G.one_hop(lk, hub.select("id").scalar())


@query(f"{_LK}, {_ND}, {_EP}, ch AS (SELECT id FROM nd WHERE type = 'concept' ORDER BY weight DESC, id LIMIT 3) SELECT id FROM nd WHERE id IN (SELECT id FROM ch UNION SELECT other FROM ep JOIN ch USING (id) WHERE weight >= 0.2)")
def adaptive_visibility(spark, folder) -> DataFrame:
    nd, lk = materialise(nodes(spark, folder), "nodes"), materialise(links(spark, folder), "links")
    chosen = nd.filter("type = 'concept'").orderBy(F.desc("weight"), "id").limit(3)
    return G.visible(nd, lk, chosen, 0.2)


@query(f"{_LK}, {_ND} SELECT id FROM lk WHERE source IN (SELECT id FROM nd WHERE round(weight, 6) >= 2) AND target IN (SELECT id FROM nd WHERE round(weight, 6) >= 2)")
def dangling_link_prune(spark, folder) -> DataFrame:
    return G.without_dangling(links(spark, folder), nodes(spark, folder).filter("round(weight, 6) >= 2")).select("id")


@query(f"{_LK}, n AS (SELECT concept_id, speaker, weight / sqrt(sum(weight * weight) OVER (PARTITION BY concept_id)) AS u FROM sc), j AS (SELECT sum(a.u * b.u) AS s FROM n a JOIN n b ON a.speaker = b.speaker AND a.concept_id < b.concept_id GROUP BY a.concept_id, b.concept_id), al AS (SELECT kind, weight FROM lk UNION ALL SELECT 'conceptConcept', s FROM j WHERE s >= {SIMILAR}) SELECT kind, count(*) AS links, round(min(weight), 10) AS low, round(max(weight), 10) AS high FROM al GROUP BY 1")
def graph_union_all(spark, folder) -> DataFrame:
    m = materialise(SP.speaker_concept(members(spark, folder)), "speaker-concept")
    pairs = SP.cosine_links(m, "concept_id", "speaker", "weight", SIMILAR)
    every = links(spark, folder).unionByName(G.similarity_links(pairs, "owner_a", "owner_b", "conceptConcept"))
    return G.weight_bounds(every).select("kind", "links", R("low").alias("low"), R("high").alias("high"))


@query(f"{_SC}, k AS (SELECT competition_id, concept_id FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY updated_at DESC NULLS LAST, label DESC NULLS LAST, summary DESC NULLS LAST) AS rn FROM concepts) WHERE rn = 1) SELECT competition_id, count(DISTINCT concept_id) AS concepts, count(DISTINCT speaker) AS speakers, round(sum(mass), 10) AS mass FROM sc JOIN k USING (concept_id) GROUP BY 1")
def hierarchy_rollup(spark, folder) -> DataFrame:
    m = SP.speaker_concept(members(spark, folder)).join(concept_facts(spark, folder).select("concept_id", "competition_id"), "concept_id")
    return m.groupBy("competition_id").agg(F.countDistinct("concept_id").alias("concepts"), F.countDistinct("speaker").alias("speakers"), R(F.sum("mass")).alias("mass"))


@query(f"{_SC} SELECT concept_id, speaker, round(weight, 10) AS weight, place FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY round(weight, 9) DESC, speaker) AS place FROM sc) WHERE place <= 3")
def concept_top_speakers(spark, folder) -> DataFrame:
    order = W.partitionBy("concept_id").orderBy(F.desc(F.round("weight", 9)), "speaker")
    rows = SP.speaker_concept(members(spark, folder)).withColumn("place", F.row_number().over(order)).filter("place <= 3")
    return rows.select("concept_id", "speaker", R("weight").alias("weight"), "place")


@query(f"{_SC} SELECT speaker, concept_id, round(weight, 10) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY round(weight, 9) DESC, concept_id) AS place FROM sc) WHERE place <= 10")
def speaker_top_concepts(spark, folder) -> DataFrame:
    rows = SP.speaker_concept(members(spark, folder)).withColumn("w", F.round("weight", 9))
    return TS.top_by(rows, "speaker", [F.desc("w"), "concept_id"], 10).select("speaker", "concept_id", R("weight").alias("weight"))


@query(f"{_SC}, ex AS (SELECT concept_id, speaker AS item, mass / sum(mass) OVER (PARTITION BY concept_id) * 12 AS x FROM sc), f AS (SELECT *, floor(x)::BIGINT AS low, round(x - floor(x), 9) AS rest FROM ex) SELECT concept_id, item AS speaker, low + CASE WHEN row_number() OVER (PARTITION BY concept_id ORDER BY rest DESC, item) <= 12 - sum(low) OVER (PARTITION BY concept_id) THEN 1 ELSE 0 END AS seats FROM f")
def branch_apportionment(spark, folder) -> DataFrame:
    m = SP.speaker_concept(members(spark, folder)).select("concept_id", F.col("speaker").alias("item"), F.col("mass").alias("weight"))
    return RP.apportioned(m, "concept_id", 12).select("concept_id", F.col("item").alias("speaker"), "seats")


@query(f"{_SC}, c AS (SELECT concept_id, count(*) AS sp FROM sc GROUP BY 1), q AS (SELECT (SELECT count(*) FROM s) AS n, count(*) AS k, count(*) FILTER (sp = 1) AS solo FROM c), d AS (SELECT n, k, n / k::DOUBLE AS den, solo / k::DOUBLE AS sr FROM q), z AS (SELECT *, CASE WHEN den < 5 OR den > 30 THEN 'poor' WHEN den < 8 OR den > 20 THEN 'warning' ELSE 'good' END AS ds, CASE WHEN den < 4 THEN 'poor' WHEN den < 7 THEN 'warning' ELSE 'good' END AS ss, CASE WHEN sr > 0.4 THEN 'poor' WHEN sr > 0.2 THEN 'warning' ELSE 'good' END AS os FROM d) SELECT n AS sentences, k AS concepts, round(den, 10) AS density, round(sr, 10) AS solo_ratio, ds AS density_status, ss AS size_status, os AS solo_status, CAST(round(0.25 * (CASE ds WHEN 'good' THEN 1.0 WHEN 'warning' THEN 0.6 ELSE 0.2 END + CASE ss WHEN 'good' THEN 1.0 WHEN 'warning' THEN 0.6 ELSE 0.2 END + 1.0 + CASE os WHEN 'good' THEN 1.0 WHEN 'warning' THEN 0.6 ELSE 0.2 END), 10) AS DOUBLE) AS score FROM z")
def report_health(spark, folder) -> DataFrame:
    facts = SP.attributed(sentence_facts(spark, folder))
    by = SP.speaker_concept(memberships(facts)).groupBy("concept_id").agg(F.count(F.lit(1)).alias("sp"))
    row = by.agg(F.count(F.lit(1)).alias("concepts"), F.count_if(F.col("sp") == 1).alias("solo_concepts")).withColumn("sentences", facts.agg(F.count(F.lit(1)).alias("n")).scalar()).withColumn("axis_variance", F.lit(0.8))
    return RP.health(row).select("sentences", "concepts", R("density").alias("density"), R("solo_ratio").alias("solo_ratio"), "density_status", "size_status", "solo_status", R("score").alias("score"))


@query("WITH r AS (SELECT concept_id AS id, label, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY updated_at DESC NULLS LAST, label DESC NULLS LAST, summary DESC NULLS LAST) AS rn FROM concepts) WHERE rn = 1) SELECT id, label, CAST(epoch_us(updated_at) AS BIGINT) AS updated_us FROM r ORDER BY updated_at DESC NULLS LAST, id LIMIT 50")
def report_retention(spark, folder) -> DataFrame:
    rows = concept_facts(spark, folder).select(F.col("concept_id").alias("id"), "label", "updated_at")
    return RP.newest(rows, 50).select("id", "label", F.unix_micros("updated_at").alias("updated_us"))


@query(f"WITH {O.K}, {O.S}, r AS (SELECT concept_id, unnest(range(1, len(representative_sentences) + 1)) AS i, representative_sentences AS l FROM k) SELECT concept_id, CAST(i - 1 AS BIGINT) AS pos, max(sent_id) AS sent_id, count(sent_id) AS matches FROM (SELECT concept_id, i, l[i] AS t FROM r) LEFT JOIN s ON s.sentence = t AND s.concept_id = concept_id WHERE t IS NOT NULL GROUP BY 1, 2".replace("s.concept_id = concept_id", "s.concept_id = r2.concept_id").replace("FROM (SELECT concept_id, i, l[i] AS t FROM r) LEFT", "FROM (SELECT concept_id, i, l[i] AS t FROM r) r2 LEFT").replace("SELECT concept_id, CAST(i - 1", "SELECT r2.concept_id, CAST(i - 1"))
def evidence_lookup(spark, folder) -> DataFrame:
    rows = concept_facts(spark, folder).select("concept_id", F.posexplode("representative_sentences").alias("pos", "sentence")).filter("sentence is not null")
    facts = sentence_facts(spark, folder).select("concept_id", "sentence", "sent_id")
    out = rows.join(facts, ["concept_id", "sentence"], "left").groupBy("concept_id", "pos").agg(F.max("sent_id").alias("sent_id"), F.count("sent_id").alias("matches"))
    return out.select("concept_id", F.col("pos").cast("bigint").alias("pos"), "sent_id", "matches")


@query(f"WITH {O.K} SELECT coalesce(label_source, 'template') AS source, count(*) AS concepts FROM k GROUP BY 1")
def label_source_summary(spark, folder) -> DataFrame:
    return concept_facts(spark, folder).groupBy(F.coalesce("label_source", F.lit("template")).alias("source")).agg(F.count(F.lit(1)).alias("concepts"))


@query(f"WITH {O.S} SELECT speaker, list_sort(list_distinct(flatten(list(list_filter(source_tags, lambda x: x IS NOT NULL))))) AS tags FROM s WHERE source_tags IS NOT NULL GROUP BY 1")
def unique_tags(spark, folder) -> DataFrame:
    facts = sentence_facts(spark, folder).filter("source_tags is not null").select("speaker", F.explode_outer("source_tags").alias("t"))
    return facts.groupBy("speaker").agg(F.array_sort(F.collect_set("t")).alias("tags"))


@query(f"{_LK} SELECT kind, count(*) AS links, CAST(sum(evidence) AS BIGINT) AS evidence FROM lk GROUP BY 1")
def graph_counts(spark, folder) -> DataFrame:
    return links(spark, folder).groupBy("kind").agg(F.count(F.lit(1)).alias("links"), F.sum("evidence").alias("evidence"))


@query(f"{_LK}, {_EP} SELECT id, count(*) AS degree, list_sort(list(other)) AS neighbours FROM ep GROUP BY 1")
def adjacency(spark, folder) -> DataFrame:
    return G.endpoints(links(spark, folder)).groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.array_sort(F.collect_list("other")).alias("neighbours"))


@query()
def build_analysis(spark, folder) -> DataFrame:
    from quillmesh.plans.pipeline import build_analysis as build

    return build(sentence_facts(spark, folder), concept_facts(spark, folder)).summary
