"""Queries on texts: splitting, stance, tags, tokens, phrases, term models, windows, segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.lexicons import UNATTRIBUTED
from quillmesh.operators import term_statistics as TS
from quillmesh.operators.numbering import numbered, row_windows
from quillmesh.operators.segmentation import speaker_blocks
from quillmesh.operators.speakers import attributed, influence_weights
from quillmesh.plans import oracle as O
from quillmesh.sources.tables import comment_facts, concept_facts, sentence_facts, table

QUERIES, ORACLES = {}, {}
R = lambda c: F.round(c, 6)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {O.S} SELECT speaker, stance, count(*) AS sentences FROM s WHERE speaker <> 'Unattributed' GROUP BY 1, 2")
def stance_by_speaker(spark: SparkSession, folder: str) -> DataFrame:
    return attributed(sentence_facts(spark, folder)).groupBy("speaker", "stance").agg(F.count(F.lit(1)).alias("sentences"))


@query(f"WITH {O.S} SELECT stance, count(*) AS sentences, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM s GROUP BY 1")
def stance_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = sentence_facts(spark, folder).groupBy("stance").agg(F.count(F.lit(1)).alias("sentences"))
    return counts.withColumn("percent", R(100.0 * F.col("sentences") / F.sum("sentences").over(W.partitionBy())))


@query(f"WITH {O.C} SELECT comment_id, {O.normal('text')} AS text FROM c")
def whitespace_normalized(spark: SparkSession, folder: str) -> DataFrame:
    return comment_facts(spark, folder).select("comment_id", T.normalized("text").alias("text"))


@query(f"WITH {O.C} SELECT comment_id, pos - 1 AS pos, list[pos] AS sentence FROM (SELECT comment_id, list, unnest(range(1, len(list) + 1)) AS pos FROM (SELECT comment_id, {O.split('text')} AS list FROM c))")
def sentence_split(spark: SparkSession, folder: str) -> DataFrame:
    parts = comment_facts(spark, folder).select("comment_id", F.posexplode_outer(T.sentences("text")).alias("pos", "sentence"))
    return parts.filter("sentence is not null").select("comment_id", F.col("pos").cast("bigint").alias("pos"), "sentence")


@query(f"WITH {O.C} SELECT channel, count(*) AS comments, CAST(sum(len({O.split('text')})) AS BIGINT) AS sentences FROM c GROUP BY 1")
def sentence_split_counts(spark: SparkSession, folder: str) -> DataFrame:
    return comment_facts(spark, folder).groupBy("channel").agg(F.count(F.lit(1)).alias("comments"), F.sum(F.size(T.sentences("text"))).alias("sentences"))


@query(
    f"WITH {O.C} SELECT (SELECT count(*) FROM c) AS comments, (SELECT count(DISTINCT speaker) FROM c) AS speakers, (SELECT CAST(sum(len(text)) AS BIGINT) FROM c) AS characters, "
    f"(SELECT count(DISTINCT t) FROM (SELECT unnest(tags) AS t FROM c)) AS tags, (SELECT CAST(sum(len({O.split('text')})) AS BIGINT) FROM c) AS sentences"
)
def ingest_totals(spark: SparkSession, folder: str) -> DataFrame:
    facts = comment_facts(spark, folder)
    tags = facts.select(F.explode("tags").alias("t")).agg(F.countDistinct("t").alias("tags"))
    row = facts.agg(F.count(F.lit(1)).alias("comments"), F.countDistinct("speaker").alias("speakers"), F.sum(F.length("text")).alias("characters"), F.sum(F.size(T.sentences("text"))).alias("sentences"))
    return row.withColumn("tags", tags.scalar())


@query("SELECT DISTINCT lower(trim(t)) AS tag FROM (SELECT unnest(tags) AS t FROM comments UNION ALL SELECT unnest(source_tags) FROM sentences) WHERE trim(t) <> ''")
def tag_inventory(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "comments").select(F.explode("tags").alias("t"))
    b = table(spark, folder, "sentences").select(F.explode("source_tags").alias("t"))
    return a.union(b).filter("trim(t) <> ''").select(F.lower(F.trim("t")).alias("tag")).distinct()


@query(f"WITH {O.C} SELECT comment_id, list_distinct_order AS tags FROM (SELECT comment_id, list_transform(list_filter(range(1, len(a) + 1), lambda i: list_position(a, a[i]) = i), lambda i: a[i]) AS list_distinct_order FROM (SELECT comment_id, regexp_extract_all(text, '#([A-Za-z0-9_]+)', 1) || regexp_extract_all(text, '\\[([A-Za-z0-9_]+)\\]', 1) AS a FROM c)) WHERE len(list_distinct_order) > 0")
def tag_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return comment_facts(spark, folder).select("comment_id", T.tags("text").alias("tags")).filter(F.size("tags") > 0)


@query(f"WITH {O.C} SELECT comment_id, {O.normal(chr(114) + 'egexp_replace(regexp_replace(text, ' + chr(39) + '#[A-Za-z0-9_]+' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + '), ' + chr(39) + chr(92) + '[[A-Za-z0-9_]+' + chr(92) + ']' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')')} AS text FROM c")
def tag_stripping(spark: SparkSession, folder: str) -> DataFrame:
    return comment_facts(spark, folder).select("comment_id", T.without_tags("text").alias("text"))


@query(f"WITH {O.S}, t AS (SELECT speaker, unnest({O.tokens('sentence')}) AS token FROM s) SELECT speaker, token, count(*) AS n FROM t GROUP BY 1, 2")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    each = sentence_facts(spark, folder).select("speaker", F.explode_outer(T.tokens("sentence")).alias("token")).filter("token is not null")
    return each.groupBy("speaker", "token").agg(F.count(F.lit(1)).alias("n"))


_GRAMS = f"WITH {O.S}, w AS (SELECT sent_id, speaker, {O.ngram_tokens('sentence')} AS words FROM s), n AS ({O.ngrams('w', 'sent_id, speaker', 'words')})"


def _grams(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_facts(spark, folder).select("sent_id", "speaker", T.ngrams(T.ngram_tokens("sentence")).alias("terms"))


@query(_GRAMS + " SELECT term AS ngram, count(*) AS n FROM n GROUP BY 1")
def ngram_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _grams(spark, folder).select(F.explode_outer("terms").alias("ngram")).filter("ngram is not null").groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))


@query(_GRAMS + " SELECT term AS ngram, count(*) AS n FROM n GROUP BY 1 ORDER BY n DESC, ngram LIMIT 50")
def ngram_counts_top(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_counts(spark, folder).orderBy(F.desc("n"), "ngram").limit(50)


@query(_GRAMS + " SELECT count(DISTINCT term) AS ngrams FROM n")
def ngram_vocab_size(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_counts(spark, folder).agg(F.count(F.lit(1)).alias("ngrams"))


_PHRASES = f"WITH {O.S}, w AS (SELECT concept_id, sent_id, {O.raw_tokens('sentence')} AS words FROM s), p AS ({O.phrases('w', 'concept_id, sent_id', 'words')})"


@query(_PHRASES + " SELECT sent_id, phrase, CAST(round(count(*) * CASE WHEN contains(phrase, ' ') THEN 1.2 ELSE 1.0 END, 6) AS DOUBLE) AS score FROM p GROUP BY 1, 2")
def keyphrase_scores(spark: SparkSession, folder: str) -> DataFrame:
    each = sentence_facts(spark, folder).select("sent_id", F.explode_outer(T.keyphrases(T.raw_tokens("sentence"))).alias("phrase")).filter("phrase is not null")
    boost = F.when(F.col("phrase").contains(" "), 1.2).otherwise(1.0)
    return each.groupBy("sent_id", "phrase").agg(F.count(F.lit(1)).alias("n")).select("sent_id", "phrase", R(F.col("n") * boost).alias("score"))


@query(
    _PHRASES
    + """, z AS (SELECT concept_id, count(*) AS size FROM s WHERE concept_id IS NOT NULL GROUP BY 1), t AS (SELECT sum(size) AS n FROM z),
 q AS (SELECT concept_id, phrase, count(*) AS c FROM p WHERE concept_id IS NOT NULL GROUP BY 1, 2), a AS (SELECT phrase, sum(c) AS total FROM q GROUP BY 1),
 d AS (SELECT q.concept_id, q.phrase, q.c, q.c::DOUBLE / size AS dens, (total - q.c)::DOUBLE / greatest(n - size, 1) AS rest FROM q JOIN a USING (phrase) JOIN z USING (concept_id), t),
 r AS (SELECT concept_id, phrase, c AS count, dens * ln(1 + c) * ln(1 + dens / greatest(rest, 1e-6)) * CASE WHEN contains(phrase, ' ') THEN 1.25 ELSE 1.0 END AS score FROM d)
 SELECT concept_id, phrase, count, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY round(score, 6) DESC, phrase) AS place FROM r) WHERE place <= 8"""
)
def concept_keyphrases(spark: SparkSession, folder: str) -> DataFrame:
    rows = sentence_facts(spark, folder).filter("concept_id is not null").select("concept_id", T.keyphrases(T.raw_tokens("sentence")).alias("phrases"))
    scored = TS.cluster_keyphrases(rows, "concept_id", "phrases").withColumn("score", R("score"))
    return TS.top_by(scored, "concept_id", [F.desc("score"), "phrase"], 8)


_TFIDF = f""", w AS (SELECT sent_id, {O.tokens('sentence')} AS words FROM s), t AS (SELECT sent_id, unnest(words) AS term FROM w), f AS (SELECT sent_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
 d AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM s)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM f GROUP BY 1),
 x AS (SELECT sent_id, term, tf, df, idf, tf * idf AS raw FROM f JOIN d USING (term)), y AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY sent_id)) AS weight FROM x)"""


@query(f"WITH {O.S}" + _TFIDF + " SELECT sent_id, term, tf, df, round(idf, 6) AS idf, round(weight, 6) AS weight FROM y")
def tfidf_weights(spark: SparkSession, folder: str) -> DataFrame:
    rows = sentence_facts(spark, folder).select("sent_id", T.tokens("sentence").alias("terms"))
    return TS.tfidf(rows, "sent_id", "terms").withColumns({"idf": R("idf"), "weight": R("weight")})


@query(f"WITH {O.S}" + _TFIDF + " SELECT term, round(max(idf), 6) AS idf, round(sum(weight), 4) AS total FROM y GROUP BY term")
def tfidf_terms(spark: SparkSession, folder: str) -> DataFrame:
    rows = sentence_facts(spark, folder).select("sent_id", T.tokens("sentence").alias("terms"))
    return TS.tfidf(rows, "sent_id", "terms").groupBy("term").agg(R(F.max("idf")).alias("idf"), F.round(F.sum("weight"), 4).alias("total"))


_CONSENSUS = _GRAMS + ", d AS (SELECT term, count(DISTINCT speaker) AS df FROM n GROUP BY 1), i AS (SELECT term, df, ln(1 + df / (SELECT count(DISTINCT speaker) FROM s)::DOUBLE) + 1 AS idf FROM d)"
_DISCRIM = _GRAMS + ", d AS (SELECT term, count(DISTINCT sent_id) AS df FROM n GROUP BY 1), i AS (SELECT term, df, greatest(0.0, ln(((SELECT count(*) FROM s) - df + 0.5) / (df + 0.5))) AS idf FROM d)"


@query(_CONSENSUS + " SELECT term, df, round(idf, 6) AS idf, round(idf * df, 6) AS score FROM i")
def bm25_consensus_scores(spark: SparkSession, folder: str) -> DataFrame:
    return TS.consensus_scores(_grams(spark, folder), "speaker", "terms").withColumns({"idf": R("idf"), "score": R("score")})


@query(_DISCRIM + " SELECT term, df, round(idf, 6) AS idf, round(idf * df, 6) AS score FROM i")
def bm25_discriminative_scores(spark: SparkSession, folder: str) -> DataFrame:
    return TS.discriminative_scores(_grams(spark, folder), "sent_id", "terms").withColumns({"idf": R("idf"), "score": R("score")})


_WEIGHTS = """, tf AS (SELECT sent_id, term, count(*) AS tf FROM n GROUP BY 1, 2), l AS (SELECT s.sent_id, greatest(count(n.term), 1) AS length FROM s LEFT JOIN n USING (sent_id) GROUP BY 1), av AS (SELECT avg(length) AS mean FROM l),
 x AS (SELECT sent_id, term, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) AS raw FROM tf JOIN i USING (term) JOIN l USING (sent_id), av), y AS (SELECT sent_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY sent_id)) AS weight FROM x WHERE raw > 0)"""


def _weights(spark: SparkSession, folder: str, consensus: bool) -> DataFrame:
    rows = _grams(spark, folder)
    idf = TS.consensus_scores(rows, "speaker", "terms") if consensus else TS.discriminative_scores(rows, "sent_id", "terms")
    return TS.bm25_weights(rows, "sent_id", "terms", idf)


@query(_DISCRIM + _WEIGHTS + " SELECT sent_id, term, round(weight, 6) AS weight FROM y")
def bm25_sentence_weights(spark: SparkSession, folder: str) -> DataFrame:
    return _weights(spark, folder, False).withColumn("weight", R("weight"))


@query(_CONSENSUS + _WEIGHTS + " SELECT sent_id, term, round(weight, 6) AS weight FROM y")
def bm25_consensus_weights(spark: SparkSession, folder: str) -> DataFrame:
    return _weights(spark, folder, True).withColumn("weight", R("weight"))


@query(
    _DISCRIM
    + _WEIGHTS
    + """, gr AS (SELECT sent_id, concept_id FROM s WHERE concept_id IS NOT NULL), z AS (SELECT concept_id, count(*) AS size FROM gr GROUP BY 1), nn AS (SELECT count(*) AS n FROM gr),
 own AS (SELECT concept_id, term, sum(weight) AS own, count(*) AS df FROM y JOIN gr USING (sent_id) GROUP BY 1, 2), al AS (SELECT term, sum(weight) AS alls FROM y JOIN gr USING (sent_id) GROUP BY 1),
 b AS (SELECT concept_id, term, df, size, own / size AS mine, CASE WHEN nn.n > size THEN greatest(round(alls - own, 9), 0) / (nn.n - size) ELSE 0 END AS rest FROM own JOIN al USING (term) JOIN z USING (concept_id), nn),
 r AS (SELECT *, df / size::DOUBLE AS prevalence, CASE WHEN rest > 0 THEN mine / rest ELSE mine END AS ratio FROM b), v AS (SELECT *, (mine - rest) * prevalence * log2(greatest(ratio, 1.0) + 1) AS score FROM r)
 SELECT concept_id, term, df, round(prevalence, 6) AS prevalence, round(score, 5) AS score FROM v WHERE df >= 2 AND df <= ceil(size * 0.8) AND score > 0 AND ratio >= 1.5"""
)
def contrastive_terms(spark: SparkSession, folder: str) -> DataFrame:
    groups = sentence_facts(spark, folder).filter("concept_id is not null").select("sent_id", "concept_id")
    terms = TS.contrastive_terms(_weights(spark, folder, False), groups, "sent_id", "concept_id")
    return terms.select("concept_id", "term", "df", R("prevalence").alias("prevalence"), F.round("score", 5).alias("score"))


@query(f"WITH {O.S}, n AS (SELECT speaker, count(*) AS sentences FROM s GROUP BY 1) SELECT speaker, sentences, round(sqrt((SELECT avg(sentences) FROM n) / sentences), 6) AS influence FROM n")
def speaker_influence_weights(spark: SparkSession, folder: str) -> DataFrame:
    return influence_weights(sentence_facts(spark, folder)).withColumn("influence", R("influence"))


_POS = f"WITH {O.S}, p AS (SELECT *, row_number() OVER (ORDER BY sent_idx) - 1 AS pos FROM s)"


@query(
    _POS
    + """, st AS (SELECT unnest(range(0, (SELECT count(*) FROM p), 2)) AS start), k AS (SELECT start FROM st WHERE start = 0 OR start + 1 < (SELECT count(*) FROM p))
 SELECT 'chunk:win:' || (start // 2) AS chunk_id, min(sent_idx) AS first_sentence, count(*) AS sentences, arg_min(speaker, pos) AS speaker, arg_min(stance, pos) AS stance, string_agg(sentence, ' ' ORDER BY pos) AS text
 FROM k JOIN p ON p.pos >= start AND p.pos < start + 3 GROUP BY start"""
)
def sentence_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = row_windows(numbered(sentence_facts(spark, folder).select("sent_idx", "speaker", "stance", "sentence"), "sent_idx"), 3, 1)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda p: p["sentence"]), " ")
    out = rows.groupBy("chunk_idx").agg(F.min("sent_idx").alias("first_sentence"), F.count(F.lit(1)).alias("sentences"), F.min_by("speaker", "pos").alias("speaker"), F.min_by("stance", "pos").alias("stance"), joined.alias("text"))
    return out.select(F.concat(F.lit("chunk:win:"), "chunk_idx").alias("chunk_id"), "first_sentence", "sentences", "speaker", "stance", "text")


@query(_POS + " SELECT pos // 5 AS chunk_idx, count(*) AS sentences, min(sent_idx) AS first_sentence, max(sent_idx) AS last_sentence FROM p GROUP BY 1")
def tumbling_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = numbered(sentence_facts(spark, folder).select("sent_idx"), "sent_idx").withColumn("chunk_idx", F.floor(F.col("pos") / 5))
    return rows.groupBy("chunk_idx").agg(F.count(F.lit(1)).alias("sentences"), F.min("sent_idx").alias("first_sentence"), F.max("sent_idx").alias("last_sentence"))


@query(f"WITH {O.S} SELECT c AS chunk_id, sent_id, speaker FROM (SELECT sent_id, speaker, unnest(chunk_ids) AS c FROM (SELECT s.sent_id, s.speaker, x.chunk_ids FROM s JOIN sentences x USING (sent_idx))) WHERE c IS NOT NULL GROUP BY ALL")
def chunk_sentence_bridge(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_facts(spark, folder).select(F.explode("chunk_ids").alias("chunk_id"), "sent_id", "speaker").filter("chunk_id is not null").distinct()


@query(f"WITH {O.C} SELECT speaker, count(*) AS comments, count(DISTINCT block_id) AS blocks, CAST(sum(len(text)) AS BIGINT) AS characters FROM c GROUP BY 1")
def text_length_by_speaker(spark: SparkSession, folder: str) -> DataFrame:
    return comment_facts(spark, folder).groupBy("speaker").agg(F.count(F.lit(1)).alias("comments"), F.countDistinct("block_id").alias("blocks"), F.sum(F.length("text")).alias("characters"))


@query(f"WITH {O.S} SELECT speaker, count(*) AS sentences FROM s GROUP BY 1")
def sentences_per_speaker(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_facts(spark, folder).groupBy("speaker").agg(F.count(F.lit(1)).alias("sentences"))


@query(
    f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, i AS line_no, trim(replace(l[i], chr(13), '')) AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
 k AS (SELECT *, len(line) BETWEEN 3 AND 60 AND NOT regexp_matches(line, '[.!?:]$') AND NOT regexp_matches(lower(line), 'selected jurors|jury|comments|competition') AND len(string_split_regex(line, '[ \\t\\f\\x0b\\x{{a0}}]+')) <= 5
   AND len(list_filter(string_split_regex(line, '[ \\t\\f\\x0b\\x{{a0}}]+'), lambda w: regexp_matches(w, '^[A-Z][A-Za-z''.\\-]*$'))) > 0 AS name_like FROM (SELECT doc_id, line_no, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(160)) AS line FROM r) WHERE line <> ''),
 h AS (SELECT *, name_like AND NOT coalesce(lead(name_like) OVER (PARTITION BY doc_id ORDER BY line_no), true) AS head FROM k),
 b AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM h)
 SELECT doc_id, block, coalesce(max(CASE WHEN head THEN line END), '{UNATTRIBUTED}') AS speaker, count(*) FILTER (NOT head) AS lines, CAST(coalesce(sum(CASE WHEN NOT head THEN len(line) END), 0) AS BIGINT) AS characters FROM b GROUP BY 1, 2"""
)
def speaker_segmentation(spark: SparkSession, folder: str) -> DataFrame:
    return speaker_blocks(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


@query(f"WITH {O.K}, q AS (SELECT concept_id, trim(label, ' ' || chr(9) || chr(10) || chr(12) || chr(160)) AS t FROM k), w AS (SELECT concept_id, t, list_transform(string_split_regex(t, '[ \\t\\n\\r\\f\\x0b\\x{{a0}}]+'), lambda x: lower(x)) AS w FROM q), f AS (SELECT concept_id, t, w, len(w) AS n, len(list_filter(w, lambda x: list_contains({O.STOP}, x))) AS st FROM w) SELECT concept_id, CAST(CASE WHEN coalesce(t, '') = '' THEN 0.0 ELSE round(greatest(0.0, least(1.0, 1.0 - CASE WHEN n = 1 THEN 0.4 ELSE 0 END - CASE WHEN n > 7 THEN 0.1 ELSE 0 END - CASE WHEN st / n::DOUBLE > 0.4 THEN 0.3 ELSE 0 END - CASE WHEN list_contains({O.STOP}, w[1]) OR w[1] IN ('addressing', 'shows', 'move', 'goes', 'tells', 'appearing', 'seems', 'is', 'are', 'about') THEN 0.45 ELSE 0 END - CASE WHEN len(list_distinct(w)) <> n THEN 0.45 ELSE 0 END - CASE WHEN len(list_filter(w, lambda x: x IN ('areas', 'project', 'design', 'spaces', 'brief', 'proposal'))) > 0 THEN 0.1 ELSE 0 END)), 6) END AS DOUBLE) AS score FROM f")
def label_quality(spark: SparkSession, folder: str) -> DataFrame:
    return concept_facts(spark, folder).select("concept_id", T.label_quality("label")["score"].alias("score"))


@query(f"WITH {O.K} SELECT concept_id, len(list_filter(string_split(concept_id, ''), lambda x: true)) AS letters, CAST(list_sum(list_transform(string_split(concept_id, ''), lambda x: ascii(x))) % 10 AS INT) AS slot FROM k")
def template_label_slot(spark: SparkSession, folder: str) -> DataFrame:
    return concept_facts(spark, folder).select("concept_id", F.length("concept_id").cast("bigint").alias("letters"), T.char_code_slot("concept_id").alias("slot"))


@query(f"WITH {O.K} SELECT concept_id, coalesce(nullif(CASE WHEN lower(trim(title)) IN ('concept', 'concepts') THEN '' ELSE trim(title) END, ''), nullif(trim(short_label), ''), label) AS resolved FROM k")
def resolved_titles(spark: SparkSession, folder: str) -> DataFrame:
    title = F.when(F.lower(F.trim("title")).isin("concept", "concepts"), "").otherwise(F.trim("title"))
    return concept_facts(spark, folder).select("concept_id", F.coalesce(F.nullif(title, F.lit("")), F.nullif(F.trim("short_label"), F.lit("")), "label").alias("resolved"))


def _stem_sql(x: str) -> str:
    from quillmesh.lexicons import STEM_SUFFIXES

    whens = " ".join(f"WHEN suffix({x}, '{s}') AND len({x}) - {len(s)} >= 3 THEN {x}[:len({x}) - {len(s)}]" for s in STEM_SUFFIXES)
    return f"CASE {whens} ELSE {x} END"


@query(f"WITH {O.S}, t AS (SELECT DISTINCT unnest({O.tokens('sentence')}) AS token FROM s) SELECT token, {_stem_sql('token')} AS stem FROM t")
def token_stems(spark: SparkSession, folder: str) -> DataFrame:
    each = sentence_facts(spark, folder).select(F.explode_outer(T.tokens("sentence")).alias("token")).filter("token is not null").distinct()
    return each.select("token", T.stem("token").alias("stem"))


@query(f"WITH {O.S}, {O.K}, a AS (SELECT DISTINCT concept_id, lower(trim(t)) AS term FROM (SELECT concept_id, unnest(keyphrases) AS t FROM k) WHERE trim(t) <> ''), b AS (SELECT DISTINCT concept_id, lower(trim(t)) AS term FROM (SELECT concept_id, unnest(top_terms) AS t FROM k) WHERE trim(t) <> ''), aw AS (SELECT concept_id, term, unnest(string_split(term, ' ')) AS w FROM a), bw AS (SELECT concept_id, term, unnest(string_split(term, ' ')) AS w FROM b), f AS (SELECT coalesce(a.concept_id, b.concept_id) AS concept_id, coalesce(a.term, b.term) AS term, a.term IS NOT NULL AS l, b.term IS NOT NULL AS r FROM a FULL JOIN b ON a.concept_id = b.concept_id AND a.term = b.term), pa AS (SELECT DISTINCT aw.concept_id, aw.term FROM aw JOIN bw USING (concept_id, w)), pb AS (SELECT DISTINCT bw.concept_id, bw.term FROM bw JOIN aw USING (concept_id, w)) SELECT f.concept_id, f.term, CASE WHEN l AND r THEN 'exact' WHEN l AND pa.term IS NOT NULL THEN 'partial' WHEN r AND pb.term IS NOT NULL THEN 'partial' WHEN l THEN 'only-keyphrase' ELSE 'only-term' END AS match FROM f LEFT JOIN pa ON pa.concept_id = f.concept_id AND pa.term = f.term LEFT JOIN pb ON pb.concept_id = f.concept_id AND pb.term = f.term")
def term_match_outer(spark: SparkSession, folder: str) -> DataFrame:
    facts = concept_facts(spark, folder)
    side = lambda c: facts.select("concept_id", F.explode(c).alias("t")).filter("trim(t) <> ''").select("concept_id", F.lower(F.trim("t")).alias("term")).distinct()
    a, b = side("keyphrases"), side("top_terms")
    word = lambda d: d.select("concept_id", "term", F.explode(F.split("term", " ")).alias("w"))
    shares = lambda x, y: word(x).join(word(y).select("concept_id", "w"), ["concept_id", "w"], "left_semi").select("concept_id", "term").distinct()
    both = a.withColumn("l", F.lit(True)).join(b.withColumn("r", F.lit(True)), ["concept_id", "term"], "full")
    rows = both.join(shares(a, b).withColumn("pa", F.lit(True)), ["concept_id", "term"], "left").join(shares(b, a).withColumn("pb", F.lit(True)), ["concept_id", "term"], "left")
    match = F.when(F.col("l") & F.col("r"), "exact").when(F.col("l") & F.col("pa"), "partial").when(F.col("r") & F.col("pb"), "partial").when(F.col("l"), "only-keyphrase").otherwise("only-term")
    return rows.select("concept_id", "term", match.alias("match"))
