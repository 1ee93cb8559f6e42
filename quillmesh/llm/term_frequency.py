"""Problem 1: frequency of every distinct value or term.

Repeated deliveries are dropped by one shuffle on the record's key. Each record's distinct terms are then counted
where the record lies, partial hash aggregation combines these counts before the only shuffle on the
term, and frequency bounds mark terms. Nothing is sampled or capped; hot terms shrink to one row per map task.

Lower case is the JVM's, by Unicode's full rules: a capital sigma at a word's end becomes the final sigma, a capital
I with a dot keeps its dot as a combining mark. (The DuckDB oracle maps letter by letter, so the two
differ on such words; a test states the result.)

Defined results: null and empty texts, and null, empty or all-null arrays, hold no terms but count
as records; a key delivered repeatedly counts once (the latest delivery, then the greatest value,
should deliveries differ); a null key is one record. Empty tables give no rows. Columns other
than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RARE_MOST = 2
COMMON_SHARE = 0.1


def cleaned(text: Column) -> Column:
    """Without format characters (category Cf), NFC, lower case; inside the JVM."""
    bare = F.regexp_replace(text, r"\p{Cf}", "")
    # Below U+0300 every string is its own NFC form, so the call is for the other strings only.
    composed = F.when(
        bare.rlike(r"[^\x{0}-\x{2FF}]"),
        F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), bare, F.lit(False)),
    ).otherwise(bare)
    return F.lower(composed)


def words(text: Column) -> Column:
    """Maximal runs of letters and combining marks, two code points or longer."""
    return F.regexp_extract_all(cleaned(text), F.lit(r"[\p{L}\p{M}]{2,}"), F.lit(0))


def phrases(values: Column) -> Column:
    """Whole cleaned elements with blanks made one and trimmed, without null and empty ones."""
    one = F.transform(values, lambda v: F.trim(F.regexp_replace(cleaned(v), r"(?U)[\s\x1c-\x1f]+", " ")))
    return F.filter(one, lambda v: v.isNotNull() & (v != ""))


def per_record_counts(records: DataFrame, terms: Column) -> DataFrame:
    """record_id, term, n: each distinct term of each record with its count in it.

    Records that lie partitioned by their key need no exchange for it. (explode_outer, as explode
    makes the optimiser repeat the expression of the terms in a filter below it.)
    """
    each = records.select("record_id", F.explode_outer(terms).alias("term")).filter("term is not null")
    return each.groupBy("record_id", "term").agg(F.count(F.lit(1)).alias("n"))


def distinct_records(df: DataFrame, key: str, value: str, order: str | None = None) -> DataFrame:
    """One row per key. The partial aggregate runs before the shuffle, so a hot key costs a row a task."""
    rank = F.struct(F.col(order), F.col(value)) if order else F.struct(F.col(value))
    return df.groupBy(F.col(key).alias("record_id")).agg(F.max(rank).alias("r")).select("record_id", F.col("r")[value].alias("value"))


def term_frequency(records: DataFrame, terms: Column, rare_most: int = RARE_MOST, common_share: float = COMMON_SHARE) -> DataFrame:
    """term, occurrences, records, mark ('rare', 'common' or null) over records(record_id, value).

    records must hold one row per record. A term in at most rare_most records is rare, else one in
    more than common_share of all records is common.
    """
    counted = per_record_counts(records, terms).groupBy("term").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("records"))
    total = records.agg(F.count(F.lit(1)).alias("total"))
    mark = F.when(F.col("records") <= rare_most, F.lit("rare")).when(F.col("records") > F.lit(common_share) * total.scalar(), F.lit("common"))
    return counted.withColumn("mark", mark)


def corpus_terms(sentences: DataFrame, concepts: DataFrame) -> DataFrame:
    """field_name, term, occurrences, records, mark of both fields."""
    text = distinct_records(sentences, "sent_id", "sentence", "ingested_at")
    keys = distinct_records(concepts, "concept_id", "keyphrases", "updated_at")
    a = term_frequency(text, words(F.col("value"))).select(F.lit("sentence").alias("field_name"), "*")
    b = term_frequency(keys, phrases(F.col("value"))).select(F.lit("keyphrase").alias("field_name"), "*")
    return a.unionByName(b)


def p1_terms(spark, sf_dir):
    from quillmesh.sources.tables import table

    return corpus_terms(table(spark, sf_dir, "sentences"), table(spark, sf_dir, "concepts"))


def p1_found(spark, sf_dir):
    return p1_terms(spark, sf_dir).filter("mark is not null").select("field_name", "term", "mark")


_COUNTED = r"""
WITH sr AS (SELECT sent_id, arg_max(sentence, (ingested_at, sentence)) AS v FROM sentences GROUP BY sent_id),
kr AS (SELECT concept_id, arg_max(keyphrases, (updated_at, keyphrases)) AS v FROM concepts GROUP BY concept_id),
sw AS (SELECT sent_id AS id, unnest(regexp_extract_all(lower(nfc_normalize(regexp_replace(v, '\p{Cf}', '', 'g'))), '[\p{L}\p{M}]{2,}')) AS term FROM sr),
ke AS (SELECT concept_id AS id, unnest(v) AS e FROM kr),
kw AS (SELECT id, trim(regexp_replace(lower(nfc_normalize(regexp_replace(e, '\p{Cf}', '', 'g'))), '[\s\p{Z}\x0b\x1c-\x1f\x85]+', ' ', 'g')) AS term FROM ke WHERE e IS NOT NULL),
c AS (
  SELECT 'sentence' AS field_name, term, count(*) AS occurrences, count(DISTINCT id) AS records, (SELECT count(*) FROM sr) AS total FROM sw GROUP BY term
  UNION ALL
  SELECT 'keyphrase', term, count(*), count(DISTINCT id), (SELECT count(*) FROM kr) FROM kw WHERE term <> '' GROUP BY term),
m AS (SELECT field_name, term, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.1 * total THEN 'common' END AS mark FROM c)
"""
QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms}
ORACLES = {
    "p1_found": _COUNTED + "SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
    "p1_terms": _COUNTED + "SELECT field_name, term, CAST(occurrences AS BIGINT) AS occurrences, records, mark FROM m",
}
