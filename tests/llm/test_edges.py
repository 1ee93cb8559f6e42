"""Every operator on empty tables, rows of nulls, repeated rows, extra columns with clashing names, and a very long text."""

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import corpus_encoding, name_variants, personal_data, scan_repair, sentence_starts, similar_clusters, source_mixture, template_residue, term_frequency
from quillmesh.sources.tables import table

SMALL = "/root/testdata/sf0.001"
CLASH = ["id", "n", "term", "word", "unit", "key", "pos", "value", "r", "count", "text_", "seed", "segment", "version", "cell", "rank", "name"]

OPERATORS = {
    "p1": (("sentences", "concepts"), term_frequency.corpus_terms),
    "p2": (("comments",), personal_data.found),
    "p2r": (("comments",), personal_data.redacted),
    "p3": (("comments",), scan_repair.found),
    "p4": (("comments", "sentences"), sentence_starts.found),
    "p5": (("sentences",), similar_clusters.found),
    "p5c": (("sentences",), similar_clusters.clusters),
    "p6": (("blocks",), name_variants.found),
    "p7": (("documents",), corpus_encoding.encode),
    "p8": (("documents", "mix_targets"), lambda d, t: source_mixture.mixture(d, t)[0]),
    "p8s": (("documents", "mix_targets"), lambda d, t: source_mixture.mixture(d, t)[1]),
    "p9": (("documents",), template_residue.found),
}


def some(spark, name):
    return table(spark, SMALL, name).limit(40)


def with_nulls(df):
    """The rows, the rows with each column null in turn, and a row of nulls."""
    out = df
    for c in df.columns:
        out = out.unionByName(df.limit(3).withColumn(c, F.lit(None).cast(df.schema[c].dataType)))
    return df.sparkSession.createDataFrame(out.collect(), df.schema)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    tables, run = OPERATORS[name]
    rows = run(*[table(spark, SMALL, t).limit(0) for t in tables]).collect()
    assert rows == []


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_repeats_and_clashing_columns_change_nothing_else(spark, name):
    tables, run = OPERATORS[name]
    dirty = [with_nulls(some(spark, t)) for t in tables]
    plain = run(*dirty).collect()
    if name not in ("p2", "p2r", "p8", "p8s", "p5c"):
        assert len(plain) == len({repr(r) for r in plain})
    clash = [d.withColumns({c: F.lit("x") for c in CLASH if c not in d.columns}) for d in dirty]
    again = run(*clash).collect()
    assert sorted(map(repr, plain)) == sorted(map(repr, again))


def test_very_long_texts(spark):
    long = "The oak roof is calm. " * 20_000 + "x" * 100_000
    comments = table(spark, SMALL, "comments").limit(2).withColumn("text", F.lit(long)).withColumn("channel", F.lit("form"))
    assert sentence_starts.found(comments, table(spark, SMALL, "sentences").limit(0)).count() == 2 * 20_000 or comments.select("comment_id").distinct().count() < 2
    documents = spark.createDataFrame([(1, long, "brief")], "doc_id bigint, text string, source string")
    (row,) = corpus_encoding.encode(documents).collect()
    assert len(row.ids) > 20_000
    assert template_residue.found(documents).count() == 0
    one = spark.createDataFrame([("s", long, "2026-01-01")], "sent_id string, sentence string, ingested_at string")
    concepts = table(spark, SMALL, "concepts").limit(0)
    assert {r.term: r.occurrences for r in term_frequency.corpus_terms(one, concepts).collect()}["oak"] == 20_000
