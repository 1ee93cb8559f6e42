"""p7 and p8: every document against the public library; the mixture's promises."""

from collections import Counter, defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmesh.llm.corpus_encoding import encode, merge_rules, replay, token_counts, vocabulary_path
from quillmesh.llm.source_mixture import mixture
from quillmesh.sources.tables import table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_every_document_has_the_librarys_ids(spark, library):
    odd = ["", None, " ", "\n\n  x", "don't we'll I'D", "<|endoftext|>", "naïve 👩‍🎨 ０３", "aaaaaaa" * 9, " 　a", "a\r\n\tb  "]
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()] + [(-1 - i, t) for i, t in enumerate(odd)]
    documents = spark.createDataFrame(rows + rows[:5], "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in encode(documents).collect()}
    assert got == {i: library(t) for i, t in rows}


def test_counts_are_the_lengths(spark, library):
    documents = table(spark, SMALL, "documents").select("doc_id", "text")
    assert {r.doc_id: r.tokens for r in token_counts(documents).collect()} == {r.doc_id: len(library(r.text)) for r in documents.collect()}


FIRST, RULES = merge_rules(vocabulary_path())
RANK = {a << 32 | b: r for r, (a, b, _) in enumerate(RULES)}


def by_hand(word: bytes) -> list[int]:
    """The lowest rank first, the leftmost of equals, one merge at a time."""
    ids = [FIRST[b] for b in word]
    while True:
        ranks = [(RANK.get(a << 32 | b, 1 << 60), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
        if not ranks or min(ranks)[0] == 1 << 60:
            return ids
        r, i = min(ranks)
        ids[i : i + 2] = [RULES[r][2]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abent ihs", min_size=1, max_size=24).map(str.encode), min_size=1, max_size=12))
def test_replay_over_many_words_equals_one_word_at_a_time(words):
    assert replay(words, FIRST, RULES, RANK) == [by_hand(w) for w in words]


def test_mixture_has_equal_blocks_right_shares_and_bounded_repeats(spark):
    texts = [(i, "oak roof stair " * (20 + i % 7), "abc"[i % 3] if i % 9 else "b") for i in range(900)]
    documents = spark.createDataFrame(texts + texts[:3], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.1, 1), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    pieces, report = mixture(documents, targets, block=64)
    rows = pieces.collect()
    filled, used = Counter(), defaultdict(list)
    for p in rows:
        filled[p.slot] += p.token_to - p.token_from
        used[p.doc_id, p.epoch].append((p.token_from, p.token_to))
    assert set(filled.values()) == {64}
    repeats = {"a": 2, "b": 1, "c": 1}
    assert all(p.epoch < repeats[p.source] for p in rows)
    for parts in used.values():  # no token of a copy twice
        parts.sort()
        assert all(x[1] <= y[0] for x, y in zip(parts, parts[1:]))
    shares = {r.source: r.actual_share for r in report.collect()}
    assert shares["none"] == 0 and abs(shares["a"] - 5 / 9) < 0.02 and abs(shares["b"] - 3 / 9) < 0.02 and abs(sum(shares.values()) - 1) < 1e-9
    # The scarcest source is used up but for a few blocks.
    tokens = {r.source: r.tokens_available * repeats.get(r.source, 0) / {"a": 5, "b": 3, "c": 1}.get(r.source, 1) for r in report.collect() if r.source != "none"}
    scarce = min(tokens, key=tokens.get)
    assert [r.tokens_used for r in report.collect() if r.source == scarce][0] > 0.9 * [r.tokens_available * repeats[scarce] for r in report.collect() if r.source == scarce][0]
