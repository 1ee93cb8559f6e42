"""p2: the decoder against every segmentation, held-out accuracy on texts of our own, and the operator's result."""

from datetime import datetime
from itertools import combinations

import pytest

from quillmesh.llm import personal_data as P

T = datetime(2026, 1, 1)
NAMES = [f"{g.title()} {s}" for g in sorted(P.GIVEN) for s in ("Kesselmark", "Vargren", "Holdavin")]


@pytest.fixture(scope="module")
def model():
    words = P.Words(set(P.GIVEN), {"mark", "gren", "avin"}, {"court", "gate", "stair"})
    return words, P.fit(P.training_set(words, NAMES, ["Amber Gate", "Quiet Court"], size=900))


def test_decoding_is_the_best_of_all_segmentations(model):
    words, weights = model
    maker = P.Maker(NAMES, ["Amber Gate"], seed=5)
    tried = 0
    while tried < 15:
        t = P.Text(maker.text()[0], words)
        spans = list(P.candidates(t))
        if not 1 <= len(spans) <= 12:
            continue
        tried += 1
        score = {c: sum(weights.get(x, 0.0) for x in P.features(t, c)) for c in spans}
        apart = lambda s: all(a[1] < b[0] or b[1] < a[0] for a, b in combinations(s, 2))
        best = max(sum(score[c] for c in s) for k in range(len(spans) + 1) for s in combinations(spans, k) if apart(s))
        assert abs(sum(score[c] for c in P.decode(t, weights)) - best) < 1e-9


def test_held_out_texts(model):
    words, weights = model
    maker, hit, found, true = P.Maker(NAMES, ["Amber Gate", "Quiet Court"], seed=77), 0, 0, 0
    for _ in range(300):
        raw, items = maker.text()
        t = P.Text(raw, words)
        got, want = {(t.at[i], k) for i, _, k in P.decode(t, weights)}, {(a, k) for a, _, k in items}
        hit, found, true = hit + len(got & want), found + len(got), true + len(want)
    assert hit / found > 0.95 and hit / true > 0.95


def test_found_and_redacted(spark):
    text = "😀 Best, Gabriela Kesselmark\nCall +44 20 7999 0123 or write to g.kessel (at) mail (dot) example. Entry no. 55501-77 was withdrawn."
    rows = [("a", text, "Gabriela Kesselmark", T), ("a", text, "Gabriela Kesselmark", T), ("n", None, None, T)] + [(f"s{i}", "The stair is calm.", n, T) for i, n in enumerate(NAMES)]
    comments = spark.createDataFrame(rows, "comment_id string, text string, speaker string, ingested_at timestamp")
    got = {tuple(r) for r in P.found(comments).collect()}
    assert got == {("a", "NAME", text.index("Gabriela")), ("a", "PHONE", text.index("+44")), ("a", "EMAIL", text.index("g.kessel"))}
    clean = {r.comment_id: r.text for r in P.redacted(comments).collect()}["a"]
    assert clean == "😀 Best, [NAME]\nCall [PHONE] or write to [EMAIL]. Entry no. 55501-77 was withdrawn."
