"""p6, p3 and p9 on hand-made rows, and their parts against brute force."""

import random
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import name_variants as NV
from quillmesh.llm import scan_repair as SR
from quillmesh.llm.template_residue import found as residue

T = datetime(2026, 1, 1)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcd", max_size=14), st.text("abcd", max_size=14))
def test_common_is_the_longest_common_subsequence(a, b):
    assert NV.common(a, b) == lcs(a, b)


def test_variants_are_linked_and_others_are_not(spark):
    same = ["Richard Vonnelund", "VONNELUND, Richard", "R. Vonnelund", "Dr. Richard Vonnelund", "Richard  vonnelund", "Rick Vonnelund", "Richard Vonenlund", "Ric. Vonnelund"]
    firm = ["Atelier Sollösky GmbH", "ATELIER Solloesky G.m.b.H.", "At. Sollösky GmbH", "Atelier Slolösky GmbH"]
    rows = [(i, s, None, " Aville" if i % 2 else "AVILLE") for i, s in enumerate(same)]
    rows += [(100 + i, s, None, "Aville") for i, s in enumerate(firm)]
    rows += [(200, "Richard Vonnelund", None, "Btown"), (201, "Ursula Vonnelund", None, "Aville"), (202, None, None, "Aville"), (203, "Unattributed", None, None), (204, "", None, "Aville"), (205, "Sollösky Architects Ltd", None, "Aville")]
    # Two Brandts whose initial is the same: the initial alone fits neither, with an affiliation it fits one.
    rows += [(300, "Olga Brandtvik", "Studio A", "Cport"), (301, "Omar Brandtvik", "Bureau B", "Cport"), (302, "O. Brandtvik", None, "Cport"), (303, "Brandtvik, O.", "Bureau B", "Cport")]
    blocks = spark.createDataFrame(rows + rows[:4], "block_id bigint, speaker string, affiliation string, home_city string")
    got = {tuple(r) for r in NV.found(blocks).collect()}
    want = {(a[0], b[0]) for g in (rows[: len(same)], rows[len(same) : len(same) + len(firm)]) for a in g for b in g if a[0] < b[0] and a[1] != b[1]}
    assert got == want | {(301, 303)}


def test_a_common_suffix_is_refined_and_not_dropped(spark):
    given_names = ["Aiko", "Lin", "Omar", "Priya", "Ursula"]
    rows = [(i, f"{random.Random(i).choice(given_names)} K{i:03}".replace("K", "K" + "abcdefghij"[i % 10] * 2) + "vonfeld", None, "Hot") for i in range(300)]
    rows = [(i, s.replace(f"{i:03}", "abcdefghij"[i // 100] + "abcdefghij"[i // 10 % 10]), a, c) for i, s, a, c in rows]
    rows += [(1000 + i, s.upper(), a, c) for i, s, a, c in rows]
    got = {tuple(r) for r in NV.found(spark.createDataFrame(rows, "block_id bigint, speaker string, affiliation string, home_city string")).collect()}
    assert {(i, 1000 + i) for i in range(300)} <= got


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=25, unique=True), st.text("abcd", min_size=1, max_size=7), st.integers(0, 3))
def test_the_automaton_finds_every_word_in_reach_and_no_other(words, word, edits):
    assert sorted(SR.within(SR.trie(words), word, edits)) == sorted(w for w in words if distance(w, word) <= edits)


def test_scans_are_repaired(spark):
    page = ["JURY REPORT   3", "The quiet stair meets the gar-", "den below, and the well-", "lit court is calrn. We follow the", "— 3 —", "", "JURY REPORT   4", "quiet garden along the brick", "wall and the ¢ourt; Vote 8:", "It is finished in zox."]
    plain = ["the quiet stair meets the garden below", "and the well-lit court is calm", "we follow the quiet garden along the brick wall and the court", "the court is calm it is finished in oak"] * 2
    rows = [("scan", "\n".join(page), "scan", T), ("scan", "\n".join(page), "scan", T)] + [(f"c{i}", t, "form", T) for i, t in enumerate(plain)]
    got = {tuple(r) for r in SR.found(spark.createDataFrame(rows, "comment_id string, text string, channel string, ingested_at timestamp")).collect()}
    assert got == {("scan", 1, "header", ""), ("scan", 2, "hyphen", "garden"), ("scan", 4, "misread", "calm"), ("scan", 5, "page_number", ""), ("scan", 7, "header", ""), ("scan", 9, "misread", "court")}


def test_residue_is_found_and_mentions_are_not(spark):
    real = "The oak roof shelters the stair. The court is calm and the wall is clay."
    cases = ["Dear {{first_name}}, thank you.", f"{real} Status of ${{score}}: pending.", "Error 404: page not found. Go back and reload.", "HTTP 500\nGo back and reload.", "Please enable JavaScript in your browser.", "Lorem ipsum dolor sit amet consectetur adipiscing elit.", "Signed: <juror_name>", "#REF! #REF! #N/A"]
    fine = [real, f"{real} An error in section 3 hides the stair.", f"{real} The team coded it in JavaScript.", f"{real} The set {{oak, ash, elm}} suits it.", f"{real} Costs rose by 12% and then 8% again.", f"{real} Entry <7> and entry <9> share a court. The column grid a[i] is explained.", None, "", " "]
    rows = [(i, t) for i, t in enumerate(cases)] + [(50 + i, t) for i, t in enumerate(cases)] + [(100 + i, t) for i, t in enumerate(fine)]
    got = {r.doc_id for r in residue(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i for i, _ in rows if i < 100}
