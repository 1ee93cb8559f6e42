"""p5: similar records and their chains, against all pairs compared one by one."""

from datetime import datetime
from itertools import combinations

from quillmesh.llm.similar_clusters import clusters, found

T = datetime(2026, 1, 1)


def rows(sets, lang="en"):
    return [(f"s{i:03}", " ".join(s), lang, T) for i, s in enumerate(sets)]


def frame(spark, data):
    return spark.createDataFrame(data, "sent_id string, sentence string, lang string, ingested_at timestamp")


def by_hand(sets):
    ids = [f"s{i:03}" for i in range(len(sets))]
    group = {i: {i} for i in ids}
    for (i, a), (j, b) in combinations(zip(ids, map(set, sets)), 2):
        if min(len(a), len(b)) >= 10 and 100 * len(a & b) >= 65 * len(a | b):
            both = group[i] | group[j]
            for k in both:
                group[k] = both
    return {(i, j) for i, j in combinations(ids, 2) if j in group[i]}


def word(k):
    return "w" + "".join(chr(97 + int(d)) for d in str(k))


def test_chain_bound_and_short_records(spark):
    base = [word(k) for k in range(33)]
    chain = [base[i : i + 20] for i in range(0, 13, 4)]  # neighbours share 16 of 24; no others are similar
    bound = [[word(100 + k) for k in range(13)] , [word(100 + k) for k in range(13)] + [word(200 + k) for k in range(7)]]  # 13 of 20: just similar
    below = [[word(300 + k) for k in range(12)], [word(300 + k) for k in range(12)] + [word(400 + k) for k in range(7)]]  # 12 of 19: just not
    short = [[word(500 + k) for k in range(9)]] * 2
    sets = chain + bound + below + short
    got = {tuple(r) for r in found(frame(spark, rows(sets) + rows(sets))).collect()}
    assert got == by_hand(sets)
    assert ("s000", "s003") in got and ("s004", "s005") in got and len(got) == 7
    out = {r.cluster: (r["size"], r.typical) for r in clusters(frame(spark, rows(sets))).collect()}
    assert {c: n for c, (n, _) in out.items()} == {"s000": 4, "s004": 2}
    assert len(out["s000"][1]) == 3 and set(out["s000"][1]) <= {"s000", "s001", "s002", "s003"} and sorted(out["s004"][1]) == ["s004", "s005"]
    assert found(frame(spark, rows(sets, "de"))).count() == 0
