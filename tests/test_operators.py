"""Core operators against brute force, on hand-made rows and on edges."""

import math
from itertools import combinations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillmesh import session
from quillmesh.functions import text as T
from quillmesh.operators import clusters, reports, segmentation, similarity, training
from quillmesh.operators.components import components
from quillmesh.operators.numbering import numbered, row_windows
from quillmesh.operators.speakers import cosine_links, entropy_links
from quillmesh.streaming.comments import stance_by_window


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f("t").alias("x")).first().x


@pytest.mark.parametrize(
    "text, stance",
    [("It stood there.", "critique"), ("An unclear wall", "critique"), ("A clear wall", "praise"), ("You should move it; it is weak", "suggestion"), ("A wall", "neutral"), ("Gift shop", "neutral"), (None, "neutral")],
)
def test_stance(spark, text, stance):
    assert one(spark, text, T.stance) == stance


def test_sentences(spark):
    text = 'The roof is calm and wide.  It rests on oak; "Yes" it is, at least so they say. no capital here.\r\n\r\n\r\nShort. The court of stone remains open'
    assert one(spark, text, T.sentences) == ["The roof is calm and wide.", '"Yes" it is, at least so they say. no capital here.', "The court of stone remains open"]
    assert one(spark, "x" * 17, T.sentences) == [] and one(spark, "x" * 18, T.sentences) == ["x" * 18]


def test_tags_and_labels(spark):
    assert one(spark, "#a [b] #a [two words] [a]", T.tags) == ["a", "b"]
    assert one(spark, "x #a  [b] y", T.without_tags) == "x y"
    assert one(spark, "light, shade\n\n,air", T.seed_phrases) == ["light", "shade", "air"]
    assert one(spark, "", T.label_quality).violations == ["empty"]
    assert one(spark, "Light", T.label_quality).score == 0.6 and one(spark, "Light", T.label_quality).passed
    assert one(spark, "light light", T.label_quality).violations == ["repetition"]
    assert [one(spark, w, T.stem) for w in ("Proportions", "wall", "lighting now", "ed")] == ["proportion", "wall", "light", "ed"]


def test_long_text_costs_no_more_than_its_length(spark):
    df = spark.createDataFrame([(" ".join(f"word{i % 50} stair" for i in range(2500)),)], "t string")
    assert df.select(F.size(T.ngrams(T.ngram_tokens("t")))).first()[0] == 4999 + 4998
    assert df.select(F.size(T.keyphrases(T.raw_tokens("t")))).first()[0] == 5000 + 4999 + 4998 + 4997


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (5, 4), (4, 6), (7, 7), (None, 1)] + [(i, i + 1) for i in range(100, 140)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 7} | {i: 100 for i in range(100, 141)}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("n, size, overlap", [(0, 3, 1), (1, 3, 1), (2, 3, 1), (7, 3, 1), (8, 3, 1), (9, 5, 1), (6, 1, 1), (10, 4, 2)])
def test_row_windows(spark, n, size, overlap):
    step, want, start = max(1, size - overlap), [], 0
    while start < n:
        want.append(list(range(start, min(n, start + size))))
        if start + size >= n:
            break
        start += step
    rows = row_windows(numbered(spark.range(n).withColumn("key", F.col("id") * 37 - 50), "key", width=16), size, overlap).groupBy("chunk_idx").agg(F.array_sort(F.collect_list("pos")).alias("p")).orderBy("chunk_idx")
    assert [r.p for r in rows.collect()] == want


def shares(spark, n=40, items=12):
    rows = []
    for i in range(n):
        own = {(i * k * 7 + k) % items: (i * k) % 5 + 1.0 for k in range(1, 5)} | ({0: 9.0} if i % 3 else {})
        rows += [(f"o{i:02}", f"i{c}", w / sum(own.values())) for c, w in own.items()]
    return spark.createDataFrame(rows, "owner string, item string, p double"), rows


@pytest.mark.parametrize("threshold", [0.35, 0.8])
def test_similarity_joins_lose_no_link(spark, threshold):
    df, rows = shares(spark)
    by = {}
    for o, i, p in rows:
        by.setdefault(o, {})[i] = p
    js = lambda a, b: -sum(a[i] * math.log2(a[i] / (a[i] + b[i])) + b[i] * math.log2(b[i] / (a[i] + b[i])) for i in a.keys() & b.keys()) / 2
    cos = lambda a, b: sum(a[i] * b[i] for i in a.keys() & b.keys()) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    links, classes = entropy_links(df, "owner", "item", "p", threshold)
    first = {r.owner: r.class_id for r in classes.collect()}
    leads = sorted(set(first.values()))
    assert {(r.class_a, r.class_b) for r in links.collect()} == {(a, b) for a, b in combinations(leads, 2) if js(by[a], by[b]) >= threshold}
    assert all(js(by[o], by[c]) > 1 - 1e-6 for o, c in first.items())
    got = {(r.owner_a, r.owner_b) for r in cosine_links(df, "owner", "item", "p", threshold).collect()}
    assert got == {(a, b) for a, b in combinations(sorted(by), 2) if cos(by[a], by[b]) >= threshold}


@pytest.mark.parametrize("carried", [2, 64])
@pytest.mark.parametrize("measure, threshold", [("ENTROPY", 0.35), ("ENTROPY", 0.8), ("COSINE", 0.245)])
def test_similar_pairs_in_blocks_and_passes(spark, measure, threshold, carried):
    df, rows = shares(spark, n=60, items=20)
    vecs = similarity.vectors(df, "owner", "item", "p")
    by = {}
    for o, i, p in rows:
        by.setdefault(o, {})[i] = p
    if measure == "COSINE":
        by = {o: {i: p / math.sqrt(sum(x * x for x in v.values())) for i, p in v.items()} for o, v in by.items()}
        vecs = similarity.vectors(spark.createDataFrame([(o, i, p) for o, v in by.items() for i, p in v.items()], df.schema), "owner", "item", "p")
    part = {"COSINE": lambda x, y: x * y, "ENTROPY": lambda x, y: -(x * math.log2(x / (x + y)) + y * math.log2(y / (x + y))) / 2}[measure]
    sim = {(a, b): sum(part(by[a][i], by[b][i]) for i in by[a].keys() & by[b].keys()) for a, b in combinations(sorted(by), 2)}
    pairs = similarity.similar_pairs(vecs, getattr(similarity, measure), threshold, pairs_a_pass=600, block=7, carried=carried)
    got = [(r.a, r.b, r.similarity) for r in similarity.with_names(pairs, vecs, "a", "b").collect()]
    want = {k: s for k, s in sim.items() if s >= threshold}
    assert {(a, b) for a, b, _ in got} == set(want) and len(got) == len(want)
    assert {(a, b): s for a, b, s in got} == pytest.approx(want)


def test_kmeans_and_dendrogram(spark):
    centres = [[1.0, 0, 0], [0, 1.0, 0], [0, 0, 1.0]]
    rows = [(i, [x + 0.01 * ((i * 7 + d) % 5) for d, x in enumerate(centres[i % 3])]) for i in range(60)]
    units = spark.createDataFrame(rows, "unit bigint, v array<double>")
    got = {}
    for seed in range(1, 6):  # some seed starts in three groups
        got = {r.unit: r.cluster for r in training.spherical_kmeans(units, 3, seed).collect()}
        if len({got[0], got[1], got[2]}) == 3:
            break
    assert all(got[i] == got[i % 3] for i in range(60))
    assert training.spherical_kmeans(units.limit(0), 3).count() == 0
    cents = clusters.centroids(units.withColumn("cluster", F.col("unit") % 3))
    merges = training.dendrogram(cents).orderBy("step").collect()
    assert len(merges) == 2 and merges[-1].size == 60


def test_speaker_blocks(spark):
    text = "Intro line of the text without a name in it.\nAnna Vale\n\nThe roof is calm and the court is wide, as it should be for once.\nMore of it.\nBo Reed\nCy Dunn\nFine.\n"
    blocks = segmentation.speaker_blocks(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string"))
    rows = {(r.speaker, r.lines) for r in blocks.collect()}
    assert rows == {("Unattributed", 1), ("Anna Vale", 3), ("Cy Dunn", 1)}
    merged = {r.speaker: r.texts for r in segmentation.without_tiny(blocks).collect()}
    assert set(merged) == {"Unattributed", "Anna Vale"} and merged["Unattributed"][-1] == "Fine."


def test_reports(spark):
    store = spark.createDataFrame([(f"r{i}", i) for i in range(5)], "id string, updated_at int")
    new = reports.upserted(store, spark.createDataFrame([("r1", 9), ("r1", 8), ("r9", 7)], "id string, updated_at int"))
    assert [tuple(r) for r in reports.newest(new, 3).collect()] == [("r1", 9), ("r9", 7), ("r4", 4)]
    seats = reports.apportioned(spark.createDataFrame([("g", "a", 1.0), ("g", "b", 1.0), ("g", "c", 1.0)], "g string, item string, weight double"), "g", 10).collect()
    assert {r.item: r.seats for r in seats} == {"a": 4, "b": 3, "c": 3}


def test_soft_membership_sums_to_one(spark):
    sims = spark.createDataFrame([Row(unit=u, other=o, similarity=(u * o % 7 - 2) / 7) for u in range(20) for o in range(6)])
    rows = clusters.soft_membership(sims, entropy_cap=0.0).groupBy("unit").agg(F.sum("weight").alias("w")).collect()
    assert all(r.w == 0 or abs(r.w - 1) < 1e-9 for r in rows)


def test_stream_of_comments(spark, tmp_path):
    rows = [(f"c{i}", "You should open the east wall soon. The court is a calm and wide place.", f"2024-01-{i + 1:02} 10:00:00") for i in range(3)]
    df = spark.createDataFrame(rows + rows[:1], "comment_id string, text string, at string").select("comment_id", "text", F.to_timestamp("at").alias("submitted_at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stance_by_window(stream).writeStream.outputMode("complete").format("memory").queryName("stances").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r.stance: r.sentences for r in spark.table("stances").groupBy("stance").agg(F.sum("sentences").alias("sentences")).collect()} == {"suggestion": 3, "neutral": 3}


def test_the_shared_folder_is_named_by_the_session(spark):
    written = session.materialise(spark.range(3), "test")
    assert written.count() == 3 and written.inputFiles()[0].startswith(session.shared_folder(spark))


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://head:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())
