"""Problem 7: encoding of the whole corpus with a public byte-level BPE, by corpus-level merge replay.

The corpus shrinks to its distinct pre-tokens first (regular expression and partial hash aggregate,
all in the JVM). Each shard of distinct pre-tokens is then one flat array of byte symbols with links
to the live neighbours and an inverted index from token pair to the positions where the pair stands.
Merges are applied in rank order: a merge touches only the positions its pair is indexed at, and only
the two pairs beside each are indexed anew. No pre-token is scanned twice.

The ids go back to the documents by joins. The HEAD most frequent short pre-tokens, which hold nearly
all rows of the corpus, are broadcast: their number and length are bounded, whatever the corpus.
The rest is a shuffle join in which, by construction, no key is hot.

Defined results: null and empty texts give an empty list; texts are encoded as they are; special
tokens' strings are ordinary text. Rows that repeat a doc_id with the same text count once; a doc_id
with several texts gives a row for each; a null doc_id is a key like others. An empty table gives no rows.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.session import materialise

VOCABULARY = "byte_bpe_50k"
#: The published pre-token pattern of the vocabulary, with white space as Unicode defines it.
PRETOKEN = r"(?U)'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
#: Pre-tokens that are broadcast: at most so many, none longer than this.
HEAD, HEAD_CHARS = 32_768, 48
#: Bytes of distinct pre-tokens whose merges are replayed together.
SHARD_BYTES = 1 << 20
# explode_outer, as explode makes the optimiser repeat the expression in a filter below it.
DEAD, WALL = -2, -1


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in vocabularies of this kind: itself if visible, else 256 upwards."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(other)) for b in range(256)]


def merge_rules(path: str) -> tuple[list[int], list[tuple[int, int, int]]]:
    """The id of each byte, and (left, right, merged) ids in rank order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    ids = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return [ids[c] for c in byte_symbols()], [(ids[a], ids[b], ids[a + b]) for a, b in pairs]


def replay(words: list[bytes], first: list[int], rules: list[tuple[int, int, int]], rank: dict[int, int]) -> list[list[int]]:
    """The ids of each word. rank: left << 32 | right → place in rules."""
    symbols: list[int] = [WALL]
    for word in words:
        symbols += [first[b] for b in word]
        symbols.append(WALL)
    after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
    places: dict[int, list[int]] = defaultdict(list)
    for i in range(len(symbols) - 1):
        r = rank.get(symbols[i] << 32 | symbols[i + 1]) if symbols[i] >= 0 and symbols[i + 1] >= 0 else None
        if r is not None:
            places[r].append(i)
    queue = list(places)
    heapq.heapify(queue)
    while queue:
        r = heapq.heappop(queue)
        left, right, merged = rules[r]
        for i in sorted(places.pop(r)):
            j = after[i]
            if symbols[i] != left or symbols[j] != right:
                continue  # an overlapping or earlier merge took one of the two
            symbols[i], symbols[j] = merged, DEAD
            k, h = after[j], before[i]
            after[i], before[k] = k, i
            for at, a, b in ((h, symbols[h], merged), (i, merged, symbols[k])):
                near = rank.get(a << 32 | b) if a >= 0 and b >= 0 else None
                if near is not None:
                    if near not in places:
                        heapq.heappush(queue, near)
                    places[near].append(at)
    out, one = [], []
    for s in symbols[1:]:
        if s == WALL:
            out.append(one)
            one = []
        elif s != DEAD:
            one.append(s)
    return out


def distinct_words(texts: DataFrame) -> DataFrame:
    """word, n over texts(text), none of them empty: every distinct pre-token and how often it stands in the corpus."""
    return texts.select(F.explode_outer(F.regexp_extract_all("text", F.lit(PRETOKEN), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def encoded_words(texts: DataFrame, path: str) -> DataFrame:
    """word, n, ids of every distinct pre-token, written to the shared folder."""
    spark = texts.sparkSession
    rules = spark.sparkContext.broadcast(merge_rules(path))  # the vocabulary: fixed size, whatever the corpus

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, merges = rules.value
        rank = {a << 32 | b: r for r, (a, b, _) in enumerate(merges)}
        words, counts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            ids = replay([w.encode() for w in words], first, merges, rank)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["word", "n", "ids"])

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.append(word)
                counts.append(n)
                size += 4 * len(word)
                if size >= SHARD_BYTES:
                    yield flush()
                    words, counts, size = [], [], 0
        if words:
            yield flush()

    return materialise(distinct_words(texts).mapInArrow(shards, "word string, n bigint, ids array<int>"), "p7-words")


def located(texts: DataFrame, words: DataFrame, *values: str) -> DataFrame:
    """doc_id, version, pos and values of words for each pre-token of texts(doc_id, version, text)."""
    each = texts.select("doc_id", "version", F.posexplode_outer(F.regexp_extract_all("text", F.lit(PRETOKEN), F.lit(0))).alias("pos", "word"))
    short = words.filter(F.length("word") <= HEAD_CHARS)
    head = short.orderBy(F.desc("n"), "word").limit(HEAD).select("word", *values)
    head = materialise(head, "p7-head")
    tail = words.select("word", *values).join(F.broadcast(head.select("word")), "word", "left_anti")
    hot = each.join(F.broadcast(head), "word").select("doc_id", "version", "pos", *values)
    rest = each.join(F.broadcast(head.select("word")), "word", "left_anti").join(tail, "word")
    return hot.unionByName(rest.select("doc_id", "version", "pos", *values))


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.xxhash64("text").alias("version"), "text").filter("text <> ''")


def _blank(documents: DataFrame) -> DataFrame:
    return documents.filter("text is null or text = ''").select("doc_id").distinct()


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids over documents(doc_id, text)."""
    texts = _texts(documents)
    words = encoded_words(texts, path or vocabulary_path())
    rows = located(texts, words, "ids").groupBy("doc_id", "version").agg(F.collect_set(F.struct("pos", "ids")).alias("parts"))
    full = rows.select("doc_id", F.flatten(F.transform(F.sort_array("parts"), lambda p: p["ids"])).alias("ids"))
    return full.unionByName(_blank(documents).select("doc_id", F.array().cast("array<int>").alias("ids")))


def token_counts(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, tokens over documents(doc_id, text), doc_id unique: the number of ids, without building the lists."""
    texts = _texts(documents)
    words = encoded_words(texts, path or vocabulary_path()).select("word", "n", F.size("ids").alias("size"))
    full = located(texts, words, "size").groupBy("doc_id").agg(F.sum("size").alias("tokens"))
    return full.unionByName(_blank(documents).select("doc_id", F.lit(0).cast("bigint").alias("tokens")))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.sources.tables import table

    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"p7_ids": p7_ids}
ORACLES: dict[str, str] = {}
