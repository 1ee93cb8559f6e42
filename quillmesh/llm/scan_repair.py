"""Problem 3: noise in text from scanned pages, repaired by Levenshtein automata over a vocabulary trie.

Lines of a comment are first told apart: page numbers by shape, page headings by their repetition in
the comment or, where one stands once, by shape and by the sentence that runs on around them. What is left
is body text. A word broken at a line's end is joined with the next body line's first word unless it
is written with a hyphen elsewhere. Body words and joined words that the vocabulary of the comments that were
not scanned lacks are suspects. Each distinct suspect's automaton (bit-parallel, up to two edits, and
two more in long words) is intersected with the trie of the vocabulary, which gives every
candidate in reach. Candidates whose every edit is a confusion of printed characters stay, ranked by
the cost of the confusions, by the count of their word pairs with the words on both sides, then by frequency.

Vocabulary and suspects are both cut into shards of SHARD words and every pair of shards is one task,
so a task's size is bounded whatever the corpus, and no candidate is missed.

Defined results: null and blank texts have no lines; of repeated deliveries the latest counts; a line keeps its
number, blank ones too; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillmesh.session import materialise

SHARD = 50_000
#: A word of the vocabulary is in at least so many texts that were not scanned.
LEAST_TEXTS = 2
# Printed characters and what they are misrecognised as.
CONFUSIONS = {
    "e": ["c"], "c": ["e", "¢", "("], "o": ["0"], "l": ["1", "i", "|", "!"], "i": ["1", "l", "!", "|"], "s": ["5", "$"], "t": ["†", "f", "+"], "g": ["9", "q"], "h": ["b", "li"], "b": ["6", "h"], "z": ["2"], "a": ["@", "o", "4"], "f": ["t"], "q": ["g"], "y": ["v"],
    "u": ["ii", "v"], "n": ["ri", "u"], "d": ["cl", "ol"], "m": ["rn", "nn", "in"], "w": ["vv"], "rn": ["m"], "ri": ["n"], "ii": ["u"], "cl": ["d"], "vv": ["w"], "li": ["h"], "B": ["8"], "ü": ["ii", "u"], "ä": ["a"], "ö": ["o"],
}
BROKEN = "-‐‑\xad¬"
EDGES = r"^[^\w¢†@|$+]+|[^\w¢†@|$+]+$"
ROMAN = r"(?:x{0,3}(?:ix|iv|v?i{1,3}|v)|x{1,3}|xl(?:ix|iv|v?i{0,3})?|l?x{0,3}(?:ix|iv|v?i{0,3}))"
NUMBER_LINE = re.compile(rf"(?i)[\s\-–—~\[\](){{}}.*·•|=]*(?:(?:page|p[a-z]gc?|pag|seite|s|p|pg)\b\.?\s*)?(?:[\dlo]*\d[\dlo]*|{ROMAN})(?:\s*(?:/|of|von|sur|de)\s*\d+)?[\s\-–—~\[\](){{}}.*·•|=]*")
PARTS = re.compile(r"\s*[·|•]\s*|\s{3,}|\t")
ENDS = tuple(".!?:;\"”»“)…")


def is_number(line: str) -> bool:
    return bool(line.strip()) and bool(re.search(r"[\dA-Za-z]", line)) and NUMBER_LINE.fullmatch(line) is not None


def heading_key(line: str) -> str:
    """A line without numbers, case and the confusion that headings show, so that a page's heading equals the next page's."""
    return re.sub(r"[\W\d_]+", " ", line.lower()).replace("c", "e").strip()


def titled(line: str) -> bool:
    """Shaped like a heading: few words, capitals at both ends, none of the marks of a sentence."""
    words = re.findall(r"[^\W\d_]+", line)
    if not 1 <= len(words) <= 12 or len(line) > 90 or re.search(r"[.,;:!?„“”\"»«]", line):
        return False
    small = [w for w in words if not w[0].isupper()]
    return words[0][0].isupper() and words[-1][0].isupper() and len(small) * 2 <= len(words) and (len(words) > 1 or line.strip().isupper() or bool(re.search(r"\d\s*$", line)))


def line_kinds(lines: list[str]) -> list[str]:
    """blank, page_number, header or body for each line."""
    kinds = ["blank" if not x.strip() else "page_number" if is_number(x) else "" for x in lines]
    keys = Counter(heading_key(x) for x, k in zip(lines, kinds, strict=True) if not k and titled(x))
    open_ = [i for i, k in enumerate(kinds) if not k]
    width = max((len(lines[i]) for i in open_), default=0)
    for place, i in enumerate(open_):
        x = lines[i]
        if not titled(x):
            continue
        shaped = bool(re.search(r"\S\s{3,}\d+\s*$|\s{3,}|[·|]", x.strip())) or x.strip().isupper()
        before = lines[open_[place - 1]].strip() if place else ""
        after = lines[open_[place + 1]].strip() if place + 1 < len(open_) else ""
        beside = (i > 0 and kinds[i - 1] in ("blank", "page_number", "header")) or (i + 1 < len(lines) and kinds[i + 1] in ("blank", "page_number"))
        short = len(x.strip()) < 0.75 * width
        runs_on = bool(before) and not before.endswith(ENDS) or bool(after) and after[0].islower()
        if keys[heading_key(x)] > 1 or shaped or (short and (beside or runs_on)):
            kinds[i] = "header"
    return [k or "body" for k in kinds]


def bare(word: str) -> str:
    return re.sub(EDGES, "", word)


def pieces_of(text: str) -> Iterator[tuple]:
    """line_no, defect, word, left, right, mark, before, after: furniture lines, body words and words broken at a line's end."""
    lines = text.split("\n")
    kinds = line_kinds(lines)
    body = [(i, x.split()) for i, (x, k) in enumerate(zip(lines, kinds, strict=True)) if k == "body"]
    for i, k in enumerate(kinds):
        if k in ("header", "page_number"):
            yield i + 1, k, "", "", "", "", "", ""
    tokens = []  # line_no, raw, broken with the next
    skip = False
    for n, (i, words) in enumerate(body):
        for at, raw in enumerate(words):
            if skip:
                skip = False
                if at == 0:
                    continue
            if at == len(words) - 1 and len(raw) > 1 and raw[-1] in BROKEN and raw[-2].isalnum() and n + 1 < len(body):
                tokens.append((i + 1, raw[:-1], raw[-1], body[n + 1][1][0]))
                skip = True
            else:
                tokens.append((i + 1, raw, "", ""))
    plain = [bare(t[1] + t[3]).lower() for t in tokens]
    for n, (line, raw, mark, rest) in enumerate(tokens):
        before, after = plain[n - 1] if n else "", plain[n + 1] if n + 1 < len(plain) else ""
        if mark:
            left, right = bare(raw).lower(), bare(rest).lower()
            yield line, "hyphen", left + right, left, right, mark, before, after
        else:
            for word in re.split(r"[-‐‑/–—…]+|(?<=\w)[.,](?=\w)", raw):
                word = bare(word).lower()
                if len(word) > 2 and re.search(r"[^\W\d_]", word):
                    yield line, "misread", word, "", "", "", before, after


def pieces(scans: DataFrame) -> DataFrame:
    schema = "comment_id string, line_no int, defect string, word string, left string, right string, mark string, before string, after string"
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(c, *p) for c, t in zip(batch["comment_id"], batch["text"], strict=True) for p in pieces_of(t)]
            yield pd.DataFrame(rows, columns=names)

    return scans.mapInPandas(cut, schema)


# --- the automaton and the trie ---


def trie(words: list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = w
    return root


def edits_allowed(word: str) -> int:
    return 1 if len(word) < 4 else 2 if len(word) < 9 else 4


def within(root: dict, word: str, edits: int) -> list[str]:
    """Every word of the trie within that many edits of word: the automaton's states are bit sets, one for each number of edits."""
    masks: dict[str, int] = {}
    for i, c in enumerate(word):
        masks[c] = masks.get(c, 0) | 1 << i
    last, full = 1 << len(word), (1 << len(word) + 1) - 1
    start = [1]
    for _ in range(edits):
        start.append((start[-1] << 1 | start[-1]) & full)  # letters of word left out
    found, stack = [], [(root, tuple(start))]
    while stack:
        node, states = stack.pop()
        for c, child in node.items():
            if c == "":
                if any(s & last for s in states):
                    found.append(child)
                continue
            mask, before, after = masks.get(c, 0), 0, []
            for k, s in enumerate(states):
                new = (s & mask) << 1
                if k:
                    p = states[k - 1]
                    new |= p | p << 1 | before << 1
                before = new & full
                after.append(before)
            if after[-1]:
                stack.append((child, tuple(after)))
    return found


COSTS = {(a, b): 1 for a, many in CONFUSIONS.items() for b in many}


def confusion_cost(word: str, truth: str, most: int = 4) -> int | None:
    """How many confusions of printed characters make truth into word; None if others are needed or more than most."""
    rows = [[math.inf] * (len(word) + 1) for _ in range(len(truth) + 1)]
    rows[0][0] = 0
    for i in range(len(truth) + 1):
        for j in range(len(word) + 1):
            here = rows[i][j]
            if here > most:
                continue
            if i < len(truth) and j < len(word) and truth[i] == word[j] and here < rows[i + 1][j + 1]:
                rows[i + 1][j + 1] = here
            for a in (1, 2):
                for b in (1, 2):
                    if i + a <= len(truth) and j + b <= len(word) and (truth[i : i + a], word[j : j + b]) in COSTS and here + 1 < rows[i + a][j + b]:
                        rows[i + a][j + b] = here + 1
    return None if rows[-1][-1] > most else int(rows[-1][-1])


def candidates(suspects: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, candidate, cost, n: every word of the vocabulary that confusions of print turn into the suspect."""
    many, size = suspects.count(), vocabulary.count()
    left, right = max(1, -(-many // SHARD), min(64, many // 500)), max(1, -(-size // SHARD))
    s = suspects.select("word", F.pmod(F.xxhash64("word"), F.lit(left)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(right - 1))).alias("shard"))
    v = vocabulary.select("word", "n", F.pmod(F.xxhash64("word"), F.lit(right)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(left - 1))).alias("part"))

    def intersect(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        root, counts, rows = trie(b["word"].tolist()), dict(zip(b["word"], b["n"], strict=True)), []
        for word in a["word"]:
            for truth in within(root, word, edits_allowed(word)):
                cost = confusion_cost(word, truth)
                if cost:
                    rows.append((word, truth, cost, counts[truth]))
        return pd.DataFrame(rows, columns=["word", "candidate", "cost", "n"])

    # A fixed number of partitions, as their few bytes would otherwise be merged into one long task.
    spread = lambda d: d.repartition(left * right, "shard", "part")
    return spread(s).groupBy("shard", "part").cogroup(spread(v).groupBy("shard", "part")).applyInPandas(intersect, "word string, candidate string, cost int, n long")


# --- the whole ---

WORDS = r"[\p{L}\p{M}]+(?:['’][\p{L}\p{M}]+)?"
COMPOUNDS = r"[\p{L}\p{M}]+(?:-[\p{L}\p{M}]+)+"


def repaired(scans: DataFrame, others: DataFrame) -> DataFrame:
    """comment_id, line_no, defect, repaired over scans(comment_id, text) and others(text), the texts that were not scanned."""
    lower = others.select(F.lower("text").alias("text"))
    each = lower.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)))).alias("word"))
    vocabulary = materialise(each.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(f"n >= {LEAST_TEXTS}"), "p3-vocabulary")
    hyphened = lower.unionByName(scans.select(F.lower("text").alias("text"))).select(F.explode(F.regexp_extract_all("text", F.lit(COMPOUNDS), F.lit(0))).alias("word"))
    compounds = materialise(hyphened.groupBy("word").agg(F.count(F.lit(1)).alias("written")), "p3-compounds")
    cut = materialise(pieces(scans), "p3-pieces")
    furniture = cut.filter("defect in ('header', 'page_number')").select("comment_id", "line_no", "defect", F.lit("").alias("repaired"))
    words = cut.filter("defect in ('hyphen', 'misread')")
    suspects = materialise(words.select("word").distinct().join(vocabulary, "word", "left_anti"), "p3-suspects")
    likely = materialise(candidates(suspects, vocabulary), "p3-candidates")
    # Word pairs of the texts that were not scanned, only for the candidates' neighbours.
    use = words.join(suspects, "word", "left_semi").select("word", "before", "after").distinct().join(likely, "word")
    tokens = lower.select(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)).alias("w"))
    joined = tokens.select(F.explode(F.transform(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.struct(x.alias("first"), F.get("w", i + 1).alias("second")))).alias("p")).select("p.first", "p.second")
    wanted = use.select(F.col("before").alias("first"), F.col("candidate").alias("second")).union(use.select("candidate", "after")).distinct()
    pairs = materialise(joined.groupBy("first", "second").agg(F.count(F.lit(1)).alias("seen")).join(wanted, ["first", "second"], "left_semi"), "p3-pairs")
    scored = use.join(pairs.toDF("before", "candidate", "seen_before"), ["before", "candidate"], "left").join(pairs.toDF("candidate", "after", "seen_after"), ["candidate", "after"], "left")
    context = F.log1p(F.coalesce("seen_before", F.lit(0))) + F.log1p(F.coalesce("seen_after", F.lit(0)))
    order = W.partitionBy("word", "before", "after").orderBy(F.desc(context - 3.0 * F.col("cost") + 0.5 * F.log("n")), "candidate")
    best = scored.withColumn("place", F.row_number().over(order)).filter("place = 1").select("word", "before", "after", F.col("candidate").alias("right_word"))
    best = materialise(best, "p3-best")
    misread = words.filter("defect = 'misread'").join(best, ["word", "before", "after"]).select("comment_id", "line_no", "defect", F.col("right_word").alias("repaired"))
    known = vocabulary.select("word", F.lit(True).alias("known"))
    broken = words.filter("defect = 'hyphen'").join(best, ["word", "before", "after"], "left").join(known, "word", "left")
    broken = broken.withColumn("compound", F.concat_ws("-", "left", "right")).join(compounds.withColumnRenamed("word", "compound"), "compound", "left")
    broken = broken.join(known.toDF("left", "known_left"), "left", "left").join(known.toDF("right", "known_right"), "right", "left")
    whole = (F.col("known") & F.col("written").isNull()) | (F.col("known") & (F.col("mark") != "-")) | F.col("right_word").isNotNull() & F.col("written").isNull() | (F.col("written").isNull() & ~(F.coalesce("known_left", F.lit(False)) & F.coalesce("known_right", F.lit(False))))
    joined_words = broken.filter(whole).select("comment_id", "line_no", "defect", F.coalesce("right_word", "word").alias("repaired"))
    return furniture.unionByName(misread).unionByName(joined_words).distinct()


def found(comments: DataFrame) -> DataFrame:
    rows = comments.filter("trim(text) <> ''")
    scans = rows.filter("channel = 'scan'").groupBy("comment_id").agg(F.max(F.struct("ingested_at", "text")).alias("r")).select("comment_id", "r.text")
    return repaired(materialise(scans, "p3-scans"), rows.filter("channel <> 'scan'").select("text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.sources.tables import table

    return found(table(spark, sf_dir, "comments"))


QUERIES = {"p3_found": p3_found}
ORACLES: dict[str, str] = {}
