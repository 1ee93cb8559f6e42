r"""Text columns: normalisation, splitting, stance, tags, tokens, phrases, labels.

White space is what the pattern [ \t\n\r\f\x0b\xa0] holds, on every engine alike. Null text gives null
(or an empty list for functions that give lists).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.lexicons import CRITIQUE, FILLER_WORDS, NAME_HEADERS, NON_NOUN_STARTS, PRAISE, STEM_SUFFIXES, STOPWORDS, SUGGESTION

LEAST_SENTENCE = 18


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use) -> Column:
    """use(value) with value computed once: a lambda's variable is bound, a column expression would be computed at every mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\n\r\f\x0b\xa0]+|[ \t\n\r\f\x0b\xa0]+$", "")


def normalized(c: Column | str) -> Column:
    """One line-break character, single blanks, at most one blank line, trimmed."""
    t = F.regexp_replace(_text(c), r"\r", "\n")
    t = F.regexp_replace(t, r"[ \t\x0b\f\xa0]+", " ")
    return trimmed(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def sentences(c: Column | str, least: int = LEAST_SENTENCE) -> Column:
    """The list of sentences: a stop before a capital, bracket or quote ends one, and so does every semicolon; short ones are dropped."""
    flat = F.regexp_replace(normalized(c), r"[ \n]+", " ")
    parts = F.flatten(F.transform(F.split(flat, r"""(?<=[.!?]) (?=[A-Z("'])"""), lambda p: F.split(p, r" ?; ?")))
    return F.filter(F.transform(parts, trimmed), lambda p: F.length(p) >= least)


def contains_any(c: Column, markers: list[str]) -> Column:
    return c.rlike("|".join(markers))


def stance(c: Column | str) -> Column:
    """suggestion before critique before praise before neutral; markers count inside words, suggestions only as words."""
    low = F.lower(_text(c))
    word = rf"(^|[^a-z0-9_])({'|'.join(SUGGESTION)})($|[^a-z0-9_])"
    return F.when(low.rlike(word), "suggestion").when(contains_any(low, CRITIQUE), "critique").when(contains_any(low, PRAISE), "praise").otherwise("neutral")


def tags(c: Column | str) -> Column:
    """All #word and then all [word], distinct in the order seen."""
    t = _text(c)
    return F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(r"#([A-Za-z0-9_]+)"), F.lit(1)), F.regexp_extract_all(t, F.lit(r"\[([A-Za-z0-9_]+)\]"), F.lit(1))))


def without_tags(c: Column | str) -> Column:
    return normalized(F.regexp_replace(F.regexp_replace(_text(c), r"#[A-Za-z0-9_]+", ""), r"\[[A-Za-z0-9_]+\]", ""))


def name_like(c: Column | str) -> Column:
    """Whether a line looks like a speaker's name."""
    t = trimmed(_text(c))
    words = F.split(t, r"[ \t\n\r\f\x0b\xa0]+")
    capital = F.exists(words, lambda w: w.rlike(r"^[A-Z][A-Za-z'.\-]*$"))
    plain = ~t.rlike(r"[.!?:]$") & ~F.lower(t).rlike("|".join(NAME_HEADERS))
    return F.length(t).between(3, 60) & plain & (F.size(words) <= 5) & capital


def raw_tokens(c: Column | str) -> Column:
    """Lower-case runs of letters a to z, digits, hyphens and apostrophes."""
    t = F.regexp_replace(F.lower(_text(c)), r"[^a-z0-9'\-]", " ")
    return F.filter(F.split(t, " +"), lambda w: w != "")


def ngram_tokens(c: Column | str) -> Column:
    """Tokens of two characters or more, stop words kept."""
    return F.filter(raw_tokens(c), lambda w: F.length(w) >= 2)


def tokens(c: Column | str) -> Column:
    """Tokens of two characters or more without stop words."""
    return F.filter(ngram_tokens(c), lambda w: ~w.isin(STOPWORDS))


def windows(words: Column, n: int) -> Column:
    """Every run of n neighbours, as lists; words must be a column or a bound variable."""
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(words, i + 1, n))).otherwise(F.array().cast("array<array<string>>"))


def ngrams(words: Column, least: int = 2, most: int = 3) -> Column:
    """Phrases of least to most tokens that neither begin nor end with a stop word."""

    def runs(w: Column) -> Column:
        every = F.concat(*[windows(w, n) for n in range(least, most + 1)])
        kept = F.filter(every, lambda r: ~F.get(r, F.lit(0)).isin(STOPWORDS) & ~F.element_at(r, -1).isin(STOPWORDS))
        return F.transform(kept, lambda r: F.array_join(r, " "))

    return let(words, runs)


def keyphrases(words: Column, most: int = 4) -> Column:
    """Phrases of one to most tokens without stop words, numbers and single characters; single words have four letters or more."""
    # What may not stand in a phrase becomes null, so the words are judged once and not in every run.
    good = F.transform(words, lambda w: F.when((F.length(w) >= 2) & ~w.isin(STOPWORDS) & ~w.rlike(r"^[0-9]+$"), w))

    def runs(w: Column) -> Column:
        every = F.concat(*[windows(w, n) for n in range(1, most + 1)])
        whole = F.transform(F.filter(every, lambda r: F.forall(r, lambda x: x.isNotNull())), lambda r: F.array_join(r, " "))
        return F.filter(whole, lambda p: ~p.rlike(r"^[-']|[-']$") & (p.contains(" ") | (F.length(p) >= 4)))

    return let(good, runs)


def stem(c: Column | str) -> Column:
    """The first word without its suffix, if three letters stay."""

    def cut(first: Column) -> Column:
        out = first
        for suffix in reversed(STEM_SUFFIXES):
            out = F.when(first.endswith(suffix) & (F.length(first) - len(suffix) >= 3), F.regexp_replace(first, f"{suffix}$", "")).otherwise(out)
        return out

    return let(F.regexp_extract(F.lower(trimmed(_text(c))), r"^([^ \t\n\r\f\x0b\xa0]*)", 1), cut)


def char_code_slot(c: Column | str, slots: int = 10) -> Column:
    """The sum of the character codes, modulo slots."""
    codes = F.transform(F.filter(F.split(_text(c), ""), lambda ch: ch != ""), lambda ch: F.ascii(ch))
    return F.aggregate(codes, F.lit(0), lambda s, x: s + x) % slots


def seed_phrases(c: Column | str) -> Column:
    """Phrases between commas and line breaks, trimmed, without blank ones."""
    return F.filter(F.transform(F.split(_text(c), r"[,\n]"), trimmed), lambda p: p != "")


def label_quality(c: Column | str) -> Column:
    """struct(score, passed, violations) of a label."""
    t = trimmed(F.coalesce(_text(c), F.lit("")))

    def judge(words: Column) -> Column:
        n, first = F.size(words), F.get(words, F.lit(0))
        rules = [
            (n == 1, 0.4, "single-word"), (n < 2, 0.0, "too-short"), (n > 7, 0.1, "too-long"),
            (F.size(F.filter(words, lambda w: w.isin(STOPWORDS))) / n > 0.4, 0.3, "stopword-heavy"),
            (first.isin(STOPWORDS) | first.isin(NON_NOUN_STARTS), 0.45, "non-noun-start"),
            (F.size(F.array_distinct(words)) != n, 0.45, "repetition"), (F.exists(words, lambda w: w.isin(FILLER_WORDS)), 0.1, "filler-words"),
        ]
        score = F.lit(1.0)
        for broken, penalty, _ in rules:
            score = score - F.when(broken, penalty).otherwise(0.0)
        score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)
        violations = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for broken, _, name in rules]))
        return F.struct(score.alias("score"), (score >= 0.6).alias("passed"), violations.alias("violations"))

    empty = F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("passed"), F.array(F.lit("empty")).alias("violations"))
    return F.when(t == "", empty).otherwise(let(F.transform(F.split(t, r"[ \t\n\r\f\x0b\xa0]+"), F.lower), judge))
