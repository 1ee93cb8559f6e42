r"""Problem 4: where further sentences start, in every script, in SQL expressions only.

Stops that end no sentence (abbreviations, initials, ordinals, addresses) are masked by a private-use
character, one for one, so that positions hold. Terminators of each script then get a mark before
the first character of what follows, and the lengths between marks give the starts. Private-use
characters of the text itself are replaced first. No minimal length, nothing is cut.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK, MARK = "", ""
LINE = r"(?>\r\n|[\n\r\x0b\f\x85\x{2028}\x{2029}])"
_H = r" \t\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
_W = _H + r"\n\r\x0b\f\x85\x{2028}\x{2029}"
W, H = f"[{_W}]", f"[{_H}]"
#: Invisible characters stand inside words and before blanks.
CF = r"\p{Cf}{0,2}"
#: Not inside a word.
B = r"(?<![\p{L}\p{M}\p{Nd}])(?<![\p{L}\p{M}\p{Nd}]\p{Cf}{1,3})"
NUMBER = rf"(?={W}*[#(]?(?:\p{{Nd}}|(?-i:\p{{Lu}})\p{{Nd}}))"
#: Before anything, and only before a number.
ALWAYS = "mr mrs ms dr prof sr sra srta hr mme mlle dipl ing st vs vgl cf acc re est incl bros ca approx env aprox bzw tel e\\.g i\\.e βλ डॉ".split()
COUNTED = "no nr fig figs abb vol p pp pa?́?g pág págs art str ext s ch sec ص".split()
MONTHS = "Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember"


def any_of(words: list[str]) -> str:
    """A pattern of any of words, with invisible characters anywhere inside."""
    return "|".join(CF.join(re.findall(r"\\?.\??", w)) for w in words)


#: What is masked: (pattern, replacement).
MASKS = [
    ("[-]", "�"),
    # The stop comes first in a pattern and the word before it is looked back at, which costs nothing elsewhere.
    # Two stops.
    (rf"(?iu){B}([zduo]|p|π|m|i|e|a|b)\.({W}*)(b|h|a|ä|ex|ej|χ|e|g)\.(?={W})", rf"$1{MASK}$2$3{MASK}"),
    (rf"(?iu)\.(?<={B}(?:{any_of(ALWAYS)}){CF}\.)", MASK),
    (rf"(?iu)\.{NUMBER}(?<={B}(?:{any_of(COUNTED)}){CF}\.)", MASK),
    (rf"(?iu)\.(?={W}+(?-i:\p{{Ll}}))(?<={B}(?:etc|usw|al|inc|ltd|no|p|art|fig|μ)\.)", MASK),
    # Ordinals of days.
    (rf"(?iu)\.(?={W}+(?:{MONTHS})(?!\p{{L}}))(?<={B}\p{{Nd}}{{1,2}}\.)", MASK),
    # Initials and short given names; after "Surname, " an initial ends the name.
    (rf"(?<![\p{{L}}\p{{M}}\p{{Nd}}.])(?<!\p{{Ll}},[ \xa0\n])(\p{{Lu}}\p{{M}}?)\.(?={W}+\p{{Lu}}|{W}*\p{{Lu}}\.)", rf"$1{MASK}"),
    (rf"{B}(\p{{Lu}}\p{{M}}?)\.(?={W}+\p{{Ll}})", rf"$1{MASK}"),
    # Thinking pauses and dots between blanks.
    (rf"(?iu){B}(?:hm{{1,4}}|um|er)", None),
    (W, None),
]
_END = r"\)\]）"
_QUOTE = r"""\"”“»«’'」』"""
NEXT = rf"(?=[^{_W},;:.!?…{_END}{MARK}])(?![»”」』](?:[,;:.…]|{W}))"
#: What gets a mark behind it.
ENDS = [
    # It begins at the line's end, so blanks inside lines cost nothing; starts() drops a mark with nothing before it.
    rf"({LINE}{H}*{LINE}{W}*+)(?=[^{_W}])",
    # Question and exclamation, also of Arabic and Devanagari; a bracket ends a sentence only before no small letter.
    rf"([!?.…]*[!?؟।॥۔][!?.…]*{CF}{W}+){NEXT}",
    rf"([!?.…؟।॥۔][{_END}]+{CF}{W}+){NEXT}(?!\p{{Ll}})",
    rf"((?<![.…])\.{CF}{W}+){NEXT}",
    rf"((?:\.{{2,}}|…){CF}{W}+){NEXT}(?!\p{{Ll}})",
    # A quotation ends the sentence only where a capital follows, and scripts without capitals never tell.
    rf"([!?.…][{_QUOTE}]+[{_END}]*{CF}{W}+)(?=[\"“„«'(]*\p{{Lu}}(?:[\p{{Ll}}\p{{M}}'’]|{W}))",
    # No blank behind the stop.
    rf"((?<=\p{{Ll}}{{2}})[.!?…]+)(?=\p{{Lu}}\p{{M}}?(?:\p{{Ll}}|{W}))",
    rf"([。！？｡]+{W}*)(?=[^{_W}。！？｡{_END}{_QUOTE}{MARK}])",
    rf"(\p{{IsGreek}}\p{{M}}*[;\x{{37E}}]+{CF}{W}+){NEXT}",
    rf"((?<=\p{{IsThai}})\p{{Cf}}*{H}++)(?!\p{{Cf}}*[\p{{Nd}}\p{{IsLatin}}{_W}{MARK}])(?=.)",
    rf"((?<=[^\p{{Nd}}\p{{IsLatin}}{_W}{MARK}]){H}++)(?=\p{{Cf}}*\p{{IsThai}})",
]
#: Addresses of mail and web, whose stops are masked one by one.
ADDRESS = r"\.(?=[\p{L}\p{Nd}])(?<=(?:[^\s.]{1,64}@[^\s@]{0,64}|www[^\s]{0,64}|https?:[^\s]{0,64})\.)|\.(?=[^\s@]{0,64}@[\p{L}\p{Nd}])"


def masked(text: Column) -> Column:
    def step(t: Column, m: tuple[str, str | None]) -> Column:
        pattern, to = m
        if to is not None:
            return F.regexp_replace(t, pattern, to)
        # pattern is what stands before; a run of dots becomes as many masks.
        after = rf"(?={W})" if pattern == W else ""
        for dots, n in (("…", 1), (r"\.\.\.", 3)):
            t = F.regexp_replace(t, rf"{dots}{after}(?<={pattern}{dots})", MASK * n)
        return t

    first = F.regexp_replace(F.regexp_replace(text, *MASKS[0]), ADDRESS, MASK)
    return reduce(step, MASKS[1:], first)


def starts(text: Column) -> Column:
    """Where further sentences start, in code points from 0, ascending; the length of text comes last."""
    marked = reduce(lambda t, p: F.regexp_replace(t, p, "$1" + MARK), ENDS, masked(text))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    step = lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.array_append(a["all"], a["at"] + F.length(p)).alias("all"))
    return F.array_distinct(F.aggregate(F.split(marked, MARK), zero, step, lambda a: a["all"]))


def sentence_starts(records: DataFrame) -> DataFrame:
    """record_kind, record_id, start_at over records(record_kind, record_id, text)."""
    blank = F.length(F.regexp_extract("text", rf"^{W}*", 0))
    each = records.filter("text is not null").select("record_kind", "record_id", F.length("text").alias("n"), blank.alias("blank"), F.explode_outer(starts(F.col("text"))).alias("start_at"))
    return each.filter("start_at > blank and start_at < n").select("record_kind", "record_id", "start_at")


def found(comments: DataFrame, sentences: DataFrame) -> DataFrame:
    one = lambda df, kind, key, value: df.groupBy(F.col(key).alias("record_id")).agg(F.max(F.struct("ingested_at", value)).alias("r")).select(F.lit(kind).alias("record_kind"), "record_id", F.col("r")[value].alias("text"))
    return sentence_starts(one(comments.filter("channel <> 'scan'"), "comment", "comment_id", "text").union(one(sentences, "sentence", "sent_id", "sentence")))


def p4_found(spark, sf_dir):
    from quillmesh.sources.tables import table

    return found(table(spark, sf_dir, "comments"), table(spark, sf_dir, "sentences"))


QUERIES = {"p4_found": p4_found}
ORACLES = {}
