"""Problem 6: variant spellings of names typed by people, by suffix blocking and longest common subsequences.

Spellings are folded (case, accents, blanks, transliterated umlauts). Distinct (city, spelling,
affiliation) triples are the units that are compared. Every suffix of a token from MIN_SUFFIX
letters on is an index key. A suffix is refined with the city first, as an entity has one, which loses nothing;
one that is still overly common in its city is refined with the initial of another token of the name
(whole tokens only from a higher count on). No key is discarded. Units that share a key are compared once by the ratio of their longest common
subsequence, part by part: firms and institutes on what is left without generic words, persons on
surname and given name in either order. A given name may also be an initial, an abbreviation or a
short form of the other; such a form is linked only if it fits one person of its city and surname,
or the one of its affiliation.

Defined results: blocks with a null, empty or blank speaker or home_city are in no pair (catch-all
speakers have no city); two known affiliations that differ separate persons; repeated blocks count
once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators.components import components
from quillmesh.session import materialise

MIN_SUFFIX = 4
#: Spellings that share a suffix, or a whole token, in one city from which on the key is refined.
COMMON, COMMON_TOKEN = 40, 400
NONE, SHORT, FULL, BOTH_SHORT = 0, 1, 2, 3

# Words that say what kind of body a name is, with the kind.
KINDS = {
    "atelier": "atelier", "at": "atelier", "gmbh": "atelier", "architects": "architects", "ltd": "architects", "limited": "architects",
    "department": "department", "dept": "department", "dud": "department", "urban": "department", "design": "department", "college": "department", "coll": "department",
    "institute": "institute", "inst": "institute", "ils": "institute", "landscape": "institute", "studies": "institute", "partners": "partners",
}
GENERIC = {*KINDS, "of", "for", "the", "and", "arch", "studio", "bureau", "academy", "office", "inc", "ag", "co", "company", "group", "university", "school"}
TITLES = {"dr", "prof", "mr", "mrs", "ms", "miss", "herr", "frau", "sr", "sra", "srta", "mme", "mlle", "m", "arch", "ing", "dipl", "professor", "sir"}
# Short forms that neither begin nor end the name they stand for.
SHORT_FORMS = {
    "bob": "robert", "bobby": "robert", "bill": "william", "dick": "richard", "rick": "richard", "mike": "michael", "mick": "michael", "sascha": "alexander",
    "sandy": "alexander", "paco": "francisco", "pancho": "francisco", "pepa": "josefina", "nacho": "ignacio", "klaus": "nikolaus", "maggie": "margarete", "peggy": "margarete",
    "hattie": "henrietta", "harriet": "henrietta", "freddy": "frederik", "fritz": "frederik", "ulla": "ursula", "uschi": "ursula", "liz": "elisabeth", "betty": "elisabeth",
    "lotte": "charlotte", "charlie": "charlotte", "toni": "antonia", "trish": "patricia", "tricia": "patricia", "vicky": "victoria", "katja": "katharina", "kathi": "katharina",
    "kate": "katharina", "jack": "john", "ted": "edward", "ned": "edward", "hans": "johannes", "hanna": "johanna", "jim": "james", "liv": "olivia", "lisa": "elisabeth",
    "beth": "elisabeth", "thea": "dorothea", "gabi": "gabriela", "niko": "nikolaus", "zach": "zacharias", "fina": "josefina", "greta": "margarete",
}


#: As folded() leaves them.
SHORT_FORMS = {k: re.sub("([aou])e(?!$)", r"\1", v) for k, v in SHORT_FORMS.items()}


def folded(text: Column) -> Column:
    """Lower case without accents, invisible characters and stops; transliterated umlauts as their letter; single blanks; null as empty."""
    plain = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), F.coalesce(F.regexp_replace(text, r"\p{Cf}", ""), F.lit("")), F.lit(True))
    t = F.lower(F.regexp_replace(plain, r"\p{M}", ""))
    t = F.translate(t, "øłđıœæð", "oldioad")
    t = F.regexp_replace(F.regexp_replace(t, "ß", "ss"), r"(?<=[bcdfghjklmnpqrstvwxyz]|^)([aou])e(?!$)", "$1")
    t = F.regexp_replace(t, r"\.", " .")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"(?U)[^\p{L}\p{N},.&+\- ]", " "), r"(?U)\s+", " "))


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence, bit-parallel."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & where.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def alike(a: str, b: str) -> bool:
    """The ratio 2 * common / (len + len) is as high as one slip of the hand leaves it: a letter lost at most on each side."""
    return a == b or (min(len(a), len(b)) >= 4 and abs(len(a) - len(b)) <= 1 and 2 * common(a, b) >= len(a) + len(b) - 2)


@lru_cache(1 << 16)
def parsed(name: str) -> tuple:
    """('firm', kind, core) or ('person', ((given, surname parts), …)) with each order that the writing allows."""
    words = re.findall(r"[^\W_]+", name.replace(" .", ""))
    marks = [KINDS[w] for w in words if w in KINDS]
    title = words[:1] == ["arch"] and len(words) >= 3 and not marks
    if (marks or "&" in name or "+" in name) and not title or words[1:2] == ["arch"]:
        kind = "partners" if "partners" in marks else marks[0] if marks else ""
        return "firm", kind, "".join(sorted(w for w in words if w not in GENERIC and len(w) > 1))
    before, comma, after = name.partition(",")
    token = r"([^\W_]+)(?:-([^\W_]+))?( \.)?"

    def parts(text: str) -> list[tuple[str, ...]]:
        found = [tuple(x for x in m[:2] if x) for m in re.findall(token, text)]
        while len(found) > 1 and len(found[0]) == 1 and found[0][0] in TITLES and not (len(found) == 2 and len(found[0][0]) == 1):
            found = found[1:]
        return found

    if comma:
        given, surname = parts(after), parts(before)
        return "person", (((given[0][0] if given else ""), surname[-1] if surname else ()),)
    found = parts(name)
    if len(found) > 2:
        found = [found[0], *(f for f in found[1:] if len(f[0]) > 1)]
    if len(found) < 2:
        return "person", (("", found[0] if found else ()),)
    forward = (found[0][0], found[-1])
    return "person", (forward, (found[-1][0], found[0])) if len(found) == 2 and len(found[-1]) == 1 else (forward,)


def short_of(a: str, b: str) -> bool:
    """Whether a is an initial, an abbreviation or a short form of b."""
    b = SHORT_FORMS.get(b, b)
    if not a or len(a) >= len(b) and SHORT_FORMS.get(a) != b:
        return False
    return b.startswith(a) or SHORT_FORMS.get(a) == b or (len(a) >= 3 and b.endswith(a)) or (3 <= len(a) <= 6 and a[:-1] == b[: len(a) - 1])


def surnames(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Alike part by part; a double surname also fits one of its parts."""
    if not a or not b:
        return False
    if len(a) == len(b):
        slips = [x for x, y in zip(a, b, strict=True) if x != y]
        return all(map(alike, a, b)) and len(slips) <= 1
    short, long = sorted((a, b), key=len)
    if alike(short[0], "".join(long)):
        return True
    return any(alike(short[0], x) for x in long)


@lru_cache(1 << 16)
def compared(a: str, b: str) -> tuple[int, bool]:
    """How two spellings agree, and whether a is the shorter form."""
    x, y = parsed(a), parsed(b)
    if x[0] != y[0]:
        return NONE, False
    if x[0] == "firm":
        fits = bool(x[2]) and (x[1] == y[1] or not x[1] or not y[1]) and alike(x[2], y[2])
        return (FULL if fits else NONE), False
    best = (NONE, False)
    for g, s in x[1]:
        for h, t in y[1]:
            if not g or not h or not surnames(s, t):
                continue
            if g == h:
                return (FULL if len(g) > 1 else BOTH_SHORT), False
            if alike(g, h):
                return FULL, False
            if short_of(g, h):
                best = (SHORT, True)
            elif short_of(h, g):
                best = (SHORT, False)
    return best


def units(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """unit, city, name, affiliation; and block_id, speaker, unit."""
    rows = blocks.filter("trim(home_city) <> '' and trim(speaker) <> ''").select("block_id", "speaker", F.lower(F.trim("home_city")).alias("city"), folded(F.col("speaker")).alias("name"), folded(F.col("affiliation")).alias("affiliation"))
    rows = rows.filter("name <> ''").withColumn("unit", F.xxhash64("city", "name", "affiliation"))
    rows = materialise(rows.distinct(), "p6-blocks")
    return rows.select("unit", "city", "name", "affiliation").distinct(), rows.select("block_id", "speaker", "unit")


def suffix_pairs(each: DataFrame) -> DataFrame:
    """a, b (units) with their city, names and affiliations: every pair that shares a key of the suffix index."""
    spellings = each.select("city", "name").distinct()
    tokens = F.array_distinct(F.filter(F.split("name", r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 2))
    token = spellings.select("city", "name", tokens.alias("tokens"), F.explode(tokens).alias("token"))
    size = F.length("token")
    keyed = token.select("city", "name", "tokens", "token", F.explode(F.when(size > MIN_SUFFIX, F.sequence(F.lit(MIN_SUFFIX), size)).otherwise(F.array(size))).alias("n"))
    keyed = keyed.select("city", "name", "tokens", "token", F.col("n") == F.length("token"), F.expr("right(token, n)").alias("suffix")).toDF("city", "name", "tokens", "token", "whole", "suffix")
    often = keyed.groupBy("city", "suffix").agg(F.count(F.lit(1)).alias("often"))
    keyed = materialise(keyed.join(often, ["city", "suffix"]), "p6-suffixes")
    rare = F.col("often") <= F.when(F.col("whole"), COMMON_TOKEN).otherwise(COMMON)
    plain = keyed.filter(rare).select("city", "name", F.concat(F.lit("s:"), "suffix").alias("key"))
    others = F.array_distinct(F.transform(F.filter("tokens", lambda t: t != F.col("token")), lambda t: F.substring(t, 1, 1)))
    refined = keyed.filter(~rare).select("city", "name", "suffix", F.explode_outer(others).alias("initial")).select("city", "name", F.concat(F.lit("r:"), "suffix", F.lit(":"), F.coalesce("initial", F.lit(""))).alias("key"))
    keys = materialise(plain.unionByName(refined).distinct(), "p6-keys")
    l, r = keys.alias("l"), keys.alias("r")
    return l.join(r, F.expr("l.city = r.city and l.key = r.key and l.name < r.name")).select("l.city", F.col("l.name").alias("name_a"), F.col("r.name").alias("name_b")).distinct()


def judged(pairs: DataFrame) -> DataFrame:
    """pairs with level and a_short, by longest common subsequences, without those that do not agree."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [compared(a, b) for a, b in zip(batch["name_a"], batch["name_b"], strict=True)]
            batch["level"], batch["a_short"] = [f[0] for f in found], [f[1] for f in found]
            yield batch[batch["level"] != NONE]

    return pairs.mapInPandas(judge, "city string, name_a string, name_b string, level int, a_short boolean")


def links(each: DataFrame) -> DataFrame:
    """a, b: units of one entity."""
    agreed = materialise(judged(suffix_pairs(each)), "p6-agreed")
    side = lambda c: each.select("city", F.col("name").alias(f"name_{c}"), F.col("affiliation").alias(f"aff_{c}"), F.col("unit").alias(c))
    same_name = each.select("city", "name").distinct().select("city", F.col("name").alias("name_a"), F.col("name").alias("name_b"), F.lit(FULL).alias("level"), F.lit(False).alias("a_short"))
    pairs = agreed.unionByName(same_name).join(side("a"), ["city", "name_a"]).join(side("b"), ["city", "name_b"])
    pairs = materialise(pairs.filter("a <> b and (name_a <> name_b or a < b) and (aff_a = '' or aff_b = '' or aff_a = aff_b)").select("a", "b", "level", "a_short", (F.expr("aff_a = aff_b and aff_a <> ''")).alias("same_aff")), "p6-pairs")
    full = pairs.filter(F.col("level") == FULL).select("a", "b")
    groups = components(full)
    # The short form of each pair, the long form, and the person the long form is.
    short = pairs.filter(F.col("level") == SHORT).select(F.when(F.col("a_short"), F.col("a")).otherwise(F.col("b")).alias("short"), F.when(F.col("a_short"), F.col("b")).otherwise(F.col("a")).alias("long"), "same_aff")
    shorts = materialise(short.select(F.col("short").alias("long")).distinct(), "p6-short")
    fits = short.join(shorts, "long", "left_anti").join(groups.withColumnRenamed("id", "long"), "long", "left").withColumn("person", F.coalesce("component", "long"))
    persons = fits.groupBy("short").agg(
        F.min("person").alias("least"), F.max("person").alias("most"), F.min(F.when(F.col("same_aff"), F.col("person"))).alias("aff_least"), F.max(F.when(F.col("same_aff"), F.col("person"))).alias("aff_most")
    )
    one = F.when(F.col("aff_least") == F.col("aff_most"), F.col("aff_least")).when(F.col("least") == F.col("most"), F.col("least"))
    resolved = materialise(persons.select("short", one.alias("person")), "p6-resolved")
    known = resolved.select(F.col("short"))
    alone = pairs.filter(F.col("level") == BOTH_SHORT).join(known.withColumnRenamed("short", "a"), "a", "left_anti").join(known.withColumnRenamed("short", "b"), "b", "left_anti").select("a", "b")
    return full.unionByName(resolved.filter("person is not null").select(F.col("short").alias("a"), F.col("person").alias("b"))).unionByName(alone)


def entities(blocks: DataFrame) -> DataFrame:
    """block_id, speaker, entity of every block that names somebody."""
    each, rows = units(blocks)
    each = materialise(each, "p6-units")
    joined = rows.join(components(links(each)).withColumnRenamed("id", "unit"), "unit", "left")
    return joined.select("block_id", "speaker", F.coalesce("component", "unit").alias("entity"))


def found(blocks: DataFrame) -> DataFrame:
    """block_a, block_b."""
    rows = materialise(entities(blocks), "p6-entities")
    l, r = rows.alias("l"), rows.alias("r")
    pairs = l.join(r, F.expr("l.entity = r.entity and l.block_id < r.block_id and l.speaker <> r.speaker"))
    return pairs.select(F.col("l.block_id").alias("block_a"), F.col("r.block_id").alias("block_b")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.sources.tables import table

    return found(table(spark, sf_dir, "blocks"))


def p6_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.sources.tables import table

    return entities(table(spark, sf_dir, "blocks"))


QUERIES = {"p6_found": p6_found, "p6_entities": p6_entities}
ORACLES: dict[str, str] = {}
