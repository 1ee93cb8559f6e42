r"""Problem 9: template residue and error-page text, by aligning records of one template.

Slots. Every delimited span of a segment (a line or sentence) is taken out; what is left is the
segment's frame. Records with the same frame are aligned at the span, so a frame whose spans differ
holds a slot, and a span's content that fills several frames, or stands in several delimiter styles,
is a variable name that was retained. A span is residue if its content is shaped like a variable,
default or blank and the alignment says so; delimiters that only template languages use need no
second record. Numbers, lists and formulas between the same delimiters fail on shape or on alignment.

Pages. Segments get a key without numbers, case and identifiers, so repeated pages and pages put together from
repeated parts align. Seed segments carry terms of error messages, script notices and filler text.
A page of which most characters lie in marked segments is an error page; a segment is then
marked by the share of its records that are such pages, which unmarks a sentence that merely mentions
an error in real reports and marks the parts of error pages (menus, footers, reference lines) that
carry no term. ROUNDS rounds; only segment keys are exchanged, and nothing is collected.

Defined results: null and blank texts are no cases; a repost has the same segments and so the same
result; a repeated row counts once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.session import materialise

MOST = 0.5
#: Share of a segment's records that must be residue pages, for seeds and for segments without a term.
SEED_RATE, PLAIN_RATE, PLAIN_PAGES = 0.5, 0.5, 2
ROUNDS = 4
SEGMENT_ENDS = r"[\r\n]+|(?<=[.!?])\s+|(?<=[。！？｡])"

# Delimiters of template languages. The first group needs no second record.
SPANS = [
    ("{{", r"\{\{\s*([^{}]{0,60})\}\}"), ("${", r"\$\{\s*([^{}]{0,60})\}"), ("<%", r"<%=?\s*([^<>%]{0,60})%>"), ("[[", r"\[\[\s*([^\[\]]{0,60})\]\]"), ("[insert", r"(?i)\[\s*(?:insert|enter|your)\s+([^\[\]]{0,60})\]"),
    ("{%", r"\{%\s*([^{}%]{0,60})%\}"), ("[object", r"(\[object Object\])"),
    ("{", r"(?<![{$])\{\s*([\p{L}_][^{}%]{0,60})\}(?!\})"), ("<", r"<\s*([\p{L}_][^<>%=/]{0,60})>"), ("__", r"(?<!_)__([\p{L}][^_\n]*(?:_[^_\n]+)*)__(?!_)"), ("%", r"%([\p{L}_][^%\n]{0,40})%"), ("#", r"#([\p{L}_][^#\n]{0,40})#"), ("[", r"(?<![\p{L}\[])\[\s*([\p{L}_][^\[\]]{0,60})\](?!\])"),
]
SURE = ["{{", "${", "<%", "[[", "[insert", "{%", "[object"]
#: A variable: one to three words of letters, digits, stops and underscores.
VARIABLE = r"^[\p{L}_][\p{L}\p{N}_.\-]*(?: [\p{L}\p{N}_.\-]+){0,2}$"
#: Joined words, which prose does not have.
JOINED = r"^[\p{L}\p{N}]+(?:[_.][\p{L}\p{N}]+)+$"

# For lower case. Terms of error messages, script notices and filler text in the languages of the corpus.
SEED = (
    r"(?:error|exception)\b|\bfile \"[^\"]+\", line|on line \d|\.php\b|\w::\w+\(|\bat \w+ \([^)]*:\d+\)|#(?:ref|value|name)[!?]|#n/a|nicht gefunden|existiert nicht|\berrors\b|\bfatal\b|traceback|\bnoscript\b|java ?script|\bscripts?\b|\bscripting\b|\bjs\b|\be_no|https? #|not found|unavailable|time[- ]?out|timed out|forbidden|"
    r"bad gateway|internal server|gateway|too many requests|access denied|permission to|session has|expired|cookies|browser|went wrong|could not (?:connect|be (?:located|found|loaded))|no longer valid|"
    r"no answer|limit was exceeded|was deleted|is gone|(?:try|load) (?:it )?again|reload|refresh|log ?in to|sign in|oops|whoops|lorem|ipsum|blindtext|dummy text|filler|placeholder|goes here|"
    r"add a short|short description of|headline|subtitle of|loading\.\.\.|cannot read|undefined|null pointer|\bnginx\b|\bapache\b|administrator|captcha|"
    r"erreur|réessayer|introuvable|supprimé|activer|désactivé|fehler|seite (?:nicht|benötigt|wurde)|aktivieren|deaktiviert|später|página|intentarlo|navegador|habilit|σφάλμα|σελίδα|javascript|"
    r"ページ|有効にして|エラー|页面|返回首页|启用|错误|刷新|पृष्ठ|त्रुटि|सक्षम|خطأ|الصفحة|تفعيل|หน้านี้|ข้อผิดพลาด|เปิดใช้"
)
# The words of the usual filler text.
FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()


def segmented(documents: DataFrame) -> DataFrame:
    """doc_id, segment: lines and sentences that are not blank."""
    each = documents.filter("text is not null").select("doc_id", F.explode_outer(F.split("text", SEGMENT_ENDS)).alias("segment"))
    return each.select("doc_id", F.trim(F.regexp_replace("segment", r"(?U)\s+", " ")).alias("segment")).filter("segment <> ''")


def shape(segment: Column) -> Column:
    """Lower case, without numbers, identifiers and marks at the ends."""
    t = F.regexp_replace(F.lower(segment), r"\b[0-9a-f]*[0-9][0-9a-f]*(?:[-–:.,][0-9a-f]+)*\b", "#")
    return F.regexp_replace(t, r"^[\s>*#\-\[\]()]+|[\s\-\[\]().!:…]+$", "")


def _styled(style: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all("segment", F.lit(pattern), F.lit(1)), lambda v: F.struct(F.lit(style).alias("style"), v.alias("inner")))


def spans(segments: DataFrame) -> DataFrame:
    """doc_id, style, name, frame of every delimited span."""
    some = segments.filter(F.col("segment").rlike(r"[{}\[\]<>%#]|__"))
    found = [_styled(style, pattern) for style, pattern in SPANS]
    each = some.select("doc_id", "segment", F.explode(F.concat(*found)).alias("span")).select("doc_id", "segment", "span.style", "span.inner")
    name = F.trim(F.regexp_replace(F.regexp_replace("inner", r"\|.*$", ""), r"(?i)\s+here\s*$", ""))
    # The frame ends where the neighbours' words may differ: the words beside the span.
    at = F.expr("instr(segment, inner)")
    left = F.regexp_extract(F.substring_index(F.expr("left(segment, instr(segment, inner) - 1)"), "\n", -1), r"((?:[\p{L}\p{N}]+\W+){0,2})$", 1)
    right = F.regexp_extract(F.expr("substring(segment, instr(segment, inner) + length(inner))"), r"^\W*((?:[\p{L}\p{N}]+\W*){0,2})", 1)
    return each.filter(at > 0).select("doc_id", "style", name.alias("name"), F.xxhash64(F.lower(left), F.lower(right)).alias("frame"))


def retained(segments: DataFrame) -> DataFrame:
    """doc_id of records that keep a variable name, default or blank in a slot."""
    each = materialise(spans(segments), "p9-spans")
    # One row per style, name and frame, however many records hold it.
    kinds = each.groupBy("style", "name", "frame").agg(F.count(F.lit(1)).alias("records"))
    slots = kinds.groupBy("frame").agg(F.countDistinct("name").alias("fills"))
    names = kinds.groupBy("name").agg(F.countDistinct("style").alias("styles"), F.countDistinct("frame").alias("frames"))
    shaped = F.col("name").rlike(VARIABLE)
    sure = F.col("style").isin(SURE) & (shaped | (F.trim("name") == "") | (F.col("style") == "[object"))
    aligned = shaped & (((F.col("styles") > 1) & ((F.col("frames") > 1) | (F.col("fills") > 1))) | F.col("name").rlike(JOINED))
    bad = kinds.join(slots, "frame").join(names, "name").filter(sure | aligned).select("style", "name", "frame")
    return each.join(bad, ["style", "name", "frame"], "left_semi").select("doc_id")


def residue_pages(segments: DataFrame) -> DataFrame:
    """doc_id of records that consist for the most part of error messages, script notices or filler."""
    words = F.regexp_extract_all(F.lower("segment"), F.lit(r"\p{L}+"), F.lit(0))
    filler = F.size(F.filter("words", lambda w: w.isin(FILLER))) * 2 > F.size("words")
    keyed = segments.select("doc_id", "segment", words.alias("words")).select("doc_id", F.xxhash64(shape(F.col("segment"))).alias("key"), F.length(F.regexp_replace("segment", " ", "")).alias("chars"), F.when(filler & (F.size("words") > 3), 2).when(F.lower("segment").rlike(SEED), 1).otherwise(0).alias("seed"))
    keyed = materialise(keyed.filter("doc_id is not null"), "p9-segments")
    size = keyed.groupBy("doc_id").agg(F.sum("chars").alias("size"), F.max("seed").alias("seed"))
    # Only pages with a seed can become residue; the records of their segments are counted over all documents.
    pages = materialise(size.filter("seed > 0").select("doc_id", "size"), "p9-pages")
    inside = materialise(keyed.join(pages, "doc_id", "left_semi"), "p9-inside")
    everywhere = keyed.join(inside.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.countDistinct("doc_id").alias("records"))
    everywhere = materialise(everywhere, "p9-keys")
    marked = inside.groupBy("key").agg(F.max("seed").alias("seed")).filter("seed > 0").select("key")
    for turn in range(ROUNDS + 1):
        hit = inside.join(marked, "key", "left_semi").groupBy("doc_id").agg(F.sum("chars").alias("hit"))
        flagged = materialise(hit.join(pages, "doc_id").filter(F.col("hit") > MOST * F.col("size")).select("doc_id"), "p9-flagged")
        if turn < ROUNDS:
            seen = inside.join(flagged, "doc_id", "left_semi").groupBy("key").agg(F.countDistinct("doc_id").alias("pages"), F.max("seed").alias("seed")).join(everywhere, "key")
            rate = F.col("pages") / F.col("records")
            marked = materialise(seen.filter((F.col("seed") == 2) | ((F.col("seed") == 1) & (rate >= SEED_RATE)) | ((rate >= PLAIN_RATE) & (F.col("pages") >= PLAIN_PAGES))).select("key"), "p9-marked")
    return flagged


def found(documents: DataFrame) -> DataFrame:
    """doc_id of every case."""
    segments = segmented(documents.select("doc_id", "text"))
    return retained(segments).unionByName(residue_pages(segments)).distinct()


def clean(documents: DataFrame) -> DataFrame:
    """documents without the cases."""
    return documents.join(found(documents), "doc_id", "left_anti")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.sources.tables import table

    return found(table(spark, sf_dir, "documents"))


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.sources.tables import table

    return clean(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")).select("doc_id", "source", "lang", "n_chars")


QUERIES = {"p9_found": p9_found, "p9_clean": p9_clean}
ORACLES: dict[str, str] = {}
