"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from quillmesh.lexicons import CRITIQUE, PRAISE, STOPWORDS, SUGGESTION


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


STOP = f"[{quoted(STOPWORDS)}]"
_ANY = lambda words: "|".join(words).replace("'", "''")


def stance(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches(lower({x}), '(^|[^a-z0-9_])({_ANY(SUGGESTION)})($|[^a-z0-9_])') THEN 'suggestion' "
        f"WHEN regexp_matches(lower({x}), '{_ANY(CRITIQUE)}') THEN 'critique' WHEN regexp_matches(lower({x}), '{_ANY(PRAISE)}') THEN 'praise' ELSE 'neutral' END"
    )


SPEAKER = "coalesce(nullif(trim(speaker), ''), 'Unattributed')"
#: s: sentence facts.
S = f"""s AS (SELECT sent_idx, sent_id, competition_id, {SPEAKER} AS speaker, sentence, {stance('sentence')} AS stance, source_tags, comment_id, concept_id, concept_membership
 FROM (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY sent_idx DESC) AS rn FROM sentences) WHERE rn = 1 AND trim(sentence) <> '')"""
#: c: comment facts.
C = f"""c AS (SELECT comment_id, {SPEAKER} AS speaker, text, tags, channel, block_id FROM (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY ingested_at DESC NULLS LAST, text DESC NULLS LAST) AS rn FROM comments) WHERE rn = 1 AND trim(text) <> '')"""
#: k: concept facts.
K = """k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY updated_at DESC NULLS LAST, label DESC NULLS LAST, summary DESC NULLS LAST) AS rn FROM concepts) WHERE rn = 1)"""
#: m: memberships, after S.
M = """e AS (SELECT sent_id, speaker, stance, source_tags, unnest(CASE WHEN len(list_filter(concept_membership, lambda x: x.concept_id IS NOT NULL AND x.weight > 0)) > 0
   THEN list_filter(concept_membership, lambda x: x.concept_id IS NOT NULL AND x.weight > 0) ELSE [{'concept_id': concept_id, 'weight': 1.0::DOUBLE}] END) AS q FROM s),
 g AS (SELECT sent_id, q.concept_id AS concept_id, min(speaker) AS speaker, min(stance) AS stance, min(source_tags) AS source_tags, sum(q.weight) AS weight FROM e WHERE q.concept_id IS NOT NULL GROUP BY 1, 2),
 h AS (SELECT *, weight / sum(weight) OVER (PARTITION BY sent_id) AS share FROM g),
 m AS (SELECT sent_id, concept_id, speaker, stance, source_tags, share AS weight, row_number() OVER (PARTITION BY sent_id ORDER BY share DESC, concept_id) = 1 AS top FROM h)"""
SC = "sc AS (SELECT speaker, concept_id, mass, hard_count, mass / sum(mass) OVER (PARTITION BY speaker) AS weight FROM (SELECT speaker, concept_id, sum(weight) AS mass, count(*) FILTER (top) AS hard_count FROM m GROUP BY 1, 2))"


def raw_tokens(x: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({x}), '[^a-z0-9''\\-]', ' ', 'g'), ' +'), lambda w: w <> '')"


def ngram_tokens(x: str) -> str:
    return f"list_filter({raw_tokens(x)}, lambda w: len(w) >= 2)"


def tokens(x: str) -> str:
    return f"list_filter({raw_tokens(x)}, lambda w: len(w) >= 2 AND NOT list_contains({STOP}, w))"


def windows(table: str, keys: str, words: str, n: int) -> str:
    """Rows (keys, r): each run of n neighbours of the list words."""
    return f"SELECT {keys}, {words}[i:i + {n - 1}] AS r FROM (SELECT {keys}, {words}, unnest(range(1, len({words}) - {n} + 2)) AS i FROM {table})"


def ngrams(table: str, keys: str, words: str) -> str:
    both = " UNION ALL ".join(windows(table, keys, words, n) for n in (2, 3))
    return f"SELECT {keys}, array_to_string(r, ' ') AS term FROM ({both}) WHERE NOT list_contains({STOP}, r[1]) AND NOT list_contains({STOP}, r[-1])"


def phrases(table: str, keys: str, words: str) -> str:
    every = " UNION ALL ".join(windows(table, keys, words, n) for n in (1, 2, 3, 4))
    good = f"len(list_filter(r, lambda w: len(w) < 2 OR list_contains({STOP}, w) OR regexp_full_match(w, '[0-9]+'))) = 0"
    return f"SELECT {keys}, phrase FROM (SELECT {keys}, array_to_string(r, ' ') AS phrase, r FROM ({every}) WHERE {good}) WHERE NOT regexp_matches(phrase, '^[-'']|[-'']$') AND (len(r) > 1 OR len(phrase) >= 4)"


#: Blanks that no engine's pattern for white space holds alike.
def normal(x: str) -> str:
    b = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(160)"
    one = f"regexp_replace(replace({x}, chr(13), chr(10)), '[ \\t\\x0b\\f\\x{{a0}}]+', ' ', 'g')"
    return f"trim(regexp_replace({one}, '\\n{{3,}}', chr(10) || chr(10), 'g'), {b})"


def split(x: str) -> str:
    """The list of sentences of 18 characters or more."""
    b = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(160)"
    flat = f"regexp_replace({normal(x)}, '[ \\n]+', ' ', 'g')"
    cut = f"""regexp_replace({flat}, '([.!?]) ([A-Z("''])', '\\1' || chr(1) || '\\2', 'g')"""
    return f"list_filter(list_transform(flatten(list_transform(string_split({cut}, chr(1)), lambda p: string_split_regex(p, ' ?; ?'))), lambda p: trim(p, {b})), lambda p: len(p) >= 18)"
