"""Problem 2: personal information in free text, by a semi-Markov conditional random field.

A text's candidate segments are spans of tokens, each as one of EMAIL, PHONE, ID, ADDRESS, NAME: every sub-span of a run of
name-like words, of digit groups and their separators, of a street and its numbers, and of the parts
around an at sign or its paraphrase. Features look at the whole span (its pattern of word classes, its group
lengths, separators and shape) and at the words on both sides. The model is a log-linear distribution over all
segmentations of a text; training maximises the likelihood of segmentations (forward-backward over
segments), decoding takes the best one by dynamic programming, which settles boundaries and
types jointly. Runs are cut into windows of WINDOW tokens only for candidates; longer items keep their start,
and digit runs and addresses of any length are candidates as a whole as well.

The model is trained here, on TRAINING texts of its own making (templates below, numbers and streets drawn at
random with a fixed seed) with names drawn from at most NAMES speakers. Word lists are statistics of all
rows: given names and endings of surnames from the speakers, words too common to be surnames from the texts.

Defined results: null and blank texts hold nothing; repeated deliveries count once (the latest); an empty table gives no
rows; positions are code points; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.session import materialise

TRAINING, NAMES, EPOCHS, WINDOW = 2200, 1000, 4, 8
MEMO = 200_000
#: A word in more texts than this share is too common for a surname; a given name and a surname's ending need three
#: persons and this share of the different ones. The shares bound the lists, whatever the number of rows.
COMMON_SHARE, PERSON_SHARE = 0.002, 0.0001
LABELS = ("EMAIL", "PHONE", "ID", "ADDRESS", "NAME")
_Z = "\u200b-\u200f\u2060\ufeff\xad"
TOKEN = re.compile(rf"(?:[^\W\d_]|[{_Z}])(?:[^\W\d_]|[{_Z}̀-ͯ]|['’](?=[^\W\d_]))*|\d+|[^\w\s]|_")
INVISIBLE = re.compile(f"[{_Z}]")

# Classes of words.
TITLES = set("mr mrs ms miss dr prof professor herr frau sr sra srta señor señora don doña m mme mlle monsieur madame sir ing arch dipl".split())
FIRMS = set("studio atelier bureau academy institute department dept college office architects gmbh ltd partners bros company firm university school".split())
STREETS_AFTER_NUMBER = set("street st lane ln court ct close road rd avenue ave drive way place square terrace row hill gardens grove mews crescent".split())
FRENCH = set("rue avenue boulevard bd place chemin allée impasse quai route cours".split())
SPANISH = set("calle avenida avda plaza paseo camino ronda c".split())
GERMAN_ENDS = ("straße", "strasse", "weg", "gasse", "platz", "allee", "ufer", "graben", "damm", "ring", "str")
LINKS = set("de del la las los du des d l le les der den dem da do".split())
GIVEN = set(
    "gabriela aiko omar elisabeth ursula eduardo samuel francisco josefina lin dorothea wanjiru william michael søren katharina patricia frederik leonard henrietta olivia ignacio robert daniel margarete "
    "priya johanna alexander zoë jürgen zacharias nikolaus charlotte antonia victoria richard theodora andré renée benjamin anna maria john james mary peter paul thomas david laura julia sofia emma lucas "
    "jean pierre claire marie carlos ana juan jose luis elena giulia marco hans karl yuki kenji wei mei ahmed fatima ali amara kwame ingrid lars nina oscar felix clara".split()
)


class Words:
    """The statistics of all rows that classes of words rest on."""

    def __init__(self, given: set[str], endings: set[str], common: set[str]):
        self.given, self.endings, self.common = given | GIVEN, endings, common
        self.bare = {_plain(g) for g in self.given}
        #: Classes of tokens seen, by the token and whether a stop follows; emptied when MEMO is reached.
        self.memo: dict[tuple[str, bool], str] = {}


def _plain(w: str) -> str:
    return w.translate(str.maketrans("áàâäãåéèêëíìîïóòôöõúùûüçñø", "aaaaaaeeeeiiiiooooouuuucno"))


class Text:
    """Tokens with classes; at[i] and to[i] are code points."""

    def __init__(self, text: str, words: Words):
        self.text = text
        found = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(text)]
        self.raw, self.at, self.to = [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]
        self.low = [(INVISIBLE.sub("", t) if INVISIBLE.search(t) else t).lower() for t in self.raw]
        self.n = len(found)
        self.words = words
        self.kinds: list[str] = []
        memo, raw, at, to = words.memo, self.raw, self.at, self.to
        if len(memo) > MEMO:
            memo.clear()
        for i, t in enumerate(raw):
            stop = i + 1 < self.n and raw[i + 1] == "." and to[i] == at[i + 1]
            # Only of M do the neighbours say more than the stop does.
            kind = memo.get((t, stop)) if t != "M" else None
            if kind is None:
                kind = memo[t, stop] = self._kind(i)
            self.kinds.append(kind)

    def glued(self, i: int) -> bool:
        """No blank between token i - 1 and token i."""
        return i > 0 and self.to[i - 1] == self.at[i]

    def _kind(self, i: int) -> str:
        t, w = self.raw[i], self.low[i]
        if t[0].isdigit():
            return "9"
        if not w or not w[0].isalpha():
            return t
        stop = i + 1 < self.n and self.raw[i + 1] == "." and self.glued(i + 1)
        if w in TITLES and w not in ("don", "m") or (t == "M" and stop and not (i and self.kinds[i - 1] in "GS")):
            return "T"
        if w in FIRMS:
            return "F"
        if len(w) == 1:
            return "I" if t.isupper() else "x"
        if w in self.words.given or _plain(w) in self.words.bare:
            return "G"
        if len(w) >= 5 and w not in self.words.common and w[-4:] in self.words.endings:
            return "S"
        if stop and t[0].isupper() and len(w) <= 4 and w not in self.words.common:
            return "A"
        return "C" if t[0].isupper() else "x"

    def side(self, i: int) -> str:
        return self.low[i] if 0 <= i < self.n else "<>"

    def line_edge(self, i: int, left: bool) -> bool:
        if left:
            return i == 0 or "\n" in self.text[self.to[i - 1] : self.at[i]]
        return i + 1 >= self.n or "\n" in self.text[self.to[i] : self.at[i + 1]]


Candidate = tuple[int, int, str]
NAMEISH = {"G", "S", "I", "A", "C", "T"}


def name_runs(t: Text) -> Iterator[tuple[int, int]]:
    for i, k in enumerate(t.kinds):
        if k in "GS" or (k == "T" and i + 2 < t.n):
            a = i
            while a > 0 and i - a < WINDOW - 2 and (t.kinds[a - 1] in NAMEISH or t.raw[a - 1] in ".-,’'"):
                a -= 1
            b = i
            while b + 1 < t.n and b - i < WINDOW - 2 and (t.kinds[b + 1] in NAMEISH or t.raw[b + 1] in ".-,’'"):
                b += 1
            yield a, b


def candidates(t: Text) -> dict[Candidate, None]:
    """Every candidate segment (first token, last token, label)."""
    out: dict[Candidate, None] = {}
    for a, b in name_runs(t):
        for i in range(a, b + 1):
            if t.kinds[i] not in "GSIAC" or (t.glued(i) and t.raw[i - 1] not in "(\"“«„'–—-:>,;"):
                continue
            for j in range(i, min(b, i + WINDOW - 1) + 1):
                kinds = t.kinds[i : j + 1]
                if t.kinds[j] in "GSIAC" and ("G" in kinds or "S" in kinds) and "T" not in kinds and not (j + 1 < t.n and t.raw[j + 1] == "-" and t.glued(j + 1) and j + 2 < t.n and t.glued(j + 2)):
                    out[i, j, "NAME"] = None
    i = 0
    while i < t.n:
        if t.kinds[i] == "9":
            a = i
            while a > 0 and i - a < 3 and (t.raw[a - 1] in "+(" or (t.raw[a - 1].isupper() and len(t.raw[a - 1]) <= 2 and t.raw[a - 1].isalpha() and t.at[a] - t.to[a - 1] <= 1)):
                a -= 1
            b, last = i, i
            while b + 1 < t.n and t.at[b + 1] - t.to[b] <= 2 and "\n\n" not in t.text[t.to[b] : t.at[b + 1]] and (t.kinds[b + 1] == "9" or t.raw[b + 1] in ".-/()–" or (t.raw[b + 1].isupper() and len(t.raw[b + 1]) <= 2 and t.raw[b + 1].isalpha())):
                b += 1
                if t.kinds[b] == "9" or (t.raw[b].isalpha() and t.glued(b)):
                    last = b
            digits = sum(len(t.raw[k]) for k in range(a, last + 1) if t.kinds[k] == "9")
            if digits >= 6:
                for s in range(a, i + 1):
                    if not (t.glued(s) and t.raw[s - 1] not in "(\"“:,;"):
                        out[s, last, "PHONE"] = out[s, last, "ID"] = None
            i = max(last, i) + 1
        else:
            i += 1
    for i in range(t.n):
        w = t.low[i]
        if w in FRENCH or w in STREETS_AFTER_NUMBER and t.raw[i][0].isupper():
            first = i
            while first > max(0, i - 8) and (t.kinds[first - 1] == "9" or t.raw[first - 1][0].isupper() or t.raw[first - 1] in ",-’'" or len(t.low[first - 1]) == 1 and t.low[first - 1].isalpha() and t.glued(first - 1) or t.low[first - 1] in ("bis", "ter", "flat")):
                first -= 1
            for a in range(first, i):
                if (t.kinds[a] == "9" or w in STREETS_AFTER_NUMBER and t.low[a] in ("flat", "apt", "unit", "apartment", "suite")) and not (t.glued(a) and t.raw[a - 1].isalnum()) and any(t.kinds[k] == "9" for k in range(a, i)):
                    for e in {i, min(t.n - 1, i + 3)}:
                        out[a, e, "ADDRESS"] = None
        spanish = w in SPANISH and (w != "c" or i + 1 < t.n and t.raw[i + 1] == "/")
        if spanish or w.endswith(GERMAN_ENDS) and t.raw[i][0].isupper() or w == "str":
            # A number stands behind a German street's name at once, behind a Spanish one after its words.
            short = w in ("str",) or w.endswith("str")
            for e in range(i + 1, min(t.n, i + (7 if spanish else 3 if short else 2))):
                if t.raw[e] in "!?;:" or (t.raw[e] == "." and not short):
                    break
                if t.kinds[e] == "9":
                    for a in range(max(0, i - 3), i + 1):
                        if t.raw[a][0].isupper() and not (t.glued(a) and t.raw[a - 1] not in "(\"“:,;"):
                            out[a, e, "ADDRESS"] = None
                    break
    for m in MAIL.finditer(t.text):
        a = next((k for k in range(t.n) if t.at[k] >= m.start()), None)
        if a is not None and t.at[a] < m.end(1):
            e = a
            while e + 1 < t.n and t.to[e + 1] <= m.end(1):
                e += 1
            out[a, e, "EMAIL"] = None
    return out


_AT = r"(?:[@＠]|\s?[(\[{<]\s?(?:@|＠|(?i:at|arroba))\s?[)\]}>]\s?|\s(?:AT|at)\s)"
_DOT = r"(?:\.|．|\s?[(\[{]\s?(?i:dot|punkt|punto|point)\s?[)\]}]\s?|\s(?i:dot)\s)"
MAIL = re.compile(rf"(?<![\w.+\-])(?=([\w][\w.+\-]*{_AT}(?:[\w\-]+{_DOT})+[A-Za-z]{{2,12}})(?!\w))")


def groups(span: str) -> str:
    return "-".join(str(len(g)) for g in re.findall(r"\d+", span))


def features(t: Text, c: Candidate) -> list[str]:
    i, j, label = c
    span = t.text[t.at[i] : t.to[j]]
    left, left2, right = t.side(i - 1), t.side(i - 2), t.side(j + 1)
    f = ["bias", f"l={left}", f"r={right}", f"lk={t.kinds[i - 1] if i else '<>'}", f"rk={t.kinds[j + 1] if j + 1 < t.n else '<>'}"]
    if label == "NAME":
        kinds = t.kinds[i : j + 1]
        pattern = "".join(kinds)
        cases = {("U" if w.isupper() else "l" if w.islower() else "t") for w, k in zip(t.raw[i : j + 1], kinds, strict=True) if k in "GSC" and len(w) > 1}
        f += [f"p={pattern}", f"p={pattern} l={t.kinds[i - 1] if i else '<>'}", f"p={pattern} r={t.kinds[j + 1] if j + 1 < t.n else '<>'}", f"first={kinds[0]}", f"last={kinds[-1]}", f"n={len(kinds)}", f"case={''.join(sorted(cases))}"]
        f += [f"edge={t.line_edge(i, True)}{t.line_edge(j, False)}", f"given={'G' in kinds} surname={'S' in kinds}", f"more={_more(t, i, j)}"]
        if "," in pattern:
            f.append("comma " + pattern.replace(",", " , "))
        if "\n\n" in span or "\n" in span and "," in pattern:
            f.append("over lines")
    elif label in ("PHONE", "ID"):
        shape = re.sub(r"\s+", " ", re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "9", span)))
        digits = sum(ch.isdigit() for ch in span)
        words = [w for w in (t.side(k) for k in range(i - 1, i - 5, -1)) if w[0].isalpha()][:2]
        f += [f"s={shape}", f"g={groups(span)}", f"d={digits}", f"start={span[0] if span[0] in '+(' else span[0] == '0'}", f"letters={'A' in shape}", f"sep={''.join(sorted(set(re.sub(r'[9A]', '', shape))))}"]
        f += [f"w={w}" for w in words] + [f"w2={left2} {left}", f"nothing left out={i == 0 or not t.raw[i - 1].isupper() or len(t.raw[i - 1]) > 2}"]
        f += [f"open={i > 0 and t.raw[i - 1] in '+('}"]
    elif label == "ADDRESS":
        pattern = "".join(_street_kind(t, k) for k in range(i, j + 1))
        head = re.sub(r"(?<=[VRDK]).*", "", pattern)
        f += [f"head={head}", f"p={pattern}", f"kinds={''.join(sorted(set(pattern)))}", f"first={pattern[0]}", f"before={_street_kind(t, i - 1) if i else '<>'}", f"has={'9' in head}{'9' in pattern}"]
    else:
        f += [f"sign={re.sub(r'[A-Za-z]+', 'a', re.search(_AT, span).group().strip())}", f"case={bool(re.search('AT', span))}", f"dot={bool(re.search(r'(?i)dot|punkt|punto', span))}", f"blank={' ' in span}", f"real={'@' in span or '＠' in span}"]
        f.append(f"sign and dot={'@' in span or '＠' in span or bool(re.search(r'[(\[{]', span)) or bool(re.search(r' AT ', span))}")
    return [f"{label} {x}" for x in f]


def _more(t: Text, i: int, j: int) -> str:
    """What name-like words the span leaves out beside it."""
    return f"{i > 0 and t.kinds[i - 1] in 'GSIA' or i > 1 and t.raw[i - 1] in '.-' and t.kinds[i - 2] in 'GSIA'}{j + 1 < t.n and t.kinds[j + 1] in 'GSI' or j + 2 < t.n and t.raw[j + 1] in '-.' and t.kinds[j + 2] in 'GSI'}"


def _street_kind(t: Text, k: int) -> str:
    w = t.low[k]
    if t.kinds[k] == "9":
        return "9"
    if w in STREETS_AFTER_NUMBER and w not in FRENCH:
        return "V"
    if w in FRENCH:
        return "R"
    if w in SPANISH:
        return "K"
    if w.endswith(GERMAN_ENDS) and t.raw[k][0].isupper():
        return "D"
    if w in ("flat", "apt", "unit", "apartment", "suite"):
        return "B"
    if w in ("bis", "ter"):
        return "b"
    if w in ("am", "an", "im", "auf", "zum", "zur"):
        return "P"
    if w in LINKS:
        return "d"
    return "C" if t.raw[k][0].isupper() else "x" if t.raw[k][0].isalpha() else t.raw[k]


def _lattice(spans: list[Candidate]) -> tuple[list[int], list[tuple[int, int]]]:
    """The boundaries of the candidates, and each candidate as a pair of places among them."""
    marks = sorted({i for i, _, _ in spans} | {j + 1 for _, j, _ in spans})
    place = {m: k for k, m in enumerate(marks)}
    return marks, [(place[i], place[j + 1]) for i, j, _ in spans]


def decode(t: Text, weights: dict[str, float]) -> list[Candidate]:
    """The best segmentation."""
    spans = list(candidates(t))
    if not spans:
        return []
    marks, ends = _lattice(spans)
    into: dict[int, list[int]] = defaultdict(list)
    for k, (_, b) in enumerate(ends):
        into[b].append(k)
    score = [sum(weights.get(x, 0.0) for x in features(t, c)) for c in spans]
    best, by = [0.0] * len(marks), [-1] * len(marks)
    for p in range(1, len(marks)):
        best[p] = best[p - 1]
        for k in into[p]:
            s = best[ends[k][0]] + score[k]
            if s > best[p]:
                best[p], by[p] = s, k
    out, p = [], len(marks) - 1
    while p > 0:
        if by[p] < 0:
            p -= 1
        else:
            out.append(spans[by[p]])
            p = ends[by[p]][0]
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def fit(examples: list[tuple[Text, list[Candidate]]], epochs: int = EPOCHS, rate: float = 0.5) -> dict[str, float]:
    """Weights that maximise the likelihood of the segmentations, by adaptive gradient steps on one text at a time."""
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(lambda: 1e-6)
    ready = []
    for t, gold in examples:
        spans = list(candidates(t) | dict.fromkeys(gold))
        if spans:
            ready.append((spans, [features(t, c) for c in spans], set(gold), *_lattice(spans)))
    order = random.Random(7)
    for _ in range(epochs):
        order.shuffle(ready)
        for spans, feats, gold, marks, ends in ready:
            n = len(marks)
            score = [sum(weights[x] for x in f) for f in feats]
            into, outof = defaultdict(list), defaultdict(list)
            for k, (a, b) in enumerate(ends):
                into[b].append(k)
                outof[a].append(k)
            ahead, behind = [0.0] * n, [0.0] * n
            for p in range(1, n):
                s = ahead[p - 1]
                for k in into[p]:
                    s = _log_add(s, ahead[ends[k][0]] + score[k])
                ahead[p] = s
            for p in range(n - 2, -1, -1):
                s = behind[p + 1]
                for k in outof[p]:
                    s = _log_add(s, behind[ends[k][1]] + score[k])
                behind[p] = s
            for k, c in enumerate(spans):
                a, b = ends[k]
                step = (c in gold) - math.exp(min(0.0, ahead[a] + score[k] + behind[b] - ahead[-1]))
                if abs(step) > 1e-3:
                    for x in feats[k]:
                        squares[x] += step * step
                        weights[x] += rate * step / math.sqrt(squares[x])
    return dict(weights)


# --- texts of our own making ---

FRAMES = [
    "Best wishes, {NAME}", "— {NAME}", "{NAME}: The roof seems heavy.", "Thanks to {NAME} and {NAME} for the walk.", "As {NAME} said, the stair is narrow.", "According to {NAME}, the board is late.", "{NAME} and I disagree about the court.",
    "The note was brought by {NAME} on the first day.", "Only {NAME} spoke against.", "Questions to {NAME} ({PHONE}) or to the office.", "I talked with {NAME}, see {EMAIL}.", "{NAME} lives at {ADDRESS} and was absent.", "Invoice to {NAME}, {IDW} {ID}, at {ADDRESS}.",
    "Did {NAME} look at the drawing?", "and {NAME} agrees.", "wrote {NAME}.", "The badge of {NAME} bears {IDW} {ID} by error.", "My neighbour {NAME}, {ADDRESS}, knows the site.", "Fax {PHONE}, then {NAME} puts it under {IDW} {ID}.", "My {IDW} {ID} must not appear.",
    "My {ID} must not appear.", "Call {PHONE} after five.", "please ring {PHONE} soon!!", "New number since June: {PHONE}.", "You may reach me at {EMAIL}.", "Write to {EMAIL} or ring {PHONE}.", "cc {EMAIL}, {EMAIL}.", "{EMAIL} bounced, try {EMAIL}.", "{EMAIL}", "{NAME}\n{ADDRESS}\n{EMAIL}", "{NAME}, {PHONE}",
    "We met at {ADDRESS} before noon.", "The courier left it at {ADDRESS}, tel. {PHONE}.", "Send the boards back to {ADDRESS}.", "For the fee I gave my {IDW} {ID} and my number {PHONE}.", "The model is still at {ADDRESS}.", "a fine stair ({NAME}). It ends", "Ich wohne {ADDRESS}.", "Meine Angaben: {IDW} {ID}.",
    "Bitte melden Sie sich unter {PHONE}.", "Fragen an {EMAIL} oder an {NAME}.", "Das Modell steht in der {ADDRESS}.", "Appelez {NAME} au {PHONE}.", "Écrivez à {EMAIL}.", "La maquette est chez {NAME}, {ADDRESS}.", "Appelez le {PHONE}.", "Llame a {NAME} al {PHONE}.", "Mi {IDW} {ID} figura en la lista.", "Vivo en {ADDRESS}.", "Mi correo es {EMAIL}.",
    "My neighbour {NAME} waited.", "See {NAME} about it. The court is calm.", "{NAME} put it well.", "The sketch by {NAME} convinces.",
]
PLAIN = [
    "Drawing {d4}-{d2}-{d4} lacks a key.", "Entry no. {d5}-{d2} was withdrawn.", "The plot measures {d3} x {d3} cm at axis {d4}.", "Scale 1:{d3}, sheet {d3} / {d2}.", "Standard EN {d4}-1-1 applies.", "Budget: {d1} {d3} 000 for 2023-2025.", "Room {d1}.{d2} has {d3} lux at 07:00.", "est. cost {d2},{d3}.50 per bay.",
    "The {C} Pavilion beside {C} Lane reads well.", "The path along {C} Street is closed.", "Follow the studio @ the fair, not online.", "built by {C} Bros. in {d2} weeks.", "vs. the St. {C} scheme", "Acc. to sheet No. {d2}, the {E} turns.", "In Vol. {d2}, pp. {d2}–{d2}, the stair of {E} is shown.", "beside the No. {d2} stair",
    "Please revisit {E}, whose porch holds.", "{E} gains a hall.", "The jury praised {E} because it is calm.", "at U-value 0.{d1}.", "about {d1}.{d1} per cent!", "Studio {S} drew it.", "Atelier {S} GmbH and {S} Architects Ltd built it.", "Bureau {S} won; {S} & Partners lost.", "Academy of {S}", "the Department of Urban Design, {S} College, asks",
    "({d2}) a proud edge and a porch", "order {d4}-{d4}-{d4} of doors", "Item {d2}.{d1}: the roof", "The east court at {C} Court is open.", "{d2} Street lamps stand in the court.", "{E}, {E} and {E} share a court.", "phase {d4} / {d4}", "Signage reads {d3} {d3} {d3}.", "tile size {d3}-{d3}-{d4}",
]


class Maker:
    def __init__(self, names: list[str], entries: list[str], seed: int = 11):
        self.r, self.names, self.entries = random.Random(seed), names, entries

    def digits(self, shape: str) -> str:
        return "".join(self.r.choice("0123456789") if c == "9" else self.r.choice("ABCDEFGHKLMNPRTXYZ") if c == "A" else c for c in shape)

    def word(self) -> str:
        return self.r.choice("Alder Juniper Harrow Wicker Fennel Osier Tallow Maple Bishop Garner Copper Mill Linden Raven Thorn".split())

    def phone(self) -> str:
        return self.digits(self.r.choice("+44 20 7999 0999|+1 (999) 555-0999|07700 900999|0049-30-99999999|+33.1.99.00.99.99|(999) 555.0999|999-555-0999|+447700900999|999 555 0999 ext. 99|030 / 99999 999|０９-9999-0999|+49 (0)30 99999-999|01 99 00 99 99|+34 699 999 999|+81 3-9999-9999|0999 9999999|+39 06 9999 9999".split("|")))

    def identity(self) -> tuple[str, str]:
        word, shape = self.r.choice(
            [("passport", "A9999999"), ("passport no.", "A99 A99999"), ("identity card", "AA 9999999"), ("national ID:", "99.999.999-9"), ("DNI", "99999999A"), ("SSN", "999-99-9999"), ("Steuer-ID", "99 999 999 999"), ("tax number", "999/999/99999"), ("ID", "AA999999"), ("NIF", "99999999A"), ("insurance no.", "AA 99 99 99 A"), ("driving licence", "A9999-99999-99999"), ("Personalausweis", "A99AA9999")]
        )
        return word, self.digits(shape)

    def address(self) -> str:
        r, w, n = self.r, self.word(), self.r.randint(1, 199)
        town = r.choice([f", {r.randint(10000, 99999)} {self.word()}brock", f", {self.word()}lira", ""])
        kind = r.choice("Street Lane Court Close Road St Ln Ct Rd Way".split())
        tree = r.choice("Amsel Linden Erlen Kessel Nebel Birken Garten".split())
        return r.choice([
            f"{n} {w} {kind}{town}", f"{n}{r.choice('abc')} {w} {kind}{town}", f"Flat {r.randint(1, 40)}, {n} {w} {kind}", f"{n}, rue des {w}s{town}", f"{n} bis avenue du {w}{town}", f"{n}, avenue de la {w}", f"{n} rue du {w}{town}", f"Calle del {w} {n}, {r.randint(1, 9)}.º {r.choice('AB')}", f"C/ {w}, {n}", f"Calle {w} {n}", f"Avenida de {w} {n}",
            f"{tree}straße {n}{town}", f"{tree}weg {n}{town}", f"{tree}-Str. {n}{town}", f"Am {tree}graben {n}{town}", f"{tree}str. {n}", f"{tree}gasse {n}", f"An der {tree}allee {n}",
        ])

    def name(self) -> str:
        name = re.sub(r"\s+", " ", self.r.choice(self.names)).strip()
        return self.r.choice([name] * 8 + [name.upper(), name.lower()])

    def email(self) -> str:
        local = _plain(re.sub(r"[^\w]+", self.r.choice("._-"), self.r.choice(self.names).lower()).strip("._-")) or "a"
        local = self.r.choice([local, local, local[:6] + self.digits("99"), local.split("_")[0] + "+jury"])
        host, tld = self.r.choice(["example", "mail.example", "post.kesse", "studio-linden"]), self.r.choice(["com", "org", "net", "test", "example"])
        at, dot = self.r.choice([("@", ".")] * 4 + [("＠", "."), (" [at] ", "."), (" (at) ", " (dot) "), (" (at) ", " (dot) "), (" AT ", " DOT ")])
        full = f"{local}{at}{host.replace('.', dot)}{dot}{tld}"
        return full.upper() if self.r.random() < 0.06 and at == "@" else full

    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A text of one to four sentences and its items."""
        out, items = "", []
        for _ in range(self.r.randint(1, 4)):
            if out:
                out += self.r.choice([" ", "  ", "\n", "\n\n"])
            if self.r.random() < 0.35:
                frame = self.r.choice(PLAIN)
                frame = re.sub(r"\{d(\d)\}", lambda m: self.digits("9" * int(m[1])), frame).replace("{C}", self.word())
                frame = re.sub(r"\{E\}", lambda _: self.r.choice(self.entries), frame)
                out += re.sub(r"\{S\}", lambda _: re.split(r"[\s,]+", self.r.choice(self.names).strip())[-1].title(), frame)
                continue
            word, number = self.identity()
            for piece in re.split(r"(\{\w+\})", self.r.choice(FRAMES)):
                if piece == "{IDW}":
                    out += word
                elif piece.startswith("{"):
                    kind = piece[1:-1]
                    value = {"NAME": self.name, "PHONE": self.phone, "ID": lambda n=number: n, "ADDRESS": self.address, "EMAIL": self.email}[kind]()
                    if kind == "NAME":
                        title, rest = re.match(r"(?i)((?:(?:dr|prof|mr|mrs|ms|herr|frau|sra?|arch)\b\.?\s+)*)(.*)", value).groups()
                        out += title or self.r.choice([""] * 6 + ["Dr. ", "Mr. ", "Ms ", "Herr ", "Frau ", "Sra. ", "Prof. "])
                        value = rest
                        if self.r.random() < 0.12 and "," not in value and " " in value:  # a surname alone after a title
                            out, value = (out if out.endswith((". ", "Ms ", "Herr ", "Frau ")) else out + "Dr. "), value.split(" ")[-1]
                    items.append((len(out), len(out) + len(value), kind))
                    out += value
                else:
                    out += piece
        return out, items


def training_set(words: Words, names: list[str], entries: list[str], size: int = TRAINING) -> list[tuple[Text, list[Candidate]]]:
    maker, out = Maker(names, entries), []
    for _ in range(size):
        raw, items = maker.text()
        t = Text(raw, words)
        start, end = {a: i for i, a in enumerate(t.at)}, {b: i for i, b in enumerate(t.to)}
        gold = []
        for a, b, kind in items:
            ends = [end[e] for e in range(b, a, -1) if e in end]
            if a in start and ends and ends[0] >= start[a]:
                gold.append(_closest(t, start[a], ends[0], kind))
        out.append((t, gold))
    return out


def _closest(t: Text, i: int, j: int, kind: str) -> Candidate:
    """The candidate with the item's start and kind that ends nearest to the item's end, or the item itself."""
    same = [c for c in candidates(t) if c[0] == i and c[2] == kind]
    return min(same, key=lambda c: abs(c[1] - j)) if same else (i, j, kind)


# --- the operator ---


def statistics(comments: DataFrame) -> tuple[Words, list[str], list[str]]:
    """Word classes over all rows, and bounded lists of speakers and entry names for the training texts."""
    clean = F.trim(F.regexp_replace("speaker", r"\s+", " "))
    person = materialise(comments.select(clean.alias("speaker")).filter(~F.lower("speaker").rlike(r"\b(?:" + "|".join(sorted(FIRMS)) + r")\b")).filter(r"speaker rlike '^[\\p{L}.’\'-]+( [\\p{L}.]+)? [\\p{L}’\'-]+$|^[\\p{L}-]+, [\\p{L}.]+$'").distinct(), "p2-speakers")
    part = F.split(F.lower("speaker"), " ")
    pairs = person.filter("speaker not like '%,%'").select(F.get(part, 0).alias("given"), F.element_at(part, -1).alias("surname")).filter("length(given) > 2 and given not like '%.'").distinct()
    pairs = materialise(pairs, "p2-persons")
    least = max(3.0, PERSON_SHARE * pairs.count())
    firm = [*sorted(FIRMS), "anonymous", "the"]
    given = pairs.filter(~F.col("given").isin(firm)).groupBy("given").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    firsts = {r.given for r in given.collect()}
    tails = pairs.filter(~F.col("given").isin(firm)).select(F.explode(F.split("surname", "-")).alias("s")).filter("length(s) >= 5").distinct().select(F.expr("right(s, 4)").alias("tail")).groupBy("tail").agg(F.count(F.lit(1)).alias("n"))
    endings = {r.tail for r in tails.filter(F.col("n") >= max(2.0, least - 1)).collect()}
    texts = comments.select("text").distinct()
    each = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0)))).alias("word"))
    total = texts.count()
    # At most words-per-text / COMMON_SHARE words can be so common, however many texts there are.
    common = {r.word for r in each.groupBy("word").count().filter(F.col("count") > max(3.0, COMMON_SHARE * total)).select("word").collect()}
    names = [r.speaker for r in person.filter(~F.lower(F.get(F.split("speaker", " "), 0)).isin(firm)).orderBy(F.xxhash64("speaker"), "speaker").limit(NAMES).collect()]
    # Capitalised pairs of common words are names of entries.
    pair = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{Ll}{3,} \p{Lu}\p{Ll}{3,}"), F.lit(0))).alias("pair")).groupBy("pair").count()
    lone = [r.pair for r in pair.orderBy(F.desc("count"), "pair").limit(300).collect()]
    known = firsts | GIVEN
    entries = [p for p in lone if p.split(" ")[0].lower() not in known and p.split(" ")[1].lower() in common] or ["Amber Gate"]
    return Words(firsts, endings, common - firsts), names or [f"{g.title()} {s}" for g in sorted(GIVEN) for s in ("Kesselmark", "Vargren", "Holdavin")], entries


def trained(comments: DataFrame) -> tuple[Words, dict[str, float]]:
    words, names, entries = statistics(comments)
    return words, {k: v for k, v in fit(training_set(words, names, entries)).items() if abs(v) > 1e-4}


def spans(texts: DataFrame, words: Words, weights: dict[str, float]) -> DataFrame:
    """comment_id, kind, start_at, end_at over texts(comment_id, text)."""
    model = texts.sparkSession.sparkContext.broadcast((words, weights))  # bounded by the training size and the limits of the lists

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, m = model.value
        for batch in batches:
            rows = []
            for key, text in zip(batch["comment_id"], batch["text"], strict=True):
                t = Text(text, w)
                rows += [(key, kind, t.at[i], t.to[j]) for i, j, kind in decode(t, m)]
            yield pd.DataFrame(rows, columns=["comment_id", "kind", "start_at", "end_at"])

    return texts.mapInPandas(find, "comment_id string, kind string, start_at int, end_at int")


def latest(comments: DataFrame) -> DataFrame:
    rows = comments.filter("trim(text) <> ''").groupBy("comment_id").agg(F.max(F.struct("ingested_at", "text", "speaker")).alias("r"))
    return materialise(rows.select("comment_id", "r.text", "r.speaker"), "p2-comments")


def found(comments: DataFrame) -> DataFrame:
    """comment_id, kind, start_at."""
    rows = latest(comments)
    return spans(rows.select("comment_id", "text"), *trained(rows)).select("comment_id", "kind", "start_at").distinct()


def redacted(comments: DataFrame) -> DataFrame:
    """comment_id, text with each item as its placeholder, [EMAIL] and so on."""
    rows = latest(comments)
    words, weights = trained(rows)
    model = rows.sparkSession.sparkContext.broadcast((words, weights))

    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, m = model.value
        for batch in batches:
            texts = []
            for text in batch["text"]:
                t = Text(text, w)
                for i, j, kind in reversed(decode(t, m)):
                    text = f"{text[: t.at[i]]}[{kind}]{text[t.to[j] :]}"
                texts.append(text)
            yield pd.DataFrame({"comment_id": batch["comment_id"], "text": texts})

    return rows.select("comment_id", "text").mapInPandas(replace, "comment_id string, text string")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.sources.tables import table

    return found(table(spark, sf_dir, "comments"))


def p2_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillmesh.sources.tables import table

    return redacted(table(spark, sf_dir, "comments"))


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted}
ORACLES: dict[str, str] = {}
