"""Problem 4: personal information in free text, found and replaced by typed placeholders.

Patterns propose spans. Labelers of three sorts - patterns, gazetteers, context - vote on
each span or abstain. Expectation-maximisation over the counts of all vote patterns of the
corpus estimates how reliable each labeler is and how likely each pattern is true; a span
classifier trained on these probabilities, with the shape and the neighbours of a span as
further features, decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm.lookalike import HYPHENS, JOINERS, LETTERS, UNSEEN
from threadmill.llm.records import records
from threadmill.session import spread, stage, table

TYPES = ("email", "phone", "id_number", "address", "person_name")
#: Spans of each kind that the classifier is trained on, at most; drawn by hash of the span.
SAMPLE = 20_000
DIM = 1024

_ONE = {ord(a): b for other, latin in LETTERS.values() for a, b in zip(other, latin, strict=True)}
_ONE |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | dict.fromkeys(map(ord, HYPHENS), "-")
_ONE |= {c: " " for c in (0xA0, 0x2007, 0x2009, 0x202F, 0x3000, *range(0x2000, 0x200B))}
_NONE = set(UNSEEN + JOINERS) - {chr(c) for c in _ONE}
_LIGATURES = {0xFB00: "ff", 0xFB01: "fi", 0xFB02: "fl", 0xFB03: "ffi", 0xFB04: "ffl"}
_ODD = re.compile("[" + "".join(map(re.escape, {chr(c) for c in _ONE} | _NONE | {chr(c) for c in _LIGATURES})) + "]")


def fold(text: str) -> tuple[str, list[int] | None]:
    """The text in plain letters, and where each of its letters stands in the text as written."""
    if text.isascii() or not _ODD.search(text):
        return text, None
    out, at = [], []
    for i, c in enumerate(text):
        if c in _NONE:
            continue
        new = _LIGATURES.get(ord(c)) or _ONE.get(ord(c), c)
        out.append(new)
        at += [i] * len(new)
    return "".join(out), [*at, len(text)]


_LABEL = r"[A-Za-z0-9][A-Za-z0-9-]*"
_AT = r"(?:\s?@\s?|\s?\(at\)\s?|\s?\[at\]\s?|\s?\{at\}\s?|\sat\s)"
_DOT = r"(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\s?\{dot\}\s?|\sdot\s)"
EMAIL = re.compile(rf"(?<![\w.+@-])[A-Za-z0-9_][\w.+-]*{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,10}}(?![\w@])", re.I | re.A)
_HAS_AT = re.compile(r"@|[(\[{]at[)\]}]|\sat\s\S+\sdot\s", re.I)
_B, _E = r"(?<![\w+])(?<!\d[.,/-])(?<!\d )", r"(?![\w])(?![.,/-]\d)"
_P_INTL = r"(?:\(\+\d{1,3}\)|\+\d{1,3})[ -]?(?:\d{10}|\d{5}[ -]\d{5}|\(?\d{1,4}\)?[ -]\d{3,4}[ -]\d{4,5}|\d{2,4}[ -]\d{6,8}|\d{7,11})"
_P_AREA = r"\(\d{2,5}\)[ -]?\d{3,4}[ -]?\d{4}"
_P_LOCAL = r"0\d{2,4}[ -]\d{6,8}|0\d{9,10}|\d{10}|\d{5}[ -]\d{5}|\d{3}[ -]\d{3}[ -]\d{4}|\d{2}(?:\.\d{2}){4}|\d(?: \d){9,10}"
PHONE = re.compile(rf"(?<![\w+])(?:{_P_INTL}|{_P_AREA})(?!\w)|{_B}(?:{_P_LOCAL}){_E}", re.A)
ID = re.compile(rf"{_B}(?:\d{{4}}([ -])\d{{4}}\1\d{{4}}|\d{{12}}|\d{{3}}-\d{{2}}-\d{{4}}|[A-Z]{{5}}\d{{4}}[A-Z]|[A-Z]\d{{7}}|[A-Z]{{2}}\d{{2}} ?\d{{11}}){_E}", re.I | re.A)
_STREET = r"road|marg|avenue|layout|street|lane|nagar|colony|chowk|path|drive|boulevard|society|enclave|vihar|bazaar|ghat road"
_UNIT = r"(?:house|h\.? ?no\.?|flat|plot|makaan|door|room|apartment|apt|block|villa|quarter)"
_NO = r"(?:(?:no|number|num)\.?:?\s*)?"


def address_pattern(upper: str, flags: int = 0, words: int = 3) -> re.Pattern:
    """Addresses whose names begin with one of ``upper``; a city has up to two such words."""
    name = rf"[{upper}][\w.'-]*(?: [{upper}][\w.'-]*){{0,{words}}}"
    city = rf"[{upper}][\w'-]*" + (rf"(?: [{upper}][\w'-]*)?" if words > 1 else "")
    pin = r"(?:,?\s?[-,–]?\s?\d{5,6}(?!\d))?"
    segment = rf"(?:(?i:sector \d+|gali \d+|ward \d+|phase \d+|\d+(?:st|nd|rd|th) (?:cross|main|street|floor))|(?i:near|opp\.?|behind) {name}|{name})"
    return re.compile(
        rf"(?<![\w/])(?:(?i:{_UNIT}\s*{_NO})\d[\w/-]*,\s?(?:{segment},\s?){{1,4}}|\d{{1,4}}(?:/\d{{1,4}})? (?:[^\W\d_]+ ){{0,3}}(?i:{_STREET}),\s?(?:{segment},\s?){{0,3}}){city}{pin}"
        rf"|(?<!\w)[^\W\d_]+(?i:weg|straße|strasse|str\.|platz|gasse|allee|ring|ufer)\s\d{{1,4}}[a-z]?,\s\d{{5}}\s{city}"
        rf"|(?<![\w/])\d{{1,4}}(?: bis)?,? (?i:rue|avenue|boulevard|place|chemin|allée|quai) [^\W\d_][\w.'-]*(?: [^\W\d_][\w.'-]*){{0,3}},\s\d{{5}}\s{city}",
        flags,
    )


ADDRESS = address_pattern("A-ZÀ-Þ")
ADDRESS_LOWER = address_pattern("a-zß-ÿ", 0, 1)
_HAS_ADDRESS = re.compile(rf"{_UNIT}\s*{_NO}\d|\d (?:[^\W\d_]+ ){{0,3}}(?:{_STREET}),|(?:weg|stra(?:ß|ss)e|str\.|platz|gasse|allee|ring|ufer) \d|\d,? (?:rue|avenue|boulevard|place|chemin|allée|quai) ", re.I)
_STREET_WORD = re.compile(rf"\b(?:{_STREET}|sector|gali|cross|near|\w+(?:weg|straße|strasse|gasse|allee)|rue)\b", re.I)
_UNIT_WORD = re.compile(rf"^{_UNIT}\b|^\d+/\d+", re.I)

_TITLE = r"(?:mr|mrs|ms|dr|prof|shri|smt|sri|herr|frau|mme|mlle)"
_PAIR = r"((?:[^\W\d_]\.\s?|[^\W\d_]{2,}\s)[^\W\d_]{3,}(?:-[^\W\d_]{3,})?)"
# How people are introduced, addressed and signed for, in the languages at hand.
STRONG = ("my name is ", "name is ", "name: ", "name - ", "mera naam ", "naam ", "signed by ", "regards, ", "contact ", "attention ", "attn ", "dear ", "call me ", "मेरा नाम ", "नाम ", "mein name ist ", "ich heiße ", "je m'appelle ", "mon nom est ")
#: Words that often stand before a name, and as often before other things.
BEFORE = (*STRONG, "from ", "by ", "with ", "to ", "ask ", "and ", "aur ", "meet ", "called ")
_TITLES = ("mr. ", "mrs. ", "ms. ", "dr. ", "prof. ", "mr ", "mrs ", "ms ", "dr ", "prof ", "shri ", "smt. ", "herr ", "frau ", "mme ", "mlle ")
#: What follows people: what they have, forms of address, and verbs of speech.
AFTER = re.compile(r"'s\b|\s(?:ka|ki|ke|ne|ko)\b|\s(?:sir|madam|ma'am|ji)\b|\s(?:said|says|told|asked|wrote|called|shouted|replied)\b|\s(?:का|की|के|ने|को)(?!\w)|, [(+]?\+?\d|\s[(<]?\S+@", re.I)
_CAPS = re.compile(r"(?<![\w.])(?=((?:[A-Z]\. ?|[A-Z][a-zß-ÿ]+ )[A-Z][a-zß-ÿ]{2,})(?!\w))")
# Frequent words, months and days, which are seldom part of a name.
NOT_NAMES = set("i me my we us you your he him she her it they them this that these those the a an is was were are be been am has had have do does did and or but so if not no yes to of in on at for from with by as up out off over who what when which where why how please never ever just very still here there now then today tomorrow yesterday someone anyone nobody everyone mother father brother sister friend teacher hai hain tha thi the ho hoon ka ki ke ko se mein main par pe aur bhi nahi hi to sab kuch ek mere mera meri yaar bhai ye wo kya kal aaj phir abhi mat raha rahi rahe gaya gayi january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split())

# Words that announce each kind.
_PLUS = {
    "email": re.compile(r"mail|write|contact|reach|send|\bid\b|लिखो|मेल|schreib|écri", re.I),
    "phone": re.compile(r"call|number|whatsapp|phone|mobile|contact|tel|nummer|numéro|नंबर|फ़ोन|फोन|\bat\b|regards", re.I),
    "id_number": re.compile(r"passport|aadhaar|aadhar|\bid\b|identity|licen[cs]e|\bpan\b|ssn|social security|tax|proof|आधार|पासपोर्ट|ausweis|identité|passeport|steuer", re.I),
    "address": re.compile(r"stay|live|address|home|house|send|deliver|rehta|rehti|pata|रहता|रहती|पता|wohne|adresse|habite", re.I),
}
_MINUS = re.compile(r"order|ticket|roll|marks|version|paid|invoice|receipt|rank|score|year|ऑर्डर|टिकट|रोल|अंक|bestell|commande|transaction|seat no", re.I)
_TLD = re.compile(r"(?:example|test|com|org|net|edu|in|de|fr|io|info|gov|co|invalid)$", re.I)


_BREAK = re.compile(r"\n|(?<=[?!।]) |(?<!\bno)(?<!\bNo)(?<!\b[A-Za-z])(?<!\b[MmDd][rs])(?<!rof)\. ")


class Finder:
    """Proposes spans and lets the labelers vote."""

    def __init__(self, given: set[str], family: set[str]) -> None:
        self.given, self.family = given, family
        self.auto = ahocorasick.Automaton()
        for w in BEFORE + _TITLES:
            self.auto.add_word(w, ("cue", w))
        for w in given | family:
            if w not in BEFORE:
                self.auto.add_word(w, ("part", w))
        self.auto.make_automaton()
        self.pair = re.compile(rf"(?:{_TITLE}\.?\s+)*{_PAIR}", re.I)

    def __call__(self, text: str) -> list[tuple]:
        """(type, start, end, votes, features, first part, second part) for each span, in the text as written."""
        t, at = fold(text)
        got: list[tuple] = []
        taken: list[tuple[int, int]] = []

        def near(a: int, b: int, left: int = 45, right: int = 25) -> tuple[str, str]:
            lo, hi = max(0, a - left), min(len(t), b + right)
            for m in _BREAK.finditer(t, lo, a):
                lo = m.end()
            if m := _BREAK.search(t, b, hi):
                hi = m.start()
            return t[lo:a], t[b:hi]

        def free(a: int, b: int) -> bool:
            return all(b <= x or a >= y for x, y in taken)

        def add(kind: str, a: int, b: int, votes: tuple[int, ...], first: str = "", second: str = "") -> None:
            before, after = near(a, b, 20, 20)
            w0, w1 = before.split()[-1:] or [""], after.split()[:1] or [""]
            shape = re.sub(r"[a-zß-ÿ]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"\d", "9", t[a:b])))[:24]
            feats = sorted({xxhash.xxh32_intdigest(f"{kind}|{k}|{v}") % DIM for k, v in (("s", shape), ("l", w0[0].lower()), ("r", w1[0].lower()))})
            x, y = (a, b) if at is None else (at[a], at[b - 1] + 1)
            got.append((kind, x, y, votes, feats, first, second))
            if kind != "person_name":
                taken.append((a, b))

        if _HAS_AT.search(t):
            for m in EMAIL.finditer(t):
                s = m.group()
                if "@" not in s and " at " in s and "dot" not in s:
                    continue
                plain = "@" in s and " " not in s
                before, after = near(*m.span())
                add("email", *m.span(), (1 if plain else 0, 0 if plain else 1, 1 if _PLUS["email"].search(before + "|" + after) else 0, 1 if _TLD.search(s) else -1))
        for m in ID.finditer(t):
            s = m.group()
            if not free(*m.span()):
                continue
            before, after = near(*m.span())
            bad = bool(_MINUS.search(before))
            plus = bool(_PLUS["id_number"].search(before + "|" + after))
            coded = not s[0].isdigit() or "-" in s or " " in s
            add("id_number", *m.span(), (1 if coded else 0, 1 if plus else 0, -1 if bad and not plus else 0, 1 if s[0] == "0" or coded else -1))
        for m in PHONE.finditer(t):
            if not free(*m.span()):
                continue
            s = m.group()
            before, after = near(*m.span())
            bad = bool(_MINUS.search(before[-25:]))
            plus = bool(_PLUS["phone"].search(before + "|" + after))
            add("phone", *m.span(), (1 if s[0] in "+(" else 0, 1 if not s.isdigit() else 0, 1 if plus and not bad else 0, -1 if bad else 0))
        if _HAS_ADDRESS.search(t):
            for m in (ADDRESS if t != t.lower() else ADDRESS_LOWER).finditer(t):
                a, b = m.span()
                s = m.group()
                taken = [x for x in taken if not (a <= x[0] and x[1] <= b)]
                before, after = near(a, b)
                add("address", a, b, (1 if _UNIT_WORD.search(s) else 0, 1 if _STREET_WORD.search(s) else -1, 1 if re.search(r"\d{5,6}", s) else 0, 1 if _PLUS["address"].search(before + "|" + after) else 0))
        self.names(t, free, add)
        return got

    def names(self, t: str, free, add) -> None:
        low = t.lower()
        if len(low) != len(t):
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
        spans: dict[tuple[int, int], int] = {}
        for end, (what, w) in self.auto.iter(low):
            a = end + 1 - len(w)
            if what == "cue":
                if a and w[0].isalpha() and low[a - 1].isalnum():
                    continue
                m = self.pair.match(t, end + 1)
                if m and (w in STRONG or w in _TITLES or self.part(m.group(1))):
                    spans[m.span(1)] = max(spans.get(m.span(1), 0), 1 if w in STRONG or w in _TITLES else 0)
            else:
                if a and low[a - 1].isalnum() or end + 1 < len(low) and low[end + 1].isalnum():
                    continue
                if w in self.given and (m := re.compile(r"[^\W\d_]{2,}\s[^\W\d_]{3,}").match(t, a)):
                    spans.setdefault(m.span(), 0)
                if w in self.family and (m := re.search(r"(?:(?<![^\W\d_])[^\W\d_]\.\s?|[^\W\d_]{2,}\s)$", t[max(0, a - 20) : a])):
                    spans.setdefault((max(0, a - 20) + m.start(), end + 1), 0)
        for m in _CAPS.finditer(t):
            spans.setdefault(m.span(1), 0)
        for (a, b), cue in sorted(spans.items()):
            if not free(a, b):
                continue
            s = t[a:b]
            first, second = (s.split(".", 1) if s[1:2] == "." else s.split(None, 1))
            first, second = first.strip().lower(), second.strip().lower()
            initial = len(first) == 1
            plain = second in NOT_NAMES or (first in NOT_NAMES and not initial)
            tail = low[max(0, a - 7) : a]
            title = any(tail.endswith(x) for x in _TITLES)
            left = any(low.endswith(x, 0, a) for x in STRONG) or (cue and not title)
            right = bool(AFTER.match(t, b))
            cap = s[0].isupper() and second[:1] and t[b - len(second)].isupper()
            add("person_name", a, b, (1 if first in self.given else 0, 1 if second in self.family else 0, 1 if title else 0, 1 if left else 0, 1 if right else 0, 1 if cap else -1, -1 if plain else 0), "" if initial else first, second)

    def part(self, pair: str) -> bool:
        ws = pair.lower().replace(".", " ").split()
        return ws[0] in self.given or ws[-1] in self.family


def propose(df: DataFrame, given: set[str], family: set[str]) -> DataFrame:
    """Spans with votes, of (src, rec_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = Finder(given, family)
        cols = ["src", "rec_id", "kind", "start", "end", "span", "votes", "feats", "first", "second"]
        for b in batches:
            rows = [(src, rid, k, x, y, t[x:y], list(v), f, p, q) for src, rid, t in zip(b["src"], b["rec_id"], b["text"], strict=True) for k, x, y, v, f, p, q in find(t)]
            yield pd.DataFrame(rows, columns=cols)

    return spread(df).mapInPandas(run, "src string, rec_id string, kind string, start int, end int, span string, votes array<int>, feats array<int>, first string, second string")


def known_parts(spans: DataFrame) -> DataFrame:
    """Votes of the corpus on parts of names: (role, part, vote).

    A part named with a title or cue, or beside a part of the gazetteer, several times is one of a name; a part often met in
    such pairs and never so is none.
    """
    n = spans.where("kind = 'person_name'").withColumn("cues", (F.col("votes")[2] + F.col("votes")[3] + F.col("votes")[4]))
    strong = (F.col("cues") >= 2) | ((F.col("cues") >= 1) & ((F.col("votes")[0] == 1) | (F.col("votes")[1] == 1))) | ((F.col("votes")[0] == 1) & (F.col("votes")[1] == 1))
    role = n.select("src", "rec_id", strong.cast("int").alias("s"), F.explode(F.map_from_arrays(F.array(F.lit("first"), F.lit("second")), F.array("first", "second"))).alias("role", "part"))
    got = role.where("part <> ''").groupBy("role", "part").agg(F.sum("s").alias("s"), F.count("*").alias("n"))
    vote = F.when((F.col("s") >= 2) & (F.col("s") >= 0.2 * F.col("n")), 1).when((F.col("n") >= 3) & (F.col("s") == 0), -1).otherwise(0)
    return got.select("role", "part", vote.alias("vote")).where("vote <> 0")


def reliabilities(counts: list[tuple[tuple[int, ...], int]], rounds: int = 25) -> dict[tuple[int, ...], float]:
    """Probability that a span of each vote pattern is true, by expectation-maximisation.

    Each labeler has, for true and for false spans, a rate of votes for and of votes against; the start is the share of votes for among the votes cast.
    """
    if not counts:
        return {}
    v = np.array([c[0] for c in counts])
    n = np.array([c[1] for c in counts], float)
    cast = np.abs(v).sum(1)
    p = np.clip(np.where(cast > 0, (v.clip(0).sum(1) + 0.5 * (v.clip(0).sum(1) > 1)) / (cast + 0.5), 0.1), 0.05, 0.95)
    p = np.where((v.clip(0).sum(1) >= 2) & ((v < 0).sum(1) == 0), 0.95, np.where((v < 0).sum(1) >= v.clip(0).sum(1), 0.05, p * 0.8))
    first = p
    for _ in range(rounds):
        prior = np.clip((n * p).sum() / n.sum(), 0.02, 0.98)
        yes, no = np.full(len(v), np.log(prior)), np.full(len(v), np.log(1 - prior))
        for j in range(v.shape[1]):
            for x in (-1, 1):  # who abstains says nothing
                at = v[:, j] == x
                yes[at] += np.log(((n * p)[at].sum() + 1) / ((n * p).sum() + 2))
                no[at] += np.log(((n * (1 - p))[at].sum() + 1) / ((n * (1 - p)).sum() + 2))
        p = 0.9 / (1 + np.exp(np.clip(no - yes, -30, 30))) + 0.1 * first
    return {c[0]: float(x) for c, x in zip(counts, p, strict=True)}


def one_hot(votes: list[int]) -> list[int]:
    return [3 * j + x + 1 for j, x in enumerate(votes) if x]


def train(rows: list[tuple[list[int], list[int], float]], width: int, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic span classifier on votes and hashed features with soft labels."""
    x = np.zeros((len(rows), 3 * width + DIM + 1), np.float32)
    y = np.array([r[2] for r in rows], np.float32)
    for i, (votes, feats, _) in enumerate(rows):
        x[i, one_hot(votes)] = 1
        x[i, [3 * width + f for f in feats]] = 0.5
    x[:, -1] = 1
    w = np.zeros(x.shape[1], np.float32)
    speed = np.zeros_like(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = 0.9 * speed - 1.0 * (x.T @ (p - y) / max(1, len(y)) + 1e-4 * w)
        w = w + speed
    return w


def detect(df: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """(src, rec_id, pii_type, start, end, pii_text, confidence) of (src, rec_id, text).

    Texts are searched whole; null and empty texts have no spans; repeated rows give repeated spans.
    ``gazetteer`` has (name_part, part_kind), is small and fixed, and may be empty or hold nulls.
    """
    parts = [(r["name_part"].strip().lower(), r["part_kind"]) for r in gazetteer.select("name_part", "part_kind").where("name_part is not null").collect()]
    spans = stage(propose(df, {p for p, k in parts if k == "given"}, {p for p, k in parts if k != "given"}), "p4")
    known = known_parts(spans)
    names = spans.where("kind = 'person_name'")
    for role in ("first", "second"):
        votes = known.where(F.col("role") == role).select(F.col("part").alias(role), F.col("vote").alias(f"v_{role}"))
        names = names.join(votes, role, "left")
    more = F.array(F.coalesce("v_first", F.lit(0)), F.coalesce("v_second", F.lit(0)))
    names = names.withColumn("votes", F.concat("votes", more)).select(*spans.columns)
    spans = stage(spans.where("kind <> 'person_name'").unionByName(names), "p4v")
    counts: dict[str, list] = {}
    for r in spans.groupBy("kind", "votes").count().collect():  # at most 3 to the number of labelers
        counts.setdefault(r["kind"], []).append((tuple(r["votes"]), r["count"]))
    likely = {k: reliabilities(sorted(c)) for k, c in counts.items()}
    # the share is that of the kind, so a rare kind is not lost beside a common one
    share = F.lit(1)
    for k, c in counts.items():
        share = F.when(F.col("kind") == k, F.lit(max(1, -(-sum(n for _, n in c) // SAMPLE)))).otherwise(share)
    rows: dict[str, list] = {}
    for r in spans.where(F.pmod(F.xxhash64("src", "rec_id", "start"), share) == 0).select("kind", "votes", "feats").collect():
        rows.setdefault(r["kind"], []).append((r["votes"], r["feats"], likely[r["kind"]][tuple(r["votes"])]))
    weights = {k: train(v, len(v[0][0])) for k, v in rows.items()}
    shared = df.sparkSession.sparkContext.broadcast((weights, likely))  # likely: at most 3 to the number of labelers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, likely = shared.value
        for b in batches:
            p = []
            for k, v, f in zip(b["kind"], b["votes"], b["feats"], strict=True):
                w = weights.get(k)
                if w is None:
                    p.append(float(likely[k][tuple(v)]))
                    continue
                base = 3 * len(v)
                s = w[one_hot(v)].sum() + 0.5 * w[[base + x for x in f]].sum() + w[-1]
                p.append(float(1 / (1 + np.exp(-np.clip(s, -30, 30)))))
            yield pd.DataFrame({"src": b["src"], "rec_id": b["rec_id"], "pii_type": b["kind"], "start": b["start"], "end": b["end"], "pii_text": b["span"], "confidence": p, "votes": [list(map(int, v)) for v in b["votes"]]})

    return spans.mapInPandas(run, "src string, rec_id string, pii_type string, start int, end int, pii_text string, confidence double, votes array<int>").where("confidence >= 0.5")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = detect(records(spark, sf_dir), table(spark, sf_dir, "name_gazetteer"))
    return got.select("src", "rec_id", "pii_type", "pii_text").distinct()


def replace_spans(text: str, spans) -> str:
    """The text with a placeholder for each span; of spans that overlap, the first and longest is replaced."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += (text[at : s["start"]], f"[{s['pii_type'].upper()}]")
            at = s["end"]
    return "".join(out) + text[at:]


def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its placeholders, otherwise unchanged; repeated rows of one key count once."""
    df = records(spark, sf_dir)
    spans = detect(df, table(spark, sf_dir, "name_gazetteer")).select("src", "rec_id", "start", "end", "pii_type").distinct()
    spans = spans.groupBy("src", "rec_id").agg(F.collect_list(F.struct("start", "end", "pii_type")).alias("spans"))

    @F.pandas_udf("string")
    def put(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([replace_spans(t, [] if s is None else list(s)) for t, s in zip(text, spans, strict=True)])

    both = df.dropDuplicates(["src", "rec_id"]).join(spans, ["src", "rec_id"], "left")
    return both.select("src", "rec_id", put("text", "spans").alias("redacted"))


QUERIES = {"p4_found": found, "p4_redacted": redacted}
