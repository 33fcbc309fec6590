"""Rules read from tables: spellings, phrases and weighted keywords, a thousand as cheap as a few.

Rule tables are small and given by the caller; their bytes are checked before they are
broadcast. Texts are scanned once by an Aho-Corasick automaton, whatever the number of rules.
Null rules are left out, null texts are empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of rules that may be broadcast.
MOST_BYTES = 64 << 20


def collect_rules(rules: DataFrame, *columns: str, most_bytes: int = MOST_BYTES) -> list[tuple]:
    """The rows of a rule table without nulls, distinct and in order; an error beyond ``most_bytes``."""
    df = rules.select(*columns)
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    size = df.agg(F.sum(sum((F.octet_length(F.col(c).cast("string")) for c in columns), F.lit(0)))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes of rules are too many to broadcast")
    return sorted(tuple(r) for r in df.distinct().collect())


def spelling_mapper(rules: DataFrame, text: Column, variant: str = "variant", canonical: str = "canonical") -> Column:
    """Lower case; each token between white space is looked up; of several canonical forms the last in order counts.

    Rules of several words never match a token, as in the text library.
    """
    table = {v.lower(): c for v, c in collect_rules(rules, variant, canonical) if not re.search(r"\s", v)}
    shared = rules.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("string")
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        get = shared.value.get
        for s in batches:
            yield s.map(lambda t: " ".join(get(w, w) for w in (t or "").lower().split()))

    return rewrite(text)


class Scanner:
    """Finds which of many phrases occur in a text, in one pass, in any case."""

    def __init__(self, phrases: list[str]) -> None:
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        self.sizes = [len(p.lower()) for p in phrases]
        self.empty = True
        for i, p in enumerate(phrases):
            low = p.lower()
            if low:
                self.auto.add_word(low, (self.auto.get(low, ()) if low in self.auto else ()) + (i,))
                self.empty = False
        if not self.empty:
            self.auto.make_automaton()

    def hits(self, low: str) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(start, end, numbers of the phrases) for each occurrence between word edges in a text in lower case."""
        if self.empty:
            return
        for end, which in self.auto.iter(low):
            end += 1
            start = end - self.sizes[which[0]]
            if not (start and word_character(low[start - 1]) and word_character(low[start])) and not (end < len(low) and word_character(low[end]) and word_character(low[end - 1])):
                yield start, end, which


def word_character(c: str) -> bool:
    return c.isalnum() or c == "_"


def phrase_rewriter(rules: DataFrame, text: Column, phrase: str = "phrase", token: str = "token") -> Column:
    """Phrases become single tokens, one rule after the other, longest first, in any case; only rules whose phrase occurs are run.

    A rule may make the phrase of a later one, so the text is scanned again after each rule that changed it.
    """
    order = sorted(collect_rules(rules, phrase, token), key=lambda r: -len(r[0]))
    shared = rules.sparkSession.sparkContext.broadcast(order)

    @F.pandas_udf("string")
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        order = shared.value
        scan = Scanner([p for p, _ in order])
        compiled: dict[int, re.Pattern] = {}

        def one(t: str | None) -> str:
            t, done = t or "", -1
            while True:
                found = sorted({i for _, _, which in scan.hits(t.lower()) for i in which if i > done})
                if not found:
                    return t
                for i in found:
                    p = compiled.get(i) or compiled.setdefault(i, re.compile(rf"(?<!\w){re.escape(order[i][0])}(?!\w)", re.I))
                    new = p.sub(lambda m, i=i: order[i][1], t)
                    done = i
                    if new != t:
                        t = new
                        break
                else:
                    return t

        for s in batches:
            yield s.map(one)

    return rewrite(text)


def keyword_scores(rules: DataFrame, text: Column, keyword: str = "keyword", category: str = "category", weight: str = "weight") -> Column:
    """A map from category to the sum of weights times occurrences of its keywords between word edges; occurrences of one keyword don't overlap. Categories without a hit are absent."""
    rows = collect_rules(rules, keyword, category, weight)
    shared = rules.sparkSession.sparkContext.broadcast(rows)

    @F.pandas_udf(T.MapType(T.StringType(), T.DoubleType()))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rows = shared.value
        scan = Scanner([k for k, _, _ in rows])

        def one(t: str | None) -> dict[str, float]:
            out: dict[str, float] = {}
            upto: dict[int, int] = {}
            for start, end, which in scan.hits((t or "").lower()):
                for i in which:
                    if start >= upto.get(i, 0):
                        upto[i] = end
                        out[rows[i][1]] = out.get(rows[i][1], 0.0) + float(rows[i][2])
            return out

        for s in batches:
            yield s.map(one)

    return score(text)


def rule_statistics(rules: DataFrame, phrase: str) -> DataFrame:
    """(n_words, n, shortest, longest): rules by their number of words, with the least and the largest length in characters."""
    p = F.col(phrase)
    return rules.where(p.isNotNull()).groupBy(F.size(F.split(F.trim(p), r"\s+")).alias("n_words")).agg(F.count("*").alias("n"), F.min(F.length(p)).alias("shortest"), F.max(F.length(p)).alias("longest"))
