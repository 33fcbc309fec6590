"""Problem 2: one consistent form for texts that look the same on screen.

Look-alike strings are joined into classes by union-find: compatibility forms,
composed and combining forms, look-alike letters of other scripts, and signs that
cannot be seen. Each class is represented by its most frequent member in the corpus,
and texts are rewritten greedily, longest match first, by an Aho-Corasick automaton.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm.records import records
from threadmill.session import spread, stage

# Letters of other scripts that are drawn like a Latin letter.
LETTERS = {
    "Cyrillic": ("аеорсухіѕјһԁԛԝӏАВЕКМНОРСТХУІЅЈԌԚԜҮ", "aeopcyxisjhdqwlABEKMHOPCTXYISJGQWY"),
    "Greek": ("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧνϳϜ", "oABEZHIKMNOPTYXvjF"),
    "Armenian": ("օՕսհցՍԼ", "oOuhgUL"),
    "Cherokee": ("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᎽᏀᏃᏎᏔᏚᏟᏞᏢᏦᏏ", "DRTiAJEWMHYGZ4WSCLPKb"),
    "Latin": ("ɑɡ", "ag"),
}
# Hyphens and minus signs drawn like the plain one.
HYPHENS = "\u2010\u2011\u2212"
# Signs of no width: soft hyphen, zero-width space, marks of direction, word joiner, byte order mark.
UNSEEN = "\u00ad\u200b\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\ufeff\u180e\u034f"
# Joiners; unseen between letters that don't join, but part of emoji and of Indic conjuncts.
JOINERS = "\u200c\u200d"

_CLUSTER = regex.compile(r"\P{M}\p{M}(?!\p{M})")
_LOOSE = r"[\p{Latin}\p{Cyrillic}\p{Greek}\d\s\p{P}]"
_JOINER = regex.compile(rf"(?<={_LOOSE})[\u200c\u200d]+|[\u200c\u200d]+(?={_LOOSE}|$)")


class UnionFind:
    """Disjoint sets of strings."""

    def __init__(self) -> None:
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while (above := self.up.setdefault(root, root)) != root:
            root = above
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.up):
            out.setdefault(self.find(x), []).append(x)
        return [sorted(v) for v in out.values()]


def text_counts(texts: Iterable[str]) -> Counter:
    """Occurrences of code points, and of letters with a combining mark that have a form of one code point; Unicode bounds both."""
    n: Counter = Counter()
    for t in texts:
        n.update(t)
        if not t.isascii() and not unicodedata.is_normalized("NFC", t):
            n.update(c for c in _CLUSTER.findall(t) if len(unicodedata.normalize("NFC", c)) == 1)
    return n


def alike(symbols: Iterable[str]) -> UnionFind:
    """The look-alike relation among ``symbols`` and what they look like."""
    u = UnionFind()
    for a, b in (pair for other, latin in LETTERS.values() for pair in zip(other, latin, strict=True)):
        u.union(a, b)
    for h in HYPHENS:
        u.union(h, "-")
    for z in UNSEEN:
        u.union(z, "")
    for s in symbols:
        plain = unicodedata.normalize("NFKC", s)
        if plain != s and (plain.strip() or not s.strip()):
            u.union(s, plain)
        elif plain != s and len(plain) > 1 and plain[0] == " ":  # a spacing accent: a space and a mark
            u.union(s, plain)
        for form in (unicodedata.normalize("NFC", s), unicodedata.normalize("NFD", s)):
            if len(s) > 1 and form != s:
                u.union(s, form)
    return u


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """For every symbol that is not its class's representative, the representative.

    The most frequent member represents its class; a string that was not counted is
    as frequent as its rarest code point; ties go to the shorter, then the smaller.
    The class of unseen signs is represented by the empty string.
    """

    def often(s: str) -> int:
        return counts[s] if s in counts else min((counts.get(c, 0) for c in s), default=0)

    to: dict[str, str] = {}
    for members in alike(counts).classes():
        best = "" if "" in members else min(members, key=lambda s: (-often(s), len(s), s))
        to |= {m: best for m in members if m != best and m}
    return to


class Rewriter:
    """Greedy leftmost-longest rewriting of look-alikes to their representatives."""

    def __init__(self, to: dict[str, str]) -> None:
        self.ascii = any(k.isascii() for k in to)
        self.auto = ahocorasick.Automaton()
        for k, v in to.items():
            self.auto.add_word(k, (len(k), v))
        if to:
            self.auto.make_automaton()
        self.empty = not to

    def __call__(self, text: str) -> str:
        if text.isascii() and not self.ascii:
            return text.replace("\r\n", "\n") if "\r" in text else text
        if not text.isascii() and ("\u200c" in text or "\u200d" in text):
            text = _JOINER.sub("", text)
        if not self.empty:
            out, at = [], 0
            for end, (length, new) in self.auto.iter_long(text):
                out += (text[at : end + 1 - length], new)
                at = end + 1
            text = "".join(out) + text[at:]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return text.replace("\r\n", "\n") if "\r" in text else text


def count_symbols(df: DataFrame, text: str = "text") -> DataFrame:
    """(symbol, n) over all texts; as many rows as there are kinds of symbol in Unicode, at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for b in batches:
            n.update(text_counts(b["t"].dropna()))
        yield pd.DataFrame({"symbol": list(n), "n": list(n.values())}, dtype=None).astype({"symbol": object, "n": "int64"})

    part = df.select(F.col(text).alias("t")).mapInPandas(run, "symbol string, n long")
    return part.groupBy("symbol").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text: str = "text", floor: int = 1) -> dict[str, str]:
    """Counts the corpus and builds the rewriting table.

    The driver gets one row per symbol that occurs, so Unicode bounds it.
    """
    return representatives({r["symbol"]: r["n"] for r in count_symbols(df, text).where(F.col("n") >= floor).collect()})


def canonical(df: DataFrame, to: dict[str, str], text: str = "text", out: str = "canonical") -> DataFrame:
    """Adds ``out``: the text in its consistent form; null stays null, empty stays empty.

    Any clash with a column called ``out`` is settled by replacing that column. Texts of any
    length are rewritten whole in one pass.
    """
    shared = df.sparkSession.sparkContext.broadcast(to)  # bounded by Unicode

    @F.pandas_udf("string")
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rw = Rewriter(shared.value)
        for s in batches:
            yield s.map(rw, na_action="ignore")

    return df.withColumn(out, rewrite(F.col(text)))


def look_alike_pairs(df: DataFrame, key: str = "rec_id", group: str = "src", text: str = "text") -> DataFrame:
    """(src, id_a, id_b): records of one ``group`` that look the same but are different strings.

    Repeated rows of one key and text count once; a null key or text takes no part. Copies
    of one string are not paired. Work and output grow with the pairs of different strings
    in a class, never with the square of a class.
    """
    df = spread(df.select(F.col(group).alias("src"), F.col(key).alias("rec_id"), F.col(text).alias("text")).where(F.col(key).isNotNull() & F.col(text).isNotNull()))
    shared = df.sparkSession.sparkContext.broadcast(learn(df))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rw = Rewriter(shared.value)
        for b in batches:
            forms = [(rw(t), t) for t in b["text"]]
            yield pd.DataFrame({"src": b["src"], "rec_id": b["rec_id"], "form": [xxhash.xxh3_128_digest(f) for f, _ in forms], "raw": [xxhash.xxh3_128_digest(t) for _, t in forms]})

    keyed = stage(df.mapInPandas(run, "src string, rec_id string, form binary, raw binary"), "p2")
    mixed = keyed.groupBy("src", "form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select("src", "form")
    member = stage(keyed.join(mixed, ["src", "form"], "left_semi").distinct(), "p2m")
    kinds = member.select("src", "form", "raw").distinct()
    a, b = kinds.withColumnRenamed("raw", "ra"), kinds.withColumnRenamed("raw", "rb")
    pairs = a.join(b, ["src", "form"]).where("ra < rb").select("src", "ra", "rb")
    left = member.select("src", F.col("raw").alias("ra"), F.col("rec_id").alias("x"))
    right = member.select("src", F.col("raw").alias("rb"), F.col("rec_id").alias("y"))
    return pairs.join(left, ["src", "ra"]).join(right, ["src", "rb"]).where("x <> y").select("src", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def memberships(df: DataFrame, key: str = "rec_id", group: str = "src", text: str = "text") -> DataFrame:
    """(src, rec_id, class_id, n_links): the class of texts that look the same, and the number of other strings in it.

    The compact form of ``look_alike_pairs``: one row for each record with a text, however large its class; repeated rows of one key and string count once.
    """
    df = spread(df.select(F.col(group).alias("src"), F.col(key).alias("rec_id"), F.col(text).alias("text")).where(F.col(key).isNotNull() & F.col(text).isNotNull()))
    shared = df.sparkSession.sparkContext.broadcast(learn(df))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rw = Rewriter(shared.value)
        for b in batches:
            yield pd.DataFrame({"src": b["src"], "rec_id": b["rec_id"], "class_id": [xxhash.xxh64_intdigest(rw(t)) - 2**63 for t in b["text"]], "raw": [xxhash.xxh64_intdigest(t) - 2**63 for t in b["text"]]})

    keyed = stage(df.mapInPandas(run, "src string, rec_id string, class_id long, raw long"), "p2c")
    size = keyed.groupBy("src", "class_id").agg((F.countDistinct("raw") - 1).alias("n_links"))
    mixed = size.where("n_links > 0")  # few, so that a class of a third of all rows is in no join unless it is mixed
    return keyed.select("src", "rec_id", "class_id").distinct().join(mixed, ["src", "class_id"], "left").select("src", "rec_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memberships(records(spark, sf_dir))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_pairs(records(spark, sf_dir))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its consistent form; repeated rows of one key count once."""
    df = spread(records(spark, sf_dir))
    return canonical(df, learn(df)).select("src", "rec_id", "canonical").distinct()


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The look-alike table of the corpus: symbol, what it becomes, occurrences."""
    n = {r["symbol"]: r["n"] for r in count_symbols(spread(records(spark, sf_dir))).collect()}
    to = representatives(n)
    return spark.createDataFrame([(k, v, n.get(k, 0)) for k, v in sorted(to.items()) if k in n], "symbol string, becomes string, n long")


QUERIES = {"p2_found": found, "p2_texts": texts, "p2_classes": classes, "p2_members": members}
