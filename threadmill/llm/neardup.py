"""Problem 5: near-duplicate records with small edits, by odd sketches.

Each text's word runs are sampled by MinHash. Bands of the samples propose candidates;
the samples folded into a parity bitmap (odd sketch) estimate the similarity of each
candidate from the population count of an exclusive or; the runs settle what is left.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.llm.lookalike import JOINERS, UNSEEN, Rewriter, alike
from threadmill.llm.records import has_content, posts
from threadmill.session import spread, stage

_WORD = re.compile(r"[\w\u0300-\u036f\u0900-\u0dff]+")
BITS = 1024


def plain_rewriter() -> Rewriter:
    """Look-alikes to plain forms without corpus counts: the ASCII member if there is one."""
    symbols = [chr(c) for c in range(0x80, 0x3001)] + [chr(c) for c in range(0xFB00, 0xFFEF)]
    to: dict[str, str] = {}
    for members in alike(symbols).classes():
        best = "" if "" in members else min(members, key=lambda s: (not s.isascii(), len(s), s))
        to |= {m: best for m in members if m != best and m and not m.isascii()}
    return Rewriter(to | dict.fromkeys(UNSEEN + JOINERS, ""))


def words(text: str, rewrite: Rewriter) -> list[str]:
    """Words without case, punctuation, entities and differences that cannot be seen."""
    if "&" in text:
        text = html.unescape(text)
    return _WORD.findall(rewrite(text).lower().replace("_", " "))


class Sampler:
    """MinHash samples, their bands, and the odd sketch of a text's word runs."""

    def __init__(self, run: int, bands: int, rows: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.run, self.bands, self.rows, self.k = run, bands, rows, bands * rows
        self.a = rng.integers(1, 2**63, self.k, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 2**63, self.k, dtype=np.uint64)
        self.mix = rng.integers(1, 2**63, max(run, rows), dtype=np.uint64) | np.uint64(1)
        self.own = rng.integers(1, 2**63, self.k, dtype=np.uint64)
        self.band_no = rng.integers(1, 2**63, bands, dtype=np.uint64)
        self.seen: dict[str, int] = {}

    def runs(self, ws: list[str]) -> np.ndarray:
        """Distinct 64-bit hashes of the runs of ``run`` words."""
        if len(self.seen) > 500_000:
            self.seen.clear()
        seen = self.seen
        h = np.fromiter((seen[w] if w in seen else seen.setdefault(w, xxhash.xxh64_intdigest(w)) for w in ws), np.uint64, len(ws))
        n = len(h) - self.run + 1
        x = np.zeros(n, np.uint64)
        for j in range(self.run):
            y = h[j : j + n] * self.mix[j]
            x = (x ^ (y ^ (y >> np.uint64(29)))) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        return np.unique(x)

    def samples(self, runs: np.ndarray) -> np.ndarray:
        out = np.full(self.k, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(runs), 256):  # a very long text in slices
            h = runs[at : at + 256, None] * self.a + self.b
            np.minimum(out, (h ^ (h >> np.uint64(31))).min(axis=0), out=out)
        return out

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band."""
        s = samples.reshape(self.bands, self.rows)
        x = self.band_no.copy()
        for j in range(self.rows):
            x = (x ^ s[:, j]) * self.mix[j]
            x ^= x >> np.uint64(31)
        return x.view(np.int64)

    def sketch(self, samples: np.ndarray) -> np.ndarray:
        """The odd sketch: each sample flips one of BITS bits; 64-bit words."""
        at = ((samples ^ self.own) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - (BITS.bit_length() - 1))
        return np.packbits((np.bincount(at.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def estimate(differing: F.Column, k: int) -> F.Column:
    """Similarity from the bits in which two odd sketches of ``k`` samples differ."""
    share = F.least(differing / F.lit(BITS), F.lit(0.4999))
    return 1 + F.lit(BITS / (4.0 * k)) * F.log(1 - 2 * share)


def sketch_texts(df: DataFrame, key: str, text: str, run: int, bands: int, rows: int, min_words: int) -> DataFrame:
    """(id, cls, keys, sketch, runs): cls is a 64-bit hash of the words, so copies share it.

    Within a task only the first text of a class carries keys, sketch and runs, so a text
    copied over a third of the corpus is sketched and shuffled once per task.
    """

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rw, sampler, recent = plain_rewriter(), Sampler(run, bands, rows), set()
        for b in batches:
            out = []
            for i, t in zip(b["id"], b["text"], strict=True):
                ws = words(t, rw)
                if len(ws) < max(min_words, run):
                    continue
                cls = xxhash.xxh64_intdigest("\x1f".join(ws)) - 2**63
                if cls in recent:
                    out.append((i, cls, None, None, None))
                    continue
                if len(recent) > 200_000:
                    recent.clear()
                recent.add(cls)
                r = sampler.runs(ws)
                s = sampler.samples(r)
                out.append((i, cls, sampler.keys(s), sampler.sketch(s), np.unique(r.astype(np.uint32)).view(np.int32)))
            yield pd.DataFrame(out, columns=["id", "cls", "keys", "sketch", "runs"]).astype({"cls": "int64"})

    df = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col(key).isNotNull() & has_content(F.col(text)))
    return spread(df).mapInPandas(go, "id string, cls long, keys array<long>, sketch array<long>, runs array<int>")


def similar_classes(sketched: DataFrame, least: float, k: int, slack: float = 0.15, crowd: int = 128) -> DataFrame:
    """(a, b, similarity): classes of different texts at least ``least`` similar, a < b.

    A key shared by more than ``crowd`` classes is split: its classes are dealt over
    salts and meet the others salt by salt, so no task gets a whole crowd. None is left out.
    """
    first = sketched.where(F.col("keys").isNotNull())
    rows = first.select("cls", F.explode("keys").alias("k")).repartition("k").distinct()
    crowds = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    # keys of one class are the most; what is left is small and is read twice
    rows = stage(rows.join(crowds, "k").withColumn("parts", F.ceil(F.col("n") / crowd).cast("int")).drop("n"), "p5k")
    left = rows.select("k", F.col("cls").alias("a"), F.pmod(F.hash("cls"), "parts").alias("salt"))
    right = rows.select("k", F.col("cls").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    pairs = left.join(right, ["k", "salt"]).where("a < b").select("a", "b").distinct()

    def attach(pairs: DataFrame, what: str) -> DataFrame:
        own = first.select("cls", what).dropDuplicates(["cls"])
        for side in ("a", "b"):
            pairs = pairs.join(own.select(F.col("cls").alias(side), F.col(what).alias(f"{what}_{side}")), side)
        return pairs

    pairs = attach(pairs, "sketch")
    differing = sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(BITS // 64)), F.lit(0))
    pairs = attach(pairs.where(estimate(differing, k) >= least - slack).select("a", "b"), "runs")  # few are left
    both = F.size(F.array_intersect("runs_a", "runs_b"))
    pairs = pairs.withColumn("similarity", both / (F.size("runs_a") + F.size("runs_b") - both))
    return pairs.where(F.col("similarity") >= least).select("a", "b", "similarity")


#: Runs of three words at 0.6 are what the test data defines; 72 bands of 6 find 0.65 with 0.996, 0.7 with 0.9998.
POSTS = {"run": 3, "bands": 72, "rows": 6, "min_words": 20}


def near_duplicates(df: DataFrame, key: str, text: str, least: float = 0.8, run: int = 5, bands: int = 24, rows: int = 8, min_words: int = 5) -> tuple[DataFrame, DataFrame]:
    """Membership (id, cls) and links (a, b, similarity) between classes of copies.

    Null keys, null, blank and too short texts take no part; repeated rows of one key count once.
    """
    sketched = stage(sketch_texts(df, key, text, run, bands, rows, min_words), "p5")
    return sketched.select("id", "cls").distinct(), similar_classes(sketched, least, bands * rows)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of posts. Copies are expanded, as the columns are fixed; p5_classes has the compact form."""
    member, links = near_duplicates(posts(spark, sf_dir), "rec_id", "text", 0.6, **POSTS)
    member, links = stage(member, "p5m"), links.select("a", "b")
    crowd = member.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1")
    links = links.unionByName(crowd.select(F.col("cls").alias("a"), F.col("cls").alias("b")))
    left, right = member.select(F.col("cls").alias("a"), F.col("id").alias("x")), member.select(F.col("cls").alias("b"), F.col("id").alias("y"))
    pairs = links.join(left, "a").join(right, "b").where("a <> b or x < y")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).where("id_a < id_b").distinct()


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per post of at least 20 words: its class of copies and the classes linked to it."""
    member, links = near_duplicates(posts(spark, sf_dir), "rec_id", "text", 0.6, **POSTS)
    ends = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls")))
    n = ends.groupBy("cls").agg(F.count("*").alias("n_links"))
    return member.join(n, "cls", "left").select("id", F.col("cls").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


QUERIES = {"p5_found": found, "p5_classes": classes}
