"""Problem 7: encoding with a public byte-level BPE vocabulary.

The merges of a pre-token are ordered by a rank queue: a bucket for each merge rank
holds positions of a linked list of symbols, a bitmap in three levels of 64 tells
which buckets hold something, find-first-set gives the next rank, and entries whose
pair has changed meanwhile are skipped. A pre-token of n bytes takes about n steps
for each merge it undergoes, so very long ones do no harm.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.session import spread, table

#: Where the vocabularies lie; only the driver reads them.
FOLDER = "/opt/tokenizers"
# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def vocabulary(name: str = "byte_bpe_50k", folder: str = FOLDER) -> dict[bytes, int]:
    """Ranks of a vocabulary given as base64 and rank on each line."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankQueue:
    """Buckets by rank under a bitmap of three levels of 64."""

    def __init__(self, ranks: int) -> None:
        self.words = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.at: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.at.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.at[rank] = [position]
        self.words[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions from left to right."""
        if not self.top:
            return None
        i = (self.top & -self.top).bit_length() - 1
        m = self.mid[i]
        j = (i << 6) + (m & -m).bit_length() - 1
        w = self.words[j]
        rank = (j << 6) + (w & -w).bit_length() - 1
        self.words[j] = w & (w - 1)
        if not self.words[j]:
            self.mid[i] = m & (m - 1)
            if not self.mid[i]:
                self.top &= self.top - 1
        bucket = self.at.pop(rank)
        bucket.sort()
        return rank, bucket


class Encoder:
    """Text to token ids; remembers the pre-tokens met, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], remember: int = 300_000) -> None:
        self.ranks, self.remember = ranks, remember
        self.split = regex.compile(PATTERN).findall
        self.queue = RankQueue(max(ranks.values()) + 1)
        self.known: dict[str, list[int]] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        n, get, push = len(data), ranks.get, self.queue.push
        ends = list(range(1, n + 1))  # where the symbol that begins here ends; it's also where the next begins
        before = list(range(-1, n))
        for i in range(n - 1):
            if (r := get(data[i : i + 2])) is not None:
                push(r, i)
        while got := self.queue.pop():
            rank, bucket = got
            for i in bucket:
                mid = ends[i]
                if not mid or mid >= n:
                    continue
                end = ends[mid]
                if get(data[i:end]) != rank:
                    continue  # stale
                ends[i], ends[mid] = end, 0
                if end < n:
                    before[end] = i
                    if (r := get(data[i : ends[end]])) is not None:
                        push(r, i)
                if (p := before[i]) >= 0 and (r := get(data[p:end])) is not None:
                    push(r, p)
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : ends[i]]])
            i = ends[i]
        return out

    def __call__(self, text: str) -> list[int]:
        known, out = self.known, []
        for w in self.split(text):
            ids = known.get(w)
            if ids is None:
                ids = self.merge(w.encode())
                if len(w) <= 64:
                    if len(known) >= self.remember:
                        known.clear()
                    known[w] = ids
            out += ids
        return out


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: dict[bytes, int] | None = None, lengths_only: bool = False) -> DataFrame:
    """(key, ids), or (key, n_tokens): token ids of each text without special tokens.

    An empty text gives an empty list, a null text gives null; strings of special tokens are
    ordinary text; every row gives one row, repeated keys and null keys too. Other columns are left out.
    """
    shared = df.sparkSession.sparkContext.broadcast(ranks or vocabulary())  # a vocabulary, whatever the data
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shared.value)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids = [None if t is None else enc(t) for t in part.column(1).to_pylist()]
                got = pa.array([None if x is None else len(x) for x in ids], pa.int32()) if lengths_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), got], [key, "n_tokens" if lengths_only else "ids"])

    out = f"`{key}` {kind}, " + ("n_tokens int" if lengths_only else "ids array<int>")
    return spread(df.select(F.col(key), F.col(text).alias("__text"))).mapInArrow(run, out)


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"p7_ids": ids}
