"""Problem 8: documents into containers of fixed capacity with little unused space.

All that decides is how many documents have each size, so the packing is computed on
that histogram, which the capacity bounds: Martello and Toth's dominance rules fix
small sets that no other choice betters, and best fit packs the remainder, containers that are alike
taken together. As an option, each container in turn takes the largest item left and the items that fill
its room best, found by subset sums. The result
is a list of fillings, each used many times; documents of one size are numbered in
parallel and the numbers say which container each goes to.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.llm.tokens import encode, vocabulary
from threadmill.session import stage, table

Filling = tuple[int, dict[int, int]]  # how often, and how many of each size


class Sizes:
    """How many items of each size are left; sizes are kept in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.n = {s: k for s, k in counts.items() if k > 0 and s > 0}
        self.order = sorted(self.n)

    def take(self, filling: dict[int, int], times: int) -> None:
        for s, k in filling.items():
            self.n[s] -= k * times
            if not self.n[s]:
                del self.n[s]
                self.order.pop(bisect_right(self.order, s) - 1)

    def left(self, s: int, without: dict[int, int]) -> int:
        return self.n.get(s, 0) - without.get(s, 0)

    def largest(self, most: int, without: dict[int, int]) -> int:
        """The largest size up to ``most`` that is left, 0 if there is none."""
        i = bisect_right(self.order, most) - 1
        while i >= 0 and self.left(self.order[i], without) <= 0:
            i -= 1
        return self.order[i] if i >= 0 else 0

    def smallest(self, without: dict[int, int], many: int, above: int = 0) -> list[int]:
        """The ``many`` smallest items larger than ``above``."""
        out: list[int] = []
        for s in self.order[bisect_right(self.order, above) :]:
            out += [s] * min(self.left(s, without), many - len(out))
            if len(out) >= many:
                break
        return out


def dominating(sizes: Sizes, j: int, capacity: int) -> dict[int, int] | None:
    """A set with an item of size j that dominates every other set with it, if one is known."""
    own, room = {j: 1}, capacity - j
    three = sizes.smallest(own, 3)
    fit = 0
    for s in three:
        if sum(three[: fit + 1]) > room:
            break
        fit += 1
    if not fit:
        return own
    best = sizes.largest(room, own)
    if fit == 1 or best == room:
        return dict(Counter([j, best]))
    if fit != 2:
        return None
    pair, total = (0, 0), 0
    for a in sizes.order[: bisect_right(sizes.order, room - 1)]:
        if sizes.left(a, own) > 0 and (b := sizes.largest(room - a, dict(Counter([j, a])))) and a + b > total:
            pair, total = (max(a, b), min(a, b)), a + b
    a, b = pair
    if best >= total:
        return dict(Counter([j, best]))
    if a == best:
        between = sizes.smallest(dict(Counter([j, a])), 2, above=b)
        if len(between) < 2 or sum(between) > room:
            return dict(Counter([j, a, b]))
    return None


def times(sizes: Sizes, filling: dict[int, int]) -> int:
    return min(sizes.n[s] // k for s, k in filling.items())


def reduce(sizes: Sizes, capacity: int) -> list[Filling]:
    """Fixes dominating sets, largest items first, until a pass fixes none."""
    out: list[Filling] = []
    moved = True
    while moved and sizes.order:
        moved = False
        for j in sorted(sizes.order, reverse=True):
            while sizes.n.get(j) and (got := dominating(sizes, j, capacity)):
                # the set dominates as long as it can be formed and the few smallest items stay the same
                k, low = times(sizes, got), sizes.order[0]
                if low in got:
                    k = max(1, min(k, (sizes.n[low] - 4) // got[low]))
                sizes.take(got, k)
                out.append((k, got))
                moved = True
    return out


def best_filling(sizes: Sizes, j: int, capacity: int) -> dict[int, int]:
    """Of all sets with an item of size j, one that leaves least space; large items are preferred."""
    got, room = Counter([j]), capacity - j
    while s := sizes.largest(room, got):
        got[s] += 1
        room -= s
    if not room:
        return dict(got)
    own, room = {j: 1}, capacity - j
    mask, steps, sums = (1 << (room + 1)) - 1, [], 1
    for s in sizes.order[: bisect_right(sizes.order, room)]:
        k = min(sizes.left(s, own), room // s)
        steps.append((s, k, sums))
        width = 1
        while k > 0:
            w = min(width, k)
            sums |= sums << (s * w) & mask
            k -= w
            width *= 2
        if sums >> room & 1:
            break
    target, got = sums.bit_length() - 1, Counter([j])
    for s, k, before in reversed(steps):
        t = min(k, target // s)
        while t and not before >> (target - t * s) & 1:
            t -= 1
        if not before >> (target - t * s) & 1:
            raise AssertionError("a reachable sum must be taken apart")
        if t:
            got[s] += t
            target -= t * s
    return dict(got)


def fill_up(sizes: Sizes, capacity: int) -> list[Filling]:
    """Container by container, the fullest one around the largest item left."""
    out: list[Filling] = []
    while sizes.order:
        got = best_filling(sizes, sizes.order[-1], capacity)
        k = times(sizes, got)
        sizes.take(got, k)
        out.append((k, got))
    return out


def best_fit(sizes: Sizes, capacity: int) -> list[Filling]:
    """Items from the largest on, each into the fullest open container that takes it, a new one if none does.

    Containers that are alike are one entry with their number, so the steps follow the kinds of containers and not the items.
    """
    rooms: dict[int, list[Filling]] = {}  # open containers by the room they have left

    def put(room: int, often: int, filling: dict[int, int]) -> None:
        rooms.setdefault(room, []).append((often, filling))

    for s in sorted(sizes.order, reverse=True):
        left = sizes.n[s]
        for room in sorted(r for r in rooms if r >= s):
            for often, filling in rooms.pop(room):
                # a container that took an item is the fullest one still open to the next, so it is filled up before another
                each = room // s
                full = min(often, left // each)
                if full:
                    put(room - each * s, full, filling | {s: each})
                    left -= full * each
                    often -= full
                if often and left:
                    put(room - left * s, 1, filling | {s: left})
                    left, often = 0, often - 1
                if often:
                    put(room, often, filling)
        each = capacity // s
        if left // each:
            put(capacity - each * s, left // each, {s: each})
        if left % each:
            put(capacity - (left % each) * s, 1, {s: left % each})
    sizes.n.clear()
    sizes.order.clear()
    return [f for room in sorted(rooms) for f in rooms[room]]


def fillings(counts: dict[int, int], capacity: int, rest: str = "best_fit") -> list[Filling]:
    """A packing of ``counts`` (size to number) into containers of ``capacity``; ``rest`` says how the remainder is packed, 'best_fit' or 'fill_up'."""
    if counts and max(counts) > capacity:
        raise ValueError("an item exceeds the capacity; split it first")
    sizes = Sizes(counts)
    return reduce(sizes, capacity) + {"best_fit": best_fit, "fill_up": fill_up}[rest](sizes, capacity)


def ranges(packed: list[Filling]) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """For each size, (first number, items a container, first container) in order; and the number of containers."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    upto: Counter = Counter()
    container = 1
    for often, filling in packed:
        for s, k in filling.items():
            out.setdefault(s, []).append((upto[s], k, container))
            upto[s] += often * k
        container += often
    return out, container - 1


def pieces(sized: DataFrame, specs: list, key: str) -> DataFrame:
    """(spec_id, key, piece_no, n_tokens): a document is one piece, or full pieces and a rest if it exceeds the capacity."""
    each = F.array(*[F.struct(F.lit(r["spec_id"]).alias("spec_id"), F.lit(r["tokenizer"]).alias("t"), F.lit(r["capacity_tokens"]).alias("capacity_tokens")) for r in specs])
    own = F.filter(each, lambda x: x["t"] == F.col("tokenizer"))
    df = sized.select("*", F.inline(own))
    n, c = F.col("n"), F.col("capacity_tokens")
    last = F.greatest(F.ceil(n / c).cast("int") - 1, F.lit(0))
    df = df.select("spec_id", F.col(key), n.alias("n"), c.alias("c"), F.explode(F.sequence(F.lit(0), last)).alias("piece_no"))
    return df.select("spec_id", key, "piece_no", F.least(F.col("n") - F.col("piece_no") * F.col("c"), F.col("c")).cast("int").alias("n_tokens"))


def numbered(items: DataFrame, by: list[str], order: list[str], largest: int, most: int = 200_000) -> DataFrame:
    """Numbers the rows of each group from 0 without putting a group into one task.

    Groups are dealt over buckets, eight at least; the buckets' sizes give each bucket its first number.
    """
    buckets = max(8, math.ceil(largest / most))
    df = items.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    inside = Window.partitionBy(*by, "__b").orderBy(*order)
    df = df.withColumn("__i", F.row_number().over(inside) - 1)
    sizes = items.withColumn("__b", F.pmod(F.xxhash64(*order), F.lit(buckets))).groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    return df.join(sizes, [*by, "__b"]).withColumn("number", F.col("__first") + F.col("__i")).drop("__b", "__i", "__first")


def pack(sized: DataFrame, specs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(spec_id, key, piece_no, n_tokens, container_id): every document in containers of every capacity.

    ``sized`` has (key, tokenizer, n), ``specs`` has (spec_id, tokenizer, capacity_tokens). Containers are
    numbered from 1 within a spec. A document of size 0 or null takes no room and goes into container 1.
    An empty table gives no rows, as do specs without a positive capacity.
    """
    sized = sized.select(key, "tokenizer", F.coalesce("n", F.lit(0)).alias("n"))
    rows = specs.select("spec_id", "tokenizer", "capacity_tokens").where("spec_id is not null and tokenizer is not null and capacity_tokens > 0").collect()  # a fixed table of a few rows
    if not rows:
        kind = dict(sized.dtypes)[key]
        return sized.sparkSession.createDataFrame([], f"spec_id int, `{key}` {kind}, piece_no int, n_tokens int, container_id long")
    items = stage(pieces(sized, rows, key), "p8")
    histogram: dict[int, dict[int, int]] = {}
    for r in items.groupBy("spec_id", "n_tokens").count().collect():  # as many rows as the capacities have tokens, at most
        histogram.setdefault(r["spec_id"], {})[r["n_tokens"]] = r["count"]
    capacity = {r["spec_id"]: r["capacity_tokens"] for r in rows}
    where: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for spec, counts in histogram.items():
        got, _ = ranges(fillings({s: k for s, k in counts.items() if s > 0}, capacity[spec]))
        for s, rows in got.items():
            where[spec, s] = tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
    shared = items.sparkSession.sparkContext.broadcast(where)  # bounded by the capacities
    largest = max((k for counts in histogram.values() for k in counts.values()), default=0)

    @F.pandas_udf("long")
    def container(spec: pd.Series, size: pd.Series, number: pd.Series) -> pd.Series:
        out = np.ones(len(size), np.int64)
        at = pd.DataFrame({"spec": spec, "size": size}).groupby(["spec", "size"]).indices
        x = number.to_numpy()
        for (sp, s), i in at.items():
            if s > 0:
                first, each, base = shared.value[sp, s]
                j = np.searchsorted(first, x[i], "right") - 1
                out[i] = base[j] + (x[i] - first[j]) // each[j]
        return pd.Series(out)

    df = numbered(items, ["spec_id", "n_tokens"], [key, "piece_no"], largest)
    return df.select("spec_id", key, "piece_no", "n_tokens", container("spec_id", "n_tokens", "number").alias("container_id"))


def sized_documents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    specs = table(spark, sf_dir, "container_specs")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = [
        encode(docs, ranks=vocabulary(name), lengths_only=True).select("doc_id", F.lit(name).alias("tokenizer"), F.col("n_tokens").alias("n"))
        for name in sorted(r["tokenizer"] for r in specs.select("tokenizer").where("tokenizer is not null").distinct().collect())
    ]
    if not parts:
        return spark.createDataFrame([], "doc_id long, tokenizer string, n int"), specs
    sized = parts[0]
    for p in parts[1:]:
        sized = sized.unionByName(p)
    return sized, specs


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(*sized_documents(spark, sf_dir))


def fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each spec: containers, tokens, share of space unused, and the fewest containers that could do."""
    sized, specs = sized_documents(spark, sf_dir)
    got = pack(sized, specs).groupBy("spec_id").agg(F.max("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"))
    got = got.join(F.broadcast(specs.select("spec_id", "capacity_tokens")), "spec_id")
    room = F.col("containers") * F.col("capacity_tokens")
    return got.select("spec_id", "containers", "pieces", "tokens", (1 - F.col("tokens") / room).alias("unused_share"), F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("fewest"))


QUERIES = {"p8_containers": containers, "p8_fill": fill}
