"""Problem 1: clusters of mutually similar records.

Records become short vectors of their telling words. A graph of near neighbours is found by
joining all against all in the cells of leaders drawn at random, and in groups of neighbours
of neighbours, until the graph has most of the exact neighbours of a sample. Communities come from moves that raise modularity, level by
level, and are described by their size and by the members with the highest weight inside.
"""

from __future__ import annotations

import logging
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.llm.neardup import plain_rewriter
from threadmill.llm.records import has_content
from threadmill.session import spread, stage, stage_by, table, unstage

DIM = 128
#: Neighbours of a record.
K = 10
#: Records that are joined all against all.
LEAF = 1_000
#: Leaders of cells, at most; they are broadcast.
LEADERS = 4_096
#: Nodes whose exact neighbours measure the recall of the graph.
QUERIED = 200
#: Edges up to which communities are finished in memory.
ALONE = 200_000
log = logging.getLogger(__name__)
_WORD = re.compile(r"[^\W\d_]{2,}")


def tokens(text: str, rewrite) -> list[str]:
    return _WORD.findall(rewrite(text).lower())


def word_counts(df: DataFrame) -> DataFrame:
    """(word, df, cf) over all texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewrite, docs, all_ = plain_rewriter(), Counter(), Counter()
        for b in batches:
            for t in b["text"]:
                w = tokens(t, rewrite)
                all_.update(w)
                docs.update(set(w))
            if len(all_) > 500_000:  # a task's memory stays bounded; the counts are added up later
                yield pd.DataFrame({"word": list(all_), "df": [docs[w] for w in all_], "cf": list(all_.values())})
                docs.clear()
                all_.clear()
        yield pd.DataFrame({"word": list(all_), "df": [docs[w] for w in all_], "cf": list(all_.values())}).astype({"word": object, "df": "int64", "cf": "int64"})

    return df.mapInPandas(run, "word string, df long, cf long").groupBy("word").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def word_weights(df: DataFrame, rarest: float = 1 / 20_000, commonest: float = 0.2) -> dict[str, float]:
    """Weights of telling words: rare among texts, but often repeated within those that have them.

    Words in fewer than ``rarest`` of the texts are left out, so there are at most as many
    as a text has words, divided by ``rarest``, whatever the number of texts. The cut depends on size:
    up to 60,000 texts a word counts from 3 texts on, beyond that from ``rarest`` of them (35 of 700,000).
    """
    counts = stage(word_counts(df), "p1w")
    n = df.count()
    kept = counts.where((F.col("df") >= max(3.0, n * rarest)) & (F.col("df") < max(4.0, n * commonest)))
    out = {}
    for r in kept.collect():
        burst = min(1.0, r["cf"] / r["df"] - 1.08)
        if burst > 0:
            out[r["word"]] = float(np.log(n / r["df"]) * np.sqrt(burst))
    return out


def vectors(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(id, node, vec): each text as a short vector of bytes, and the hash of its words.

    Texts without a telling word have no vector.
    """
    shared = df.sparkSession.sparkContext.broadcast(weights)  # bounded, see word_weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewrite, weights, at = plain_rewriter(), shared.value, {}

        def sketch(w: str) -> np.ndarray:
            bits = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w, seed=s) for s in range(DIM // 128)), np.uint8)
            return (np.unpackbits(bits).astype(np.float32) * 2 - 1) * weights[w]

        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["text"], strict=True):
                n = Counter(w for w in tokens(t, rewrite) if w in weights)
                if not n:
                    continue
                v = np.zeros(DIM, np.float32)
                for w, k in n.items():
                    if w not in at:
                        at[w] = sketch(w)
                    v += k * at[w]
                v = np.clip(np.round(v * (40 / max(1e-9, np.sqrt(v @ v / DIM)))), -127, 127).astype(np.int8)
                rows.append((i, xxhash.xxh64_intdigest(v.tobytes()) - 2**63, v.tobytes()))
            yield pd.DataFrame(rows, columns=["id", "node", "vec"]).astype({"node": "int64"})

    return df.mapInPandas(run, "id string, node long, vec binary")


def unit(vecs) -> np.ndarray:
    x = np.frombuffer(b"".join(bytes(v) for v in vecs), np.int8).reshape(-1, DIM).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def cell_keys(leaders: np.ndarray, levels: int, seed: int):
    """A column: the cells of the two nearest leaders, each cut by ``levels`` random planes through its leader."""
    planes = np.random.default_rng(seed).normal(size=(DIM, max(1, levels))).astype(np.float32)

    @F.pandas_udf("array<long>")
    def keys(vec: pd.Series) -> pd.Series:
        x, out = unit(vec), []
        for at in range(0, len(x), 1_000):
            y = x[at : at + 1_000]
            s = y @ leaders.T
            two = np.argpartition(-s, min(1, s.shape[1] - 1), axis=1)[:, :2]
            code = [two[:, j] if not levels else two[:, j] << levels | ((y - leaders[two[:, j]]) @ planes > 0) @ (1 << np.arange(levels)) for j in range(two.shape[1])]
            out += np.stack(code, axis=1).astype(np.int64).tolist()
        return pd.Series(out)

    return keys("vec")


def in_cells(nodes: DataFrame, n: int, seed: int, leaf: int = LEAF) -> DataFrame:
    """The nodes with ``key``, once for each of the two leaders nearest to them, drawn anew by ``seed``.

    Leaders are drawn among the nodes, so dense regions have more. There are ``n`` / half a leaf of them, ``LEADERS``
    at most; beyond that cells are cut further by planes.
    """
    want = max(1, min(LEADERS, -(-2 * n // leaf)))
    levels = max(0, int(np.ceil(np.log2(max(1.0, n / (want * leaf / 2))))))
    drawn = nodes.where(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1_000_000_007)) < int(1_000_000_007 * min(1.0, want / n)))
    leaders = [r["vec"] for r in drawn.select("vec").collect()]  # bounded by LEADERS but for chance
    if not leaders:
        return nodes.withColumn("key", F.lit(0).cast("long"))
    return nodes.withColumn("key", F.explode(cell_keys(unit(leaders), levels, seed)))


def by_neighbours(nodes: DataFrame, graph: DataFrame, seed: int) -> DataFrame:
    """The nodes with ``key``, the least hash within two steps along edges in either direction, so that neighbours of neighbours meet."""
    both = graph.select("u", "v").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
    one = both.groupBy("u").agg(F.least(F.min(F.xxhash64("v", F.lit(seed))), F.xxhash64("u", F.lit(seed))).alias("h"))
    two = both.join(one.select(F.col("u").alias("v"), "h"), "v").groupBy("u").agg(F.min("h").alias("key"))
    return nodes.join(two.withColumnRenamed("u", "node"), "node")


def join_blocks(nodes: DataFrame, n: int, k: int = K, leaf: int = LEAF) -> DataFrame:
    """(u, v, s): the best neighbours of each node among those with the same ``key``.

    Nodes are cut by ranges of (key, salt) into tasks of about four ``leaf``, so a key that many
    share is cut too, and each key is joined all against all, in slices.
    """
    tasks = max(1, -(-n // (4 * leaf)))
    salted = nodes.withColumn("salt", F.xxhash64("node", F.lit(1)))
    parts = salted.repartitionByRange(tasks, "key", "salt") if tasks > 1 else salted.coalesce(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b[["node", "key", "vec"]] for b in batches]
        if not got:
            return
        whole = pd.concat(got).sort_values("key", kind="stable")
        keys = whole["key"].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        outs: list[tuple] = []
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            for lo in range(start, end, 4 * leaf):  # a key may be that of more than meant
                b = whole.iloc[lo : min(end, lo + 4 * leaf)]
                ids, x = b["node"].to_numpy(), unit(b["vec"])
                m = min(k, len(ids) - 1)
                if m < 1:
                    continue
                for at in range(0, len(ids), 1_000):
                    s = x[at : at + 1_000] @ x.T
                    s[np.arange(len(s)), at + np.arange(len(s))] = -2
                    best = np.argpartition(-s, m - 1, axis=1)[:, :m]
                    outs.append((np.repeat(ids[at : at + len(s)], m), ids[best.ravel()], np.take_along_axis(s, best, 1).ravel()))
            if sum(len(o[0]) for o in outs) > 50_000:
                yield pd.DataFrame(dict(zip("uvs", map(np.concatenate, zip(*outs, strict=True)), strict=True)))
                outs.clear()
        if outs:
            yield pd.DataFrame(dict(zip("uvs", map(np.concatenate, zip(*outs, strict=True)), strict=True)))

    return parts.select("node", "key", "vec").mapInPandas(run, "u long, v long, s float")


def best_of(edges: DataFrame, k: int = K, floor: float = 0.15) -> DataFrame:
    """The ``k`` best distinct neighbours of each node."""
    distinct = edges.where(F.col("s") > floor).repartition("u").groupBy("u", "v").agg(F.max("s").alias("s"))  # one shuffle serves both
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    return distinct.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def exact_neighbours(nodes: DataFrame, n: int, k: int = K, queries: int = QUERIED, seed: int = 3) -> dict[int, list[float]]:
    """The similarities of the ``k`` best neighbours of ``queries`` nodes drawn by hash, met with all nodes."""
    drawn = nodes.where(F.pmod(F.xxhash64("node", F.lit(seed - 1)), F.lit(1_000_000_007)) < int(1_000_000_007 * min(1.0, queries / n)))
    rows = drawn.collect()
    ids, q = np.array([r["node"] for r in rows], np.int64), unit([r["vec"] for r in rows])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = b["node"].to_numpy()
            s = q @ unit(b["vec"]).T
            s[ids[:, None] == v[None, :]] = -2
            m = min(k, len(v))
            best = np.argpartition(-s, m - 1, axis=1)[:, :m]
            yield pd.DataFrame({"u": np.repeat(ids, m), "v": v[best.ravel()], "s": np.take_along_axis(s, best, 1).ravel()})

    out: dict[int, list[float]] = {}
    if rows:
        for r in best_of(nodes.mapInPandas(run, "u long, v long, s float"), k).collect():
            out.setdefault(r["u"], []).append(r["s"])
    return out


def recall_of(graph: DataFrame, truth: dict[int, list[float]]) -> float:
    """The share of the exact neighbours in ``truth`` that the graph has; of equally similar ones any counts."""
    worst = {u: min(s) - 1e-4 for u, s in truth.items()}
    total = sum(len(s) for s in truth.values())
    if not total:
        return 1.0
    got = graph.where(F.col("u").isin(list(worst))).select("u", "s").collect()
    return sum(r["s"] >= worst[r["u"]] for r in got) / total


def neighbour_graph(nodes: DataFrame, n: int, k: int = K, target: float = 0.95, most: int = 60, seed: int = 3) -> DataFrame:
    """(u, v, s): approximate nearest neighbours of the nodes (node, vec) by cosine.

    Nodes meet in the cells of leaders drawn anew and in groups of neighbours of neighbours, by turns, until the
    graph has ``target`` of the exact neighbours of ``QUERIED`` nodes, whatever the size of the table. It is an error
    if ``most`` turns do not get there.
    """
    if n <= LEAF:
        return stage(best_of(join_blocks(nodes.withColumn("key", F.lit(0).cast("long")), n, k), k), "p1g")
    truth = exact_neighbours(nodes, n, k, seed=seed)
    graph, recall = None, 0.0
    for t in range(most):
        # two turns in cells come first, as joins of neighbours need a graph to start from
        keyed = in_cells(nodes, n, seed + t) if t < 2 or t % 2 else by_neighbours(nodes, graph, seed + t)
        part = join_blocks(keyed, 2 * n if t < 2 or t % 2 else n, k)
        old, graph = graph, stage(best_of(part if graph is None else graph.unionByName(part), k), "p1g")
        unstage(old)
        recall = recall_of(graph, truth)
        log.info("turn %d: recall %.3f", t + 1, recall)
        if recall >= target:
            return graph
    raise RuntimeError(f"after {most} turns the neighbour graph of {n} nodes has a recall of {recall:.3f}, wanted {target}")


def move_alone(u: np.ndarray, v: np.ndarray, w: np.ndarray, gamma: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The nodes and their communities, by moves one after the other until none raises modularity, level by level until nothing merges."""
    if not len(u):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, total = ends[: len(u)], ends[len(u) :], float(w.sum()) or 1.0
    names, member, rng = ids, np.arange(len(ids)), np.random.default_rng(3)
    while True:
        n = len(names)
        near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for i, j, x in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
            if i != j:
                near[i].append((j, x))
        k = np.bincount(a, w, n).tolist()
        sums, c, moved, order = k[:], list(range(n)), True, rng.permutation(n).tolist()  # in the order of ids chains would grow
        while moved:  # ends, as each move raises modularity
            moved = False
            for i in order:
                links: dict[int, float] = {}
                for j, x in near[i]:
                    links[c[j]] = links.get(c[j], 0.0) + x
                own = c[i]
                sums[own] -= k[i]
                best, gain = own, links.get(own, 0.0) - gamma / total * k[i] * sums[own] + 1e-9
                for o, x in links.items():
                    g = x - gamma / total * k[i] * sums[o]
                    if g > gain:
                        best, gain = o, g
                sums[best] += k[i]
                moved |= best != own
                c[i] = best
        left, c = np.unique(c, return_inverse=True)
        member, names = c[member], names[left]
        if len(left) == n:
            return ids, names[member]
        at, inverse = np.unique(c[a] * len(left) + c[b], return_inverse=True)
        w, a, b = np.bincount(inverse, w), at // len(left), at % len(left)


def move_all(edges: DataFrame, label: DataFrame, few: float, gamma: float, seed: int, little: float, most: int) -> tuple[DataFrame, int]:
    """``label`` (node, k, c) after moves to the neighbouring community that raises modularity most, half of the nodes at a time, and the number of nodes.

    Two rounds that move fewer than ``few`` of the nodes, or raise modularity by less than ``little``, are the last.
    """
    r = label.agg(F.sum("k"), F.count("*")).first()
    total, n = r[0] or 1.0, r[1]
    shares, heights, held = [1.0], [], None
    for t in range(most):
        own = label.join(label.groupBy("c").agg(F.sum("k").alias("sum_k")), "c")
        near = edges.where("u <> v").join(own.select(F.col("node").alias("v"), "c", "sum_k"), "v").select("u", "c", "w", "sum_k", F.lit(None).cast("double").alias("k"))
        near = near.unionByName(own.select(F.col("node").alias("u"), "c", F.lit(0.0).alias("w"), "sum_k", "k"))
        # one shuffle serves all that follows
        near = near.repartition("u").groupBy("u", "c").agg(F.sum("w").alias("w"), F.max("sum_k").alias("sum_k"), F.max("k").alias("own_k"))
        near = near.withColumn("k", F.max("own_k").over(Window.partitionBy("u")))
        mine = F.col("own_k").isNotNull()
        gain = F.col("w") - F.lit(gamma / total) * F.col("k") * (F.col("sum_k") - F.when(mine, F.col("k")).otherwise(0.0))
        best = near.withColumn("gain", gain).groupBy("u").agg(
            F.max(F.struct(F.col("gain"), F.col("c"))).alias("best"), F.max(F.when(mine, F.col("gain"))).alias("stay"), F.first("k").alias("k"), F.max(F.when(mine, F.col("c"))).alias("own")
        )
        turn = F.pmod(F.xxhash64("u", F.lit(seed + t // 2)), F.lit(2)) == t % 2
        go = turn & (F.col("best.gain") > F.col("stay") + 1e-9)
        label = stage(best.select(F.col("u").alias("node"), "k", F.when(go, F.col("best.c")).otherwise(F.col("own")).alias("c"), go.cast("int").alias("moved"), "stay"), "p1l")
        unstage(held)
        held = label
        r = label.agg(F.sum("moved"), F.sum("stay")).first()
        label = label.select("node", "k", "c")
        shares.append((r[0] or 0) / max(1, n))
        heights.append((r[1] or 0.0) / total)  # modularity before the round, but for a constant
        log.info("round %d: %d nodes, moved %.4f, modularity %.5f", t + 1, n, shares[-1], heights[-1])
        if shares[-1] + shares[-2] < few or t > 3 and heights[-1] - heights[-3] < little:
            return label, n
    raise RuntimeError(f"{shares[-1]:.3f} of {n} nodes still move after {most} rounds")


def communities(edges: DataFrame, gamma: float = 1.0, few: float = 0.01, slow: float = 0.1, little: float = 2e-4, alone: int = ALONE, most: int = 200) -> DataFrame:
    """(node, community) of an undirected graph given by (u, v, w) in both directions.

    Nodes move until two rounds move fewer than ``slow`` of them, then communities become the nodes of the
    next level, until a level merges nothing. Last, the nodes themselves move between the final communities until two rounds
    move fewer than ``few`` of them. A level of ``alone`` edges or fewer is finished in memory. More than ``most``
    rounds or levels are an error.
    """
    spark, member, first, below = edges.sparkSession, None, None, None
    for level in range(most):
        edges = edges if level == 0 and hasattr(edges, "_threadmill_path") else stage_by(edges, "v", "p1e")
        if first and below is not first[0]:
            unstage(below)
        below = edges
        done = edges.count() <= alone
        if done:
            t = edges.select("u", "v", F.col("w").cast("double").alias("w")).orderBy("u", "v").toArrow()
            ids, got = move_alone(*(t[x].to_numpy() for x in "uvw"), gamma)
            member = onward(member, spark.createDataFrame(pa.table({"node": pa.array(ids, pa.int64()), "community": pa.array(got, pa.int64())})))
        else:
            degree = stage(edges.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k")), "p1k")
            first = first or (edges, degree)
            label, n = move_all(edges, degree.withColumn("c", F.col("node")), slow, gamma, level * 1_000, little, most)
            step = label.select("node", F.col("c").alias("community"))
            member = onward(member, step)
            done = step.select("community").distinct().count() == n
        if done and first:
            label, _ = move_all(first[0], first[1].join(member, "node").withColumnRenamed("community", "c"), few, gamma, -1_000, little, most)
            return label.select("node", F.col("c").alias("community"))
        if done:
            return member
        up, vp = step.withColumnRenamed("node", "u").withColumnRenamed("community", "cu"), step.withColumnRenamed("node", "v").withColumnRenamed("community", "cv")
        edges = edges.join(vp, "v").join(up, "u").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w"))
    raise RuntimeError(f"communities still merge after {most} levels")


def onward(member: DataFrame | None, step: DataFrame) -> DataFrame:
    """(node, community) after one more level."""
    if member is None:
        return stage(step, "p1m")
    new = stage(member.withColumnRenamed("community", "mid").join(step.withColumnRenamed("node", "mid"), "mid").select("node", "community"), "p1m")
    unstage(member)
    return new


def undirected(graph: DataFrame) -> DataFrame:
    """The graph in both directions, each edge once, weighted by the square of the similarity."""
    both = graph.select("u", "v", "s").unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s"))
    # one shuffle serves the groups and, in as many partitions as buckets, their staging by v
    return both.repartition(int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions")), "v").groupBy("u", "v").agg(F.max("s").alias("s")).select("u", "v", (F.col("s") * F.col("s")).cast("float").alias("w"))


def topic_posts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(id, text) of posts in ``topics``, and (id, topic_id) of topics; repeated rows of one id count once."""
    topics = table(spark, sf_dir, "topics").where("id is not null").groupBy("id").agg(F.max("topic_id").alias("topic_id"))
    p = table(spark, sf_dir, "posts_merged_final_preprocessed").select("id", F.col("cleaned_text").alias("text")).where(F.col("id").isNotNull() & has_content(F.col("cleaned_text")))
    return p, topics


def cluster(df: DataFrame, weights: dict[str, float], only: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, node), (node, community) and the edges (u, v, w) of (id, text).

    Null and blank texts and texts without a telling word are in no community; repeated ids and
    copies of a text share a node, so a text copied many times weighs as one. ``only`` has the ids to cluster.
    """
    got = vectors(spread(df), weights)
    if only is not None:
        got = got.join(only.select("id"), "id", "left_semi")
    got = stage(got, "p1v")
    # short numbers for nodes, drawn once as the table is written, take less room in every later shuffle
    nodes = stage(got.groupBy(F.col("node").alias("hash")).agg(F.first("vec").alias("vec")).withColumn("node", F.monotonically_increasing_id()), "p1n")
    member = stage(got.select("id", F.col("node").alias("hash")).join(nodes.select("hash", "node"), "hash").select("id", "node").distinct(), "p1i")
    unstage(got)
    graph = neighbour_graph(nodes.select("node", "vec"), nodes.count())
    edges = stage_by(undirected(graph), "v", "p1u", placed=True)  # rounds of moves meet it by v
    unstage(graph, nodes)
    return member, communities(edges), edges


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, cluster_id) of every clustered post."""
    posts, topics = topic_posts(spark, sf_dir)
    member, community, _ = cluster(posts, word_weights(spread(posts)), topics)
    return member.join(community, "node", "left").select("id", F.coalesce("community", "node").alias("cluster_id"))


def typical(member: DataFrame, community: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """(cluster_id, size, typical): the members with the highest weighted degree inside their community. A node without an edge is its own."""
    cu, cv = community.select(F.col("node").alias("u"), F.col("community").alias("a")), community.select(F.col("node").alias("v"), F.col("community").alias("b"))
    inside = edges.join(cu, "u").join(cv, "v").where("a = b").groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("degree"))
    one = member.groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    rows = one.join(community, "node", "left").withColumn("community", F.coalesce("community", "node")).join(inside, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0.0)))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc(F.round("degree", 6)), "id"))
    best = rows.withColumn("r", rank).where(F.col("r") <= top).groupBy("community").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("typical"))
    size = rows.groupBy("community").agg(F.sum("copies").alias("size"))
    return size.join(best, "community").select(F.col("community").alias("cluster_id"), "size", "typical")


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster with its size and its most typical posts."""
    posts, topics = topic_posts(spark, sf_dir)
    return typical(*cluster(posts, word_weights(spread(posts)), topics))


def agree(df: DataFrame, weights: dict[str, float], suspects: DataFrame, right: DataFrame, smooth: float = 0.2) -> DataFrame:
    """Suspects (id, topic_id, sure) that are sure or whose own words speak for ``topic_id`` more than for any other, by naive Bayes.

    ``right`` has (id, topic_id) by community. The table of words by topics is bounded: by word_weights'
    bound on words, and by the topics of a fixed table.
    """
    w = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewrite = plain_rewriter()
        n: Counter = Counter()
        for b in batches:
            for t, topic in zip(b["text"], b["topic_id"], strict=True):
                n.update((x, int(topic)) for x in set(tokens(t, rewrite)) if x in w.value)
                n["", int(topic)] += 1
        yield pd.DataFrame([(x, t, c) for (x, t), c in n.items()], columns=["word", "topic_id", "n"]).astype({"word": object, "topic_id": "int64", "n": "int64"})

    both = df.join(right, "id").dropDuplicates(["id"])
    counts = both.select("text", "topic_id").mapInPandas(run, "word string, topic_id long, n long").groupBy("word", "topic_id").agg(F.sum("n").alias("n"))
    rows = counts.collect()
    topics = sorted({r["topic_id"] for r in rows})
    size = {r["topic_id"]: r["n"] for r in rows if r["word"] == ""}
    table_: dict[str, np.ndarray] = {}
    for r in rows:
        if r["word"]:
            table_.setdefault(r["word"], np.zeros(len(topics)))[topics.index(r["topic_id"])] = r["n"]
    total = np.array([size.get(t, 0) for t in topics], float)
    for x, c in table_.items():
        base = (c.sum() + smooth) / (total.sum() + 1)
        table_[x] = np.log((c + 5 * base) / (total + 5)).astype(np.float32)
    shared = df.sparkSession.sparkContext.broadcast((table_, topics, np.log(total / total.sum())))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rewrite = plain_rewriter()
        logs, topics, prior = shared.value
        for b in batches:
            keep = []
            for t, topic, sure in zip(b["text"], b["topic_id"], b["sure"], strict=True):
                if sure:
                    keep.append(True)
                    continue
                s = prior + sum((logs[x] for x in set(tokens(t, rewrite)) if x in logs), np.zeros(len(topics)))
                keep.append(topics[int(s.argmax())] == topic)
            yield b.loc[keep, ["id", "topic_id"]]

    return df.join(suspects, "id").dropDuplicates(["id"]).select("id", "text", "topic_id", "sure").mapInPandas(judge, "id string, topic_id int")


def placed(posts: DataFrame, topics: DataFrame, member: DataFrame, community: DataFrame) -> DataFrame:
    """(id, recorded, c) of every post with content in ``topics``; ``c`` is null for a post without a telling word or without a neighbour."""
    rows = topics.join(posts.select("id"), "id", "left_semi").join(member, "id", "left").join(community, "node", "left")
    return rows.select("id", F.col("topic_id").alias("recorded"), F.col("community").alias("c"))


def suspects_of(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(id, topic_id, sure) of (id, recorded, topic_id) with another topic recorded; sure where the recorded one is null or not ``known``, or ``c`` is null."""
    rows = rows.where(~F.col("recorded").eqNullSafe(F.col("topic_id")))
    rows = rows.join(F.broadcast(known.select(F.col("topic_id").alias("recorded"), F.lit(True).alias("is_known"))), "recorded", "left")
    return rows.select("id", "topic_id", (F.col("is_known").isNull() | F.col("c").isNull()).alias("sure"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts whose recorded topic is null or at odds with their cluster, with the cluster's topic.

    A cluster's topic is the known one that most of its posts hold; a cluster without any, and a
    post in no cluster, have -1. A recorded topic that is null or not in topic_labels is a case as it is; other suspects come
    out only if a classifier by words, which may err, agrees with their cluster.
    """
    posts, topics = topic_posts(spark, sf_dir)
    weights = word_weights(spread(posts))
    member, community, _ = cluster(posts, weights, topics)
    known = table(spark, sf_dir, "topic_labels").select("topic_id").where("topic_id is not null").distinct()
    rows = placed(posts, topics, member, community)
    votes = rows.join(F.broadcast(known), rows["recorded"] == known["topic_id"]).groupBy("c", "topic_id").agg(F.count("*").alias("n"))
    right = votes.groupBy("c").agg(F.max(F.struct(F.col("n"), -F.col("topic_id"))).alias("m")).select("c", (-F.col("m.col2")).cast("int").alias("topic_id"))
    rows = stage(rows.join(right, "c", "left").withColumn("topic_id", F.coalesce("topic_id", F.lit(-1))), "p1r")
    suspects = suspects_of(rows, known)
    return agree(posts, weights, suspects, rows.select("id", "topic_id"))


QUERIES = {"p1_found": found, "p1_clusters": clusters, "p1_members": members}
