"""Reduction, density clusters and hierarchies of vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadmill.operators.relational import first_by
from threadmill.session import stage


def reduce_pca(df: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    """(key, reduced): the ``k`` principal components; the signs of axes are free."""
    v = df.where(F.col(vec).isNotNull()).select(key, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("v"))
    if v.isEmpty():
        return v.select(key, F.array().cast("array<double>").alias("reduced"))
    return PCA(k=k, inputCol="v", outputCol="r").fit(v).transform(v).select(key, vector_to_array("r").alias("reduced"))


#: Bytes of pivots that are broadcast, at most; rows of one side of a cell that meet in one task.
PIVOT_BYTES, BLOCK = 64 << 20, 4_096


def knn(df: DataFrame, key: str, vec: str, k: int, cells: int | None = None, probes: int = 4, seed: int = 7) -> DataFrame:
    """(u, v, d): near neighbours by Euclidean distance through an inverted file.

    Vectors go to the cell of the nearest of some pivots, which are drawn among them, and are looked up in their
    ``probes`` nearest cells; with as many probes as cells the result is exact. There are about as many cells as the root of the number of vectors,
    so a vector meets some ``probes`` times that many others at any size. Whoever asks a cell that many ask is dealt over
    salts. Rows with a null vector are left out; equal vectors under several keys should be one row before, see ``density_clusters``.
    """
    rows = df.where(F.col(vec).isNotNull()).select(F.col(key).alias("u"), F.transform(vec, lambda x: x.cast("double")).alias("x"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim")).first()
    n, dim = size["n"], size["dim"] or 1
    cells = cells or max(1, math.isqrt(n))
    cells = max(1, min(cells, PIVOT_BYTES // (8 * dim)))
    pivots = np.array([r["x"] for r in rows.orderBy(F.xxhash64(F.col("u").cast("string"), F.lit(seed)), "u").limit(cells).collect()])
    if not len(pivots):
        return rows.select("u", F.col("u").alias("v"), F.lit(0.0).alias("d")).limit(0)
    probes = min(probes, len(pivots))
    kind = dict(rows.dtypes)["u"]
    shared = df.sparkSession.sparkContext.broadcast(pivots)  # bounded by PIVOT_BYTES

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = shared.value
        half = (p**2).sum(1) / 2
        for b in batches:
            x = np.stack(b["x"].to_numpy()) if len(b) else np.zeros((0, p.shape[1]))
            for at in range(0, len(x), 1_000):
                s = half[None] - x[at : at + 1_000] @ p.T
                m = min(probes, s.shape[1])
                best = np.argpartition(s, m - 1, axis=1)[:, :m]
                best = np.take_along_axis(best, np.take_along_axis(s, best, 1).argsort(axis=1, kind="stable"), 1)
                yield pd.DataFrame({"u": b["u"].to_numpy()[at : at + 1_000], "x": b["x"].to_numpy()[at : at + 1_000], "cells": list(best.astype(np.int64))})

    placed = stage(rows.mapInPandas(near, f"u {kind}, x array<double>, cells array<long>"), "knn")
    ask = placed.select("u", "x", F.explode("cells").alias("cell"))
    salts = ask.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))  # a row for each cell
    ask = ask.join(F.broadcast(salts), "cell").withColumn("salt", F.pmod(F.xxhash64(F.col("u").cast("string")), "salts"))
    ask = ask.select("u", "x", "cell", F.col("salt").cast("long").alias("salt"))
    home = placed.select(F.col("u").alias("hu"), F.col("x").alias("hx"), F.col("cells")[0].alias("hc"))
    home = home.join(F.broadcast(salts.select(F.col("cell").alias("hc"), F.col("salts").alias("hs"))), "hc")
    home = home.select("hu", "hx", "hc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("hs").cast("long") - 1)).alias("salt_h"))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"u": a["u"].iloc[:0], "v": a["u"].iloc[:0], "d": np.zeros(0)})
        x, y = np.stack(a["x"].to_numpy()), np.stack(b["hx"].to_numpy())
        out, names = [], b["hu"].to_numpy()
        for at in range(0, len(x), 512):
            own = a["u"].to_numpy()[at : at + 512]
            d = np.maximum((x[at : at + 512] ** 2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x[at : at + 512] @ y.T, 0)
            m = min(k + 1, len(y))
            best = np.argpartition(d, m - 1, axis=1)[:, :m]
            exact = np.sqrt(((x[at : at + 512, None] - y[best]) ** 2).sum(-1))
            out.append(pd.DataFrame({"u": np.repeat(own, m), "v": names[best.ravel()], "d": exact.ravel()}))
        got = pd.concat(out)
        return got[got["u"] != got["v"]]

    pairs = ask.groupBy("cell", "salt").cogroup(home.groupBy("hc", "salt_h")).applyInPandas(meet, f"u {kind}, v {kind}, d double")
    return first_by(pairs, ["u"], [F.col("d"), F.col("v")], k)


def minimum_spanning_forest(edges: DataFrame, rounds: int = 32) -> DataFrame:
    """(u, v, d): Boruvka's forest of an undirected graph (u, v, d), u and v of one type.

    Each round every component takes its shortest edge out and components are relabelled by
    pointer jumping; the number of rounds is logarithmic and each is staged.
    """
    e = stage(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "d").groupBy("u", "v").agg(F.min("d").alias("d")), "mst")
    label = stage(e.select(F.col("u").alias("n")).unionByName(e.select(F.col("v").alias("n"))).distinct().withColumn("c", F.col("n")), "mstl")
    tree = None
    for _ in range(rounds):
        a, b = label.select(F.col("n").alias("u"), F.col("c").alias("cu")), label.select(F.col("n").alias("v"), F.col("c").alias("cv"))
        open_ = e.join(a, "u").join(b, "v").where("cu <> cv")
        both = open_.select("cu", "cv", "u", "v", "d").unionByName(open_.select(F.col("cv").alias("cu"), F.col("cu").alias("cv"), "u", "v", "d"))
        pick = stage(both.groupBy("cu").agg(F.min(F.struct("d", "u", "v", "cv")).alias("m")).select("cu", "m.*"), "mstp")
        if pick.isEmpty():
            break
        new = pick.select("u", "v", "d").distinct()
        tree = new if tree is None else tree.unionByName(new)
        hop = pick.select(F.col("cu").alias("c"), "cv")
        back = hop.select(F.col("c").alias("cv"), F.col("cv").alias("back"))
        jump = hop.join(back, "cv", "left").select("c", F.when(F.col("back") == F.col("c"), F.least("c", "cv")).otherwise(F.col("cv")).alias("to"))
        while True:
            jump = stage(jump, "mstj")
            two = jump.alias("x").join(jump.select(F.col("c").alias("to"), F.col("to").alias("next")).alias("y"), "to", "left").select("c", F.coalesce("next", "to").alias("next"), "to")
            if two.where("next <> to").isEmpty():
                break
            jump = two.select("c", F.col("next").alias("to"))
        label = stage(label.join(jump, "c", "left").select("n", F.coalesce("to", "c").alias("c")), "mstl")
    return tree if tree is not None else e.limit(0)


def density_clusters(df: DataFrame, key: str, vec: str, min_samples: int = 5, least: int = 10, cut: float = 0.9, cells: int | None = None, probes: int = 4) -> DataFrame:
    """(key, cluster): density-based clusters, -1 for noise.

    Equal vectors are one node, so a vector copied many times is no crowd. Core distances come from near neighbours, edges get the mutual reachability
    distance, the spanning forest is cut at the quantile ``cut`` of its lengths, and components under ``least`` vectors are noise, as are null vectors.
    A cluster is named after the least hash in it.
    """
    whole = df.where(F.col(vec).isNotNull()).select(F.col(key).alias("__k"), F.transform(vec, lambda x: x.cast("double")).alias("x"))
    named = stage(whole.withColumn("h", F.xxhash64("x")), "dh")
    nodes = stage(named.groupBy("h").agg(F.first("x").alias("x"), F.count("*").alias("m")), "dn")
    near = stage(knn(nodes, "h", "x", min_samples, cells, probes), "dknn")
    # the own copies are neighbours at no distance, and a neighbour's copies are as many neighbours
    reach = near.join(nodes.select(F.col("h").alias("v"), F.col("m").alias("mv")), "v").join(nodes.select(F.col("h").alias("u"), F.col("m").alias("mu")), "u")
    upto = F.sum("mv").over(Window.partitionBy("u").orderBy("d", "v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("mu") - 1
    core = reach.withColumn("upto", upto).groupBy("u").agg(F.when(F.max("mu") > min_samples, 0.0).otherwise(F.coalesce(F.min(F.when(F.col("upto") >= min_samples, F.col("d"))), F.max("d"))).alias("core"))
    e = near.join(core, "u").join(core.select(F.col("u").alias("v"), F.col("core").alias("core_v")), "v")
    e = e.select("u", "v", F.greatest("d", "core", "core_v").alias("d"))
    tree = stage(minimum_spanning_forest(e), "dtree")
    at = tree.agg(F.percentile_approx("d", F.lit(cut)).alias("at"))
    short = tree.crossJoin(F.broadcast(at)).where("d <= at").select("u", "v", "d")  # one row
    parts = connected(short)
    parts = nodes.select(F.col("h").alias("n"), "m").join(parts, "n", "left").select("n", "m", F.coalesce("c", "n").alias("c"))
    size = parts.groupBy("c").agg(F.sum("m").alias("size"))
    good = parts.join(size, "c").where(F.col("size") >= least).select(F.col("n").alias("h"), F.col("c").alias("cluster"))
    good = named.join(good, "h").select(F.col("__k").alias(key), "cluster")
    return df.select(key).join(good, key, "left").select(key, F.coalesce(F.col("cluster").cast("long"), F.lit(-1)).alias("cluster"))


def connected(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(n, c): the smallest node of each node's component, by alternating large and small stars."""
    e = stage(edges.select("u", "v").where("u <> v").distinct(), "cc")
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        m = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(m, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(m.select("u", F.col("m").alias("v")))
        new = stage(small.where("u <> v").distinct(), "cc")
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            break
        e = new
    nodes = edges.select(F.col("u").alias("n")).unionByName(edges.select(F.col("v").alias("n"))).distinct()
    roots = e.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("c"))
    return nodes.join(roots, "n", "left").select("n", F.coalesce("c", "n").alias("c"))


def average_linkage(pairs: DataFrame, sizes: DataFrame, most: int = 2_000) -> DataFrame:
    """(step, left_id, right_id, distance, size): the merge table of topics by average linkage.

    ``pairs`` has (i, j, sim) of topics, ``sizes`` their ids (topic). Topics are few; their number is checked.
    """
    spark = pairs.sparkSession
    ids = sorted(r[0] for r in sizes.select(sizes.columns[0]).limit(most + 1).collect())
    if len(ids) > most:
        raise ValueError("too many topics for a hierarchy on the driver")
    at = {t: i for i, t in enumerate(ids)}
    d = np.full((len(ids), len(ids)), np.inf)
    for r in pairs.collect():
        d[at[r["i"]], at[r["j"]]] = d[at[r["j"]], at[r["i"]]] = 1 - r["sim"]
    alive, name, n, rows = list(range(len(ids))), list(range(len(ids))), [1] * len(ids), []
    while len(alive) > 1:
        sub = d[np.ix_(alive, alive)]
        i, j = divmod(int(np.argmin(sub)), len(alive))
        i, j = sorted((i, j))
        a, b = alive[i], alive[j]
        rows.append((len(rows), int(name[a]), int(name[b]), float(round(sub[i, j], 6)), n[a] + n[b]))
        for c in alive:
            if c not in (a, b):
                d[a, c] = d[c, a] = (n[a] * d[a, c] + n[b] * d[b, c]) / (n[a] + n[b])
        n[a] += n[b]
        name[a] = len(ids) + len(rows) - 1
        alive.remove(b)
    return spark.createDataFrame(rows, "step int, left_id int, right_id int, distance double, size int")
