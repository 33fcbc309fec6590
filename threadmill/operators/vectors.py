"""Vectors as array columns with a key: centroids, similarity, retrieval and its measures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions.text import word_tokens
from threadmill.operators.relational import first_by, rank_in_groups, ratio
from threadmill.session import stage


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length plus 1e-12."""
    n = F.sqrt(dot(v, v)) + 1e-12
    return F.transform(v, lambda x: x.cast("double") / n)


def check_dimension(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """``df``; a vector of another length fails the job."""
    return df.where(F.when(F.size(vec) == dim, True).otherwise(F.raise_error(F.lit(f"a vector hasn't {dim} dimensions")).cast("boolean")))


def centroids(df: DataFrame, topic: str, vec: str) -> DataFrame:
    """(topic, size, centroid): unit mean of unit vectors; sums per dimension combine before the shuffle."""
    flat = df.select(topic, F.posexplode(unit(F.col(vec))).alias("pos", "x"))
    mean = flat.groupBy(topic, "pos").agg(F.avg("x").alias("m"), F.count("*").alias("size"))
    rows = mean.groupBy(topic).agg(F.max("size").alias("size"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("mean"))
    return rows.select(topic, "size", unit(F.col("mean")).alias("centroid"))


def confidence(df: DataFrame, topic: str, vec: str, digits: int = 6) -> DataFrame:
    """``df`` with the cosine of each vector to its topic's centroid. Topics are few, so centroids are broadcast."""
    c = centroids(df, topic, vec).select(topic, "centroid")
    return df.join(F.broadcast(c), topic).withColumn("confidence", F.round(dot(unit(F.col(vec)), F.col("centroid")), digits)).drop("centroid")


def centroid_pairs(df: DataFrame, topic: str, vec: str, digits: int = 6) -> DataFrame:
    """(i, j, sim) for topics i < j."""
    c = centroids(df, topic, vec)
    a, b = c.select(F.col(topic).alias("i"), F.col("centroid").alias("a")), c.select(F.col(topic).alias("j"), F.col("centroid").alias("b"))
    return a.join(F.broadcast(b), F.col("i") < F.col("j")).select("i", "j", F.round(dot(F.col("a"), F.col("b")), digits).alias("sim"))


def separation(df: DataFrame, topic: str, vec: str, redundant: float = 0.90, digits: int = 6) -> DataFrame:
    """(intra, inter, separation, redundant_pairs): two-level mean of confidences, mean similarity of centroids."""
    intra = confidence(df, topic, vec, 12).groupBy(topic).agg(F.avg("confidence").alias("m")).agg(F.avg("m").alias("intra"))
    inter = centroid_pairs(df, topic, vec, 12).agg(F.coalesce(F.avg("sim"), F.lit(0.0)).alias("inter"), F.count_if(F.col("sim") > redundant).alias("redundant_pairs"))
    got = intra.crossJoin(inter)  # one row each
    return got.select(F.round("intra", digits).alias("intra"), F.round("inter", digits).alias("inter"), F.round(F.col("intra") - F.col("inter"), digits).alias("separation"), "redundant_pairs")


def nearest(queries: DataFrame, docs: DataFrame, qid: str, did: str, vec: str, k: int = 10, digits: int = 6, block_bytes: int = 64 << 20) -> DataFrame:
    """(qid, did, rank, sim): the k most similar documents of each query.

    ``queries`` is a stated set. It meets the documents block by block, a block being so many queries that their
    vectors take ``block_bytes`` at most; each task multiplies its documents with a block and keeps k for each query, so k rows a
    query and task are shuffled, not all pairs. Several blocks are staged one after the other.
    """
    qt, dt = dict(queries.dtypes)[qid], dict(docs.dtypes)[did]
    q = queries.where(F.col(vec).isNotNull()).select(qid, vec)
    size = q.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("dim")).first()
    blocks = max(1, -(-(size["n"] * (size["dim"] or 0) * 8) // block_bytes))
    docs = docs.select(did, vec).where(F.col(vec).isNotNull())

    def one(part: DataFrame) -> DataFrame:
        rows = part.collect()  # at most ``block_bytes``, give or take what hashing deals
        ids = [r[qid] for r in rows]
        m = np.array([r[vec] for r in rows], np.float64).reshape(len(rows), size["dim"] or 0)
        m = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)
        shared = docs.sparkSession.sparkContext.broadcast((ids, m))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, m = shared.value
            for b in batches:
                if not len(b) or not ids:
                    continue
                x = np.stack(b[vec].to_numpy()).astype(np.float64)
                x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
                for lo in range(0, len(ids), 2_000):
                    s = np.round(m[lo : lo + 2_000] @ x.T, digits)
                    n = min(k, s.shape[1])
                    kth = np.partition(s, s.shape[1] - n, axis=1)[:, -n]
                    qi, di = np.nonzero(s >= kth[:, None])
                    yield pd.DataFrame({"q": np.array(ids)[lo + qi], "d": b[did].to_numpy()[di], "sim": s[qi, di]})

        got = docs.mapInPandas(run, f"q {qt}, d {dt}, sim double")
        rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "d"))
        return got.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(qid), F.col("d").alias(did), F.col("rank").cast("int").alias("rank"), "sim")

    if blocks == 1:
        return one(q)
    parts = [stage(one(q.where(F.pmod(F.xxhash64(qid), F.lit(blocks)) == i)), "near") for i in range(blocks)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def substring_relevance(retrieved: DataFrame, keywords: DataFrame, qid: str, text: str, rank: str = "rank", k: int = 10, first: int = 150, digits: int = 6) -> DataFrame:
    """(qid, relevance): the mean over the ``k`` best of the share of a query's hand-made keywords that occur in the first ``first`` characters.

    ``keywords`` has (qid, keywords), an array; null texts are empty.
    """
    got = retrieved.where(F.col(rank) <= k).join(F.broadcast(keywords.select(qid, "keywords")), qid)  # a stated set of queries
    head = F.lower(F.substring(F.coalesce(F.col(text), F.lit("")), 1, first))
    share = F.size(F.filter("keywords", lambda w: F.contains(head, w))) / F.size("keywords")
    return got.groupBy(qid).agg(F.round(F.avg(share), digits).alias("relevance"))


def graded_label(overlap: Column) -> Column:
    """Three shared words or more are relevant, one or two partially."""
    return F.when(overlap >= 3, "relevant").when(overlap >= 1, "partially_relevant").otherwise("not_relevant")


def metric_summary(metrics: DataFrame, names: list[str], by: str | None = None, digits: int = 6) -> DataFrame:
    """Mean and population deviation of metrics over queries, of all or by ``by``, in long form: (by, metric, mean, std)."""
    long = metrics.unpivot([by] if by else [], names, "metric", "value")
    keys = [by, "metric"] if by else ["metric"]
    return long.groupBy(*keys).agg(F.round(F.avg("value"), digits).alias("mean"), F.round(F.stddev_pop("value"), digits).alias("std"))


def keyword_relevance(queries: DataFrame, docs: DataFrame, qid: str, did: str, qtext: str, text: str, digits: int = 6) -> DataFrame:
    """(qid, did, rel): the share of a query's words that a document has, where above 0.

    Documents are taken apart once and meet the queries word by word.
    """
    q = queries.select(qid, F.array_distinct(word_tokens(F.col(qtext))).alias("ws")).where(F.size("ws") > 0)
    qw = q.select(qid, F.size("ws").alias("size"), F.explode("ws").alias("w"))
    dw = docs.select(did, F.explode(F.array_distinct(word_tokens(F.col(text)))).alias("w"))
    hits = dw.join(F.broadcast(qw), "w").groupBy(qid, did).agg(F.count("*").alias("n"), F.first("size").alias("size"))  # a stated set of queries
    return hits.select(qid, did, F.round(F.col("n") / F.col("size"), digits).alias("rel"))


def ir_metrics(ranked: DataFrame, relevance: DataFrame, qid: str, did: str, k: int = 10, digits: int = 6) -> DataFrame:
    """(qid, p, r, mrr, ap, ndcg) at ``k``. AP is over the hits retrieved; nDCG has linear gain and the corpus's ideal."""
    got = ranked.where(F.col("rank") <= k).join(relevance, [qid, did], "left").na.fill(0.0, ["rel"])
    hits = F.sum((F.col("rel") > 0).cast("int")).over(Window.partitionBy(qid).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    got = got.withColumn("hits", hits)
    hit = F.col("rel") > 0
    per = got.groupBy(qid).agg(
        F.sum(hit.cast("int")).alias("n_hits"), F.min(F.when(hit, F.col("rank"))).alias("first"), F.avg(F.when(hit, F.col("hits") / F.col("rank"))).alias("ap"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1.0)).alias("dcg")
    )
    total = relevance.where("rel > 0").groupBy(qid).agg(F.count("*").alias("n_rel"))
    best = first_by(relevance, [qid], [F.desc("rel"), F.col(did)], k).withColumn("i", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("rel"), did)))
    ideal = best.groupBy(qid).agg(F.sum(F.col("rel") / F.log2(F.col("i") + 1.0)).alias("idcg"))
    all_ = per.join(total, qid, "left").join(ideal, qid, "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), digits)
    return all_.select(qid, zero(F.col("n_hits") / F.lit(float(k))).alias("p"), zero(ratio(F.col("n_hits"), F.col("n_rel"))).alias("r"), zero(1.0 / F.col("first")).alias("mrr"), zero("ap").alias("ap"), zero(ratio(F.col("dcg"), F.col("idcg"))).alias("ndcg"))


def representative(df: DataFrame, topic: str, key: str, conf: str, content: Column, least: int = 5) -> DataFrame:
    """(topic, pick, key): the three best and the ones at 45 % and 65 % of each topic's pool.

    The pool is what bears content, or everything where fewer than ``least`` do. Repeated picks count once.
    """
    flagged = df.withColumn("__c", content.cast("int"))
    n = flagged.groupBy(topic).agg((F.sum("__c") >= least).alias("__e"))
    pool = flagged.join(F.broadcast(n), topic).where((~F.col("__e")) | (F.col("__c") == 1))  # topics are few
    pool = rank_in_groups(pool.select(topic, key, conf), [topic], [(conf, True), (key, False)], "i")
    at = lambda pct: F.floor(F.lit(pct) * (F.col("i_of") - 1) / 100)
    got = pool.where((F.col("i") < 3) | (F.col("i") == at(45)) | (F.col("i") == at(65)))
    return got.select(topic, F.row_number().over(Window.partitionBy(topic).orderBy("i")).cast("int").alias("pick"), key)


def embed(df: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int, batch: int = 64) -> DataFrame:
    """(key, embedding): vectors of texts by a model that the caller brings.

    ``load`` is called once in each task, where it may choose a device, and gives a function from a list of texts to a matrix.
    Within an Arrow batch texts go to the model in order of length, so that a model's batch wastes little padding, and come back by key.
    Null texts are empty. A model of another dimension than ``dim`` fails the job.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            texts = b["__t"].tolist()
            order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
            for lo in range(0, len(order), batch):
                part = order[lo : lo + batch]
                m = np.asarray(model([texts[i] for i in part]), np.float32)
                if m.shape != (len(part), dim):
                    raise ValueError(f"the model gave {m.shape}, wanted {(len(part), dim)}")
                yield pd.DataFrame({key: b[key].to_numpy()[part], "embedding": list(m)})

    return df.select(key, F.coalesce(F.col(text), F.lit("")).alias("__t")).mapInPandas(run, f"`{key}` {kind}, embedding array<float>")
