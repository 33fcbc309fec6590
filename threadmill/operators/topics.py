"""Class-based term weighting, vocabulary, coherence and other measures of topics, in long format."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions.text import STOPWORDS, without_stopwords, word_tokens
from threadmill.operators.relational import first_by, ratio
from threadmill.session import spread


def terms(df: DataFrame, key: str, text: str, least: int = 2, stop: Sequence[str] = (), also: Sequence[str] = ()) -> DataFrame:
    """(key, *also, pos, term): one row for each token."""
    words = word_tokens(F.col(text), least)
    if stop:
        words = without_stopwords(words, stop)
    return df.select(key, *also, F.posexplode(words).alias("pos", "term"))


def class_counts(df: DataFrame, topic: str, text: str, least: int = 3, stop: Sequence[str] = ()) -> DataFrame:
    """(topic, term, n). Counts of documents are added up; texts are never joined into class documents."""
    words = word_tokens(F.col(text), least)
    if stop:
        words = without_stopwords(words, stop)
    return df.where(F.col(topic).isNotNull()).select(topic, F.explode(words).alias("term")).groupBy(topic, "term").agg(F.count("*").alias("n"))


def ctfidf(n: DataFrame, topic: str) -> DataFrame:
    """(topic, term, n, score): n / class total * ln(1 + A / term total), A the whole part of the mean class length."""
    size = n.groupBy(topic).agg(F.sum("n").alias("size"))
    mean = size.agg(F.floor(F.avg("size")).alias("a"))
    freq = n.groupBy("term").agg(F.sum("n").alias("f"))
    got = n.join(freq, "term").join(F.broadcast(size), topic).crossJoin(F.broadcast(mean))  # classes are few; the mean is one row
    return got.select(topic, "term", "n", (F.col("n") / F.col("size") * F.log1p(F.col("a") / F.col("f"))).alias("score"))


def top_terms(scored: DataFrame, topic: str, k: int = 10, digits: int = 6) -> DataFrame:
    """(topic, rank, term, score); equal scores in the order of terms."""
    s = scored.withColumn("score", F.round("score", digits)).where("score > 0")
    rank = F.row_number().over(Window.partitionBy(topic).orderBy(F.desc("score"), "term"))
    return s.withColumn("rank", rank).where(F.col("rank") <= k).select(topic, F.col("rank").cast("int").alias("rank"), "term", "score")


def vocabulary(df: DataFrame, key: str, text: str, min_df: int = 15, max_df: float = 0.45, most: int = 20_000, stop: Sequence[str] = STOPWORDS, bigrams: bool = True) -> DataFrame:
    """(term, df, tf): terms of fitting document frequency, the most frequent ones; bigrams form after stop words go."""
    words = F.filter(without_stopwords(word_tokens(F.col(text), 2), stop), lambda w: w.rlike("^[a-z]"))
    d = df.select(key, words.alias("w"))
    grams = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i.cast("int")), F.element_at("w", (i + 1).cast("int"))))).otherwise(F.array().cast("array<string>"))
    d = d.select(key, F.explode(F.concat("w", grams) if bigrams else F.col("w")).alias("term"))
    per = d.groupBy(key, "term").agg(F.count("*").alias("k"))
    got = per.groupBy("term").agg(F.count("*").alias("df"), F.sum("k").alias("tf"))
    n = df.agg(F.count("*").alias("n_docs"))
    got = got.crossJoin(F.broadcast(n)).where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n_docs"))).drop("n_docs")
    return got.orderBy(F.desc("tf"), "term").limit(most)


def diversity(top: DataFrame) -> DataFrame:
    """Distinct terms over terms of all topics' keywords; 0 if there are none."""
    return top.agg(F.round(F.coalesce(ratio(F.countDistinct("term"), F.count("term")), F.lit(0.0)), 6).alias("diversity"))


def half_split_jaccard(top: DataFrame, topic: str) -> DataFrame:
    """Jaccard similarity of the keywords of the first half of topics and of the second."""
    order = top.select(topic).distinct().withColumn("i", F.row_number().over(Window.orderBy(topic)) - 1).withColumn("m", F.count("*").over(Window.partitionBy()))
    side = top.join(F.broadcast(order.select(topic, (F.col("i") < F.floor(F.col("m") / 2)).alias("first"))), topic)
    per = side.groupBy("term").agg(F.max(F.col("first").cast("int")).alias("a"), F.max((~F.col("first")).cast("int")).alias("b"))
    return per.agg(F.round(F.coalesce(ratio(F.sum(F.col("a") * F.col("b")), F.count("*")), F.lit(0.0)), 6).alias("jaccard"))


_WORD = re.compile("[a-z0-9_]+")


def pair_counts(df: DataFrame, key: str, text: str, wanted: DataFrame, size: int, least: int = 2, at_once: int = 4_096) -> DataFrame:
    """(a, b, n_ab, n_a, n_b, n_windows) for all ordered pairs of wanted terms that meet in a window, and of terms with themselves.

    Boolean sliding windows of ``size`` tokens; a text shorter than that is one window. Each text is read
    once and its windows are counted where it is read, so only sums for pairs of terms are shuffled. Rows
    with a null key and texts without tokens have no windows.
    """
    terms_ = sorted(r["term"] for r in wanted.select("term").distinct().collect())  # keywords of topics: a few hundred
    at = {t: i for i, t in enumerate(terms_)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = 0, np.zeros((len(terms_), len(terms_)), np.int64)
        for batch in batches:
            for t in batch["t"]:
                words = [w for w in _WORD.findall(t) if len(w) >= least]
                if not words:
                    continue
                windows = max(1, len(words) - size + 1)
                total += windows
                where: dict[int, list[int]] = {}
                for p, w in enumerate(words):
                    if w in at:
                        where.setdefault(at[w], []).append(p)
                if not where:
                    continue
                ids = np.array(list(where))
                if windows == 1:
                    n[np.ix_(ids, ids)] += 1
                    continue
                for lo in range(0, windows, at_once):  # a long text in slices
                    hi = min(windows, lo + at_once)
                    inside = np.zeros((len(ids), hi - lo), np.float32)
                    for row, places in enumerate(where.values()):
                        for p in places:
                            inside[row, max(0, p - size + 1 - lo) : max(0, p + 1 - lo)] = 1
                    n[np.ix_(ids, ids)] += (inside @ inside.T).round().astype(np.int64)
        a, b = np.nonzero(n)
        yield pd.DataFrame({"i": np.r_[a, -1], "j": np.r_[b, -1], "n": np.r_[n[a, b], total]})

    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.lower(text).alias("t"))
    sums = spread(rows).mapInPandas(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # as many as pairs of keywords
    n = {(r["i"], r["j"]): r["n"] for r in sums}
    out = [(terms_[i], terms_[j], c, n[i, i], n[j, j], n[-1, -1]) for (i, j), c in sorted(n.items()) if i >= 0]
    return df.sparkSession.createDataFrame(out, "a string, b string, n_ab long, n_a long, n_b long, n_windows long")


def dictionary(df: DataFrame, key: str, text: str, no_below: int, no_above: float, least: int = 2) -> DataFrame:
    """(term, df): terms in at least ``no_below`` texts and at most the share ``no_above`` of those that have any."""
    words = df.where(F.col(key).isNotNull()).select(F.array_distinct(word_tokens(F.col(text), least)).alias("ws")).where(F.size("ws") > 0)
    n = words.agg(F.count("*").alias("n"))
    got = words.select(F.explode("ws").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return got.crossJoin(F.broadcast(n)).where((F.col("df") >= no_below) & (F.col("df") <= no_above * F.col("n"))).drop("n")  # one row


def known_keywords(top: DataFrame, words: DataFrame, topic: str, least: int = 3, topics: int = 2) -> DataFrame:
    """The keywords that are in a dictionary, of topics with at least ``least`` of them; none at all if fewer than ``topics`` topics are left."""
    top = top.join(words.select("term"), "term", "left_semi")
    good = top.groupBy(topic).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).drop("__n")
    good = good.withColumn("__m", F.count("*").over(Window.partitionBy())).where(F.col("__m") >= topics).select(topic)  # topics are few
    return top.join(F.broadcast(good), topic, "left_semi")


def npmi(eps: float = 1e-12):
    p, a, b = F.col("n_ab") / F.col("n_windows"), F.col("n_a") / F.col("n_windows"), F.col("n_b") / F.col("n_windows")
    return F.log((p + eps) / (a * b)) / -F.log(p + eps)


def coherence_npmi(df: DataFrame, key: str, text: str, top: DataFrame, topic: str, size: int = 10, digits: int = 6) -> DataFrame:
    """(topic, c_npmi): mean NPMI of the pairs of a topic's keywords; pairs that never meet count with their limit value."""
    counts = pair_counts(df, key, text, top, size)
    single = counts.where("a = b").select(F.col("a").alias("t"), F.col("n_ab").alias("n_t"), "n_windows")
    k = top.select(topic, "rank", "term")
    pairs = k.select(topic, F.col("rank").alias("i"), F.col("term").alias("a")).join(k.select(topic, F.col("rank").alias("j"), F.col("term").alias("b")), topic).where("i < j")
    s1, s2 = single.select(F.col("t").alias("a"), F.col("n_t").alias("n_a"), "n_windows"), single.select(F.col("t").alias("b"), F.col("n_t").alias("n_b"))
    got = pairs.join(F.broadcast(s1), "a").join(F.broadcast(s2), "b").join(F.broadcast(counts.select("a", "b", "n_ab")), ["a", "b"], "left").na.fill(0, ["n_ab"])  # keywords only
    return got.groupBy(topic).agg(F.round(F.avg(npmi()), digits).alias("c_npmi"))


def coherence_cv(df: DataFrame, key: str, text: str, top: DataFrame, topic: str, size: int = 110, digits: int = 6) -> DataFrame:
    """(topic, c_v): mean cosine of each keyword's NPMI vector with the sum of all of the topic's."""
    counts = pair_counts(df, key, text, top, size)
    k = top.select(topic, F.col("term").alias("a")).join(top.select(topic, F.col("term").alias("b")), topic)
    scored = counts.select("a", "b", F.coalesce(npmi(), F.lit(0.0)).alias("x"))
    rows = k.join(F.broadcast(scored), ["a", "b"], "left").na.fill(0.0, ["x"])
    out = f"`{topic}` {dict(top.dtypes)[topic]}, c_v double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:  # at most 10 keywords by 10
        m = pdf.pivot(index="a", columns="b", values="x").to_numpy()
        s = m.sum(axis=0)
        norm = np.linalg.norm(m, axis=1) * np.linalg.norm(s)
        cos = np.where(norm > 0, (m @ s) / np.where(norm > 0, norm, 1), 0.0)
        return pd.DataFrame({topic: [pdf[topic].iat[0]], "c_v": [round(float(cos.mean()), digits)]})

    return rows.groupBy(topic).applyInPandas(one, out)


def reduce_outliers(df: DataFrame, key: str, text: str, topic: str, threshold: float = 0.05, least: int = 3, digits: int = 6) -> DataFrame:
    """(key, old, new, sim): documents of topic -1 go to the topic most similar by c-TF-IDF if that is ``threshold`` similar.

    The cosine is summed over shared terms, so neither matrix is made dense.
    """
    weights = ctfidf(class_counts(df.where(F.col(topic) != -1), topic, text, least), topic).select(topic, "term", "score")
    norm = weights.groupBy(topic).agg(F.sqrt(F.sum(F.col("score") ** 2)).alias("norm"))
    idf = weights.groupBy("term").agg(F.max("score").alias("__x")).select("term")
    out = df.where(F.col(topic) == -1).select(key, F.explode(word_tokens(F.col(text), least)).alias("term")).join(idf, "term").groupBy(key, "term").agg(F.count("*").cast("double").alias("tf"))
    length = out.groupBy(key).agg(F.sqrt(F.sum(F.col("tf") ** 2)).alias("length"))
    dots = out.join(weights, "term").groupBy(key, topic).agg(F.sum(F.col("tf") * F.col("score")).alias("dot"))
    sims = dots.join(F.broadcast(norm), topic).join(length, key).withColumn("sim", F.round(F.col("dot") / (F.col("norm") * F.col("length")), digits))
    best = first_by(sims, [key], [F.desc("sim"), F.col(topic)])
    old = df.where(F.col(topic) == -1).select(key)
    got = old.join(best.select(key, F.col(topic).alias("best"), "sim"), key, "left")
    return got.select(key, F.when(F.col("sim") >= threshold, F.col("best")).otherwise(-1).cast("int").alias("new_topic"), F.coalesce("sim", F.lit(0.0)).alias("sim"))


def rerank_mmr(top: DataFrame, vectors: DataFrame, topic: str, k: int = 5, balance: float = 0.7) -> DataFrame:
    """(topic, rank, term): keywords re-ranked by maximal marginal relevance; ``vectors`` has (term, vec)."""
    rows = top.join(vectors, "term").select(topic, "term", "score", "vec")
    out = f"`{topic}` {dict(top.dtypes)[topic]}, rank int, term string"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:  # a topic's keywords: a few dozen at most
        pdf = pdf.sort_values(["score", "term"], ascending=[False, True])
        x = np.stack(pdf["vec"].to_numpy()).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
        rel = pdf["score"].to_numpy(float)
        rel = rel / (rel.max() + 1e-12)
        got = [0]
        while len(got) < min(k, len(rel)):
            left = [i for i in range(len(rel)) if i not in got]
            value = [balance * rel[i] - (1 - balance) * (x[got] @ x[i]).max() for i in left]
            got.append(left[int(np.argmax(value))])
        return pd.DataFrame({topic: pdf[topic].iat[0], "rank": range(1, len(got) + 1), "term": pdf["term"].iloc[got].to_numpy()})

    return rows.groupBy(topic).applyInPandas(one, out)


def topic_similarity(scored: DataFrame, topic: str, digits: int = 6) -> DataFrame:
    """(inter_sim_ctfidf): mean cosine of pairs of topics by their weighted terms; 0 below two topics. Dots are summed over shared terms."""
    w = scored.select(topic, "term", "score")
    norm = w.groupBy(topic).agg(F.sqrt(F.sum(F.col("score") ** 2)).alias("norm"))
    ids = norm.select(F.col(topic).alias("i"), F.col("norm").alias("ni"))
    pairs = ids.join(F.broadcast(ids.select(F.col("i").alias("j"), F.col("ni").alias("nj"))), F.col("i") < F.col("j"))  # topics are few
    a, b = w.select(F.col(topic).alias("i"), "term", F.col("score").alias("x")), w.select(F.col(topic).alias("j"), "term", F.col("score").alias("y"))
    dots = a.join(b, "term").where("i < j").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    sim = F.coalesce(ratio(F.col("dot"), F.col("ni") * F.col("nj")), F.lit(0.0))
    return pairs.join(dots, ["i", "j"], "left").agg(F.round(F.coalesce(F.avg(sim), F.lit(0.0)), digits).alias("inter_sim_ctfidf"))


def coherence_proxy(scored: DataFrame, topic: str, digits: int = 6) -> DataFrame:
    """(proxy): the mean over topics of their highest weight."""
    return scored.groupBy(topic).agg(F.max("score").alias("m")).agg(F.round(F.avg("m"), digits).alias("proxy"))
