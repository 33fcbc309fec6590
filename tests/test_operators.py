import math

import pytest
from pyspark.sql import functions as F

from threadmill.operators import classify as C
from threadmill.operators import cluster as K
from threadmill.operators import relational as R
from threadmill.operators import stats as S
from threadmill.operators import topics as T
from threadmill.operators import vectors as V


def test_buckets(spark):
    df = spark.createDataFrame([(0.3,), (0.2,), (0.5,), (0.8,), (None,)], "c double")
    assert [r[0] for r in df.select(R.confidence_bucket(F.col("c"))).collect()] == ["borderline", "low", "medium", "high", "borderline"]


def test_fallback_and_existing(spark):
    df = spark.createDataFrame([(" ", "t", "s"), ("x", "t", "s"), (None, None, None)], "full string, title string, self string")
    assert [r[0] for r in df.select(R.text_fallback(df, ["none", "full"], ["title", "self"])).collect()] == ["t s", "x", ""]
    assert R.keep_existing(df, ["full", "nope"], ["human"]).columns == ["full", "human"]


def test_sizes(spark):
    even = S.size_spread(spark.createDataFrame([(i,) for i in range(4)], "t int"), "t").first()
    assert even["gini"] == 0 and abs(even["entropy"] - 1) < 1e-6 and even["top3_share"] == 0.75
    assert S.size_spread(spark.createDataFrame([(1,), (2,)], "t int"), "t").first()["top3_share"] == 1.0
    assert S.size_spread(spark.createDataFrame([], "t int"), "t").count() == 0


def test_kappa_and_macro(spark):
    df = spark.createDataFrame([("a", "a")] * 4 + [("b", "b")] * 3 + [("a", "b")] * 2 + [("b", "a")] + [("a", None)], "x string, y string")
    r = S.kappa(df, "x", "y").first()
    pe = 0.6 * 0.5 + 0.4 * 0.5
    assert r["n"] == 10 and r["agreement"] == 0.7 and math.isclose(r["kappa"], (0.7 - pe) / (1 - pe), abs_tol=1e-6)
    m = S.macro_prf(df, "x", "y").first()
    assert math.isclose(m["recall"], (4 / 6 + 3 / 4) / 2, abs_tol=1e-6)
    assert S.macro_prf(spark.createDataFrame([("a", "z")], "x string, y string"), "x", "y").first()["f1"] == 0


def test_ari(spark):
    same = spark.createDataFrame([(i % 3, (i % 3) + 7) for i in range(30)], "a int, b int")
    assert S.adjusted_rand(same, "a", "b").first()["ari"] == 1.0
    assert S.adjusted_rand(same, "a", "b", least=100).first()["ari"] == 0.0
    one = spark.createDataFrame([(0, 0)] * 5, "a int, b int")
    assert S.adjusted_rand(one, "a", "b").first()["ari"] is None
    noise = same.unionByName(spark.createDataFrame([(-1, 5)] * 9, "a int, b int"))
    assert S.adjusted_rand(noise, "a", "b", noise=-1).first()["n"] == 30


def test_chi_square_published(spark):
    """Formula check on a hand-made table."""
    df = spark.createDataFrame([("x", "a")] * 10 + [("x", "b")] * 20 + [("y", "a")] * 30 + [("y", "b")] * 40, "r string, c string")
    r = S.chi_square(df, "r", "c").first()
    assert r["dof"] == 1 and math.isclose(r["chi2"], 0.7937, abs_tol=1e-4)


def test_mann_whitney_brute(spark):
    x, y = [1, 2, 2, 5, 9], [2, 3, 4, 4, 0, 1]
    df = spark.createDataFrame([(v, True) for v in x] + [(v, False) for v in y] + [(None, True)], "v int, f boolean")
    u = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
    assert S.mann_whitney(df, "v", F.col("f")).first()["u"] == u


def test_bootstrap(spark):
    r = S.bootstrap_ci(spark.createDataFrame([(float(i % 2),) for i in range(400)], "v double"), "v").first()
    assert r["mean"] == 0.5 and 0.42 < r["low"] < 0.48 and 0.52 < r["high"] < 0.58


def test_ir_metrics(spark):
    ranked = spark.createDataFrame([(1, d, d) for d in range(1, 11)] + [(2, d, d) for d in range(1, 11)], "q int, d int, rank int")
    rel = spark.createDataFrame([(1, 1, 1.0), (1, 3, 1.0)], "q int, d int, rel double")
    r = {x["q"]: x for x in V.ir_metrics(ranked, rel, "q", "d").collect()}
    assert (r[1]["p"], r[1]["mrr"], r[1]["ap"]) == (0.2, 1.0, 0.833333)
    assert (r[2]["p"], r[2]["r"], r[2]["mrr"], r[2]["ap"], r[2]["ndcg"]) == (0, 0, 0, 0, 0)


def test_nearest_exact(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, e array<double>").repartition(5)
    got = V.nearest(df.where("i < 3").withColumnRenamed("i", "q"), df, "q", "i", "e", 5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(3):
        want = list(np.argsort(-(u @ u[q]), kind="stable")[:5])
        assert [r["i"] for r in got.where(f"q = {q}").orderBy("rank").collect()] == want


def test_classifier(spark):
    rows = [("a", "idiot loser"), ("b", "nothing here at all"), ("c", "nothing here at all?"), ("d", None), ("e", " LOL "), ("f", "keep going, you idiot"), ("g", "x"), ("i", "same here"), ("j", "please report it using the form"), ("k", "rofl"), ("h", "I am a bot and i hear you")]
    df = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], "id string, t string, author string, parent string, score int")
    got = {r["id"]: r for r in C.classify(df, "t", "author", "parent", "score").collect()}
    assert (got["a"]["primary"], got["a"]["confidence_"]) == ("neutral_discussion", 1.0)
    assert (got["b"]["primary"], got["b"]["secondary"], got["b"]["confidence_"]) == ("neutral_discussion", None, 0.0)
    assert (got["c"]["primary"], got["c"]["confidence_"]) == ("neutral_discussion", 0.99)
    assert got["d"]["confidence_"] == 1.0 and got["e"]["primary"] == "humor_meme_coping" and got["g"]["primary"] == "neutral_discussion"
    assert (got["f"]["primary"], got["f"]["secondary"]) == ("toxic_abusive", "encouragement_motivation") and got["h"]["confidence_"] == 1.0
    assert got["i"]["primary"] == "neutral_discussion" and got["j"]["confidence_"] == 1.0 and got["k"]["primary"] == "humor_meme_coping"


def test_coherence_limits(spark):
    df = spark.createDataFrame([(1, "aa bb"), (2, "aa bb"), (3, "cc dd"), (4, None)], "i int, t string")
    top = spark.createDataFrame([(0, 1, "aa", 1.0), (0, 2, "bb", 0.5), (1, 1, "aa", 1.0), (1, 2, "cc", 0.5)], "topic int, rank int, term string, score double")
    c = {r["topic"]: r["c_npmi"] for r in T.coherence_npmi(df, "i", "t", top, "topic").collect()}
    assert c[0] > 0.99 and c[1] < -0.9
    v = {r["topic"]: r["c_v"] for r in T.coherence_cv(df, "i", "t", top, "topic").collect()}
    assert v[0] > v[1]


def test_density_and_components(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 0.1, (40, 3)), rng.normal(5, 0.1, (40, 3))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i long, e array<double>")
    got = {r["i"]: r["cluster"] for r in K.density_clusters(df, "i", "e", 4, 10, 0.97).collect()}
    a, b = {got[i] for i in range(40)} - {-1}, {got[i] for i in range(40, 80)} - {-1}
    assert a and b and not a & b and len(a) == len(b) == 1
    e = spark.createDataFrame([(1, 2), (2, 3), (10, 11), (11, 12), (12, 13), (3, 1)], "u long, v long")
    assert {r["n"]: r["c"] for r in K.connected(e).collect()} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 13: 10}


def test_resume_and_samples(spark):
    df = spark.createDataFrame([(f"k{i}", i % 3) for i in range(50)], "id string, g int")
    assert R.resume(df, df.limit(20), "id").count() == 30
    a = [r[0] for r in R.sample_per_group(df, ["g"], "id", 4).orderBy("id").collect()]
    assert a == [r[0] for r in R.sample_per_group(df.repartition(7), ["g"], "id", 4).orderBy("id").collect()] and len(a) == 12
    assert R.stratified_sample(df, ["g"], "id", 4, 20).count() == 20


@pytest.mark.parametrize("rows", [0, 1])
def test_empty_tables(spark, rows):
    df = spark.createDataFrame([("a", None)][:rows], "r string, c string")
    R.shares(df, "r").collect()
    R.crosstab(df, "r", "c", "row").collect()
    S.chi_square(df, "r", "c").collect()
    S.kappa(df, "r", "c").collect()
    S.macro_prf(df, "r", "c").collect()


def test_ranks_of_a_hot_group(spark):
    rows = [(1 if i % 3 else None, i * 7 % 50, i) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, v int, k int")
    got = {r["k"]: (r["i"], r["i_of"]) for r in R.rank_in_groups(df, ["g"], [("v", True), ("k", False)], "i", 13).collect()}
    for g in (1, None):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))
        assert [got[k] for _, _, k in own] == [(i, len(own)) for i in range(len(own))]
    assert R.rank_in_groups(df.limit(0), ["g"], [("v", True)], "i").count() == 0


def brute_neighbours(x, k):
    import numpy as np

    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize(("n", "cells", "probes", "least"), [(500, 8, 8, 1.0), (3_000, None, 12, 0.9)])
def test_knn_against_brute_force(spark, n, cells, probes, least):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (20, 8))[rng.integers(0, 20, n)] + rng.normal(0, 0.3, (n, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(-1, None)], "i long, e array<double>")
    want = brute_neighbours(x, 5)
    got = {}
    for r in K.knn(df, "i", "e", 5, cells, probes).collect():
        got.setdefault(r["u"], set()).add(r["v"])
    recall = np.mean([len(got[i] & set(want[i].tolist())) / 5 for i in range(n)])
    assert recall >= least and K.knn(df.limit(0), "i", "e", 5).count() == 0


def test_density_of_copies(spark):
    rows = [(i, [0.0, 0.0]) for i in range(60)] + [(100 + i, [9.0 + i % 5 * 0.01, 9.0]) for i in range(40)] + [(999, [50.0, -50.0]), (1000, None)]
    df = spark.createDataFrame(rows, "i long, e array<double>")
    got = {r["i"]: r["cluster"] for r in K.density_clusters(df, "i", "e", 3, 10, 0.8).collect()}
    assert len({got[i] for i in range(60)}) == 1 and got[0] != -1 and got[1000] == -1 and len(got) == 102


def test_pair_counts_by_hand(spark):
    df = spark.createDataFrame([(1, "a b c a"), (2, "a b"), (3, None), (4, ""), (None, "a b")], "id int, t string")
    top = spark.createDataFrame([("a",), ("b",), ("zz",)], "term string")
    got = {(r["a"], r["b"]): r["n_ab"] for r in T.pair_counts(df, "id", "t", top, 2, 1).collect()}
    assert got == {("a", "a"): 3, ("b", "b"): 3, ("a", "b"): 2, ("b", "a"): 2}  # windows ab bc ca, and ab
    assert T.pair_counts(df, "id", "t", top, 2, 1).first()["n_windows"] == 4
    assert T.pair_counts(df.limit(0), "id", "t", top, 2, 1).count() == 0


def test_known_keywords(spark):
    top = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, "c"), (1, 1, "a"), (1, 2, "x")], "topic int, rank int, term string")
    words = spark.createDataFrame([("a",), ("b",), ("c",)], "term string")
    assert T.known_keywords(top, words, "topic", 3, 2).count() == 0
    assert T.known_keywords(top, words, "topic", 3, 1).count() == 3


def test_nearest_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 3) + 1]) for i in range(40)] + [(99, None)], "i int, e array<double>")
    q = v.where("i % 10 = 0").withColumnRenamed("i", "q")
    one = sorted(map(tuple, V.nearest(q, v, "q", "i", "e", 3).collect()))
    many = sorted(map(tuple, V.nearest(q, v, "q", "i", "e", 3, block_bytes=32).collect()))
    assert one == many and len(one) == 12 and V.nearest(q.limit(0), v, "q", "i", "e", 3).count() == 0


def test_embed_by_a_given_model(spark):
    import numpy as np

    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "z" * 50)], "i int, t string")
    got = {r["i"]: list(r["embedding"]) for r in V.embed(df, "i", "t", lambda: lambda ts: np.array([[len(t), 1.0] for t in ts]), 2, 2).collect()}
    assert got == {1: [3.0, 1.0], 2: [0.0, 1.0], 3: [50.0, 1.0]}
    with pytest.raises(Exception, match="the model gave"):
        V.embed(df, "i", "t", lambda: lambda ts: np.zeros((len(ts), 3)), 2).collect()


def test_chi_square_tail(spark):
    df = spark.createDataFrame([(3.841459, 1.0), (18.307038, 10.0), (0.0, 4.0), (None, 1.0), (200.0, 5.0)], "x double, k double")
    p = [r[0] for r in df.select(S.chi_square_tail(F.col("x"), F.col("k"))).collect()]
    assert math.isclose(p[0], 0.05, abs_tol=1e-6) and math.isclose(p[1], 0.05, abs_tol=1e-6) and p[2] == 1.0 and p[3] is None and p[4] < 1e-30


def test_length_batches(spark):
    df = spark.createDataFrame([(i, i * 7 % 10) for i in range(10)], "i int, n int")
    got = {r["i"]: r["batch"] for r in R.length_batches(df, "i", "n", 4).collect()}
    assert got[0] == 0 and got[7] == 2 and sorted(got.values()) == [0] * 4 + [1] * 4 + [2] * 2


def test_bootstrap_draws_with_replacement(spark):
    import numpy as np

    x = np.r_[np.zeros(300), np.ones(700)]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    r = S.bootstrap_ci(df, "v", 400, block=90).first()
    rng = np.random.default_rng(1)
    lo, hi = np.percentile([x[rng.integers(0, 1000, 1000)].mean() for _ in range(4_000)], [2.5, 97.5])
    assert r["mean"] == 0.7 and abs(r["low"] - lo) < 0.006 and abs(r["high"] - hi) < 0.006
    same = S.bootstrap_ci(spark.createDataFrame([(2.0,)] * 50, "v double"), "v", 100, block=7).first()
    assert (same["mean"], same["low"], same["high"]) == (2.0, 2.0, 2.0)  # every resample has as many draws as there are rows
    assert S.bootstrap_ci(df.limit(0), "v", 10).first()["low"] is None
