import random

import numpy as np

from threadmill.llm import neardup as N


def jaccard(a, b, k):
    x, y = ({tuple(t[i : i + k]) for i in range(len(t) - k + 1)} for t in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def texts(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        base = [f"w{rng.randint(0, 4000)}" for _ in range(60)]
        out.append((f"a{i}", " ".join(base)))
        edited = list(base)
        for _ in range(rng.choice((1, 2, 3, 12))):
            edited[rng.randrange(len(edited))] = "edit"
        out.append((f"b{i}", " ".join(edited)))
    return out


def test_brute_force(spark):
    rows = texts(150)
    df = spark.createDataFrame(rows, "id string, t string").repartition(5)
    member, links = N.near_duplicates(df, "id", "t", 0.6, **N.POSTS)
    cls = {r["id"]: r["cls"] for r in member.collect()}
    got = {(r["a"], r["b"]) for r in links.collect()}
    for i in range(0, len(rows), 2):
        (x, a), (y, b) = rows[i], rows[i + 1]
        j = jaccard(a, b, 3)
        if j < 1:
            assert (tuple(sorted((cls[x], cls[y]))) in got) == (j >= 0.6)


def test_edges(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    text = " ".join(f"t{i}" for i in range(40))
    rows = [("1", text), ("1", text), ("2", text.upper() + "!"), ("3", None), ("4", ""), ("5", "short one"), (None, text), ("6", long), ("7", long + " end"), ("8", "[removed]")]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("keys", N.F.lit(1)).withColumn("cls", N.F.lit("x"))
    member, links = N.near_duplicates(df, "id", "text", 0.6, **N.POSTS)
    cls = {r["id"]: r["cls"] for r in member.collect()}
    assert set(cls) == {"1", "2", "6", "7"} and cls["1"] == cls["2"] and member.count() == 4
    assert [sorted((r["a"], r["b"])) for r in links.collect()] == [sorted((cls["6"], cls["7"]))]
    assert N.near_duplicates(df.limit(0), "id", "text")[1].count() == 0


def test_crowded_key_loses_nothing(spark):
    base = " ".join(f"t{i}" for i in range(80))
    rows = [(f"{i:03}", f"{base} end{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "id string, t string")
    sketched = N.sketch_texts(df, "id", "t", 3, 72, 6, 20)
    assert N.similar_classes(sketched, 0.6, 432, crowd=7).count() == 60 * 59 // 2


def test_odd_sketch_estimates(spark):
    s = N.Sampler(3, 72, 6)
    a = s.runs([f"w{i}" for i in range(100)])
    b = s.runs([f"w{i}" for i in range(10, 110)])
    x, y = s.samples(a), s.samples(b)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    differ = int(np.bitwise_count((s.sketch(x) ^ s.sketch(y)).view(np.uint64)).sum())
    est = spark.range(1).select(N.estimate(N.F.lit(differ), s.k)).first()[0]
    assert abs(est - true) < 0.1
