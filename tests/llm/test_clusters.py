import random

import numpy as np

from threadmill.llm import clusters as C

TOPICS = [[f"{t}{i}" for i in "abcdefgh"] for t in ("zeta", "omega", "kappa", "sigma")]
FILL = [f"fill{i}" for i in "abcdefghijklmnopqrstuvwxyz"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = i % 4
        rows.append((f"p{i:04}", " ".join(rng.choices(TOPICS[t], k=8) * 2 + rng.choices(FILL, k=12)), t))
    return rows


def test_clusters_are_topics(spark):
    rows = corpus(400)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(rows[0][0], rows[0][1]), ("n1", "only1 unseen2")], "id string, text string")
    member, community, edges = C.cluster(df, C.word_weights(df, commonest=0.6))
    got = {r["id"]: r["community"] for r in member.join(community, "node").collect()}
    for t in range(4):
        own = [got[i] for i, _, k in rows if k == t]
        assert len(own) == 100
        others = {got[i] for i, _, k in rows if k != t}
        assert not set(own) & others
    assert member.count() == 400
    top = C.typical(member, community, edges).collect()
    assert sum(r["size"] for r in top) == 400 and all(1 <= len(r["typical"]) <= 5 for r in top)


def test_graph_recall(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(30, C.DIM)) * 2
    x = (centers[rng.integers(0, 30, 3_000)] + rng.normal(size=(3_000, C.DIM)))
    q = np.clip(np.round(x / np.linalg.norm(x, axis=1, keepdims=True) * 40 * np.sqrt(C.DIM)), -127, 127).astype(np.int8)
    df = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(q)], "node long, vec binary")
    got: dict = {}
    for r in C.neighbour_graph(df, 3_000).collect():
        got.setdefault(r["u"], set()).add(r["v"])
    u = q / np.linalg.norm(q.astype(float), axis=1, keepdims=True)
    hit = 0
    for i in range(0, 3_000, 100):
        s = u @ u[i]
        s[i] = -2
        hit += len(got[i] & set(np.argsort(-s)[: C.K]))
    assert hit / (30 * C.K) >= 0.9


def test_modularity_on_two_cliques(spark):
    e = [(a, b) for c in (range(6), range(10, 16)) for a in c for b in c if a != b] + [(0, 10), (10, 0)]
    got = {r["node"]: r["community"] for r in C.communities(spark.createDataFrame([(a, b, 1.0) for a, b in e], "u long, v long, w float")).collect()}
    assert len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(10, 16)}) == 1 and got[0] != got[10]


def test_blocks_split_a_key_that_all_share(spark):
    rng = np.random.default_rng(5)
    rows = [(i, bytearray(rng.integers(-90, 90, C.DIM).astype(np.int8).tobytes()), 0) for i in range(500)]
    df = spark.createDataFrame(rows, "node long, vec binary, key long")
    got = C.join_blocks(df, 500, 3, leaf=50)
    assert got.select("u").distinct().count() == 500


def test_graph_recall_holds_as_the_table_grows(spark):
    rng = np.random.default_rng(6)
    n = 20_000
    centers = rng.normal(size=(30, C.DIM)) * 2
    x = centers[rng.integers(0, 30, n)] + rng.normal(size=(n, C.DIM))
    q = np.clip(np.round(x / np.linalg.norm(x, axis=1, keepdims=True) * 40 * np.sqrt(C.DIM)), -127, 127).astype(np.int8)
    df = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(q)], "node long, vec binary")
    got: dict = {}
    for r in C.neighbour_graph(df, n).collect():
        got.setdefault(r["u"], set()).add(r["v"])
    u = q / np.linalg.norm(q.astype(float), axis=1, keepdims=True)
    hit = 0
    for i in range(0, n, 100):  # not the nodes that the graph measures itself by
        s = u @ u[i]
        s[i] = -2
        hit += len(got[i] & set(np.argsort(-s)[: C.K]))
    assert hit / (200 * C.K) >= 0.9


def test_communities_do_not_break_up_as_the_graph_grows(spark):
    half, near = 1_500, 4  # two long rings whose nodes see only their next neighbours, so that moves have far to go
    e = {(c * half + i, c * half + (i + d) % half) for c in (0, 1) for i in range(half) for d in range(1, near + 1)}
    both = [(x, y, 1.0) for a, b in sorted(e) for x, y in ((a, b), (b, a))]
    df = spark.createDataFrame(both, "u long, v long, w float")
    for more in ({}, {"alone": 0}):
        got = {r["node"]: r["community"] for r in C.communities(df, **more).collect()}
        assert len(got) == 2 * half and not {got[i] for i in range(half)} & {got[i] for i in range(half, 2 * half)}
        total, inside, k = len(both), 0, {}
        for a, b, _ in both:
            inside += got[a] == got[b]
            k[got[a]] = k.get(got[a], 0) + 1
        assert inside / total - sum((x / total) ** 2 for x in k.values()) >= 0.93 and len(k) <= 45, more


def test_null_and_unknown_topics_need_no_agreement(spark):
    texts = [(f"a{i}", "apple apple tree") for i in range(5)] + [(f"b{i}", "brick brick wall") for i in range(5)]
    df = spark.createDataFrame(texts, "id string, text string")
    rows = spark.createDataFrame([(i, 1 if i[0] == "a" else 2) for i, _ in texts], "id string, topic_id int")
    known = spark.createDataFrame([(1,), (2,)], "topic_id int")
    odd = spark.createDataFrame([("b0", None, 1, 7), ("b1", 99, 1, 7), ("b2", 2, 1, 7), ("a0", 2, 1, 7), ("a1", 1, 1, 7)], "id string, recorded int, topic_id int, c long")
    weights = {w: 1.0 for w in ("apple", "tree", "brick", "wall")}
    got = {(r["id"], r["topic_id"]) for r in C.agree(df, weights, C.suspects_of(odd, known), rows).collect()}
    assert got == {("b0", 1), ("b1", 1), ("a0", 1)}


def test_posts_in_no_cluster_are_kept(spark):
    posts = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "id string, text string")
    topics = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("gone", 1)], "id string, topic_id int")
    member = spark.createDataFrame([("a", 10), ("b", 11)], "id string, node long")
    community = spark.createDataFrame([(10, 10)], "node long, community long")
    rows = C.placed(posts, topics, member, community)
    assert {(r["id"], r["recorded"], r["c"]) for r in rows.collect()} == {("a", 1, 10), ("b", 1, None), ("c", 1, None)}
    known = spark.createDataFrame([(1,)], "topic_id int")
    sure = C.suspects_of(rows.withColumn("topic_id", C.F.when(C.F.col("c").isNull(), -1).otherwise(1)), known)
    assert {(r["id"], r["topic_id"], r["sure"]) for r in sure.collect()} == {("b", -1, True), ("c", -1, True)}
    edges = spark.createDataFrame([], "u long, v long, w float")
    assert {(r["cluster_id"], r["size"]) for r in C.typical(member, community, edges).collect()} == {(10, 1), (11, 1)}
