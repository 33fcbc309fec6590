from collections import Counter
from itertools import combinations

from hypothesis import given, settings
from hypothesis import strategies as st

from threadmill.llm import packing as P


def fewest(items, c):
    """Exact by search; for a few items only."""
    best = [len(items)]

    def go(rest, bins):
        if len(bins) >= best[0]:
            return
        if not rest:
            best[0] = len(bins)
            return
        x, rest = rest[0], rest[1:]
        for i, b in enumerate(bins):
            if b + x <= c and b not in bins[:i]:
                go(rest, bins[:i] + [b + x] + bins[i + 1 :])
        go(rest, [*bins, x])

    go(sorted(items, reverse=True), [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9), st.integers(20, 30))
def test_packs_all_and_reduction_is_sound(items, c):
    counts = dict(Counter(items))
    packed = P.fillings(counts, c)
    back = Counter()
    for k, f in packed:
        assert sum(s * n for s, n in f.items()) <= c
        for s, n in f.items():
            back[s] += k * n
    assert back == Counter(items)
    sizes = P.Sizes(counts)
    fixed = sum(k for k, _ in P.reduce(sizes, c))
    left = [s for s, k in sizes.n.items() for _ in range(k)]
    assert fixed + fewest(left, c) == fewest(items, c)  # what is fixed costs nothing
    assert sum(k for k, _ in packed) <= fewest(items, c) + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=40), st.integers(20, 40))
def test_best_fit_is_that_of_one_item_at_a_time(items, c):
    rooms = []
    for x in sorted(items, reverse=True):
        fits = [r for r in rooms if r >= x]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else c) - x)
    packed = P.best_fit(P.Sizes(dict(Counter(items))), c)
    got = Counter()
    for k, f in packed:
        got[c - sum(s * n for s, n in f.items())] += k
    assert got == Counter(rooms)


def test_best_filling_is_best():
    s = P.Sizes({7: 1, 5: 2, 4: 1, 3: 1})
    got = P.best_filling(s, 7, 16)
    items = [5, 5, 4, 3]
    best = max(7 + sum(x) for n in range(5) for x in combinations(items, n) if 7 + sum(x) <= 16)
    assert sum(k * n for k, n in got.items()) == best == 16


def test_many_items_are_quick():
    for rest in ("best_fit", "fill_up"):
        packed = P.fillings({s: 10**9 + s for s in range(1, 256)}, 256, rest)
        assert len(packed) < 2_000


def test_frame(spark):
    docs = [(i, "t", 1 + (i * 37) % 90) for i in range(500)] + [(900, "t", 1_000), (901, "t", None), (902, "t", 0), (903, "t", 100)]
    sized = spark.createDataFrame(docs, "doc_id long, tokenizer string, n int")
    specs = spark.createDataFrame([(1, "t", 100), (2, "t", 2_000)], "spec_id int, tokenizer string, capacity_tokens int")
    rows = P.pack(sized, specs).collect()
    used = Counter()
    for r in rows:
        used[r["spec_id"], r["container_id"]] += r["n_tokens"]
    assert all(v <= (100 if s == 1 else 2_000) for (s, _), v in used.items())
    got = Counter()
    for r in rows:
        got[r["spec_id"], r["doc_id"]] += r["n_tokens"]
    assert all(got[s, i] == (n or 0) for s in (1, 2) for i, _, n in docs)
    pieces = Counter((r["spec_id"], r["doc_id"]) for r in rows)
    assert pieces[1, 900] == 10 and max(v for (s, d), v in pieces.items() if d != 900) == 1
    assert P.pack(sized.limit(0), specs).count() == 0


def test_numbers_without_a_hot_task(spark):
    df = spark.range(1_000).selectExpr("id as doc_id", "cast(id % 2 as int) as g")
    got = P.numbered(df, ["g"], ["doc_id"], 500, most=60).groupBy("g").agg(P.F.collect_set("number").alias("s")).collect()
    assert all(sorted(r["s"]) == list(range(500)) for r in got)
