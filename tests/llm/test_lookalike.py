from hypothesis import given, settings
from hypothesis import strategies as st

from threadmill.llm import lookalike as L

LATIN, ODD = "admin", "аdmіn"


def test_union_find_is_transitive():
    u = L.UnionFind()
    u.union("a", "b")
    u.union("c", "d")
    u.union("b", "c")
    assert [sorted(c) for c in u.classes()] == [["a", "b", "c", "d"]]


def test_forms_meet():
    texts = [LATIN, ODD, "café", "café", "ａｂ", "ab", "x​y", "xy", "a b", "a b", "ﬁn", "fin"]
    rw = L.Rewriter(L.representatives(L.text_counts(texts * 2 + ["plain ascii text"] * 20)))
    for a, b in zip(texts[::2], texts[1::2], strict=True):
        assert rw(a) == rw(b)
    assert rw("Case") != rw("case") and rw("cafe") != rw("café")


def test_joiners_stay_in_emoji_and_conjuncts():
    rw = L.Rewriter(L.representatives(L.text_counts(["plain"] * 5)))
    coder = "\U0001f468‍\U0001f4bb"
    assert rw(coder) == coder and rw("क्‍ष") == "क्‍ष" and rw("la‍tin") == "latin"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_rewriting_twice_changes_nothing(t):
    rw = L.Rewriter(L.representatives(L.text_counts([t, "the quick brown fox " * 3])))
    assert rw(rw(t)) == rw(t)


def test_pairs(spark):
    rows = [("post", "1", LATIN, 0), ("post", "2", ODD, 0), ("post", "2", ODD, 1), ("post", "3", LATIN, 0), ("comment", "4", ODD, 0), ("post", "5", None, 0), (None, "6", LATIN, 0), ("post", None, LATIN, 0), ("post", "7", "", 0), ("post", "8", "x" * 50_000, 0)]
    df = spark.createDataFrame(rows, "src string, rec_id string, text string, form int")
    got = {tuple(r) for r in L.look_alike_pairs(df).collect()}
    assert got == {("post", "1", "2"), ("post", "2", "3")}
    assert L.look_alike_pairs(df.limit(0)).count() == 0
    out = {r["rec_id"]: r["canonical"] for r in L.canonical(df, L.learn(df)).collect()}
    assert out["5"] is None and out["7"] == "" and out["2"] == LATIN


def test_members_are_one_row_a_record(spark):
    rows = [("post", "a", "plain text"), ("post", "b", "pl\u0430in text"), ("post", "b", "pl\u0430in text"), ("post", "c", "other"), ("post", "d", None), ("post", None, "x"), ("comment", "a", "plain text")]
    df = spark.createDataFrame(rows, "src string, rec_id string, text string")
    got = {(r["src"], r["rec_id"]): (r["class_id"], r["n_links"]) for r in L.memberships(df).collect()}
    assert len(got) == 4 and got["post", "a"][0] == got["post", "b"][0] and got["post", "a"][1] == 1 and got["post", "c"][1] == 0 and got["comment", "a"][1] == 0
