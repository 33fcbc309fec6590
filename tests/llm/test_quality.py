import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadmill.llm import quality as Q


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .,\n|1é\t", max_size=80), st.integers(1, 9))
def test_chunks_merge_exactly(t, size):
    whole = Q.finish(Q.measure(t))
    parts = [Q.measure(t[i : i + size]) for i in range(0, len(t), size)] or [Q.measure("")]
    left = parts[0]
    for p in parts[1:]:
        left = Q.merge(left, p)
    right = parts[-1]
    for p in reversed(parts[:-1]):
        right = Q.merge(p, right)
    assert Q.finish(left) == Q.finish(right) == whole


def test_counts_by_hand():
    words, mean, symbols, ended, common, lines, kind = Q.finish(Q.measure("The cat is here.\n\nno end"))
    assert (words, lines, ended, kind) == (6, 2, 0.5, None) and mean == 3.0 and common == pytest.approx(3 / 6)


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("- apples\n- pears\n- plums\n- figs\n- dates\n- grapes", "list"), ("red kite, old lamp, green door, blue mug, tin box, grey hat, wet rope", "list"), ("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n| 5 | 6 |", "table"), ("name,age,city\nann,3,x\nbob,4,y\ncy,5,z\ndi,6,w", "table"),
        ("qwerty zxcvb asdfg hjkl poiu lkjh mnbv cxz asdf qwe rty fgh vbn", "junk"), ("https://a.example/x https://b.example/y https://c.example/z", "junk"), ("Share | Save | Report | Log in | Sign up | Share | Hide | Next page", "junk"), ("?!" * 40, "junk"),
        ("I went to the shop and it was closed, so we had to walk back home in the rain.", None), ("MAIN GHAR PAR THA AUR KISI NE KUCH NAHI KAHA, PHIR SAB THEEK HO GAYA.", None), ("Je ne sais pas pourquoi il est parti si tôt, mais je suis fatigué.", None), ("", None), ("   ", None),
    ],
)
def test_kinds(text, kind):
    assert Q.finish(Q.measure(text))[-1] == kind


def test_frame(spark):
    long = "I was in the house and it is a fine day for all of us. " * 6_000
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, long), (None, "x")], "doc_id long, text string").withColumn("state", Q.F.lit(0)).withColumn("part", Q.F.lit("p"))
    rows = {r["doc_id"]: r for r in Q.statistics(df).collect()}
    assert set(rows) == {2, 3, 4} and rows[2]["n_words"] == 0 and rows[4]["n_words"] == 90_000 and rows[4]["n_chars"] == len(long) and rows[4]["kind"] is None
    small = {r["doc_id"]: r for r in Q.statistics(df, chunk=1_000, fan=4).collect()}
    assert small == rows
    assert Q.statistics(df.limit(0)).count() == 0
