import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from threadmill.llm import tokens as T

try:
    from tokenizers import Tokenizer

    REF = Tokenizer.from_file(f"{T.FOLDER}/byte_bpe_50k.json")
    REF.encode_special_tokens = True
except Exception:  # noqa: BLE001
    REF = None
pytestmark = pytest.mark.skipif(REF is None, reason="no vocabulary")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_agrees(t):
    assert T.Encoder(T.vocabulary())(t) == REF.encode(t, add_special_tokens=False).ids


def test_long_pre_tokens_and_special_strings():
    e = T.Encoder(T.vocabulary())
    for t in ("ab" * 100_000, "=" * 50_001, "a" * 30_000, " " * 5_000 + "x", "<|endoftext|>", "à¤¤" * 2_000):
        assert e(t) == REF.encode(t, add_special_tokens=False).ids


def test_round_trip():
    ranks = T.vocabulary()
    back = {v: k for k, v in ranks.items()}
    t = "Naïve café 🙂 नमस्ते\r\n\t end"
    assert b"".join(back[i] for i in T.Encoder(ranks)(t)).decode() == t


def test_queue_orders():
    q = T.RankQueue(300_000)
    for r in (70_000, 5, 64, 5, 4_096, 262_143):
        q.push(r, r + 1)
    got = []
    while x := q.pop():
        got.append(x)
    assert got == [(5, [6, 6]), (64, [65]), (4_096, [4_097]), (70_000, [70_001]), (262_143, [262_144])]


def test_frame(spark):
    df = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "hello world", "z"), (3, "hello world", "z"), (None, "a", "z")], "doc_id long, text string, ids string")
    got = T.encode(df)
    assert got.columns == ["doc_id", "ids"]
    rows = [(r["doc_id"], r["ids"]) for r in got.collect()]
    assert (1, None) in rows and (2, []) in rows and rows.count((3, [31373, 995])) == 2 and len(rows) == 5
    assert T.encode(df.limit(0)).count() == 0
    assert {r["n_tokens"] for r in T.encode(df, lengths_only=True).collect()} == {None, 0, 1, 2}
