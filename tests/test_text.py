import pytest
from pyspark.sql import functions as F

from threadmill.functions import text as X


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("value", "kept", "result"),
    [
        ("**bold** text", "delete", "text"), ("**bold** text", "keep", "bold text"), ("_it_ x", "delete", "it x"), ("> quoted", "delete", "> quoted"), ("> quoted", "keep", "quoted"), (None, "delete", ""), ("", "delete", ""),
        ("[removed by a] b] c", "delete", "c"), ("see https://a.example/x?y=1 now", "delete", "see now"), ("a &lt;b&gt; c", "delete", "a <b> c"), ("x\t\n y", "delete", "x y"), ("credited", "delete", "cr"), ("/r/abc /u/me hi", "delete", "hi"), ("12 points", "delete", ""),
    ],
)
def test_clean(spark, value, kept, result):
    assert one(spark, X.Cleaner(emphasis=kept), value) == result


def test_clean_very_long(spark):
    assert one(spark, X.Cleaner(aggressive=True), "word​ " * 100_000) == " ".join(["word"] * 100_000)


@pytest.mark.parametrize(("value", "result"), [("Nai YR bohot", "nahi yaar bahut"), ("nai, bohot", "nai, bahut"), ("kya karoon pls", "kya karu please"), (None, ""), ("  ", "")])
def test_normalize(spark, value, result):
    assert one(spark, X.normalize_tokens, value) == result


@pytest.mark.parametrize(("value", "result"), [("drop year, DROP YEAR", "drop_year, drop_year"), ("double drop year", "double_drop year"), ("backdrop year", "backdrop year"), ("Tier-3 tier3", "tier_3 tier_3"), (None, "")])
def test_phrases(spark, value, result):
    assert one(spark, X.preserve_phrases, value) == result


def test_many_phrases_agree_with_few(spark):
    rules = X.PHRASES | {f"no such phrase {i}": f"no_{i}" for i in range(60)}
    for t in ("double drop year", "my mock test, Tier 3", ""):
        assert one(spark, lambda c: X.preserve_phrases(c, rules), t) == one(spark, X.preserve_phrases, t)


def test_restore(spark):
    assert one(spark, X.restore_phrases, "tier_3 some_word drop_year") == "tier3 some word drop year"


def test_phrase_tokens(spark):
    assert one(spark, X.phrase_tokens, "(Hello), a 'world'! x") == ["Hello", "world"]


def test_anonymize(spark):
    assert one(spark, lambda c: X.anonymize(c, 100, True), "u/me wrote to a.b@c.example or +91 98765 43210, see https://x.example/y in r/abc") == "[user] wrote to [email] or [phone], see [link] in [sub]"
    assert len(one(spark, lambda c: X.anonymize(c, 10), "x" * 50)) == 10


def test_anonymize_whole_texts(spark, tmp_path):
    from threadmill.plans.catalogue import QUERIES

    spark.createDataFrame([("a", "word " * 500 + "u/me")], "id string, full_text string").write.parquet(str(tmp_path / "posts_merged_final_preprocessed.parquet"))
    (row,) = QUERIES["anonymize_text"](spark, str(tmp_path)).collect()
    assert row["anonymous"] == "word " * 500 + "[user]"


def test_audit_and_flags(spark):
    df = spark.createDataFrame([("[removed]",), ("a view poll",), (None,), ("fine",)], "t string")
    r = X.artifact_audit(df, "t").first()
    assert (r["n_removed"], r["n_view_poll"], r["n_any"], r["n_empty"], r["n_texts"]) == (1, 1, 2, 1, 4)
    assert one(spark, X.is_mostly_artifacts, "[removed] [deleted] [removed] x") is True
    assert one(spark, X.is_mostly_artifacts, "[removed]") is False


def test_topics_text(spark):
    assert one(spark, X.normalize_for_topics, "Kya  karu, DROP year! https://x.example a") == "kya_karu drop_year"
    assert one(spark, X.is_contentful, "a b c d e f g h i j k l") is True
    assert one(spark, X.slug, "Big-Model/X") == "big_model_x"
