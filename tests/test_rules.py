import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadmill.functions import rules as U


def test_spellings(spark):
    rules = spark.createDataFrame([("Nai", "nahi"), ("two words", "x"), (None, "y"), ("a", None)], "variant string, canonical string")
    df = spark.createDataFrame([("NAI  nai, two words",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(U.spelling_mapper(rules, F.col("t"))).collect()] == ["nahi nai, two words", "", ""]
    assert [r[0] for r in df.select(U.spelling_mapper(rules.limit(0), F.col("t"))).collect()] == ["nai nai, two words", "", ""]


def one_after_the_other(text, rules):
    for phrase, token in sorted(sorted(rules), key=lambda r: -len(r[0])):
        text = re.sub(rf"(?<!\w){re.escape(phrase)}(?!\w)", lambda m, t=token: t, text, flags=re.I)
    return text


RULES = [("mock test", "mock_test"), ("test series", "test_series"), ("tier 3", "tier_3"), ("tier-3", "tier_3"), ("a b c", "abc"), ("b c", "bc"), ("abc d", "made"), ("x", "tier 3")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["mock", "test", "series", "Tier", "3", "tier-3", "a", "b", "c", "d", "x", "é", "TEST"]), max_size=8), min_size=1, max_size=5))
def test_phrases_as_one_after_the_other(spark, docs):
    rules = spark.createDataFrame(RULES, "phrase string, token string")
    texts = [" ".join(d) for d in docs]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["out"] for r in df.select("i", U.phrase_rewriter(rules, F.col("t")).alias("out")).collect()}
    assert got == {i: one_after_the_other(t, RULES) for i, t in enumerate(texts)}


def test_a_thousand_keywords_in_one_scan(spark):
    rules = spark.createDataFrame([(f"word{i}", f"c{i % 3}", 0.5) for i in range(1_000)] + [("aa", "c9", 2.0), ("aa aa", "c8", 1.0), (None, "c", 1.0)], "keyword string, category string, weight double")
    df = spark.createDataFrame([("WORD1 word10 word999, xword2 word3é aa aa aa",), (None,)], "t string")
    got = [r[0] for r in df.select(U.keyword_scores(rules, F.col("t"))).collect()]
    assert got[0] == {"c1": 1.0, "c0": 0.5, "c9": 6.0, "c8": 1.0} and got[1] == {}


def test_rules_are_bounded(spark):
    rules = spark.createDataFrame([("a" * 50, "b")], "phrase string, token string")
    with pytest.raises(ValueError):
        U.collect_rules(rules, "phrase", "token", most_bytes=10)
    got = {r["n_words"]: (r["n"], r["shortest"], r["longest"]) for r in U.rule_statistics(spark.createDataFrame([("a b",), ("abc de",), ("x",), (None,)], "p string"), "p").collect()}
    assert got == {2: (2, 3, 6), 1: (1, 1, 1)}
