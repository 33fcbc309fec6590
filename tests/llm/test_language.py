import random

from threadmill.llm import language as L

WORDS = {"en": "the of and was with this that from have would there about", "de": "der und die nicht mit ist auch werden haben wir über ein", "hi": "है और के में यह नहीं पर था हम सब कुछ लिए"}


def corpus(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        code = rng.choice(list(WORDS))
        label = code if rng.random() > 0.1 else rng.choice(list(WORDS))
        rows.append((f"r{i}", " ".join(rng.choices(WORDS[code].split(), k=14)), label, code))
    return rows


def test_learns_in_spite_of_noise(spark):
    rows = corpus(600)
    df = spark.createDataFrame([("post", i, t, lab) for i, t, lab, _ in rows], "src string, rec_id string, text string, lang string")
    net, codes = L.train(df, {c: c for c in WORDS}, 200, (100, 100, 100))
    fresh = corpus(200, 9)
    mixed = fresh[0][1] + "\n\n" + next(t for _, t, _, c in fresh if c != fresh[0][3])
    extra = [("post", "m", mixed, "en"), ("post", "b", "   ", "en"), ("post", "d", "12 34 !!", None), ("post", "l", ("the and was with this " * 20_000), None)]
    test = spark.createDataFrame([("post", i, t, lab) for i, t, lab, _ in fresh] + extra, df.schema)
    got = L.segments(test, net, codes).collect()
    whole = {r["rec_id"]: r["lang_code"] for r in got if r["seg_no"] == 0}
    assert sum(whole[i] == c for i, _, _, c in fresh) >= 195
    lines = {r["seg_no"]: r["lang_code"] for r in got if r["rec_id"] == "m" and r["seg_no"]}
    assert set(lines) == {1, 2} and lines[1] == fresh[0][3] and lines[2] != lines[1]
    assert "b" not in whole and "d" not in whole and whole["l"] == "en"
    assert L.segments(test.limit(0), net, codes).count() == 0


def test_windows_cover_all_bytes():
    x, first, weight = L.windows(["a" * 300, "", "é" * 100])
    assert list(first) == [0, 3, 4] and len(x) == 6 and (x != 0).sum() == 300 + 200 and weight[2] < 1


def test_brackets_do_not_count():
    assert L.plain_lines("मैं घर (mock test 3) गया\n\nfoo", lambda t: t) == [(1, "मैं घर   गया", 6), (2, "foo", 1)]


def test_labels(spark):
    df = spark.createDataFrame([("en", "English", "eng"), ("hi", None, " ")], "lang_code string, lang_name string, alias string")
    assert L.label_map(df) == {"en": "en", "english": "en", "eng": "en", "hi": "hi"}
