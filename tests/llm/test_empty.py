import numpy as np

from threadmill.llm import clusters, language, packing


def test_no_language(spark):
    df = spark.createDataFrame([("post", "a", "some words here", "en")], "src string, rec_id string, text string, lang string")
    net, codes = language.train(df, {})
    assert codes == [] and language.segments(df, net, codes).count() == 0
    net, codes = language.train(df.limit(0), {"en": "en", "de": "de"})
    assert language.segments(df, net, codes).count() == 1


def test_no_container(spark):
    sized = spark.createDataFrame([(1, "t", 5)], "doc_id long, tokenizer string, n int")
    specs = spark.createDataFrame([(1, None, 5), (2, "t", 0)], "spec_id int, tokenizer string, capacity_tokens int")
    assert packing.pack(sized, specs).count() == 0 and packing.pack(sized.limit(0), specs).columns == ["spec_id", "doc_id", "piece_no", "n_tokens", "container_id"]


def test_no_edge():
    none = np.zeros(0, np.int64)
    assert [len(x) for x in clusters.move_alone(none, none, none.astype(float))] == [0, 0]
