import numpy as np
import pytest
from pyspark.sql import functions as F

from threadmill.sources import io
from threadmill.streaming import events as E


def test_csv_round_trip(spark, tmp_path):
    rows = [("c1", "p1", 3, "a", None, "me", -2, 5, 'two\nlines, "quoted"'), ("c2", None, None, None, None, None, None, None, "x")]
    df = spark.createDataFrame(rows, io.COMMENTS)
    io.write_csv(df, str(tmp_path / "c"), single=True)
    assert sorted(map(tuple, io.read_csv(spark, str(tmp_path / "c"), io.COMMENTS).collect()), key=str) == sorted(rows, key=str)
    assert io.read_csv(spark, str(tmp_path / "c"), io.COMMENTS, ["body"]).columns == ["body"]


def test_log_and_resume(spark, tmp_path):
    path = str(tmp_path / "log")
    assert io.read_log(spark, path).count() == 0
    io.append_log(spark.createDataFrame([("a", False)], "config_id string, valid boolean"), path)
    io.append_log(spark.createDataFrame([("b", True)], "config_id string, valid boolean"), path)
    got = io.read_log(spark, path)
    assert got.count() == 2 and got.where("c_v is null").count() == 2


def test_matrix_and_chunks(spark, tmp_path):
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "m.npy", m)
    got = io.read_matrix(spark, str(tmp_path / "m.npy"), [7, 5, 6, 9], rows=3)
    assert {r["doc_id"]: list(r["embedding"]) for r in got.collect()}[9] == [9, 10, 11]
    with pytest.raises(ValueError):
        io.read_matrix(spark, str(tmp_path / "m.npy"), [1, 2])
    path = str(tmp_path / "chunks")
    io.write_chunks(spark.range(10), path, F.lit(0))
    with pytest.raises(FileNotFoundError):
        io.assemble_chunks(spark, path, 2)
    io.write_chunks(spark.range(5), path, F.lit(1))
    io.write_chunks(spark.range(4), path, F.lit(1))
    assert io.assemble_chunks(spark, path, 2).count() == 14


def test_markdown_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None)], "x int, y string")
    assert io.markdown(df).splitlines()[2] == "| 1 | a\\|b |"
    io.write_json(df, str(tmp_path / "j"))
    assert io.read_json(spark, str(tmp_path / "j")).count() >= 1
    assert io.read_optional(spark, str(tmp_path / "none")) is None


def test_available_now(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.range(5).write.parquet(src)
    for _ in range(2):
        E.run_available(spark, src, out, ck, lambda df: df.where("id > 1"))
    assert spark.read.parquet(out).count() == 3
    spark.range(10, 12).write.mode("append").parquet(src)
    E.run_available(spark, src, out, ck, lambda df: df.where("id > 1"))
    assert spark.read.parquet(out).count() == 5


def test_matrix_by_a_frame_of_ids_and_optional_join(spark, tmp_path):
    m = np.arange(50, dtype=np.float64).reshape(25, 2)
    np.save(tmp_path / "m.npy", m)
    ids = spark.range(25).select(F.col("id").alias("row"), (100 - F.col("id")).alias("doc_id"))
    got = {r["doc_id"]: list(r["embedding"]) for r in io.read_matrix(spark, str(tmp_path / "m.npy"), ids, rows=4).collect()}
    assert got[100] == [0, 1] and got[76] == [48, 49] and len(got) == 25
    with pytest.raises(ValueError):
        io.read_matrix(spark, str(tmp_path / "m.npy"), [1] * 25)
    df = spark.createDataFrame([("a",), ("b",)], "id string")
    other = spark.createDataFrame([("a", 3), ("a", 2)], "id string, topic_id int")
    assert {r["id"]: r["topic_id"] for r in io.join_optional(df, other, "id", "topic_id").collect()} == {"a": "3", "b": ""}
    assert {r["topic_id"] for r in io.join_optional(df, None, "id", "topic_id").collect()} == {""}
    assert [r["id"] for r in io.head(df, "id", 1).collect()] == ["a"]


def test_csv_keeps_white_space(spark, tmp_path):
    rows = [(1, "  x \r\n y  "), (2, None)]
    df = spark.createDataFrame(rows, "i int, t string")
    io.write_csv(df, str(tmp_path / "w"))
    assert sorted(map(tuple, io.read_csv(spark, str(tmp_path / "w"), df.schema).collect())) == rows
