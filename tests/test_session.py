import os

from pyspark.sql import functions as F

from threadmill import session as S


def test_staged_tables_go(spark):
    df = S.stage(spark.range(10), "t")
    path = df._threadmill_path.removeprefix("file:").replace("//", "/")
    assert df.count() == 10 and os.path.isdir(path)
    S.unstage(df, None, spark.range(1))
    assert not os.path.isdir(path)


def test_buckets_need_no_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = S.stage_by(spark.range(1_000).select((F.col("id") % 50).alias("v"), F.col("id").alias("u")), "v", "b")
        other = S.stage(spark.range(50).withColumnRenamed("id", "v"), "o")
        got = edges.join(other, "v")
        assert got.count() == 1_000
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
        name = next(iter(S._tables.values()))
        S.unstage(edges, other)
        assert not spark.catalog.tableExists(name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
