"""Tables in and out: Parquet first; CSV, JSON, JSON lines, matrices with keys, chunks, Markdown."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMENTS = T.StructType([T.StructField(c, t) for c, t in (("comment_id", T.StringType()), ("post_id", T.StringType()), ("topic_id", T.IntegerType()), ("distress_type", T.StringType()), ("parent_id", T.StringType()), ("author", T.StringType()), ("score", T.LongType()), ("created_utc", T.LongType()), ("body", T.StringType()))])
POSTS = T.StructType([T.StructField(c, t) for c, t in (("id", T.StringType()), ("subreddit", T.StringType()), ("lifecycle_stage", T.StringType()), ("title", T.StringType()), ("selftext", T.StringType()), ("full_text", T.StringType()), ("is_distress", T.BooleanType()), ("distress_confidence", T.DoubleType()), ("score", T.LongType()), ("timestamp", T.StringType()))])
EXPERIMENT = T.StructType([T.StructField(c, t) for c, t in (("config_id", T.StringType()), ("valid", T.BooleanType()), ("reason", T.StringType()), ("n_topics", T.IntegerType()), ("outlier_rate", T.DoubleType()), ("c_v", T.DoubleType()), ("c_npmi", T.DoubleType()), ("topic_diversity", T.DoubleType()), ("elapsed_s", T.DoubleType()))])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header, quoted fields over several lines, and a declared schema; pruned to ``columns``."""
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', lineSep="\n", enforceSchema=False)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """White space at the ends and line ends inside of values are kept; an empty text is read back as null, as CSV has it."""
    w = (df.coalesce(1) if single else df).write.mode("overwrite")
    w.csv(path, header=True, quote='"', escape='"', lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One document a file."""
    r = spark.read.schema(schema) if schema else spark.read
    return r.json(path, multiLine=True)


def read_log(spark: SparkSession, path: str, schema: T.StructType = EXPERIMENT) -> DataFrame:
    """JSON lines; a missing field is null. A log that does not exist is empty."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_many(df: DataFrame, *paths: str) -> None:
    """One computation, several Parquet copies."""
    df = df.persist()
    try:
        for p in paths:
            df.write.mode("overwrite").parquet(p)
    finally:
        df.unpersist()


def read_matrix(spark: SparkSession, path: str, ids: DataFrame | list, key: str = "doc_id", rows: int = 10_000) -> DataFrame:
    """(key, embedding): a numpy matrix file in a folder that all executors share, with the id of each row; the id is never the position.

    Only the file's head is read here; executors map the file and read ranges of ``rows`` rows. ``ids`` is a frame (row, key)
    with the number of each row, or a list. Every row needs one id and ids must be distinct, else it is an error.
    """
    local = path.removeprefix("file://").removeprefix("file:")
    m = np.load(local, mmap_mode="r")
    n, kind = len(m), "array<double>" if m.dtype == np.float64 else "array<float>"
    if isinstance(ids, list):
        ids = spark.createDataFrame(pd.DataFrame({"row": range(len(ids)), key: ids})) if ids else spark.createDataFrame([], f"row long, {key} long")
    ids = ids.select(F.col("row").cast("long").alias("row"), key)
    seen = ids.agg(F.count("*"), F.countDistinct(key), F.countDistinct("row"), F.min("row"), F.max("row")).first()
    if seen[0] != n or n and (seen[2] != n or seen[3] != 0 or seen[4] != n - 1):
        raise ValueError("as many ids as rows are needed")
    if seen[1] != n:
        raise ValueError("ids must be distinct")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.load(local, mmap_mode="r")
        for b in batches:
            for at in b["at"]:
                part = np.array(m[at : at + rows])
                yield pd.DataFrame({"row": np.arange(at, at + len(part)), "embedding": list(part if part.dtype == np.float64 else part.astype(np.float32))})

    ranges = spark.range(0, max(n, 1), rows).withColumnRenamed("id", "at").where(F.col("at") < n)
    return ranges.repartition(max(1, min(-(-n // rows), 10_000))).mapInPandas(read, f"row long, embedding {kind}").join(ids, "row").select(key, "embedding")


def head(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows in the order of ``key``, the same at every run."""
    return df.orderBy(key).limit(n)


def join_optional(df: DataFrame, other: DataFrame | None, key: str, column: str, default: str = "") -> DataFrame:
    """``df`` with ``column`` of ``other`` if there is such a table with both columns, else with ``default`` in its place."""
    if other is None or not {key, column} <= set(other.columns):
        return df.withColumn(column, F.lit(default))
    one = other.groupBy(key).agg(F.max(F.col(column).cast("string")).alias(column))
    return df.drop(column).join(one, key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def write_chunks(df: DataFrame, path: str, chunk: F.Column) -> None:
    """Partitioned by chunk; writing a chunk again replaces only that one."""
    df.withColumn("chunk_id", chunk).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk_id").parquet(path)


def assemble_chunks(spark: SparkSession, path: str, expected: int) -> DataFrame:
    """All chunks 0..expected-1; a missing one is an error."""
    df = spark.read.parquet(path)
    missing = [r[0] for r in spark.range(expected).select(F.col("id").cast("int").alias("chunk_id")).join(df.select("chunk_id").distinct(), "chunk_id", "left_anti").orderBy("chunk_id").limit(20).collect()]
    if missing:
        raise FileNotFoundError(f"chunks are missing: {missing}")
    return df


def markdown(df: DataFrame, most: int = 1_000) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(most).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows)])


def read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def read_lines(path: str) -> list[dict]:
    """A small local JSON lines file."""
    return [json.loads(x) for x in Path(path).read_text().splitlines() if x.strip()]
