"""The text records that the problems on posts and annotated comments share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.session import table

#: Texts that hold nothing, trimmed and in lower case.
EMPTY_TEXTS = ("", "[removed]", "[deleted]")


def has_content(text: F.Column) -> F.Column:
    """False for null, blank, ``[removed]`` and ``[deleted]`` texts."""
    return text.isNotNull() & ~F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", "")).isin(*EMPTY_TEXTS)


def posts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(src, rec_id, text, *more) of the posts; repeated rows of one id are not removed."""
    p = table(spark, sf_dir, "posts_merged_final_preprocessed")
    return p.select(F.lit("post").alias("src"), F.col("id").alias("rec_id"), F.col("full_text").alias("text"), *more)


def comments(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """(src, rec_id, text, *more) of the annotated comments."""
    c = table(spark, sf_dir, "comments_interaction_annotation")
    return c.select(F.lit("comment").alias("src"), F.col("comment_id").alias("rec_id"), F.col("body").alias("text"), *more)


def records(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Both kinds of record that hold a text. A null key is kept out."""
    both = posts(spark, sf_dir, *more).unionByName(comments(spark, sf_dir, *more))
    return both.where(F.col("rec_id").isNotNull() & has_content(F.col("text")))
