"""Counts, shares, crosstabs, bands, lookups, deduplication and samples as DataFrame operators.

Contingencies are kept long, (row, col, n); pivots are left to the sink. Empty inputs give no
rows; nulls form a group of their own unless said otherwise; a division by zero gives null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.session import stage


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def counts(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias(name))


def shares(df: DataFrame, by: str, digits: int = 4) -> DataFrame:
    """(by, n, pct): counts with the percentage of all rows, which are counted as one row and joined."""
    total = df.agg(F.count("*").alias("__total"))
    return counts(df, by).crossJoin(F.broadcast(total)).select(by, "n", F.round(100.0 * F.col("n") / F.col("__total"), digits).alias("pct"))


def crosstab(df: DataFrame, row: str, col: str, norm: str | None = None, digits: int = 4) -> DataFrame:
    """(row, col, n) or with ``norm`` 'row' or 'col' also pct within it."""
    got = counts(df, row, col)
    if not norm:
        return got
    total = F.sum("n").over(Window.partitionBy(row if norm == "row" else col))
    return got.withColumn("pct", F.round(100.0 * F.col("n") / total, digits))


def pivot_counts(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """A column for each of ``values``, 0 where there is none."""
    return df.groupBy(row).pivot(col, list(values)).count().na.fill(0)


def share_of(cond: Column, digits: int = 4) -> Column:
    """Percentage of rows for which ``cond`` holds; null counts as no."""
    return F.round(100.0 * F.avg(F.when(cond, 1.0).otherwise(0.0)), digits)


def lookup(df: DataFrame, dim: DataFrame, key: str, values: Mapping[str, object]) -> DataFrame:
    """Joins the columns in ``values`` from a fixed, small dimension; its defaults where the key is unknown."""
    got = df.join(F.broadcast(dim.select(key, *values)), key, "left")
    for c, default in values.items():
        if default is not None:
            got = got.withColumn(c, F.coalesce(c, F.lit(default)))
    return got


def in_order(got: DataFrame, key: str, domain: Sequence[str]) -> DataFrame:
    """One row for each member of an ordered domain, with its ordinal; absent ones have nulls."""
    spark = got.sparkSession
    dim = spark.createDataFrame(list(enumerate(domain)), f"ordinal int, {key} string")
    return F.broadcast(dim).join(got, key, "left")


def confidence_bucket(c: Column) -> Column:
    """high from 0.8, medium from 0.5, low to 0.2, else borderline; null is borderline."""
    return F.when(c >= 0.8, "high").when(c >= 0.5, "medium").when(c <= 0.2, "low").otherwise("borderline")


def text_fallback(df: DataFrame, columns: Sequence[str], parts: Sequence[str] = ()) -> Column:
    """The first of the columns at hand that isn't blank, else the ``parts`` joined by spaces, else ''."""
    got = [F.nullif(F.trim(c), F.lit("")) for c in columns if c in df.columns]
    have = [F.col(c) for c in parts if c in df.columns]
    if have:
        got.append(F.nullif(F.trim(F.concat_ws(" ", *have)), F.lit("")))
    return F.coalesce(*got, F.lit(""))


def keep_existing(df: DataFrame, want: Sequence[str], blank: Sequence[str] = ()) -> DataFrame:
    """The wanted columns that exist; those in ``blank`` are made up as '' if absent."""
    for c in blank:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    return df.select(*[c for c in (*want, *blank) if c in df.columns])


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")


def ranked(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def rank_in_groups(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], name: str = "rank", parts: int | None = None) -> DataFrame:
    """``df`` with each row's place in its group, from 0, in a total order of (column, descending).

    Rows are cut by ranges of keys and order, so a group that holds a third of all rows lies in many
    tasks; counts of the cuts before give each cut its first place. For the first few rows of a group
    ``first_by`` does, as it limits groups before the shuffle.
    """
    by = [F.desc(c) if down else F.asc(c) for c, down in order]
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stage(df.repartitionByRange(parts, *[F.asc(k) for k in keys], *by).withColumn("__cut", F.spark_partition_id()), "rank")
    n = cut.groupBy(*keys, "__cut").agg(F.count("*").alias("__n"))  # a few rows for each group
    before = Window.partitionBy(*keys).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)
    n = n.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__cut").alias("__c"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"), F.sum("__n").over(Window.partitionBy(*keys)).alias("__size"))
    same = F.col("__cut") == F.col("__c")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__cut").orderBy(*by)) - 1
    got = cut.withColumn("__i", inside).join(n, same)
    return got.withColumn(name, F.col("__first") + F.col("__i")).withColumn(f"{name}_of", F.col("__size")).drop("__cut", "__c", "__first", "__i", "__size", *[f"__k{i}" for i in range(len(keys))])


def cumulative_share(df: DataFrame, n: str, key: str, digits: int = 6) -> DataFrame:
    """(key, n, rank, share): running share of the groups from the largest on; meant for aggregated rows."""
    w = Window.orderBy(F.desc(n), key)
    run, total = F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum(n).over(Window.partitionBy())
    return df.select(key, n, F.row_number().over(w).alias("rank"), F.round(run / total, digits).alias("cum_share"))


def z_scores(df: DataFrame, signs: Mapping[str, int], name: str = "composite", digits: int = 4) -> DataFrame:
    """The mean of signed z scores; 0 for a metric that does not vary. Meant for aggregated rows."""
    w = Window.partitionBy()
    total = F.lit(0.0)
    for c, s in signs.items():
        sd = F.stddev_pop(c).over(w)
        total = total + F.lit(float(s)) * F.when(sd > 1e-9, (F.col(c) - F.avg(c).over(w)) / sd).otherwise(0.0)
    return df.withColumn(name, F.round(total / len(signs), digits))


def min_max(c: str) -> Column:
    """To 0..1 over all rows; 0.5 if all are equal."""
    w = Window.partitionBy()
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.5)


def draw(key: str, seed: int = 42) -> Column:
    """A reproducible order of rows: a hash of key and seed, then the key."""
    return F.struct(F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed)))), F.col(key))


def sample_per_group(df: DataFrame, keys: Sequence[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows of each group, at random but reproducibly."""
    return first_by(df, keys, [draw(key, seed)], n)


def stratified_sample(df: DataFrame, keys: Sequence[str], key: str, n: int, total: int, seed: int = 42) -> DataFrame:
    """``n`` of each stratum, topped up from the rest to ``total``; strata in all hold no more than ``total``."""
    first = sample_per_group(df, keys, key, n, seed).withColumn("part", F.lit(0))
    rest = df.join(first.select(key), key, "left_anti").withColumn("part", F.lit(1))
    both = first.unionByName(rest).withColumn("__d", draw(key, seed))
    return both.orderBy("part", "__d").limit(total).drop("__d")


def proportional_sample(df: DataFrame, group: str, key: str, per: int = 100, most: int = 3, seed: int = 42) -> DataFrame:
    """From each group one row for every ``per``, at least 1 and at most ``most``."""
    quota = counts(df, group, name="__n").withColumn("__q", F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("__n") / per))))
    got = ranked(first_by(df, [group], [draw(key, seed)], most), [draw(key, seed)], [group], "__r").join(quota, group)
    return got.where(F.col("__r") <= F.col("__q")).drop("__r", "__q", "__n")


def fixed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(draw(key, seed)).limit(n)


def histogram_json(df: DataFrame, by: str, value: str, top: int = 10) -> DataFrame:
    """(by, histogram): counts of the ``top`` values as a JSON object, most frequent first."""
    n = first_by(counts(df, by, value), [by], [F.desc("n"), F.col(value)], top)
    rows = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v"), "n"))), lambda x: F.struct(x["v"].alias("key"), x["n"].alias("value")))
    return n.where(F.col(value).isNotNull()).groupBy(by).agg(F.to_json(F.map_from_entries(rows)).alias("histogram"))


def resume(config: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Configurations not yet in the log."""
    return config.join(done.select(key).distinct(), key, "left_anti")


def sanity_gate(df: DataFrame, topics: str, outliers: str, least: int = 6, most: float = 0.70) -> DataFrame:
    """Adds valid and the reason for which a result is rejected, null if none."""
    few, loose = F.col(topics) < least, F.col(outliers) > most
    reason = F.when(few, F.concat(F.lit("too few topics: "), F.col(topics).cast("string"))).when(loose, F.concat(F.lit("too many outliers: "), F.format_string("%.2f", outliers)))
    return df.withColumn("reason", reason).withColumn("valid", reason.isNull())


def length_batches(df: DataFrame, key: str, length: str, size: int = 64) -> DataFrame:
    """(key, batch): rows in order of length, cut into batches of ``size``; the key restores their order. Ranges of lengths are numbered in parallel."""
    got = rank_in_groups(df.select(key, length).withColumn("__g", F.lit(0)), ["__g"], [(length, False), (key, False)], "__place")
    return got.select(key, F.floor(F.col("__place") / size).cast("long").alias("batch"))


def join_metrics(frames: Mapping[str, DataFrame], model: str) -> DataFrame:
    """One row for each model that every family of metrics has; columns are called family_metric. Models are few."""
    out: DataFrame | None = None
    for name, f in frames.items():
        f = f.select(model, *[F.col(c).alias(f"{name}_{c}") for c in f.columns if c != model])
        out = f if out is None else out.join(f, model)
    return out


def weighted_score(df: DataFrame, weights: Mapping[str, float], lower_is_better: Sequence[str] = (), name: str = "weighted_score", digits: int = 6) -> DataFrame:
    """Adds the weighted sum of min-max scaled metrics; metrics of which less is better are turned round. Meant for aggregated rows."""
    total = F.lit(0.0)
    for c, w in weights.items():
        total = total + F.lit(float(w)) * (1 - min_max(c) if c in lower_is_better else min_max(c))
    return df.withColumn(name, F.round(total, digits))
