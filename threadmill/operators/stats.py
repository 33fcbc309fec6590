"""Association, agreement, rank and spread statistics over long contingencies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.operators.relational import counts, crosstab, ratio
from threadmill.session import stage


def two_columns(df: DataFrame, a: str, b: str) -> tuple[DataFrame, str, str]:
    """Only the two columns, by names that clash with nothing, rows with a null left out."""
    return df.select(F.col(a).alias("__a"), F.col(b).alias("__b")).where("__a is not null and __b is not null"), "__a", "__b"


def chi_square(df: DataFrame, row: str, col: str, digits: int = 4) -> DataFrame:
    """(n, chi2, dof, cramers_v) of two columns, rows with a null left out; absent cells count as 0."""
    df, row, col = two_columns(df, row, col)
    n = crosstab(df, row, col)
    r, c = n.groupBy(row).agg(F.sum("n").alias("r")), n.groupBy(col).agg(F.sum("n").alias("c"))
    total = n.agg(F.sum("n").alias("total"), F.countDistinct(row).alias("rows"), F.countDistinct(col).alias("cols"))
    cells = F.broadcast(r).crossJoin(F.broadcast(c)).crossJoin(F.broadcast(total)).join(n, [row, col], "left")  # the margins only
    expected = F.col("r") * F.col("c") / F.col("total")
    got = cells.agg(F.sum((F.coalesce("n", F.lit(0)) - expected) ** 2 / expected).alias("chi2"), F.first("total").alias("n"), F.first("rows").alias("rows"), F.first("cols").alias("cols"))
    least = F.least("rows", "cols") - 1
    return got.select("n", F.round("chi2", digits).alias("chi2"), ((F.col("rows") - 1) * (F.col("cols") - 1)).alias("dof"), F.round(F.sqrt(ratio(F.col("chi2"), F.col("n") * least)), digits).alias("cramers_v"))


def chi_square_tail(x: Column, dof: Column) -> Column:
    """P(X > x) of the chi-square distribution; Spark has no incomplete gamma function. Null for null, 1 without freedom."""
    import math

    def upper(x: float, k: float) -> float:
        a, y = k / 2, x / 2
        if y <= 0 or k <= 0:
            return 1.0
        log_front = a * math.log(y) - y - math.lgamma(a)
        if y < a + 1:  # the series of the lower function
            term = total = 1 / a
            n = 0
            while abs(term) > 1e-16 * abs(total) and n < 100_000:
                n += 1
                term *= y / (a + n)
                total += term
            return max(0.0, 1 - total * math.exp(log_front))
        c = 1e300  # the continued fraction of the upper one, by Lentz
        b, d = y + 1 - a, 1 / (y + 1 - a)
        h = d
        for i in range(1, 100_000):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b)
            c = b + an / c
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return h * math.exp(log_front)

    @F.pandas_udf("double")
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) else upper(float(a), float(b)) for a, b in zip(x, k, strict=True)], dtype="float64")

    return tail(x, dof)


def relative_rate(df: DataFrame, category: str, subset: Column, digits: int = 4) -> DataFrame:
    """(category, n, n_subset, relative_rate): the share in the subset over the share in all."""
    got = df.groupBy(category).agg(F.count("*").alias("n"), F.count_if(subset).alias("n_subset"))
    w = Window.partitionBy()
    inside = ratio(F.col("n_subset"), F.sum("n_subset").over(w))
    return got.select(category, "n", "n_subset", F.round(ratio(inside, F.col("n") / F.sum("n").over(w)), digits).alias("relative_rate"))


def coverage(df: DataFrame, group: str, flags: dict[str, Column], digits: int = 4) -> DataFrame:
    """Percentage of groups with a row of each kind."""
    per = df.groupBy(group).agg(*[F.max(F.when(c, 1).otherwise(0)).alias(k) for k, c in flags.items()])
    return per.agg(F.count("*").alias("n_groups"), *[F.round(100.0 * F.avg(k), digits).alias(f"{k}_pct") for k in flags])


def mann_whitney(df: DataFrame, value: str, first: Column, digits: int = 4) -> DataFrame:
    """(n1, n2, u, z): U of the rows of ``first`` against the others, z with tie correction; rows with a null left out.

    Ranks come from counts of equal values, so only distinct values are ordered in one task.
    """
    per = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("x")).agg(F.count_if(first).alias("a"), F.count("*").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = per.withColumn("rank", before + (F.col("t") + 1) / 2)
    s = r.agg(F.sum("a").cast("double").alias("n1"), F.sum(F.col("t") - F.col("a")).cast("double").alias("n2"), F.sum(F.col("a") * F.col("rank")).alias("r1"), F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties"))
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - ratio(F.col("ties"), n * (n - 1))))
    return s.select(F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), F.round(u, digits).alias("u"), F.round(ratio(u - F.col("n1") * F.col("n2") / 2, sd), digits).alias("z"))


def normal_tail(z: Column) -> Column:
    """P(Z > z); Spark has no error function."""
    import math

    @F.pandas_udf("double")
    def tail(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if pd.isna(x) else 0.5 * math.erfc(x / math.sqrt(2)))

    return tail(z)


def kappa(df: DataFrame, a: str, b: str, digits: int = 6) -> DataFrame:
    """(n, agreement, kappa) of two labels, rows with a null left out."""
    df, a, b = two_columns(df, a, b)
    n = crosstab(df, a, b)
    both = n.select(F.col(a).alias("label"), F.col("n").alias("x"), F.lit(0).alias("y")).unionByName(n.select(F.col(b).alias("label"), F.lit(0).alias("x"), F.col("n").alias("y")))
    chance = both.groupBy("label").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("pe"))
    seen = n.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("same"))
    got = seen.crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("pe") / (F.col("n").cast("double") * F.col("n"))
    return got.select("n", F.round(po, digits).alias("agreement"), F.round(ratio(po - pe, 1 - pe), digits).alias("kappa"))


def per_class(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(label, tp, n_guess, n_truth) for every label of either column."""
    df, truth, guess = two_columns(df, truth, guess)
    n = crosstab(df, truth, guess)
    t = n.groupBy(F.col(truth).alias("label")).agg(F.sum("n").alias("n_truth"), F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)).alias("tp"))
    g = n.groupBy(F.col(guess).alias("label")).agg(F.sum("n").alias("n_guess"))
    return t.join(g, "label", "full_outer").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "n_guess", "n_truth")])


def macro_prf(df: DataFrame, truth: str, guess: str, digits: int = 6) -> DataFrame:
    """(labels, precision, recall, f1): unweighted means over all labels, 0 for 0/0."""
    p, r = F.coalesce(ratio(F.col("tp"), F.col("n_guess")), F.lit(0.0)), F.coalesce(ratio(F.col("tp"), F.col("n_truth")), F.lit(0.0))
    f = F.coalesce(ratio(2.0 * F.col("tp"), F.col("n_guess") + F.col("n_truth")), F.lit(0.0))
    return per_class(df, truth, guess).agg(F.count("*").alias("labels"), *[F.round(F.avg(x), digits).alias(k) for k, x in (("precision", p), ("recall", r), ("f1", f))])


def adjusted_rand(df: DataFrame, a: str, b: str, noise: int | None = None, least: int = 0, digits: int = 6) -> DataFrame:
    """(n, ari) of two labelings; with ``noise`` rows with that label on either side are left out; 0 below ``least`` rows."""
    df, a, b = two_columns(df, a, b)
    if noise is not None:
        df = df.where((F.col(a) != noise) & (F.col(b) != noise))
    pairs = lambda c: F.sum(F.col(c).cast("double") * (F.col(c) - 1) / 2)
    n = crosstab(df, a, b)
    cells = n.agg(pairs("n").alias("ij"), F.sum("n").alias("total"))
    row = n.groupBy(a).agg(F.sum("n").alias("m")).agg(pairs("m").alias("i"))
    col = n.groupBy(b).agg(F.sum("n").alias("m")).agg(pairs("m").alias("j"))
    got = cells.crossJoin(row).crossJoin(col)  # one row each
    total = F.col("total").cast("double") * (F.col("total") - 1) / 2
    chance = ratio(F.col("i") * F.col("j"), total)
    value = ratio(F.col("ij") - chance, (F.col("i") + F.col("j")) / 2 - chance)
    return got.select(F.col("total").alias("n"), F.round(F.when(F.col("total") < least, 0.0).otherwise(value), digits).alias("ari"))


def size_spread(df: DataFrame, by: str, digits: int = 6) -> DataFrame:
    """(k, entropy, entropy_ln, gini, top3_share, cv_pct) of group sizes; top3_share is 1 below three groups."""
    n = counts(df.select(F.col(by).alias("__a")), "__a")
    by = "__a"
    w = Window.partitionBy()
    k, total = F.count("*").over(w), F.sum("n").over(w)
    cum = F.sum("n").over(Window.orderBy("n", by).rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(Window.orderBy(F.desc("n"), by))
    rows = n.select("n", k.alias("k"), total.alias("total"), cum.alias("cum"), place.alias("place"))
    p = F.col("n") / F.col("total")
    got = rows.agg(
        F.first("k").alias("k"), F.sum(-p * F.log2(p + 1e-12)).alias("h2"), F.sum(-p * F.ln(p)).alias("h"), F.sum("cum").alias("cums"), F.first("total").alias("total"),
        F.sum(F.when(F.col("place") <= 3, p).otherwise(0.0)).alias("top3"), F.stddev_pop("n").alias("sd"), F.avg("n").alias("mean"),
    )
    gini = (F.col("k") + 1 - 2.0 * F.col("cums") / F.col("total")) / F.col("k")
    return got.where("k > 0").select("k", *[F.round(x, digits).alias(c) for c, x in {
        "entropy": F.when(F.col("k") > 1, F.col("h2") / F.log2(F.col("k").cast("double"))).otherwise(0.0), "entropy_ln": F.when(F.col("k") > 1, F.col("h") / F.ln(F.col("k").cast("double"))).otherwise(0.0), "gini": gini,
        "top3_share": F.when(F.col("k") < 3, 1.0).otherwise(F.col("top3")), "cv_pct": 100 * F.col("sd") / F.col("mean"),
    }.items()])


def bootstrap_ci(df: DataFrame, value: str, times: int = 1000, seed: int = 42, digits: int = 6, block: int = 100_000) -> DataFrame:
    """(mean, low, high): 95 % interval of the mean by resampling with replacement; nulls are left out, without rows all are null.

    Rows lie in blocks of about ``block``, ten thousand blocks at most. How many draws of each resample fall on each block is
    multinomial, as are the draws within a block, so together they are draws from all rows. A block gives ``times`` sums.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.monotonically_increasing_id().alias("i"))
    rows = stage(rows, "boot")
    n = rows.count()
    blocks = max(1, min(10_000, -(-n // block)))
    rows = rows.select("v", F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int").alias("p"))
    sizes = np.zeros(blocks, np.int64)
    for r in rows.groupBy("p").count().collect():  # ten thousand rows at most
        sizes[r["p"]] = r["count"]

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        x, p = pdf["v"].to_numpy(float), int(pdf["p"].iat[0])
        share = np.random.default_rng(seed).multinomial(n, sizes / n, times)[:, p]  # the same in every task
        rng = np.random.default_rng([seed, p])
        return pd.DataFrame({"i": range(times), "s": [x[rng.integers(0, len(x), k)].sum() for k in share]})

    means = rows.groupBy("p").applyInPandas(resample, "i int, s double").groupBy("i").agg((F.sum("s") / F.lit(float(max(1, n)))).alias("m"))
    ends = means.agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return rows.agg(F.avg("v").alias("mean")).crossJoin(ends).select(*[F.round(c, digits).alias(c) for c in ("mean", "low", "high")])  # one row each
