"""Duplicate, consistency, distribution and outlier audits of a measurement table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import KEY, TYPE, Y
from ..dist import SMALL_ROWS, exact_quantiles, join_small
from .clean import top_rows


def is_consistent(lo: Column, hi: Column, mean: Column, rel: float = 0.01, abs_: float = 1e-6) -> Column:
    """Values agree when their range is small relative to the mean, or absolutely tiny."""
    return ((hi - lo) / (F.abs(mean) + 1e-9) < rel) | (hi - lo < abs_)


def _per_key(df: DataFrame, coarse: Column | None = None) -> DataFrame:
    """One row per (type, coarse key, exact key): what every duplicate audit starts from."""
    df = df if coarse is None else df.withColumn("coarse", coarse)
    return df.groupBy(TYPE, *([] if coarse is None else ["coarse"]), KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min(Y).alias("lo"), F.max(Y).alias("hi"), F.sum(Y).alias("s"), F.count(Y).alias("ny"))


def _groups(per_key: DataFrame, by: str, at_least: str, rel: float, abs_: float) -> DataFrame:
    g = per_key.groupBy(TYPE, by).agg(
        F.count(F.lit(1)).alias("n_variants"), F.sum("n").alias("n_rows"), F.min("lo").alias("y_min"),
        F.max("hi").alias("y_max"), F.try_divide(F.sum("s"), F.sum("ny")).alias("y_mean")).filter(f"{at_least} > 1")
    return g.withColumn("consistent", is_consistent(F.col("y_min"), F.col("y_max"), F.col("y_mean"), rel, abs_))


def exact_duplicates(df: DataFrame, rel: float = 0.01, abs_: float = 1e-6) -> DataFrame:
    """(type, key) groups of more than one row, with their agreement."""
    return _groups(_per_key(df), KEY, "n_rows", rel, abs_).drop("n_variants")


def near_duplicates(df: DataFrame, coarse: Column, rel: float = 0.01, abs_: float = 1e-6) -> DataFrame:
    """(type, coarse key) groups that span at least two different exact keys.

    Rows are pre-aggregated per exact key, so a hot coarse key costs one row per
    distinct exact key.
    """
    return _groups(_per_key(df, coarse), "coarse", "n_variants", rel, abs_).filter(F.col("coarse").isNotNull())


def duplicate_report(df: DataFrame, coarse: Column) -> DataFrame:
    """Exact and near duplicate counts per type plus a grand total row (type null)."""
    multi, agree = F.col("n") > 1, is_consistent(F.col("lo"), F.col("hi"), F.try_divide("s", "ny"))
    total = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    # a key has one coarse form, so its row already is its exact group
    groups = _per_key(df, coarse).groupBy(TYPE, "coarse").agg(
        F.sum("n").alias("n_rows"), F.count_if(multi).alias("exact_groups"), total(multi).alias("exact_rows"),
        F.count_if(multi & agree).alias("exact_consistent"), F.count_if(multi & ~F.coalesce(agree, F.lit(False))).alias("exact_conflicting"),
        (F.col("coarse").isNotNull() & (F.count(F.lit(1)) > 1)).alias("near"),
        is_consistent(F.min("lo"), F.max("hi"), F.try_divide(F.sum("s"), F.sum("ny"))).alias("agree"))
    near, same = F.col("near"), F.coalesce("agree", F.lit(False))
    exact = ("exact_groups", "exact_rows", "exact_consistent", "exact_conflicting")
    return groups.rollup(TYPE).agg(
        F.sum("n_rows").alias("n"), *[F.sum(c).alias(c) for c in exact], F.count_if(near).alias("near_groups"),
        F.coalesce(F.sum(F.when(near, F.col("n_rows"))), F.lit(0)).alias("near_rows"),
        F.count_if(near & same).alias("near_consistent"), F.count_if(near & ~same).alias("near_conflicting"))


def conflict_examples(df: DataFrame, k: int = 3) -> DataFrame:
    """The values of the first ``k`` conflicting groups per type, one row per distinct value.

    Kept long: an example group may be arbitrarily large.
    """
    bad = exact_duplicates(df).filter(~F.col("consistent")).select(TYPE, KEY)
    first = top_rows(bad, [TYPE], [F.col(KEY)], k, "example")
    return join_small(df, first, [TYPE, KEY]).groupBy(TYPE, KEY, "example", Y).agg(
        F.count(F.lit(1)).alias("n_rows"))


def near_conflict_examples(df: DataFrame, coarse: Column, k: int = 3) -> DataFrame:
    """The variants and values of the first ``k`` conflicting near-duplicate groups per type."""
    bad = near_duplicates(df, coarse).filter(~F.col("consistent")).select(TYPE, "coarse")
    first = top_rows(bad, [TYPE], [F.col("coarse")], k, "example")
    return join_small(df.withColumn("coarse", coarse), first, [TYPE, "coarse"]).groupBy(TYPE, "coarse", "example", KEY, Y).agg(
        F.count(F.lit(1)).alias("n_rows"))


def distribution(df: DataFrame) -> DataFrame:
    """n, min, max, mean, std (ddof 1) and bias-adjusted skew per type."""
    n = F.count(Y)
    adjust = F.sqrt(n * (n - 1.0)) / F.nullif(n - 2.0, F.lit(0.0))
    return df.groupBy(TYPE).agg(
        n.alias("n"), F.min(Y).alias("y_min"), F.max(Y).alias("y_max"), F.avg(Y).alias("y_mean"),
        F.stddev_samp(Y).alias("y_std"), F.when(n > 2, F.skewness(Y) * adjust).alias("y_skew"))


def iqr_fences(df: DataFrame, k: float = 1.5) -> DataFrame:
    q = exact_quantiles(df, TYPE, Y, [0.25, 0.75])
    iqr = F.col("q1") - F.col("q0")
    return q.select(TYPE, (F.col("q0") - k * iqr).alias("fence_lo"), (F.col("q1") + k * iqr).alias("fence_hi"))


def _beyond() -> Column:
    return (F.col(Y) < F.col("fence_lo")) | (F.col(Y) > F.col("fence_hi"))


def iqr_outliers(df: DataFrame, k: float = 1.5) -> DataFrame:
    return join_small(df.select(TYPE, Y), iqr_fences(df, k), TYPE).groupBy(TYPE).agg(
        F.first("fence_lo").alias("fence_lo"), F.first("fence_hi").alias("fence_hi"),
        F.count_if(_beyond()).alias("n_outliers"),
        (F.count_if(_beyond()) * 100.0 / F.count(Y)).alias("pct_outliers"))


def extremes(df: DataFrame, k: int = 3) -> DataFrame:
    """Up to ``k`` lowest and ``k`` highest outlier values per type, distinct."""
    out = join_small(df.select(TYPE, Y), iqr_fences(df), TYPE).filter(_beyond()).select(TYPE, Y)
    low = top_rows(out, [TYPE], [F.col(Y)], k, "r")
    high = top_rows(out, [TYPE], [F.col(Y).desc()], k, "r")
    return low.drop("r").union(high.drop("r")).distinct()


def group_sizes(df: DataFrame) -> DataFrame:
    """How many (type, key) groups have each size."""
    return (df.groupBy(TYPE, KEY).agg(F.count(F.lit(1)).alias("size"))
            .groupBy(TYPE, "size").agg(F.count(F.lit(1)).alias("n_groups")))


def target_stats(df: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Mean and ddof-0 std per type; a vanishing std counts as 1."""
    sd = F.stddev_pop(Y)
    return df.groupBy(TYPE).agg(F.avg(Y).alias("y_mean"),
                                F.when(sd <= eps, 1.0).otherwise(sd).alias("y_std"))


def standardize_target(df: DataFrame) -> DataFrame:
    return join_small(df, target_stats(df), TYPE).withColumn(
        "y_z", (F.col(Y) - F.col("y_mean")) / F.col("y_std"))


def target_means(df: DataFrame) -> DataFrame:
    return df.groupBy(TYPE).agg(F.avg(Y).alias("y_mean"))


def clip_bounds(df: DataFrame, frac: float = 0.10, floors: Mapping[str, float] | None = None) -> DataFrame:
    """Training range widened by a margin; some types have a hard lower bound."""
    margin = frac * (F.max(Y) - F.min(Y))
    b = df.groupBy(TYPE).agg((F.min(Y) - margin).alias("clip_lo"), (F.max(Y) + margin).alias("clip_hi"))
    for t, floor in (floors or {}).items():
        b = b.withColumn("clip_lo", F.when(F.col(TYPE) == t, F.greatest("clip_lo", F.lit(float(floor))))
                         .otherwise(F.col("clip_lo")))
    return b


def cross_coverage(df: DataFrame) -> DataFrame:
    """How many keys are measured under exactly ``n_types`` types, and their rows."""
    per = df.groupBy(KEY, TYPE).agg(F.count(F.lit(1)).alias("n")).groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_types"), F.sum("n").alias("n"))
    return per.groupBy("n_types").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows"))


def flag_rates(df: DataFrame, split: str, values: list[str], flag: str) -> DataFrame:
    """Mean of a 0/1 flag by type, one column per split."""
    return df.groupBy(TYPE).pivot(split, values).agg(F.avg(F.col(flag).cast("double"))).select(
        TYPE, *[F.col(v).alias(f"rate_{v}") for v in values])


def clip_counts(df: DataFrame, pred: str, bounds: DataFrame) -> DataFrame:
    p = F.col(pred)
    return join_small(df.select(TYPE, pred), bounds, TYPE).groupBy(TYPE).agg(
        F.count_if(p < F.col("clip_lo")).alias("n_below"), F.count_if(p > F.col("clip_hi")).alias("n_above"))


def percentile_threshold(df: DataFrame, by, value: str, p: float) -> DataFrame:
    return exact_quantiles(df, by, value, [p]).withColumnRenamed("q0", "threshold")
