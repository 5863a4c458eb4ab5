"""Fold scores, summaries, and the accept/reject gates built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import FOLD, MODEL, PRED, REPEAT, TYPE, Y

KEYS = [TYPE, MODEL, REPEAT, FOLD]


def r2_rmse(df: DataFrame, keys: Sequence[str], pred: str = PRED) -> DataFrame:
    """``1 - SSE/SST`` about the group's own mean, and RMSE; null R2 for a constant target.

    Rows without a target or a prediction are left out by the sums: a filter would be pushed below what predicts, a lookup of
    coefficients, which the condition then makes anew for every feature of every row.
    """
    err = F.col("_err")
    rows = df.select(*keys, Y, (F.col(Y) - F.col(pred)).alias("_err"))
    sums = rows.groupBy(*keys).agg(F.count(err).alias("n"), F.sum(err * err).alias("_sse"),
                                   F.var_pop(F.when(err.isNotNull(), F.col(Y))).alias("_var")).filter("n > 0")
    return sums.select(*keys, "n", (1 - F.try_divide(F.col("_sse"), F.col("_var") * F.col("n"))).alias("r2"),
                       F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"))


def fold_scores(preds: DataFrame) -> DataFrame:
    """Scores per (type, model, repeat, fold) of long out-of-fold predictions."""
    return r2_rmse(preds, KEYS)


def summarize_scores(scores: DataFrame, keys: Sequence[str] = (TYPE, MODEL)) -> DataFrame:
    """Mean and ddof-0 std over all folds of all repeats."""
    return scores.groupBy(*keys).agg(F.avg("r2").alias("mean_r2"), F.stddev_pop("r2").alias("std_r2"),
                                     F.count("r2").alias("n_folds"))


def mean_r2(summary: DataFrame) -> DataFrame:
    """Headline metric: unweighted mean over types."""
    return summary.groupBy(MODEL).agg(F.avg("mean_r2").alias("mean_r2"))


def gate_unpaired(summary: DataFrame, base: str, candidate: str, key: str = MODEL) -> DataFrame:
    """Accept when the gain in mean exceeds the larger of the two stds."""
    a = summary.filter(F.col(key) == base).select(TYPE, F.col("mean_r2").alias("a_mean"), F.col("std_r2").alias("a_std"))
    b = summary.filter(F.col(key) == candidate).select(TYPE, F.col("mean_r2").alias("b_mean"), F.col("std_r2").alias("b_std"))
    return a.join(b, TYPE).select(
        TYPE, "a_mean", "b_mean", (F.col("b_mean") - F.col("a_mean")).alias("delta"),
        F.greatest("a_std", "b_std").alias("floor")).withColumn("accepted", F.col("delta") > F.col("floor"))


def paired_deltas(scores: DataFrame, base: str, candidate: str, key: str = MODEL) -> DataFrame:
    on = [TYPE, REPEAT, FOLD]
    a = scores.filter(F.col(key) == base).select(*on, F.col("r2").alias("a"))
    b = scores.filter(F.col(key) == candidate).select(*on, F.col("r2").alias("b"))
    return a.join(b, on).withColumn("d", F.col("b") - F.col("a"))


def gate_paired(scores: DataFrame, base: str, candidate: str, key: str = MODEL, floor: str = "std") -> DataFrame:
    """Accept when the mean per-fold gain exceeds the spread of the per-fold gains.

    ``floor='se'`` divides the spread by the square root of the number of folds.
    """
    spread = F.stddev_pop("d") if floor == "std" else F.stddev_pop("d") / F.sqrt(F.count("d"))
    return paired_deltas(scores, base, candidate, key).groupBy(TYPE).agg(
        F.avg("a").alias("a_mean"), F.avg("b").alias("b_mean"), F.avg("d").alias("delta"),
        spread.alias("floor")).withColumn("accepted", F.col("delta") > F.col("floor"))


def evaluate_block(scores: DataFrame, base: str, candidate: str, key: str = MODEL) -> DataFrame:
    """Per-type verdicts on a feature block, plus the pooled mean gain on every row."""
    g = gate_paired(scores, base, candidate, key)
    pooled = g.agg(F.avg("delta").alias("pooled_delta"))
    return g.join(F.broadcast(pooled), F.lit(True))


def ablation(scores: DataFrame, variants: Sequence[str], baseline: str, key: str = MODEL) -> DataFrame:
    """Mean and std per variant side by side, with the variant to keep."""
    s = summarize_scores(scores, (TYPE, key))
    wide = s.groupBy(TYPE).pivot(key, list(variants)).agg(F.first("mean_r2").alias("mean"), F.first("std_r2").alias("std"))
    return wide.join(keep_variant(s, baseline, key), TYPE)


def keep_variant(summary: DataFrame, baseline: str, key: str = MODEL) -> DataFrame:
    """Variant with the largest margin among those clearing the noise floor, else the baseline."""
    base = summary.filter(F.col(key) == baseline).select(TYPE, F.col("mean_r2").alias("_m"), F.col("std_r2").alias("_s"))
    j = summary.join(base, TYPE).withColumn("margin", F.col("mean_r2") - F.col("_m"))
    clears = (F.col(key) != baseline) & (F.col("margin") > F.greatest("std_r2", "_s")) & (F.col("margin") > 0)
    best = F.max(F.when(clears, F.struct("margin", F.col(key).alias("v"))))
    return j.groupBy(TYPE).agg(F.coalesce(best["v"], F.lit(baseline)).alias("keep"),
                               F.coalesce(best["margin"], F.lit(0.0)).alias("margin"))


def rank_models(summary: DataFrame, k: int = 2) -> DataFrame:
    w = Window.partitionBy(TYPE).orderBy(F.desc("mean_r2"), MODEL)
    return summary.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def softmax_weights(summary: DataFrame, k: int = 2, sharpness: float = 5.0) -> DataFrame:
    """Weights of the ``k`` best models of each type from their mean scores."""
    w = Window.partitionBy(TYPE)
    top = rank_models(summary, k).withColumn("_e", F.exp(sharpness * (F.col("mean_r2") - F.max("mean_r2").over(w))))
    return top.withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def best_model(summary: DataFrame, roster: Sequence[str]) -> DataFrame:
    """Highest mean per type; the earlier name in the roster wins a tie."""
    pos = F.array_position(F.array(*[F.lit(m) for m in roster]), F.col(MODEL))
    w = Window.partitionBy(TYPE).orderBy(F.desc("mean_r2"), pos)
    return summary.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def non_dominated(summary: DataFrame, roster: Sequence[str]) -> DataFrame:
    """Models whose gap to the best is within the larger of the two stds."""
    top = best_model(summary, roster).select(TYPE, F.col("mean_r2").alias("_bm"), F.col("std_r2").alias("_bs"))
    return summary.join(top, TYPE).filter(
        F.col("_bm") - F.col("mean_r2") <= F.greatest("_bs", "std_r2")).drop("_bm", "_bs")


def top_features(coefs: DataFrame, n: int = 20, by: str = "coef") -> DataFrame:
    """Leading features by absolute coefficient, or by standardised ``weight``."""
    w = Window.partitionBy(TYPE, MODEL).orderBy(F.desc(F.abs(by)), "feature")
    return coefs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def best_alpha(cv: DataFrame, by: Sequence[str] = (TYPE,)) -> DataFrame:
    """Penalty with the least cross-validated error; the smaller penalty wins a tie."""
    low = F.min(F.struct("rmse", "alpha"))
    return cv.groupBy(*by).agg(low["alpha"].alias("alpha"), low["rmse"].alias("rmse"))


def distinct_masks(selected: DataFrame, candidate: str = "candidate", row: str = "row_id") -> DataFrame:
    """One representative per distinct selection of rows, with the candidates that share it.

    Candidates are compared by an order-free hash and count of the rows they select;
    the list of candidates is a parameter grid, so it stays short.
    """
    h = F.xxhash64(F.col(row).cast("string"))
    per = selected.groupBy(candidate).agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("_x"),
                                          F.sum(F.pmod(h, F.lit(1_000_003))).alias("_s"))
    return per.groupBy("n_rows", "_x", "_s").agg(
        F.min(candidate).alias("representative"), F.count(F.lit(1)).alias("n_same")).drop("_x", "_s")


def nested_score(df: DataFrame, pred: str) -> DataFrame:
    """One R2 per type over all pooled out-of-fold rows."""
    return r2_rmse(df, [TYPE], pred)


def choose_combiner(scores: DataFrame) -> DataFrame:
    """Stack or blend per type, whichever pooled R2 is higher; the blend is kept on a tie."""
    return scores.select(TYPE, F.when(F.col("stack_r2") > F.col("blend_r2"), "stack").otherwise("blend").alias("combiner"),
                         F.greatest("stack_r2", "blend_r2").alias("r2"))
