"""Stacking, blending, bagging and the gates on stack columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import FOLD, MODEL, PRED, REPEAT, ROW, TYPE, Y
from ..dist import join_small
from .evaluate import gate_paired, gate_unpaired, nested_score, summarize_scores
from ..session import cut
from .folds import fold_columns, fold_names, seeded_folds
from .gram import CHUNK, Gram, fold_gram, train_medians
from .linear import fit_linear, gram_scores, predict_oof, settled_models, solve

META_ALPHA = 1.0
STACK = {"stack": {"kind": "ridge", "alpha": META_ALPHA}}


def stack(oof: DataFrame, columns: Sequence[str], repeats: int = 1, k: int = 5,
          specs: Mapping[str, Mapping] | None = None) -> DataFrame:
    """Meta-learner model table on prediction columns: held-out fits and the final fit."""
    return fit_linear(oof, columns, specs or STACK, repeats=repeats, k=k)


def stacked_gram(gram: Gram, models: DataFrame, names: Sequence[str]) -> Gram:
    """Gram of the out-of-fold predictions, from the Gram of the features.

    A row of fold ``f`` is predicted by fixed coefficients, so its predictions are
    linear in its features and their moments are ``L' M_f L``: the stack is fitted and
    scored without predicting, or reading, a single row.
    """
    by, names = gram.by, list(names)
    at = [gram.features.index(c) for c in gram.missing]
    shift, p, width = np.array(gram.shift), len(gram.features), gram.width
    keys = [*by, REPEAT, FOLD]

    def project(m: pd.DataFrame, fits: pd.DataFrame) -> pd.DataFrame:
        if m.empty or fits.empty:
            return pd.DataFrame({c: [] for c in [*keys, "chunk", "m"]})
        mat = np.concatenate(m.sort_values("chunk")["m"].tolist()).reshape(width, width)
        fits = fits.set_index(MODEL)
        el = np.zeros((width, 2 + len(names)))
        el[0, 0] = el[1, 1] = 1.0
        for i, n in enumerate(names):
            b, fill = np.asarray(fits.at[n, "coefs"], dtype=float), np.asarray(fits.at[n, "fill"], dtype=float)
            el[0, 2 + i] = fits.at[n, "b0"] + b @ shift[1:] - shift[0]
            el[2:2 + p, 2 + i] = b
            el[2 + p:, 2 + i] = b[at] * (fill[at] - shift[1:][at])
        flat = (el.T @ mat @ el).ravel()
        cut_at = range(0, flat.size, CHUNK)
        return pd.DataFrame({**{c: [m[c].iloc[0]] * len(cut_at) for c in keys}, "chunk": range(len(cut_at)),
                             "m": [flat[s:s + CHUNK] for s in cut_at]})

    held = models.filter((F.col(FOLD) >= 0) & F.col(MODEL).isin(names)).select(*keys, MODEL, "b0", "coefs", "fill")
    table = gram.table.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(project, gram.table.schema)
    return Gram(table, by, [f"pred_{n}" for n in names], [], [gram.shift[0]] * (1 + len(names)))


def stack_linear(df: DataFrame, features: Sequence[str], specs: Mapping[str, Mapping], repeats: int = 1, k: int = 5,
                 metas: Mapping[str, Mapping] | None = None) -> tuple[DataFrame, DataFrame]:
    """Base model table and meta-learner model table from one Gram pass over the rows."""
    folds = fold_names(repeats)
    gram = fold_gram(df, features, TYPE, folds)
    gram.table = cut(gram.table)
    models = settled_models(solve(gram, specs, train_medians(df, gram, folds, k)), len(features))
    meta = solve(stacked_gram(gram, models, list(specs)), metas or STACK)
    return models, settled_models(meta, len(specs))


def stack_scores(oof: DataFrame, columns: Sequence[str], repeats: int = 1, k: int = 5) -> DataFrame:
    return gram_scores(stack(oof, columns, repeats, k))


def nested_stack_score(oof: DataFrame, columns: Sequence[str], repeats: int = 1) -> DataFrame:
    """Pooled R2 of the meta-learner predicted by fits that excluded each row's fold."""
    meta = predict_oof(oof, columns, stack(oof, columns, repeats), ["stack"], repeats)
    return nested_score(meta, "pred_stack")


def select_meta(oof: DataFrame, columns: Sequence[str], repeats: int, candidates: Mapping[str, Mapping],
                default: str) -> DataFrame:
    """Per type: the default meta-learner unless another clears the unpaired gate by more."""
    s = summarize_scores(gram_scores(fit_linear(oof, columns, candidates, repeats=repeats)))
    gates = [gate_unpaired(s, default, c).withColumn("candidate", F.lit(c)) for c in candidates if c != default]
    won = F.max(F.when(F.col("accepted"), F.struct("delta", "candidate")))
    return reduce(DataFrame.unionByName, gates).groupBy(TYPE).agg(
        F.coalesce(won["candidate"], F.lit(default)).alias("meta"))


def mean_over_repeats(long_preds: DataFrame, names: Sequence[str], keys: Sequence[str] = (TYPE, ROW)) -> DataFrame:
    """``keys.., model, pred``: each model's mean over the repeats of a row, for the models that the row has.

    A row's sums of all models are shuffled together, once; what is grouped by ``keys`` next finds them in place.
    """
    own = lambda n: F.col(MODEL) == n
    sums = long_preds.groupBy(*keys).agg(*[x for i, n in enumerate(names) for x in (
        F.avg(F.when(own(n), F.col(PRED))).alias(f"_p{i}"), F.bool_or(own(n)).alias(f"_h{i}"))])
    cells = F.array(*[F.struct(F.lit(n).alias(MODEL), F.col(f"_p{i}").alias(PRED), F.col(f"_h{i}").alias("_has")) for i, n in enumerate(names)])
    return sums.select(*keys, F.explode(cells).alias("_c")).select(*keys, "_c.*").filter("_has").drop("_has")


def blend(long_preds: DataFrame, weights: DataFrame, keys: Sequence[str] = (TYPE, ROW)) -> DataFrame:
    """Weighted sum of the kept models' predictions."""
    return join_small(long_preds, weights.select(TYPE, MODEL, "weight"), [TYPE, MODEL]).groupBy(*keys).agg(
        F.sum(F.col("weight") * F.col(PRED)).alias("blend"))


def blend_wide(df: DataFrame, weights: DataFrame, names: Sequence[str], name: str = "pred_blend") -> DataFrame:
    """The same from ``pred_<model>`` columns, row by row and without a shuffle of rows."""
    w = weights.groupBy(TYPE).pivot(MODEL, list(names)).agg(F.first("weight"))
    w = w.select(TYPE, *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(f"_w_{n}") for n in names])
    total = reduce(lambda a, b: a + b, [F.col(f"_w_{n}") * F.col(f"pred_{n}") for n in names])
    return join_small(df, w, TYPE, "left").withColumn(name, total).drop(*[f"_w_{n}" for n in names])


def row_spread(long_preds: DataFrame, keys: Sequence[str] = (TYPE, ROW)) -> DataFrame:
    """Ensemble mean and ddof-0 disagreement per row of long predictions."""
    return long_preds.groupBy(*keys).agg(F.avg(PRED).alias("mean_pred"), F.stddev_pop(PRED).alias("spread"))


def row_spread_wide(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    xs = F.array(*[F.col(c) for c in cols])
    mean = F.aggregate(xs, F.lit(0.0), lambda a, v: a + v) / len(cols)
    df = df.withColumn("mean_pred", mean)
    dev = reduce(lambda a, b: a + b, [(F.col(c) - F.col("mean_pred")) ** 2 for c in cols])
    return df.withColumn("spread", F.sqrt(dev / len(cols)))


def seed_bag(df: DataFrame, features: Sequence[str], specs: Mapping[str, Mapping], seeds: Sequence[int],
             k: int = 5) -> DataFrame:
    """Out-of-fold predictions averaged over fold seeds, as ``pred_<model>`` next to ``first_<model>``.

    Each seed is one more fold column, so all seeds share a single Gram pass. Rows without a key have no fold and no prediction.
    """
    df = seeded_folds(df, k, seeds)
    models = fit_linear(df, features, specs, repeats=len(seeds), k=k)
    out = predict_oof(df, features, models, list(specs), len(seeds), per_repeat=True)
    return out.withColumns({f"first_{n}": F.col(f"pred_{n}_0") for n in specs}).drop(
        *[f"pred_{n}_{i}" for n in specs for i in range(len(seeds))])


def keep_bag(bagged: DataFrame, name: str) -> DataFrame:
    """Per type: bag only when the pooled R2 improves on the first seed alone."""
    one = nested_score(bagged, f"first_{name}").select(TYPE, F.col("r2").alias("single_r2"))
    many = nested_score(bagged, f"pred_{name}").select(TYPE, F.col("r2").alias("bagged_r2"))
    return one.join(many, TYPE).withColumn("keep", F.col("bagged_r2") > F.col("single_r2"))


def gate_column(oof: DataFrame, columns: Sequence[str], extra: str, k: int = 5) -> DataFrame:
    """Does the stack improve with one more column? Paired over three seeds for every type."""
    oof = fold_columns(oof, k, 3)
    base = stack_scores(oof, columns, 3, k).withColumn(MODEL, F.lit("base"))
    more = stack_scores(oof, [*columns, extra], 3, k).withColumn(MODEL, F.lit("extra"))
    return gate_paired(base.unionByName(more), "base", "extra")


def oof_matrix(df: DataFrame, features: Sequence[str], specs: Mapping[str, Mapping], repeats: int = 1,
               k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rows with one out-of-fold column per model, and the model table behind them."""
    models = fit_linear(df, features, specs, repeats=repeats, k=k)
    return predict_oof(df, features, models, list(specs), repeats), models


def pivot_oof(long_preds: DataFrame, names: Sequence[str], keys: Sequence[str] = (TYPE, ROW)) -> DataFrame:
    """Long predictions to one column per model, averaged over repeats; a pivot would shuffle each model's row, and then the whole again."""
    return long_preds.groupBy(*keys).agg(*[F.avg(F.when(F.col(MODEL) == n, F.col(PRED))).alias(f"pred_{n}") for n in names])
