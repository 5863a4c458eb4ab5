"""Linear models solved from fold Grams, and row-wise scoring with their coefficients."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import FOLD, MODEL, PRED, REPEAT, TYPE, Y
from ..dist import SMALL_ROWS, as_list, join_small, settled
from ..functions.scalars import finite
from .folds import fold_names
from .gram import Gram, Moments, filled, fold_gram, train_medians

CODEGEN_FEATURES = 200
MODEL_NUMBERS = 20_000_000      # most numbers a model table may bring to the driver
FULL = -1

# A model is described by a plain mapping:
#   kind      mean | ridge | nonneg | enet | ridge_cv (folds) | ridge_gcv (leave-one-out, generalised)
#   alpha     penalty; ``alphas`` for ridge_cv and ridge_gcv; ``l1`` share for enet
#   scale     standardise with training statistics first
#   select    keep this many features by univariate F, or "adaptive"
#   only      use these features alone; a list, or a mapping type -> list
Spec = Mapping[str, object]


def univariate_f(s: Moments) -> np.ndarray:
    """``r^2 / (1 - r^2) * (n - 2)`` per feature; constant features score 0."""
    den = s.var * s.syy
    r2 = np.divide(s.cxy ** 2, den, out=np.zeros_like(den), where=den > 0)
    return r2 / np.maximum(1.0 - r2, 1e-15) * (s.n - 2)


def adaptive_k(n: float, p: int) -> int:
    """All features when rows are plenty, else a fifth of the rows, at least 30."""
    return p if n >= p else min(p, max(30, int(n) // 5))


def nonneg_ridge(g: np.ndarray, c: np.ndarray, alpha: float) -> np.ndarray:
    """Minimise ``w'Gw - 2c'w + alpha w'w`` over ``w >= 0`` by active sets."""
    a = g + alpha * np.eye(len(c))
    w, free = np.zeros(len(c)), np.zeros(len(c), dtype=bool)
    tol = 1e-10 * max(1.0, np.abs(c).max(initial=0.0))
    for _ in range(30 * max(1, len(c))):
        grad = c - a @ w
        if free.all() or grad[~free].max() <= tol:
            break
        free[np.argmax(np.where(free, -np.inf, grad))] = True
        while True:
            s = np.zeros(len(c))
            s[free] = np.linalg.solve(a[np.ix_(free, free)], c[free])
            if s[free].min(initial=0.0) >= 0:
                w = s
                break
            neg = free & (s < 0)
            step = np.min(w[neg] / (w[neg] - s[neg]))
            w = w + step * (s - w)
            free &= w > 1e-14
            w[~free] = 0.0
    return w


def elastic_net(g: np.ndarray, c: np.ndarray, n: float, alpha: float, l1: float) -> np.ndarray:
    """Coordinate descent on ``1/(2n)|y-Xw|^2 + alpha l1 |w|_1 + alpha (1-l1)/2 |w|^2``."""
    w, left = np.zeros(len(c)), c.astype(float).copy()   # left: c - g @ w
    diag = np.diag(g)

    def sweep(at: np.ndarray) -> float:
        moved = 0.0
        for j in at:
            rho = (left[j] + diag[j] * w[j]) / n
            new = np.sign(rho) * max(abs(rho) - alpha * l1, 0.0) / (diag[j] / n + alpha * (1 - l1))
            if new != w[j]:
                np.subtract(left, g[j] * (new - w[j]), out=left)
                moved, w[j] = max(moved, abs(new - w[j])), new
        return moved

    for _ in range(200):   # coordinates at zero are looked at once the others have settled
        if sweep(np.arange(len(c))) < 1e-10:
            break
        for _ in range(2000):
            if sweep(np.flatnonzero(w)) < 1e-10:
                break
    return w


def _solve(s: Moments, spec: Spec, alpha: float, allowed: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    p = len(s.cxy)
    b = np.zeros(p)
    live = np.flatnonzero(s.var > 0 if allowed is None else (s.var > 0) & allowed)
    k = spec.get("select")
    if k is not None and len(live):
        keep = adaptive_k(s.n, p) if k == "adaptive" else int(k)
        live = np.sort(live[np.argsort(-univariate_f(s)[live], kind="stable")[:keep]])
    if spec["kind"] != "mean" and len(live):
        d = np.sqrt(s.var[live] / s.n) if spec.get("scale") else np.ones(len(live))
        g = s.cov[np.ix_(live, live)] / np.outer(d, d)
        c = s.cxy[live] / d
        if spec["kind"] == "nonneg":
            w = nonneg_ridge(g, c, alpha)
        elif spec["kind"] == "enet":
            w = elastic_net(g, c, s.n, alpha, float(spec["l1"]))
        else:
            w = np.linalg.lstsq(g, c, rcond=None)[0] if alpha == 0 else np.linalg.solve(
                g + alpha * np.eye(len(live)), c)
        b[live] = w / d
    return s.y_mean - float(s.mean @ b), b


def _gcv_alpha(s: Moments, spec: Spec, allowed: np.ndarray | None) -> float:
    """Penalty with the least generalised cross-validation error ``n SSE / (n - tr H)^2`` of one side."""
    live = np.flatnonzero(s.var > 0 if allowed is None else (s.var > 0) & allowed)
    d = np.sqrt(s.var[live] / max(s.n, 1.0)) if spec.get("scale") else np.ones(len(live))
    eig = np.maximum(np.linalg.eigvalsh(s.cov[np.ix_(live, live)] / np.outer(d, d)), 0.0) if len(live) else np.zeros(0)
    best, least = float(spec["alphas"][0]), np.inf
    for alpha in map(float, spec["alphas"]):
        free = s.n - 1 - float((eig / np.maximum(eig + alpha, 1e-300)).sum())
        err = s.n * s.sse(*_solve(s, spec, alpha, allowed)) / free ** 2 if free > 0 else np.inf
        if err < least:
            best, least = alpha, err
    return best


def _pick_alpha(parts: list[np.ndarray], total: np.ndarray, spec: Spec, allowed: np.ndarray | None) -> float:
    """Penalty with the least mean squared error over the given folds."""
    best, least = None, np.inf
    for alpha in spec["alphas"]:
        err = 0.0
        for v in parts:
            held = Moments(v)
            err += held.sse(*_solve(Moments(total - v), spec, float(alpha), allowed)) / max(held.n, 1.0)
        if err < least:
            best, least = float(alpha), err
    return best


def model_schema(gram: Gram) -> T.StructType:
    arr = T.ArrayType(T.DoubleType())
    return T.StructType([
        *[gram.table.schema[b] for b in gram.by], T.StructField(REPEAT, T.IntegerType()),
        T.StructField(FOLD, T.IntegerType()), T.StructField(MODEL, T.StringType()),
        T.StructField("n_train", T.DoubleType()), T.StructField("alpha", T.DoubleType()),
        T.StructField("b0", T.DoubleType()), T.StructField("coefs", arr), T.StructField("weights", arr),
        T.StructField("fill", arr),
        T.StructField("n_val", T.DoubleType()), T.StructField("val_sse", T.DoubleType()),
        T.StructField("val_sst", T.DoubleType()), T.StructField("train_sse", T.DoubleType())])


def solve(gram: Gram, specs: Mapping[str, Spec], medians: DataFrame | None = None) -> DataFrame:
    """Every model on every training side: one row per (type, repeat, fold, model).

    Fold -1 is the fit on all rows. Validation sums come from the held-out Gram, so
    scoring a candidate needs no pass over rows either.
    """
    p, by, schema = len(gram.features), gram.by, model_schema(gram)
    at = [gram.features.index(c) for c in gram.missing]
    shift = np.array(gram.shift)
    width = gram.width

    features = gram.features

    def allowed(spec: Spec, key: list) -> np.ndarray | None:
        only = spec.get("only")
        if isinstance(only, Mapping):
            only = only.get(key[0])
        return None if only is None else np.isin(features, list(only))

    def fit(pdf: pd.DataFrame, fills: pd.DataFrame | None = None) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in schema.names})
        known = {} if fills is None else {int(f): np.asarray(v, dtype=float) for f, v in zip(fills[FOLD], fills["fill"])}
        pdf = pdf.sort_values([FOLD, "chunk"])
        parts = {int(f): np.concatenate(g["m"].tolist()).reshape(width, width) for f, g in pdf.groupby(FOLD)}
        total = sum(parts.values())
        key, rep = [pdf[b].iloc[0] for b in by], int(pdf[REPEAT].iloc[0])
        rows = []
        for f in ([FULL] if rep == 0 else []) + sorted(parts):
            raw = total if f == FULL else total - parts[f]
            if raw[0, 0] < 0.5:
                continue
            med = known.get(f)
            off = med - shift[1:][at] if med is not None else None
            fill = np.zeros(p)
            fill[:] = shift[1:]
            if med is not None:
                fill[at] = med
            side = filled(raw, p, at, off)
            s = Moments(side)
            inner = [filled(m, p, at, off) for g, m in parts.items() if g != f]
            held = Moments(filled(parts[f], p, at, off)) if f != FULL else None
            for name, spec in specs.items():
                use = allowed(spec, key)
                alpha = (_pick_alpha(inner, side, spec, use) if spec["kind"] == "ridge_cv" else
                         _gcv_alpha(s, spec, use) if spec["kind"] == "ridge_gcv" else float(spec.get("alpha", 0.0)))
                b0, b = _solve(s, spec, alpha, use)
                rows.append([*key, rep, f, name, s.n, alpha, b0 + shift[0] - float(shift[1:] @ b), b.tolist(),
                             (b * np.sqrt(s.var / max(s.n, 1.0))).tolist(), fill.tolist(), held.n if held else None, held.sse(b0, b) if held else None,
                             held.syy if held else None, s.sse(b0, b)])
        return pd.DataFrame(rows, columns=schema.names)

    keys = [*by, REPEAT]
    if medians is None:
        return gram.table.groupBy(*keys).applyInPandas(lambda pdf: fit(pdf), schema)
    return gram.table.groupBy(*keys).cogroup(medians.groupBy(*keys)).applyInPandas(fit, schema)


def settled_models(models: DataFrame, n_features: int) -> DataFrame:
    return settled(models, min(SMALL_ROWS, MODEL_NUMBERS // (3 * n_features + 10)))


def fit_linear(df: DataFrame, features: Sequence[str], specs: Mapping[str, Spec], by=TYPE, repeats: int = 1,
               k: int = 5, target: str = Y, weight: str | None = None) -> DataFrame:
    """Model table from rows that carry ``fold_0 .. fold_{repeats-1}``; medians fill the gaps.

    Computed once: the table has one row per (type, repeat, fold, model).
    """
    folds = fold_names(repeats)
    gram = fold_gram(df, features, by, folds, target, weight)
    return settled_models(solve(gram, specs, train_medians(df, gram, folds, k, target)), len(features))


def dot(model: Column, features: Sequence[str]) -> Column:
    """Intercept plus coefficients times features, with the model's fills for nulls."""
    if len(features) <= CODEGEN_FEATURES:
        out = model["b0"]
        for j, c in enumerate(features):
            out = out + model["coefs"][j] * F.coalesce(finite(F.col(c)), model["fill"][j])
        return out
    xs = F.array(*[finite(F.col(c)) for c in features])
    terms = F.zip_with(F.zip_with(xs, model["fill"], lambda x, f: F.coalesce(x, f)), model["coefs"],
                       lambda x, b: x * b)
    return model["b0"] + F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)


def packed(models: DataFrame, by, names: Sequence[str]) -> DataFrame:
    """One row per type; per model a map (repeat, fold) -> coefficients. Bounded by folds x repeats."""
    value = F.struct("b0", "coefs", "fill")
    entry = F.struct((F.col(REPEAT) * 1000 + F.col(FOLD)).alias("k"), value.alias("v"))
    return models.groupBy(*as_list(by)).agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col(MODEL) == n, entry))).alias(f"_m_{n}") for n in names])


def predict_oof(df: DataFrame, features: Sequence[str], models: DataFrame, names: Sequence[str],
                repeats: int = 1, by=TYPE, per_repeat: bool = False) -> DataFrame:
    """Out-of-fold predictions as ``pred_<model>`` columns, averaged over repeats.

    Every row looks up the coefficients that did not see its fold: no shuffle, no
    join on row ids.
    """
    out = join_small(df, packed(models.filter(F.col(FOLD) != FULL), by, names), by, "left")
    for n in names:
        for r in range(repeats):
            out = out.withColumn("_m", F.try_element_at(f"_m_{n}", F.lit(r * 1000) + F.col(f"fold_{r}")))
            out = out.withColumn(f"pred_{n}_{r}", dot(F.col("_m"), features)).drop("_m")
        each = [F.col(f"pred_{n}_{r}") for r in range(repeats)]
        out = out.withColumn(f"pred_{n}", sum(each[1:], each[0]) / repeats)
    out = out.drop(*[f"_m_{n}" for n in names])
    return out if per_repeat else out.drop(*[f"pred_{n}_{r}" for n in names for r in range(repeats)])


def long_oof(df: DataFrame, names: Sequence[str], repeats: int, keep: Sequence[str]) -> DataFrame:
    """Per-repeat predictions in long form: keep.., repeat, fold, model, pred."""
    cells = [F.struct(F.lit(r).alias(REPEAT), F.col(f"fold_{r}").alias(FOLD), F.lit(n).alias(MODEL),
                      F.col(f"pred_{n}_{r}").alias(PRED)) for n in names for r in range(repeats)]
    return df.select(*keep, F.explode(F.array(*cells)).alias("_c")).select(*keep, "_c.*")


def predict_full(df: DataFrame, features: Sequence[str], models: DataFrame, names: Sequence[str],
                 by: str = TYPE) -> DataFrame:
    """Predictions of the fits on all rows, as ``pred_<model>`` columns."""
    out = join_small(df, packed(models.filter(F.col(FOLD) == FULL), by, names), by, "left")
    for n in names:
        out = out.withColumn("_m", F.try_element_at(f"_m_{n}", F.lit(FULL)))
        out = out.withColumn(f"pred_{n}", dot(F.col("_m"), features)).drop("_m", f"_m_{n}")
    return out


def predict_ensemble(df: DataFrame, features: Sequence[str], models: DataFrame, source: str,
                     names: Sequence[str], by: str = TYPE) -> DataFrame:
    """Rows of any type scored by the mean of ``source``'s fold models."""
    own = models.filter((F.col(by) == source) & (F.col(FOLD) != FULL))
    sets = own.groupBy(by).agg(*[F.collect_list(F.when(F.col(MODEL) == n, F.struct("b0", "coefs", "fill")))
                                 .alias(f"_m_{n}") for n in names]).withColumnRenamed(by, "_src")
    out = join_small(df.withColumn("_src", F.lit(source)), sets, "_src", "left")
    xs = F.array(*[finite(F.col(c)) for c in features])
    for n in names:
        each = F.transform(f"_m_{n}", lambda m: m["b0"] + F.aggregate(
            F.zip_with(F.zip_with(xs, m["fill"], lambda x, f: F.coalesce(x, f)), m["coefs"], lambda x, b: x * b),
            F.lit(0.0), lambda a, v: a + v))
        out = out.withColumn(f"pred_{n}", F.aggregate(each, F.lit(0.0), lambda a, v: a + v) / F.size(f"_m_{n}"))
    return out.drop("_src", *[f"_m_{n}" for n in names])


def coefficients(models: DataFrame, features: Sequence[str], by: str = TYPE) -> DataFrame:
    """Long coefficients of the full fits; ``weight`` is the coefficient of the standardised feature."""
    names = F.array(*[F.lit(f) for f in features])
    return models.filter(F.col(FOLD) == FULL).select(by, MODEL, F.explode(F.arrays_zip(
        names.alias("feature"), F.col("coefs").alias("coef"), F.col("weights").alias("weight"))).alias("z")).select(
        by, MODEL, F.col("z.feature").alias("feature"), F.col("z.coef").alias("coef"), F.col("z.weight").alias("weight"))


def gram_scores(models: DataFrame, by: str = TYPE) -> DataFrame:
    """Fold R2 and RMSE straight from the model table."""
    return models.filter(F.col(FOLD) != FULL).select(
        by, MODEL, REPEAT, FOLD, (1 - F.try_divide("val_sse", "val_sst")).alias("r2"),
        F.sqrt(F.greatest(F.col("val_sse"), F.lit(0.0)) / F.col("n_val")).alias("rmse"))
