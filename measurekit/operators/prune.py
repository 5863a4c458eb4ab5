"""Feature pruning, imputation and scaling fitted on one side and applied to another."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dist import exact_quantiles, join_small
from ..functions.scalars import finite
from .gram import CHUNK, column_means

VAR_FLOOR = 1e-6
CORR_CEIL = 0.98
BLOCK = 32                  # columns of a side of a tile
PASS_BYTES = 256 << 20      # tiles that a task holds


def feature_variances(df: DataFrame, cols: Sequence[str], ddof: int = 1) -> DataFrame:
    """``(feature, variance)`` over the non-null values, all columns in one aggregate."""
    fn = F.var_samp if ddof == 1 else F.var_pop
    row = df.agg(*[fn(finite(F.col(c))).alias(c) for c in cols])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("variance")) for c in cols])).alias("v")).select("v.*")


def variance_prune(df: DataFrame, cols: Sequence[str], floor: float = VAR_FLOOR, ddof: int = 1,
                   keep_all_if_none: bool = False) -> list[str]:
    """Columns whose variance exceeds the floor, in input order."""
    got = {r["feature"]: r["variance"] for r in feature_variances(df, cols, ddof).collect()}
    kept = [c for c in cols if got[c] is not None and got[c] > floor]
    return list(cols) if not kept and keep_all_if_none else kept


def correlations(df: DataFrame, cols: Sequence[str], block: int = BLOCK, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """``(pos_i, pos_j, i, j, r)`` with ``i`` before ``j`` in column order, over pairwise complete rows.

    Columns are cut into blocks; a tile is the cross products of two blocks. With ``Z`` the shifted values (0 where
    missing), ``P`` the presence mask and ``Q = Z*Z``, six products of a tile hold every sum its pairs need. Tiles are
    summed by key with map-side combining and judged where they are. A pass holds at most ``pass_bytes`` of tiles in a
    task, so many columns take several passes.
    """
    cols = list(cols)
    df = df.select(*[finite(F.col(c)).alias(c) for c in cols])
    means, _ = column_means(df, cols)
    shift, p = np.array(means), len(cols)
    edges = [(s, min(p, s + block)) for s in range(0, p, block)]
    tiles = [(a, b) for b in range(len(edges)) for a in range(b + 1)]
    each = max(1, int(pass_bytes // (6 * 8 * block * block)))

    def partials(own: list[tuple[int, int]]):
        def rows(batches):
            acc: dict[tuple[int, int], np.ndarray] = {}
            for pdf in batches:
                x = pdf.to_numpy(dtype=float) - shift
                has = ~np.isnan(x)
                z, m = np.where(has, x, 0.0), has.astype(float)
                q = z * z
                for a, b in own:
                    i, j = slice(*edges[a]), slice(*edges[b])
                    t = np.stack([z[:, i].T @ z[:, j], z[:, i].T @ m[:, j], m[:, i].T @ z[:, j], q[:, i].T @ m[:, j], m[:, i].T @ q[:, j], m[:, i].T @ m[:, j]])
                    acc[a, b] = acc[a, b] + t if (a, b) in acc else t
            for (a, b), t in acc.items():
                flat = t.ravel()
                yield pd.DataFrame({"a": a, "b": b, "chunk": range(-(-flat.size // CHUNK)), "m": [flat[s:s + CHUNK] for s in range(0, flat.size, CHUNK)]})
        return rows

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        (i0, i1), (j0, j1) = edges[a], edges[b]
        zz, zm, mz, qm, mq, mm = np.concatenate(pdf.sort_values("chunk")["m"].tolist()).reshape(6, i1 - i0, j1 - j0)
        with np.errstate(divide="ignore", invalid="ignore"):
            cov = zz - zm * mz / mm
            den = np.sqrt((qm - zm ** 2 / mm) * (mq - mz ** 2 / mm))
            r = np.where(den > 1e-12 * np.maximum(np.sqrt(qm * mq), 1e-300), cov / den, np.nan)
        i, j = np.nonzero(np.arange(i0, i1)[:, None] < np.arange(j0, j1)[None, :])
        v = r[i, j]
        return pd.DataFrame({"pos_i": i + i0, "pos_j": j + j0, "i": np.array(cols)[i + i0], "j": np.array(cols)[j + j0],
                             "r": pd.Series(v).astype(object).where(~np.isnan(v), None)})

    summed = None
    for s in range(0, len(tiles), each):
        part = df.mapInPandas(partials(tiles[s:s + each]), "a int, b int, chunk int, m array<double>")
        summed = part if summed is None else summed.unionAll(part)
    whole = summed.groupBy("a", "b", "chunk").agg(vector_to_array(Summarizer.sum(array_to_vector("m"))).alias("m"))
    return whole.groupBy("a", "b").applyInPandas(pairs, "pos_i int, pos_j int, i string, j string, r double")


def correlation_drops(df: DataFrame, cols: Sequence[str], ceil: float = CORR_CEIL) -> DataFrame:
    """Features with an earlier feature above the ceiling, whether or not that one is dropped too."""
    return correlations(df, cols).filter(F.abs("r") > ceil).select(F.col("j").alias("feature")).distinct()


def correlation_prune(df: DataFrame, cols: Sequence[str], ceil: float = CORR_CEIL) -> list[str]:
    gone = {r["feature"] for r in correlation_drops(df, cols, ceil).collect()}
    return [c for c in cols if c not in gone]


def prune(df: DataFrame, cols: Sequence[str], floor: float = VAR_FLOOR, ceil: float = CORR_CEIL) -> list[str]:
    """Variance first, then correlation among the survivors."""
    return correlation_prune(df, variance_prune(df, cols, floor), ceil)


def prune_pooled(df: DataFrame, ref: DataFrame, cols: Sequence[str]) -> list[str]:
    """Prune the columns common to both on their union; the others pass through."""
    common = [c for c in cols if c in ref.columns]
    kept = set(prune(df.select(*common).unionByName(ref.select(*common)), common))
    return [c for c in cols if c in kept or c not in common]


def common_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Features kept by two fits, as the intersection of their ``(feature)`` tables."""
    return a.select("feature").intersect(b.select("feature"))


def medians(df: DataFrame, cols: Sequence[str], by: str | None = None) -> DataFrame:
    """``(by, feature, median)``, exact at any size."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), finite(F.col(c)).alias("x")) for c in cols])
    keys = [by] if by else []
    long = df.select(*keys, F.explode(cells).alias("v")).select(*keys, "v.*")
    return exact_quantiles(long, [*keys, "feature"], "x", [0.5]).withColumnRenamed("q0", "median")


def impute_median(train: DataFrame, df: DataFrame, cols: Sequence[str], by: str | None = None) -> DataFrame:
    """Nulls of ``df`` filled with the medians of ``train``."""
    med = medians(train, cols, by)
    if by is None:
        got = {r["feature"]: r["median"] for r in med.collect()}
        return df.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(got.get(c)).cast("double")) for c in cols})
    wide = med.groupBy(by).pivot("feature", list(cols)).agg(F.first("median"))
    wide = wide.select(by, *[F.col(f"`{c}`").alias(f"_med_{c}") for c in cols])
    out = join_small(df, wide, by, "left")
    return out.withColumns({c: F.coalesce(finite(F.col(c)), F.col(f"_med_{c}")) for c in cols}).drop(
        *[f"_med_{c}" for c in cols])


def scale_stats(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and ddof-0 std per column; a zero std counts as 1."""
    row = train.agg(*[F.avg(finite(F.col(c))).alias(f"m_{c}") for c in cols],
                    *[F.stddev_pop(finite(F.col(c))).alias(f"s_{c}") for c in cols]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in cols}


def standardize(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    st = scale_stats(train, cols)
    return df.withColumns({c: (finite(F.col(c)) - F.lit(st[c][0])) / F.lit(st[c][1]) for c in cols if st[c][0] is not None})


def pooled_scaler(train: DataFrame, ref: DataFrame, cols: Sequence[str]):
    """Imputer and scaler fitted once on train and corpus together; apply to anything."""
    pool = train.select(*cols).unionByName(ref.select(*cols))
    med = {r["feature"]: r["median"] for r in medians(pool, cols).collect()}
    fill = lambda d: d.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(med.get(c)).cast("double")) for c in cols})
    st = scale_stats(fill(pool), cols)
    return lambda d: fill(d).withColumns({c: (F.col(c) - F.lit(st[c][0])) / F.lit(st[c][1]) for c in cols})


def constant_in_training(df: DataFrame, cols: Sequence[str], by: str, fold: str) -> DataFrame:
    """``(by, fold, feature)`` of columns constant on the training side of that fold only or more."""
    per = df.groupBy(by, fold).agg(*[F.min(c).alias(f"lo_{c}") for c in cols],
                                   *[F.max(c).alias(f"hi_{c}") for c in cols])
    own = per.select(by, fold)
    other = per.withColumnRenamed(fold, "_g")
    side = own.join(other, by).filter(F.col(fold) != F.col("_g")).groupBy(by, fold).agg(*[
        F.coalesce(F.min(f"lo_{c}") == F.max(f"hi_{c}"), F.lit(True)).alias(c) for c in cols])
    cells = F.array(*[F.when(F.col(c), F.lit(c)) for c in cols])
    return side.select(by, fold, F.explode(F.filter(cells, lambda v: v.isNotNull())).alias("feature"))


def univariate_scores(df: DataFrame, cols: Sequence[str], target: str, by: str) -> DataFrame:
    """``(by, feature, r2, f)``: squared correlation with the target and its F statistic."""
    n = F.count(target)
    agg = df.groupBy(by).agg(n.alias("n"), *[F.corr(finite(F.col(c)), finite(F.col(target))).alias(c) for c in cols])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), (F.col(c) * F.col(c)).alias("r2")) for c in cols])
    return agg.select(by, "n", F.explode(cells).alias("v")).select(
        by, "v.*", (F.col("v.r2") / F.nullif(1 - F.col("v.r2"), F.lit(0.0)) * (F.col("n") - 2)).alias("f"))
