"""Fold Gram matrices: one data pass that serves pruning, scaling, selection and linear fits.

For each (type, repeat, fold) the moments ``Z'WZ`` of ``Z = [1, y, x.., missing flags]``
are summed. Training statistics of a fold are the total minus that fold, so no row is
read again per fold, model or penalty. Partials leave the tasks as chunks of at most
``CHUNK`` numbers and are summed in the JVM with map-side combining; a hot type is
summed where its rows are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import FOLD, REPEAT, Y
from ..dist import as_list, join_small, order_statistics, settled
from ..functions.scalars import finite
from ..session import cut

CHUNK = 4096
FLUSH_BYTES = 256 << 20


@dataclass
class Gram:
    table: DataFrame            # by.., repeat, fold, chunk, m
    by: list[str]
    features: list[str]
    missing: list[str]          # features that have nulls; their flags follow the features
    shift: list[float]          # subtracted from [y, *features] before the products

    @property
    def width(self) -> int:
        return 2 + len(self.features) + len(self.missing)


def column_means(df: DataFrame, cols: Sequence[str], known: str | None = None) -> tuple[list[float], list[str]]:
    """Means of the columns and the names of those with nulls, in one aggregate; over the rows where ``known`` is not null."""
    of = (lambda x: x) if known is None else (lambda x: F.when(F.col(known).isNotNull(), x))
    row = df.agg(F.count(of(F.lit(1))).alias("_n"), *[F.avg(of(F.col(c))).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.count(of(F.col(c))).alias(f"c{i}") for i, c in enumerate(cols)]).first()
    means = [row[f"m{i}"] or 0.0 for i in range(len(cols))]
    return means, [c for i, c in enumerate(cols) if row[f"c{i}"] < row["_n"]]


def fold_gram(df: DataFrame, features: Sequence[str], by, folds: Sequence[str], target: str = Y,
              weight: str | None = None, like: Gram | None = None) -> Gram:
    """Moments of labelled rows with a key; NaN and infinite features count as missing. ``folds`` names one fold column per repeat.

    ``like`` reuses another Gram's layout, so that the two can be added.
    """
    by, features = as_list(by), list(features)
    # rows without a fold or a finite target are left out inside the tasks: a filter would be pushed below what computes
    # both, often a hash, and compute it again
    df = df.select(*by, *folds, finite(F.col(target)).alias(target), *[finite(F.col(c)).alias(c) for c in features if c != target],
                   *([F.col(weight).cast("double").alias(weight)] if weight else []))
    if like is None:
        means, gaps = column_means(df.drop(*folds), [target, *features], target)
        missing = [c for c in features if c in gaps]
    else:
        means, missing = like.shift, like.missing
    at = [features.index(c) for c in missing]
    shift = np.array(means)
    width, n_by = 2 + len(features) + len(missing), len(by)

    def partials(batches):
        acc: dict[tuple, np.ndarray] = {}

        def emit():
            for key, m in acc.items():
                flat = m.ravel()
                yield pd.DataFrame({
                    **{b: [key[i]] * -(-flat.size // CHUNK) for i, b in enumerate(by)},
                    REPEAT: key[n_by], FOLD: key[n_by + 1], "chunk": range(-(-flat.size // CHUNK)),
                    "m": [flat[s:s + CHUNK] for s in range(0, flat.size, CHUNK)]})

        for pdf in batches:
            pdf = pdf[pdf[target].notna() & pdf[list(folds)].notna().all(axis=1)].reset_index(drop=True)
            if pdf.empty:
                continue
            x = pdf[features].to_numpy(dtype=float) - shift[1:]
            gap = np.isnan(x)
            z = np.column_stack([np.ones(len(pdf)), pdf[target].to_numpy(dtype=float) - shift[0],
                                 np.where(gap, 0.0, x), gap[:, at].astype(float)])
            w = pdf[weight].to_numpy(dtype=float)[:, None] if weight else None
            ids = [pdf[f].to_numpy() for f in folds]
            for key, idx in pdf.groupby(by, sort=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                for r, f in enumerate(ids):
                    for v in np.unique(f[idx]):
                        take = idx[f[idx] == v]
                        s = z[take]
                        m = s.T @ (s if w is None else s * w[take])
                        slot = (*key, r, int(v))
                        acc[slot] = acc[slot] + m if slot in acc else m
            if len(acc) * width * width * 8 > FLUSH_BYTES:
                yield from emit()
                acc.clear()
        yield from emit()

    schema = T.StructType([*[df.schema[b] for b in by], T.StructField(REPEAT, T.IntegerType()),
                           T.StructField(FOLD, T.IntegerType()), T.StructField("chunk", T.IntegerType()),
                           T.StructField("m", T.ArrayType(T.DoubleType()))])
    table = df.mapInPandas(partials, schema).groupBy(*by, REPEAT, FOLD, "chunk").agg(
        vector_to_array(Summarizer.sum(array_to_vector("m"))).alias("m"))
    return Gram(table, by, features, missing, [float(v) for v in shift])


def train_medians(df: DataFrame, gram: Gram, folds: Sequence[str], k: int, target: str = Y) -> DataFrame | None:
    """Exact training-side medians: ``by.., repeat, fold, fill``, one list a side over the features with gaps; None without such.

    Fold -1 of repeat 0 is the median over all rows. Only features with nulls are read.
    All sides of a type have their medians close together, so only rows in a narrow
    bracket around the type's median are copied to the sides; exact counts below the
    bracket give the rank wanted inside it. If a rank falls outside, the bracket widens. Ranks and
    medians stay tables, however many there are.
    """
    if not gram.missing:
        return None
    by, side = gram.by, [*gram.by, REPEAT, FOLD, "j"]
    cols = {j: finite(F.col(c)) for j, c in enumerate(gram.missing)}
    rows = df.filter(F.col(folds[0]).isNotNull() & finite(F.col(target)).isNotNull()).select(*by, *folds, *[c.alias(f"_x{j}") for j, c in cols.items()])
    for half in (0.02, 0.15, None):
        if half is None:
            held = rows.withColumns({f"_b{j}": F.array(F.lit(float("-inf")), F.lit(float("inf"))) for j in cols})
        else:
            probs = F.array(F.lit(0.5 - half), F.lit(0.5 + half))
            held = join_small(rows, rows.groupBy(*by).agg(
                *[F.percentile_approx(f"_x{j}", probs, 10_000).alias(f"_b{j}") for j in cols]), by)
        ranks = settled(_side_ranks(held, by, folds, list(cols), k))
        if half is None or ranks.filter("not ok").isEmpty():
            break
    sides = F.array(*[F.struct(F.lit(r).alias(REPEAT), F.lit(f).alias(FOLD))
                      for r in range(len(folds)) for f in [-1, *range(k)] if f >= 0 or r == 0])
    own = F.coalesce(*[F.when(F.col("s")[REPEAT] == r, F.col(c)) for r, c in enumerate(folds)])
    near = F.filter(F.array(*[
        F.when((F.col(f"_x{j}") >= F.col(f"_b{j}")[0]) & (F.col(f"_x{j}") <= F.col(f"_b{j}")[1]),
               F.struct(F.lit(j).alias("j"), F.col(f"_x{j}").alias("x"))) for j in cols]), lambda v: v.isNotNull())
    long = (held.select(*by, *folds, F.explode(near).alias("v")).withColumn("s", F.explode(sides))
            .filter(own != F.col("s")[FOLD])
            .select(*by, F.col("s")[REPEAT].alias(REPEAT), F.col("s")[FOLD].alias(FOLD), "v.*"))
    found = order_statistics(long, side, "x", ranks.filter("n > 0").select(*side, F.col("rank").alias("_rank")))
    each = F.map_from_entries(F.collect_list(F.struct("j", "_q")))   # one entry a feature
    fill = F.array(*[F.coalesce(F.try_element_at("_m", F.lit(j)), F.lit(0.0)) for j in cols])
    return cut(found.groupBy(*by, REPEAT, FOLD).agg(each.alias("_m")).select(*by, REPEAT, FOLD, fill.alias("fill")))


def _side_ranks(held: DataFrame, by: list[str], folds: Sequence[str], js: list[int], k: int) -> DataFrame:
    """Per training side and feature: rows ``n``, wanted rank inside the bracket, and whether it lies there (``ok``)."""
    pairs = F.array(*[F.struct(F.lit(r).alias(REPEAT), F.col(c).cast("int").alias(FOLD)) for r, c in enumerate(folds)])
    x, lo, hi = (lambda j: F.col(f"_x{j}")), (lambda j: F.col(f"_b{j}")[0]), (lambda j: F.col(f"_b{j}")[1])
    counts = held.withColumn("_rf", F.explode(pairs)).groupBy(
        *by, F.col("_rf")[REPEAT].alias(REPEAT), F.col("_rf")[FOLD].alias(FOLD)).agg(*[F.struct(
            F.lit(j).alias("j"), F.count(x(j)).alias("n"), F.count_if(x(j) < lo(j)).alias("below"),
            F.count_if((x(j) >= lo(j)) & (x(j) <= hi(j))).alias("inside")).alias(f"_c{j}") for j in js])
    long = settled(counts.select(*by, REPEAT, FOLD, F.explode(F.array(*[f"_c{j}" for j in js])).alias("v")).select(*by, REPEAT, FOLD, "v.*"))
    sums = ["n", "below", "inside"]
    total = long.groupBy(*by, REPEAT, "j").agg(*[F.sum(c).alias(f"{c}_all") for c in sums])
    every = total.withColumn(FOLD, F.explode(F.when(F.col(REPEAT) == 0, F.sequence(F.lit(-1), F.lit(k - 1))).otherwise(F.sequence(F.lit(0), F.lit(k - 1)))))
    # a held-out fold is taken off; types may be null, and then still meet
    a, b = every.alias("a"), long.alias("b")
    same = F.lit(True)
    for c in [*by, REPEAT, FOLD, "j"]:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    left = a.join(b, same, "left").select(*[f"a.{c}" for c in [*by, REPEAT, FOLD, "j"]], *[
        (F.col(f"a.{c}_all") - F.coalesce(F.col(f"b.{c}"), F.lit(0))).alias(c) for c in sums])
    return left.withColumn("rank", (F.col("n") - 1) / 2 - F.col("below")).withColumn(
        "ok", (F.col("n") == 0) | ((F.col("rank") >= 0) & (F.ceil("rank") <= F.col("inside") - 1)))


@dataclass
class Moments:
    """Weighted sums of ``[1, y, x..]`` on one side of a split, missing values filled."""
    m: np.ndarray

    def __post_init__(self) -> None:
        self.n = self.m[0, 0]
        n = max(self.n, 1e-300)
        self.y_mean = self.m[0, 1] / n
        self.mean = self.m[0, 2:] / n
        self.cov = self.m[2:, 2:] - n * np.outer(self.mean, self.mean)      # sums, not averages
        self.cxy = self.m[1, 2:] - n * self.mean * self.y_mean
        self.syy = self.m[1, 1] - n * self.y_mean ** 2
        floor = 1e-12 * np.maximum(np.diag(self.m)[2:], 1.0)
        self.var = np.where(np.diag(self.cov) > floor, np.diag(self.cov), 0.0)

    def sse(self, b0: float, b: np.ndarray) -> float:
        c = np.concatenate([[b0, -1.0], b])
        return float(c @ self.m @ c)


def filled(m: np.ndarray, p: int, at: Sequence[int], fill: np.ndarray | None) -> np.ndarray:
    """Moments with each missing value replaced by its column's fill."""
    if fill is None or not len(at):
        return m[:2 + p, :2 + p]
    a = np.zeros((m.shape[0], 2 + p))
    a[:2 + p] = np.eye(2 + p)
    for j, col in enumerate(at):
        a[2 + p + j, 2 + col] = fill[j]
    return a.T @ m @ a
