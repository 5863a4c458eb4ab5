"""Cross-type lookups and the features derived from them; paired-variant features."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import KEY, ROW, TYPE, Y
from ..dist import join_salted
from ..functions.scalars import finite


def cross_lookup(df: DataFrame, types: Sequence[str]) -> DataFrame:
    """Mean target per key, one ``xtarget_<type>`` column per type, in the given order."""
    wide = df.groupBy(KEY).pivot(TYPE, list(types)).agg(F.avg(Y))
    return wide.select(KEY, *[F.col(f"`{t}`").alias(f"xtarget_{t}") for t in types])


def lookup_join(df: DataFrame, wide: DataFrame, key: str = KEY) -> DataFrame:
    """Left lookup; hot keys on the row side are spread over tasks."""
    return join_salted(df, wide, key, "left")


def blank_own(t: str, value: Column) -> Column:
    """Leak guard: a row never sees the lookup value of its own type."""
    return F.when(F.col(TYPE) == t, None).otherwise(value)


def cross_features(df: DataFrame, lookup: DataFrame, types: Sequence[str]) -> DataFrame:
    joined = lookup_join(df, lookup)
    values = {f"xtarget_{t}": blank_own(t, F.col(f"xtarget_{t}")) for t in types}
    known = {f"known_{t}": F.when(v.isNotNull(), 1).otherwise(0) for t, v in zip(types, values.values())}
    return joined.withColumns({**values, **known})


# Ways to derive a feature from cross values; null as soon as one input is null.
DERIVATIONS: dict[str, Callable[..., Column]] = {
    "square": lambda a: a * a,
    "root": lambda a: F.when(a.isNotNull(), F.sqrt(F.greatest(a, F.lit(0.0)))),
    "difference": lambda a, b: a - b,
    "sum": lambda a, b: a + b,
}


def derived_features(df: DataFrame, rules: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """``rules``: new column -> (derivation name, input columns)."""
    return df.withColumns({n: DERIVATIONS[how](*[F.col(c) for c in cols]) for n, (how, cols) in rules.items()})


def key_overlap(train: DataFrame, score: DataFrame) -> DataFrame:
    """Per type: scoring keys seen in training under any type, unseen ones, and the share seen."""
    seen = train.select(KEY).dropna().distinct().withColumn("seen", F.lit(1))
    keys = score.select(TYPE, KEY).dropna().distinct()
    return join_salted(keys, seen, KEY, "left").groupBy(TYPE).agg(
        F.count("seen").alias("n_seen"), F.count_if(F.col("seen").isNull()).alias("n_unseen"),
        (F.count("seen") / F.count(F.lit(1))).alias("seen_rate"))


def unseen_keys(train: DataFrame, score: DataFrame) -> DataFrame:
    """Scoring (type, key) pairs whose key no training row has."""
    keys = score.select(TYPE, KEY).dropna().distinct()
    return join_salted(keys, train.select(KEY).dropna().distinct(), KEY, "left_anti")


def attach(df: DataFrame, preds: DataFrame, on: str = ROW) -> DataFrame:
    """Predictions joined to rows by id, never by position."""
    return df.join(preds, on, "left")


def _paired(base: DataFrame, variant: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    v = variant.select(key, *[F.col(c).alias(f"_v_{c}") for c in cols], F.lit(True).alias("_has"))
    return join_salted(base, v, key, "left")


def delta_features(base: DataFrame, variant: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """``delta_<c>`` = variant - base; null when either is not finite; 0 without a variant row."""
    d = _paired(base, variant, key, cols).withColumns({
        f"delta_{c}": F.when(F.col("_has").isNull(), 0.0).otherwise(finite(F.col(f"_v_{c}")) - finite(F.col(c)))
        for c in cols})
    return d.drop("_has", *[f"_v_{c}" for c in cols])


def ratio_features(base: DataFrame, variant: DataFrame, key: str, cols: Sequence[str],
                   eps: float = 1e-9) -> DataFrame:
    """``ratio_<c>`` = variant / base where the base is not almost zero; null without a variant row."""
    d = _paired(base, variant, key, cols).withColumns({
        f"ratio_{c}": F.when(F.abs(F.col(c)) > eps, finite(F.col(f"_v_{c}")) / finite(F.col(c)))
        for c in cols})
    return d.drop("_has", *[f"_v_{c}" for c in cols])
