"""Group-aware cross-validation folds, their reports and the leak check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import FOLD, KEY, REPEAT, ROW, TYPE
from ..dist import join_salted, join_small, row_number_by_cell, tile
from ..functions.hashing import hash_cell, hash_fold, hash_order
from ..session import cut

SEED = 42


def group_kfold(df: DataFrame, k: int = 5, seed: int = SEED, mode: str = "hash",
                key: str = KEY, name: str = FOLD) -> DataFrame:
    """All rows of a key share a fold; rows without a key get a null fold, so they are on no side.

    ``hash`` needs no shuffle and balances folds in expectation; ``balanced`` deals
    the keys of each type into folds whose key counts differ by at most one.
    """
    if mode == "hash":
        return df.withColumn(name, _fold(seed, key, k))
    if mode != "balanced":
        raise ValueError(f"unknown mode {mode!r}")
    return join_salted(df, balanced_key_folds(df, k, seed, key).withColumnRenamed(FOLD, name), [TYPE, key], "left")


def _fold(seed: int, key: str, k: int) -> Column:
    return F.when(F.col(key).isNotNull(), hash_fold(seed, F.col(key), k))


def balanced_key_folds(df: DataFrame, k: int = 5, seed: int = SEED, key: str = KEY) -> DataFrame:
    keys = cut(df.select(TYPE, key).dropna().distinct()).withColumn("_h", hash_order(seed, F.col(key)))
    ranked = row_number_by_cell(keys, TYPE, hash_cell(F.col("_h"), keys.count()), [F.col("_h"), F.col(key)], "_rn", "_tot")
    return ranked.select(TYPE, key, tile(F.col("_rn"), F.col("_tot"), k).alias(FOLD))


def row_kfold(df: DataFrame, k: int = 5, seed: int = SEED, name: str = FOLD) -> DataFrame:
    """Ungrouped folds: duplicates of a key may land on both sides."""
    return group_kfold(df, k, seed, key=ROW, name=name)


def fold_columns(df: DataFrame, k: int = 5, repeats: int = 3, seed: int = SEED,
                 key: str = KEY) -> DataFrame:
    """Wide form: ``fold_0 .. fold_{repeats-1}``, one seed each, without multiplying rows; null without a key."""
    return seeded_folds(df, k, range(seed, seed + repeats), key)


def seeded_folds(df: DataFrame, k: int, seeds: Sequence[int], key: str = KEY) -> DataFrame:
    """The same for given seeds."""
    return df.withColumns({f"fold_{i}": _fold(s, key, k) for i, s in enumerate(seeds)})


def fold_names(repeats: int) -> list[str]:
    return [f"fold_{r}" for r in range(repeats)]


def long_folds(df: DataFrame, repeats: int) -> DataFrame:
    """One row per (row, repeat) from the wide form."""
    pairs = F.array(*[F.struct(F.lit(r).alias(REPEAT), F.col(f"fold_{r}").alias(FOLD)) for r in range(repeats)])
    return df.withColumn("_rf", F.explode(pairs)).select(
        *[c for c in df.columns if c not in fold_names(repeats)], "_rf.*")


def repeat_policy(df: DataFrame, small_rows: int, small: int = 3, large: int = 1) -> DataFrame:
    """Repeats per type: small types are split ``small`` times, large ones ``large`` times."""
    return df.groupBy(TYPE).agg(F.count(F.lit(1)).alias("n")).select(
        TYPE, F.when(F.col("n") <= small_rows, small).otherwise(large).alias("repeats"))


def repeated_folds(df: DataFrame, policy: DataFrame, k: int = 5, seed: int = SEED) -> DataFrame:
    """Long folds with seeds ``seed + repeat`` and as many repeats as the policy gives the type."""
    most = 3 if (m := policy.agg(F.max("repeats")).first()[0]) is None else m
    wide = fold_columns(join_small(df, policy, TYPE), k, most, seed)
    return long_folds(wide, most).filter(F.col(REPEAT) < F.col("repeats")).drop("repeats")


def search_folds(df: DataFrame, seed: int = SEED) -> DataFrame:
    """Cheap split for searching only: three folds, one repeat."""
    return long_folds(fold_columns(df, 3, 1, seed), 1)


def paired_folds(df: DataFrame, k: int = 5, seed: int = SEED) -> DataFrame:
    """Split for paired comparisons: three seeds for every type."""
    return long_folds(fold_columns(df, k, 3, seed), 3)


def fold_report(folds: DataFrame) -> DataFrame:
    """Training and validation row counts per type, repeat and fold."""
    n = folds.filter(F.col(FOLD).isNotNull()).groupBy(TYPE, REPEAT, FOLD).agg(F.count(F.lit(1)).alias("n_val"))
    whole = n.groupBy(TYPE, REPEAT).agg(F.sum("n_val").alias("_all"))
    return n.join(whole, [TYPE, REPEAT]).select(
        TYPE, REPEAT, FOLD, (F.col("_all") - F.col("n_val")).alias("n_train"), "n_val")


def leak_check(folds: DataFrame, key: str = KEY, repeats: Sequence[int] | None = None) -> DataFrame:
    """Keys that appear in more than one fold, per type and repeat; zero everywhere is clean.

    A task holds one row a key, whatever the number of repeats. ``repeats`` names all of them; without it they are looked up first.
    """
    known = folds.filter(F.col(FOLD).isNotNull())
    if repeats is None:
        repeats = sorted(r[0] for r in known.select(REPEAT).distinct().collect())   # one row a repeat
    if not repeats:
        return known.groupBy(TYPE, REPEAT).agg(F.count(F.lit(1)).alias("n_keys"), F.count(F.lit(1)).alias("n_shared"))
    own = [F.when(F.col(REPEAT) == r, F.col(FOLD)) for r in repeats]
    per = known.groupBy(TYPE, key).agg(*[x for i, f in enumerate(own) for x in (F.min(f).alias(f"lo{i}"), F.max(f).alias(f"hi{i}"))])
    sums = per.groupBy(TYPE).agg(*[x for i in range(len(repeats)) for x in (
        F.count(f"lo{i}").alias(f"n{i}"), F.count_if(F.col(f"lo{i}") < F.col(f"hi{i}")).alias(f"s{i}"))])
    cells = F.array(*[F.struct(F.lit(r).cast(known.schema[REPEAT].dataType).alias(REPEAT), F.col(f"n{i}").alias("n_keys"),
                               F.col(f"s{i}").alias("n_shared")) for i, r in enumerate(repeats)])
    return sums.select(TYPE, F.explode(cells).alias("_c")).select(TYPE, "_c.*").filter("n_keys > 0")
