"""Row filters, identities, imputation by constants, column policy, sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..columns import ROW, TYPE
from ..dist import join_small, row_number_by_cell
from ..functions.hashing import hash_cell, hash_order
from ..session import cut


def slice_type(df: DataFrame, t: str) -> DataFrame:
    return df.filter(F.col(TYPE) == t)


def semi_types(df: DataFrame, types: Sequence[str]) -> DataFrame:
    return df.filter(F.col(TYPE).isin(list(types)))


def drop_invalid(df: DataFrame, valid: Column, name: str = "drop_invalid") -> tuple[DataFrame, Observation]:
    """Usable rows, and an observation that holds ``total`` and ``dropped`` once they are read."""
    seen = Observation(name)
    ok = F.coalesce(valid, F.lit(False))
    return df.observe(seen, F.count(F.lit(1)).alias("total"),
                      F.count_if(~ok).alias("dropped")).filter(ok), seen


def invalid_report(df: DataFrame, valid: Column) -> DataFrame:
    """Rows kept and dropped per type."""
    ok = F.coalesce(valid, F.lit(False))
    return df.groupBy(TYPE).agg(F.count_if(ok).alias("n_kept"), F.count_if(~ok).alias("n_dropped"))


def with_row_id(df: DataFrame, cols: Sequence[str], name: str = ROW) -> DataFrame:
    """Content-derived row id: a hash of ``cols`` plus a number among equal rows.

    Only for sources without an id of their own. Equal rows differ in nothing but
    their place in the input, so they are numbered by it, partition by partition;
    the numbered input is materialised first, so a recomputed task cannot renumber.
    """
    text = [F.col(c).cast("string") for c in cols]   # length first: no two rows run together, null is not empty
    whole = F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])
    tagged = cut(df.withColumn("_h", F.md5(whole)).withColumn("_part", F.spark_partition_id())
                 .withColumn("_at", F.monotonically_increasing_id()))
    out = row_number_by_cell(tagged, "_h", F.col("_part"), [F.col("_at")], "_rn")
    return out.withColumn(name, F.concat_ws("-", "_h", F.col("_rn").cast("string"))).drop(
        "_h", "_part", "_at", "_rn")


def fill_mean(df: DataFrame, cols: Sequence[str], by: str | None = None) -> DataFrame:
    """Nulls replaced by the column mean, over everything or per ``by``."""
    means = [F.avg(c).alias(f"_m_{c}") for c in cols]
    if by is None:
        row = df.agg(*means).first()
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(row[f"_m_{c}"]).cast("double")) for c in cols})
    out = join_small(df, df.groupBy(by).agg(*means), by, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in cols}).drop(
        *[f"_m_{c}" for c in cols])


def feature_cols(columns: Sequence[str], t: str, policy: Mapping[str, Sequence[str]],
                 optional: Sequence[str]) -> list[str]:
    """Columns for one type: families listed in ``optional`` only when its policy opts in."""
    allowed = set(policy.get(t, ()))
    blocked = tuple(p for p in optional if p not in allowed)
    return [c for c in columns if not c.startswith(blocked)] if blocked else list(columns)


def align(df: DataFrame, keep: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """``keep`` plus exactly ``cols`` in order; absent ones are null."""
    have = set(df.columns)
    return df.select(*keep, *[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in cols])


def one_hot(df: DataFrame, col: str, values: Sequence[str], prefix: str = "is_") -> DataFrame:
    return df.withColumns({f"{prefix}{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in values})


def with_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def sample_n(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` distinct keys in seeded hash order, exact, with no global sort.

    A threshold on the hash, set from the number of keys, leaves little more than ``n`` of them;
    only those are ranked, cell by cell.
    """
    keys = df.select(key).dropna().distinct().withColumn("_h", hash_order(seed, F.col(key)))
    total, share = keys.count(), 0.0
    while True:
        share = min(1.0, max(2 * share, (n + 6 * n ** 0.5 + 10) / max(1, total)))
        near = keys if share == 1.0 else keys.filter(F.col("_h") < f"{int(share * 2 ** 32):08x}")
        found = near.count()
        if found >= min(n, total):
            break
    ranked = row_number_by_cell(near.withColumn("_all", F.lit(1)), "_all", hash_cell(F.col("_h"), found), [F.col("_h"), F.col(key)], "_rn")
    return ranked.filter(F.col("_rn") <= n).select(key)


def sample_fraction(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Keys whose hash falls under a threshold; decided row by row."""
    h = F.conv(F.substring(hash_order(seed, F.col(key)), 1, 8), 16, 10).cast("bigint")
    return df.filter(h < int(fraction * 2 ** 32))


def distinct_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).dropDuplicates()


def top_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group; Spark keeps only ``k`` per group and task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)
