"""Skew-safe building blocks shared by the operators.

Nothing here hands an unbounded group to one task: small sides are measured before
they are broadcast, hot join keys are salted by their counts, ranks are taken inside cells and
shifted by cell offsets, and quantiles of large groups are found by narrowing a
bracket with map-side-combined aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut

SMALL_ROWS = 50_000        # most rows a side may have to be broadcast
ROWS_PER_TASK = 5_000_000  # a key with more rows is hot and spread over several tasks
EXACT_GROUP_ROWS = 1_000_000


def as_list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def small_local(df: DataFrame, bound: int = SMALL_ROWS) -> DataFrame | None:
    """``df`` as a local relation if it has at most ``bound`` rows, else None."""
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner",
               bound: int = SMALL_ROWS) -> DataFrame:
    """Join to a side expected to be small: broadcast once measured, salted otherwise."""
    local = small_local(right, bound)
    if local is not None:
        return left.join(F.broadcast(local), as_list(on), how)
    return join_salted(left, right, on, how)


def hot_keys(df: DataFrame, on, rows: int = ROWS_PER_TASK) -> DataFrame | None:
    """Keys with more rows than a task should hold, and ``_salts``, the tasks they need; None when there are none.

    There are at most (rows of ``df`` / ``rows``) of them. Every count is combined in the tasks first.
    """
    on = as_list(on)
    known = df.select(*on).dropna()
    if known.count() <= rows:
        return None
    return _hot(known, on, rows)


def _hot(known: DataFrame, on: list[str], rows: int) -> DataFrame | None:
    counted = known.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows)
    hot = settled(counted.select(*on, F.ceil(F.col("_n") / rows).alias("_salts")))
    return None if hot.isEmpty() else hot


def join_salted(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = ROWS_PER_TASK) -> DataFrame:
    """Equi-join whose hot left keys are spread over as many tasks as their count needs.

    The salt is a hash of the row, not a random number, so a recomputed task sends each row to
    the same place. Right rows are copied for hot keys only. In a left or anti join rows without a key
    match nothing and are spread too.
    """
    on = as_list(on)
    keyless = F.lit(False)
    for c in on:
        keyless = keyless | F.col(c).isNull()
    known, nulls = left.select(*on).agg(F.count_if(~keyless), F.count_if(keyless)).first()
    nulls = nulls if how in ("left", "left_anti") else 0
    hot = _hot(left.select(*on).dropna(), on, rows) if known > rows else None
    if hot is None and nulls <= rows:
        return left.join(right, on, how)
    hot = left.select(*on, F.lit(1).cast("long").alias("_salts")).limit(0) if hot is None else hot
    plain = [F.col(f"`{f.name}`") for f in left.schema.fields if f.dataType.typeName() != "map"]
    salts = F.when(keyless, F.lit(max(1, -(-nulls // rows)))).otherwise(F.coalesce("_salts", F.lit(1)))
    lhs = (join_measured(left.withColumn("_row", F.xxhash64(*plain)), hot, on)
           .withColumn("_salt", F.pmod(F.col("_row"), salts)).drop("_row", "_salts"))
    rhs = (join_measured(right, hot, on)
           .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts"))
    return lhs.join(rhs, [*on, "_salt"], how).drop("_salt")


def join_measured(df: DataFrame, flags: DataFrame, on: list[str]) -> DataFrame:
    """Left join to a short table of keys: broadcast when it is counted to be short."""
    local = small_local(flags)
    return df.join(flags if local is None else F.broadcast(local), on, "left")


def row_number_by_cell(df: DataFrame, by, cell: Column, order: Sequence[Column],
                       name: str = "rn", total: str | None = None) -> DataFrame:
    """``row_number() over (partition by by order by cell, *order)`` without one task per group.

    ``cell`` must be non-decreasing in the wanted order. Rows are numbered inside
    their cell, then shifted by the number of rows in earlier cells.
    """
    by = as_list(by)
    celled = df.withColumn("_cell", cell)
    counts = celled.groupBy(*by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_n").over(Window.partitionBy(*by)))
    inside = Window.partitionBy(*by, "_cell").orderBy(*order)
    return (celled.join(offsets.drop("_n"), [*by, "_cell"])
            .withColumn(name, F.row_number().over(inside) + F.col("_off"))
            .drop("_cell", "_off"))


def tile(rn: Column, n: Column, k: int) -> Column:
    """0-based ``ntile(k)`` from a row number and the group size."""
    q, r = F.floor(n / k), n % k
    head = r * (q + 1)
    return F.when(rn <= head, F.floor((rn - 1) / (q + 1))).otherwise(
        r + F.floor((rn - 1 - head) / F.greatest(q, F.lit(1)))).cast("int")


def settled(df: DataFrame, bound: int = SMALL_ROWS) -> DataFrame:
    """``df`` computed once: a local relation when small, a reliable checkpoint otherwise."""
    local = small_local(df, bound)
    return cut(df) if local is None else local


def exact_quantiles(df: DataFrame, by, value: str, probs: Sequence[float],
                    group_rows: int = EXACT_GROUP_ROWS) -> DataFrame:
    """Linear-interpolated quantiles ``q0, q1, ...`` per group, exact at any group size.

    Groups of up to ``group_rows`` rows use the built-in exact aggregate. Larger ones,
    which would need every distinct value in one task, are narrowed first. What gives the
    values is computed once, however many rounds that takes.
    """
    by = as_list(by)
    known = cut(df.select(*by, value).filter(F.col(value).isNotNull()))
    sizes = settled(known.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")))
    hot = sizes.filter(F.col("_n") > group_rows)
    if hot.isEmpty():
        return _builtin_quantiles(known, by, value, probs)
    flagged = join_small(known, hot, by, "left")
    rest = _builtin_quantiles(flagged.filter(F.col("_n").isNull()).drop("_n"), by, value, probs)
    wide = reduce(
        lambda a, b: a.join(b, by),
        [order_statistics(flagged.filter(F.col("_n").isNotNull()).drop("_n"), by, value,
                          hot.select(*by, ((F.col("_n") - 1) * p).alias("_rank")), group_rows)
         .withColumnRenamed("_q", f"q{i}") for i, p in enumerate(probs)])
    return rest.unionByName(wide)


def _builtin_quantiles(df, by, value, probs):
    return df.groupBy(*by).agg(*[
        F.percentile(value, F.lit(float(p))).alias(f"q{i}") for i, p in enumerate(probs)])


def order_statistics(rows: DataFrame, by: list[str], value: str, ranks: DataFrame,
                     group_rows: int = EXACT_GROUP_ROWS) -> DataFrame:
    """``_q``: the value at the 0-based, possibly fractional rank ``_rank`` of each group of ``ranks``.

    Groups above ``group_rows`` are closed in on first. Each round takes approximate
    quantiles of the current bracket to propose a tighter one and counts exactly what
    lies below it; a proposal that misses the rank is refused, so approximation affects
    speed only. Every round is an aggregate combined on the map side: no round shuffles
    the rows.
    """
    x = F.col(value)
    state = settled(rows.groupBy(*by).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_in")).join(ranks, by).select(
        *by, "_lo", "_hi", F.lit(0).cast("long").alias("_below"), "_in", "_rank"))
    inside = (x >= F.col("_lo")) & (x <= F.col("_hi"))
    left = None
    while True:   # every round shrinks some bracket, or is the last
        wide = state.filter((F.col("_in") > group_rows) & (F.col("_lo") < F.col("_hi")))
        now = tuple(wide.agg(F.count(F.lit(1)), F.sum("_in")).first())
        if now[0] == 0 or now == left:
            break
        left = now
        held = join_small(rows, wide, by).filter(inside)
        at = (F.col("_rank") - F.col("_below")) / F.col("_in")
        cuts = held.groupBy(*by).agg(
            F.percentile_approx(value, [i / 200 for i in range(201)], 10_000).alias("_c"), F.first(at).alias("_at"))
        pick = lambda shift: F.element_at("_c", F.greatest(F.lit(1), F.least(
            F.lit(201), (F.floor(F.col("_at") * 200) + 1 + shift).cast("int"))))
        proposed = settled(cuts.select(*by, pick(-1).alias("_plo"), pick(2).alias("_phi")))
        counted = join_small(held, proposed, by).groupBy(*by).agg(
            F.count_if(x < F.col("_plo")).alias("_b"),
            F.count_if((x >= F.col("_plo")) & (x <= F.col("_phi"))).alias("_i"))
        nxt = state.join(proposed, by, "left").join(counted, by, "left")
        base = F.col("_below") + F.col("_b")
        holds = F.coalesce((base <= F.floor("_rank")) & (base + F.col("_i") > F.ceil("_rank")), F.lit(False))
        state = settled(nxt.select(
            *by, F.when(holds, F.col("_plo")).otherwise(F.col("_lo")).alias("_lo"),
            F.when(holds, F.col("_phi")).otherwise(F.col("_hi")).alias("_hi"),
            F.when(holds, base).otherwise(F.col("_below")).alias("_below"),
            F.when(holds, F.col("_i")).otherwise(F.col("_in")).alias("_in"), "_rank"))
    kept = join_small(rows, state, by).filter(inside).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("_m"), F.first("_below").alias("_below"), F.first("_rank").alias("_rank"))
    placed = kept.withColumn("_upto", F.sum("_m").over(Window.partitionBy(*by).orderBy(value)) + F.col("_below"))
    lo = F.min(F.when(F.col("_upto") > F.floor("_rank"), x))
    hi = F.min(F.when(F.col("_upto") > F.ceil("_rank"), x))
    frac = F.first(F.col("_rank") - F.floor("_rank"))
    return placed.groupBy(*by).agg((lo + (hi - lo) * frac).alias("_q"))
