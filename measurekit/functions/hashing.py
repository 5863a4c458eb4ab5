"""Engine-independent hash numbers: the first eight hex digits of an md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_number(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("bigint")


def seeded(seed: int | Column, c: Column) -> Column:
    s = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.concat_ws(":", s, c.cast("string"))


def hash_fold(seed: int | Column, c: Column, k: int) -> Column:
    """Fold of a key: all rows of the key agree, with no shuffle."""
    return F.pmod(md5_number(seeded(seed, c)), F.lit(k)).cast("int")


def hash_order(seed: int | Column, c: Column) -> Column:
    """Hex string giving a seeded, reproducible shuffle order."""
    return F.md5(seeded(seed, c))


def hash_cell(order: Column, rows: int, rows_per_cell: int = 10_000) -> Column:
    """Leading hex digits of a hash: evenly filled cells in hash order, as many as ``rows`` need."""
    digits = 1
    while 16 ** digits * rows_per_cell < rows:
        digits += 1
    return F.substring(order, 1, digits)
