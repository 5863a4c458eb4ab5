"""Column expressions: cleaning, keys, guarded arithmetic, array and text summaries."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    d = c.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == F.lit(float("inf"))), None).otherwise(d)


def normalize_key(c: Column, fallback: Column | None = None) -> Column:
    """Case- and space-insensitive key; ``fallback`` is tried when the first is blank."""
    def form(x: Column) -> Column:
        return F.nullif(F.trim(F.regexp_replace(F.lower(x), r"[ \t\r\n]+", " ")), F.lit(""))
    return form(c) if fallback is None else F.coalesce(form(c), form(fallback))


def coarse_key(c: Column) -> Column:
    """Digest of the whole key with detail stripped: letters and digits only; null when none is left."""
    return F.md5(F.nullif(F.regexp_replace(F.lower(c), "[^a-z0-9]+", ""), F.lit("")))


def guarded_ratio(num: Column, den: Column) -> Column:
    """``num / max(den, 1)``."""
    return num.cast("double") / F.greatest(den.cast("double"), F.lit(1.0))


def literal_count(c: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    gone = F.length(F.replace(c, F.lit(literal), F.lit("")))
    return ((F.length(c) - gone) / len(literal)).cast("bigint")


def class_counts(c: Column, patterns: Mapping[str, str]) -> dict[str, Column]:
    """``n_<class>`` and ``frac_<class>`` of a text per character-class pattern."""
    out: dict[str, Column] = {}
    for name, pattern in patterns.items():
        n = F.regexp_count(c, F.lit(pattern)).cast("bigint")
        out[f"n_{name}"] = n
        out[f"frac_{name}"] = guarded_ratio(n, F.length(c))
    return out


def pattern_counts(c: Column, rules: Mapping[str, str], binary: bool = False) -> list[Column]:
    """One count (or 0/1 hit) column per named pattern."""
    hits = {n: F.regexp_count(c, F.lit(p)).cast("bigint") for n, p in rules.items()}
    return [(F.when(h > 0, 1).otherwise(0) if binary else h).alias(n) for n, h in hits.items()]


def array_stats(c: Column) -> dict[str, Column]:
    """max, min, mean, sum, std (ddof 0) over the finite elements; all 0 when there are none.

    One pass: the accumulator carries count, running mean and squared deviation.
    """
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"),
                    F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"))

    def add(a: Column, v: Column) -> Column:
        n = a["n"] + 1.0
        mean = a["mean"] + (v - a["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"),
                        (a["m2"] + (v - a["mean"]) * (v - mean)).alias("m2"), (a["sum"] + v).alias("sum"),
                        F.least(a["lo"], v).alias("lo"), F.greatest(a["hi"], v).alias("hi"))

    st = F.aggregate(F.filter(F.transform(c, finite), lambda v: v.isNotNull()), zero, add)
    raw = {"a_max": st["hi"], "a_min": st["lo"], "a_mean": F.when(st["n"] > 0, st["mean"]),
           "a_sum": st["sum"], "a_std": F.sqrt(F.try_divide(st["m2"], st["n"]))}
    return {k: F.coalesce(v, F.lit(0.0)) for k, v in raw.items()}


def clip(x: Column, lo: Column, hi: Column) -> Column:
    """Null stays null; an absent bound does not bind."""
    return F.when(x.isNotNull(), F.greatest(lo, F.least(hi, x)))


@dataclass(frozen=True)
class TargetTransform:
    """Expression pair applied to the target before fitting and to predictions after."""
    forward: Callable[[Column], Column]
    inverse: Callable[[Column], Column]


TRANSFORMS: dict[str, TargetTransform] = {
    "identity": TargetTransform(lambda y: y, lambda z: z),
    "log": TargetTransform(lambda y: F.ln(F.when(y > 0, y)), F.exp),
    "sqrt": TargetTransform(lambda y: F.sqrt(F.when(y >= 0, y)), lambda z: z * z),
}
