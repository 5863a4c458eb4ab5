"""Spans of pattern matches as column expressions: code point offsets, neighbours, no Python.

``split`` gives the gaps between the leftmost, non-overlapping matches that ``regexp_extract_all``
gives, so positions are running sums of lengths. Sums are taken in chunks, which keeps a text with
very many matches linear. Patterns use possessive repeats where nothing after them could need
their characters back: same matches, no recursion on long runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 256
NEAR = 40


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def starts(lengths: Column) -> Column:
    """Exclusive running sums of an array of lengths."""
    def summed(first: Column, part: Column) -> Column:
        zero = F.struct(first.alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(part, zero, lambda a, x: F.struct(
            (a["at"] + x).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))["all"]

    def chunked(n: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / CHUNK).cast("int")), lambda c: F.slice(n, c * CHUNK + 1, F.lit(CHUNK)))
        def firsts(p: Column) -> Column:
            return let(summed(F.lit(0), F.transform(p, lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b))),
                       lambda f: F.flatten(F.transform(p, lambda x, i: summed(F.get(f, i), x))))
        return let(parts, firsts)

    return F.when(F.size(lengths) == 0, F.array().cast("array<int>")).when(
        F.size(lengths) <= CHUNK, summed(F.lit(0), lengths)).otherwise(chunked(lengths))


def found(text: Column, pattern: str, guard: Column, valid: Callable[[Column], Column] | None = None) -> Column:
    """``array<struct<at, to, value, before, after>>`` of the matches that are valid; empty unless ``guard`` holds.

    ``before`` and ``after`` are up to ``NEAR`` code points of the gaps beside the match.
    """
    def spans(m: Column) -> Column:
        lengths = F.transform(m["v"], lambda v, i: F.length(F.get(m["g"], i)) + F.length(v))
        def one(at: Column) -> Column:
            return F.transform(m["v"], lambda v, i: F.struct(
                (F.get(at, i) + F.length(F.get(m["g"], i))).alias("at"),
                (F.get(at, i) + F.length(F.get(m["g"], i)) + F.length(v)).alias("to"), v.alias("value"),
                F.right(F.get(m["g"], i), F.lit(NEAR)).alias("before"), F.left(F.get(m["g"], i + 1), F.lit(NEAR)).alias("after")))
        return let(lengths, lambda n: let(starts(n), one))

    kind = "array<struct<at:int,to:int,value:string,before:string,after:string>>"
    parts = F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"))
    every = let(parts, spans)
    if valid is not None:
        every = F.filter(every, lambda s: valid(s["value"]))
    return F.when(guard, every).otherwise(F.array()).cast(kind)


def listed(kind: str, spans: Column) -> Column:
    """``kind:start:end`` of every span, in their order."""
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["at"].cast("string"), s["to"].cast("string")))
