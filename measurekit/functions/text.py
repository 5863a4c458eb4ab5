"""Word-level text expressions: words, shingles, folded fingerprints, sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import md5_number

WORD = "[a-z0-9]+"


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(ws: Column, n: int) -> Column:
    """Runs of ``n`` consecutive words; empty when the text is shorter.

    Shifted copies are zipped, so no lambda refers back to the whole array. ``ws`` is
    used several times: bind it first when it is costly.
    """
    if n == 1:
        return ws
    count = F.greatest(F.size(ws) - (n - 1), F.lit(0))
    out = F.slice(ws, 1, count)
    for j in range(1, n):
        out = F.zip_with(out, F.slice(ws, j + 1, count), lambda a, b: F.concat_ws(" ", a, b))
    return out


def fingerprint(c: Column, n_bits: int = 256, n: int = 2, kind: str = "run") -> Column:
    """Sorted on-bits of the folded binary fingerprint of a text.

    ``kind='run'`` hashes runs of up to ``n`` words, ``'exact'`` runs of exactly ``n``.
    """
    sizes = [n] if kind == "exact" else list(range(1, n + 1))
    grams = bind(words(c), lambda ws: F.flatten(F.array(*[shingles(ws, i) for i in sizes])))
    bits = F.transform(F.array_distinct(grams), lambda g: F.pmod(md5_number(g), F.lit(n_bits)).cast("int"))
    return F.array_sort(F.array_distinct(bits))


def sentences(c: Column) -> Column:
    """Per position the word, then the word pair starting there; the last position has no pair."""
    return bind(words(c), lambda ws: F.flatten(F.zip_with(
        ws, F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))),
        lambda a, b: F.when(b.isNull(), F.array(a)).otherwise(F.array(a, F.concat_ws(" ", a, b))))))
