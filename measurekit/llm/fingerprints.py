"""Order MinHash fingerprints: minimal occurrence-numbered k-mers, kept in text order, hashed as tuples.

A k-mer is ``K`` bytes of UTF-8; its n-th occurrence counts as an element of its own. For each of
``TUPLES`` hash functions the ``PICKS`` elements with the least hashes are taken in their order in
the text; the hash of that tuple is one value of the signature. Two signatures agree in about the
share of values that texts with a small edit distance keep, and moved or repeated passages count
as edits, unlike in a plain MinHash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

K, PICKS, TUPLES = 8, 2, 32
ROWS_PER_PART = 50_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_MULTIPLIERS = (np.arange(1, TUPLES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) >> np.uint64(13)).astype(np.uint32) | np.uint32(1)
_SHIFTS = (np.arange(1, TUPLES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(17)).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def elements(raw: bytes) -> np.ndarray:
    """32-bit hashes of the occurrence-numbered k-mers, in text order; a shorter text is one k-mer."""
    if len(raw) < K:
        raw = raw.ljust(K, b"\0") if raw else b""
    n = len(raw) - K + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    data = np.frombuffer(raw, np.uint8)
    word = np.zeros(n, np.uint64)
    for j in range(K):
        word = (word << np.uint64(8)) | data[j:j + n]
    # hash above, position below: one fast sort groups equal k-mers with their places in order
    both = np.sort((_mix(word) & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64))
    place, h = (both & np.uint64(0xFFFFFFFF)).astype(np.int64), both >> np.uint64(32)
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    turn = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    out = np.empty(n, np.uint32)
    out[place] = (_mix(h + turn.astype(np.uint64) * _B) >> np.uint64(32)).astype(np.uint32)
    return out


def signature(raw: bytes) -> np.ndarray:
    """``TUPLES`` 32-bit values; all zero for an empty text."""
    x = elements(raw)
    if not len(x):
        return np.zeros(TUPLES, np.uint32)
    picked = np.empty((TUPLES, PICKS), np.int64)
    if len(x) <= 2048:
        h = x[None, :] * _MULTIPLIERS[:, None] + _SHIFTS[:, None]
        for p in range(PICKS):
            at = h.argmin(axis=1)
            picked[:, p] = at
            if p + 1 < PICKS and len(x) > 1:
                h[np.arange(TUPLES), at] = 0xFFFFFFFF
    else:
        for t in range(TUPLES):
            h = x * _MULTIPLIERS[t] + _SHIFTS[t]
            for p in range(PICKS):
                picked[t, p] = at = h.argmin()
                h[at] = 0xFFFFFFFF
    picked.sort(axis=1)
    value = np.arange(TUPLES, dtype=np.uint64)
    for p in range(PICKS):
        value = _mix(value * _A + x[picked[:, p]])
    return (value >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the start of ``following``."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part, descending; each is finished when the next one of its part arrives."""
    before = None
    for b in batches:
        out = []
        for part, doc, border, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
            text = text or ""
            sig = signature(text.encode())
            if before is not None and before[0] == part:
                _, old, t, s = before
                changed = edited(t, text)
                e = signature(changed.encode())
                out.append((old, len(t), hashlib.sha256(changed.encode()).hexdigest(), s.astype(">u4").tobytes().hex(),
                            e.astype(">u4").tobytes().hex(), likeness(s, e), likeness(s, sig)))
            before = None if border else (part, doc, text, sig)
        cols = list(zip(*out)) if out else [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, KINDS, strict=True)], NAMES)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
KINDS = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]


def _not_above(x: Column, cuts: list[int], width: int = 100) -> Column:
    """How many of the ascending ``cuts`` are at most ``x``: first whole groups, then inside one."""
    if not cuts:
        return F.lit(0)
    groups = [cuts[i:i + width] for i in range(0, len(cuts), width)]
    count = lambda a: F.size(F.filter(a, lambda c: c <= x))
    whole = count(F.array(*[F.lit(g[0]) for g in groups])) - 1
    inside = count(F.get(F.array(*[F.array(*map(F.lit, g)) for g in groups]), whole))
    return F.when(whole >= 0, whole * width + inside).otherwise(0)


def fingerprint_pairs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``SCHEMA`` for every row of ``docs``: its fingerprint beside those of its edited text and of its successor.

    The successor is the next row in descending ``doc_id``, of the last row the first; rows that
    share an id follow one another in the order of a hash of their text, and rows without an id
    come last. A null text is empty; a single row succeeds itself; an empty table gives no rows.
    Rows are dealt to ranges of ids, and each range also gets its successor's first row, so texts
    move once and no task sees more than its range.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    ids = stored(rows.select("doc_id", "version"))
    total = ids.count()
    if not total:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(max(4 * tasks, -(-total // ROWS_PER_PART)), 10_000, total)
    cuts = ids.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts).alias("c")).first()["c"] or [] if parts > 1 else []
    cuts = sorted(set(cuts))
    # part 0 holds the largest ids; rows without one form the last part
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(F.lit(len(cuts)) - _not_above(F.col("doc_id"), cuts))
    place = F.struct(F.col("doc_id").isNull().alias("none"), (-F.col("doc_id")).alias("low"), F.col("version").alias("version"))
    heads = ids.withColumn("part", part).groupBy("part").agg(F.min(place).alias("h")).orderBy("part").collect()
    border = [(heads[i]["part"], r["h"]["none"], None if r["h"]["low"] is None else -r["h"]["low"], r["h"]["version"])
              for i, r in enumerate(heads[1:] + heads[:1])]
    # one row for each part
    table = docs.sparkSession.createDataFrame(border, "part int, none boolean, doc_id long, version long")
    joined = rows.alias("r").join(F.broadcast(table.alias("t")), F.col("r.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("r.version") == F.col("t.version")))
    extra = joined.select("t.part", "r.doc_id", "r.version", F.lit(True).alias("border"), "r.text").dropDuplicates(["part"])
    dealt = rows.select(part.alias("part"), "doc_id", "version", F.lit(False).alias("border"), "text").unionByName(extra)
    ordered = dealt.repartition(max(tasks, parts // 4), "part").sortWithinPartitions("part", "border", F.desc_nulls_last("doc_id"), "version")
    return ordered.select("part", "doc_id", "border", "text").mapInArrow(_compared, SCHEMA)
