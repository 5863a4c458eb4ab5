"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Documents longer than a sequence are cut into full pieces and one shorter first piece; full
pieces are sequences of their own. Of the rest, *large* pieces (above a third of the capacity)
meet at most twice in a sequence, by greedy matching: each takes the largest partner that fits.
Smaller pieces then fill the gaps, longest first, each where it fits best.

How many pieces have which length decides the whole plan: a histogram of at most ``capacity``
rows goes to the driver, runs of equal sequences come back as intervals of ranks, and every
piece finds its place by its rank among those of its length.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_totals, stored

CAPACITY = 1024
END = 2
ROWS_PER_CELL = 1_000
VOCABULARY = "byte_bpe_50k"
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of the byte-level vocabulary as little-endian 32-bit numbers.

    The merge ranks and the tokenizer file hold one vocabulary; the ranks encode several times
    faster. A text that spells a special token goes to the tokenizer file, which knows it.
    """

    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers as public
        import tiktoken
        self._file = public.path(f"{name}.json")
        with open(public.path(f"{name}.tiktoken"), "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary
        self._whole = None

    def __call__(self, text: str) -> bytes:
        if SPECIAL not in text:
            return np.array(self.plain(text), "<u4").tobytes()
        if self._whole is None:
            from tokenizers import Tokenizer
            self._whole = Tokenizer.from_file(self._file)
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` ids: the first may be short, the others are full."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return [(0, head)] * bool(head) + [(at, capacity) for at in range(head, n, capacity)]


def _piece_rows(capacity: int, end: int, vocabulary: str):
    def rows(batches):
        encode, last = Encoder(vocabulary), end.to_bytes(4, "little")
        for b in batches:
            which, piece, start, length, crc = [], [], [], [], []
            for i, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                raw = encode(t or "") + last
                for k, (at, n) in enumerate(cut(len(raw) // 4, capacity)):
                    which.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * at:4 * (at + n)]))
            index = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(index), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]],
                ["doc_id", "piece", "start", "length", "ids_crc32"])
    return rows


@dataclass
class Run:
    """``count`` pieces of one length, by rank from ``rank`` on, at ``offset`` of the sequences from ``bin`` on."""
    length: int
    rank: int
    count: int
    bin: int
    offset: int


def plan(histogram: dict[int, int], capacity: int) -> list[Run]:
    """The packing of ``{length: pieces}``, lengths below the capacity, as runs of equal sequences."""
    left = {n: c for n, c in histogram.items() if c}
    used: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    runs: list[Run] = []
    bins = 0

    def put(n: int, count: int, first: int, offset: int) -> None:
        runs.append(Run(n, used[n], count, first, offset))
        used[n] += count
        left[n] -= count

    def free(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, count))

    large = sorted(n for n in left if 3 * n > capacity)
    for n in reversed(large):
        while left[n]:
            fits = [m for m in large if m <= min(n, capacity - n) and left[m] - (m == n) > 0]
            m = fits[-1] if fits else 0
            pairs = min(left[n], left[m]) if m and m != n else left[n] // 2 if m else left[n]
            put(n, pairs, bins, 0)
            if m:
                put(m, pairs, bins, n)
            free(capacity - n - m, bins, pairs)
            bins += pairs
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(order, n)
            if at == len(order):
                fresh_bins = -(-left[n] // (capacity // n))
                free(capacity, bins, fresh_bins)
                bins += fresh_bins
                continue
            gap = order[at]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            each = min(gap // n, left[n])
            full = min(count, left[n] // each)
            for k in range(each):
                put(n, full, first, capacity - gap + k * n)
            free(gap - each * n, first, full)
            free(gap, first + full, count - full)
    return runs


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end: int = END,
         vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document's ids are those of its whole text plus ``end``; a null text counts as empty, so it
    still gives its end. Every row of ``docs`` is packed, repeated rows and null ids too, and an
    empty table packs to no rows. Ranks among equal lengths are taken in cells of hashed order, so
    a length that most pieces share is ranked by many tasks; equal rows of a cell are told apart by
    a number, and which of them stands where makes no difference.
    """
    pieces = stored(docs.select(doc_id, text).mapInArrow(
        _piece_rows(capacity, end, vocabulary), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    full = counts.pop(capacity, 0)
    runs = plan(counts, capacity)
    top = max((r.bin + r.count for r in runs), default=0)
    if full:
        runs.append(Run(capacity, 0, full, top, 0))
    spark = docs.sparkSession
    table = spark.createDataFrame([(r.length, r.rank, r.rank + r.count, r.bin - r.rank, r.offset) for r in runs],
                                  "length long, first long, after long, shift long, offset long")
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    # one row for each length, and at most a few runs for each
    cells = spark.createDataFrame([(n, -(-c // ROWS_PER_CELL)) for n, c in [*counts.items(), (capacity, full)]], "length long, cells long")
    dealt = pieces.join(F.broadcast(cells), "length")
    ranked = running_totals(dealt, ["length"], F.pmod(F.shiftright(order, 8), F.col("cells")), [order, F.col("doc_id"), F.col("piece"), F.col("start")],
                            {"rank": F.lit(1).cast("long")})
    placed = ranked.join(F.broadcast(table), "length").filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("after")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("shift")).alias("sequence_id"), "offset")
