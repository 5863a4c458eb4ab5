"""Cross-tokenizer alignment: groups of tokens of two vocabularies that cover the same bytes, and their links.

Both tokenizers cut a text's bytes; where both have a cut, groups of tokens end. A byte range of a document
gives a *fragment*: the tokens before its first common cut (open prefix), the closed groups, and the tokens
after its last common cut (open suffix). Tokens that begin in a range belong to it, so ranges may end inside tokens.
``compose`` joins neighbouring fragments and is associative, so fragments may be joined in any grouping:
along a segment inside a task, and in a tree of joins of ``FAN`` neighbours across tasks for documents
longer than a segment, which are cut where neither tokenizer can join bytes (before a single space).

How often each pair of ids is linked is counted corpus-wide from sums that tasks have already combined. The table
of pairs, bounded by the vocabularies, is sent to a last narrow pass in parts of ``PART_PAIRS``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, stored_at
from .packing import VOCABULARY, Encoder

PIECES = "piece_bpe_32k.model"
SEGMENT = 1 << 16        # bytes of a text that one task tokenises at a time
RANGE = 1 << 14          # bytes of a fragment inside a segment
FAN = 16                 # fragments joined at a time across tasks
PART_PAIRS = 2_000_000   # pairs of ids sent to a task at a time
FLUSH_PAIRS = 1_000_000
B_BITS = 20
ROWS = 1_000             # texts of a batch that are held as Python objects at a time


class Tokenizers:
    """Ids and byte ends of both vocabularies for a text that begins with a space."""

    def __init__(self, a: str = VOCABULARY, b: str = PIECES):
        import public_tokenizers as public
        from sentencepiece import SentencePieceProcessor
        self.a = Encoder(a)
        self.a_bytes = [x for x, _ in sorted(self.a.ranks.items(), key=lambda r: r[1])]
        self.b = SentencePieceProcessor(model_file=public.path(b))
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
                        for i in range(len(self.b))]
        self.a_len, self.b_len = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """``(a ids, a ends, b ids, b ends)`` of a space and ``text``; None where a vocabulary's bytes are others."""
        b = self.b.encode(text, num_threads=1)
        whole = f" {text}".encode()
        if b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        a = self.a.plain(f" {text}")   # special strings are plain text
        a, b = np.fromiter(a, np.int64, len(a)), np.fromiter(b, np.int64, len(b))
        a_end = np.cumsum(self.a_len[a])
        # byte-level tokens are the text's bytes in order, so their number decides
        return (a, a_end, b, np.cumsum(self.b_len[b])) if a_end[-1] == len(whole) else None


@dataclass
class Fragment:
    """``pre`` and ``suf``: ``(a ids, a ends, b ids, b ends)``, ends from the document's start. Without a common cut all is ``pre``."""
    pre: tuple
    suf: tuple
    cut: bool                 # holds a common cut, the document's start included
    n_a: int
    n_b: int
    n_groups: int = 0
    groups: str = ""          # closed groups, ``a1,a2|b1;a3|b2``
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))   # a code for each link of the closed groups


NONE = tuple(np.zeros(0, np.int64) for _ in range(4))


def _joined(x: tuple, y: tuple) -> tuple:
    return tuple(np.concatenate(z) for z in zip(x, y, strict=True))


_WRITTEN: dict[int, np.ndarray] = {}


def written(top: int) -> np.ndarray:
    """Decimal ids below ``top`` as ASCII, followed by ``,``, then all by ``|``, then all by ``;``."""
    if top not in _WRITTEN:
        _WRITTEN[top] = np.array([f"{i}{mark}" for mark in ",|;" for i in range(top)], "S")
    return _WRITTEN[top]


def all_ends(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every byte where a token ends, in order: the places of the first A and B tokens that end there or later, and whether both end there."""
    if not len(a_end) or not len(b_end):
        return np.arange(len(a_end)), np.arange(len(b_end)), np.zeros(max(len(a_end), len(b_end)), bool)
    low = min(a_end[0], b_end[0])
    at = np.zeros(max(a_end[-1], b_end[-1]) - low + 1, np.uint8)
    at[a_end - low] = 1
    at[b_end - low] |= 2
    at = at[np.flatnonzero(at)]
    ends_a, ends_b = (at & 1).astype(np.int64), (at >> 1).astype(np.int64)
    return np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b, at == 3


def closed(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, common: np.ndarray) -> tuple[int, str, np.ndarray]:
    """Groups, their text and links of tokens that begin and end at common cuts; ``i``, ``j``, ``common`` as ``all_ends`` has them.

    Between two neighbouring ends of any tokens there is one pair that overlaps, and each pair overlaps once.
    """
    if not len(i):
        return 0, "", NONE[0]
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)   # of their group
    x, y = i[common], j[common]
    last_a[x], last_b[y] = True, True
    # a token's place in the text: those before it in its vocabulary, and those of the other one that its group has let pass
    place_a = np.arange(len(a)) + np.r_[0, y + 1][np.cumsum(last_a) - last_a]
    place_b = np.arange(len(b)) + (x + 1)[np.cumsum(last_b) - last_b]
    top = 1 << int(max(a.max(), b.max(), 65_535)).bit_length()
    tokens = np.empty(len(a) + len(b), np.int64)
    tokens[place_a], tokens[place_b] = a + top * last_a, b + 2 * top * last_b
    text = written(top).take(tokens).tobytes().translate(None, b"\0")[:-1].decode("ascii")
    return len(x), text, a[i] << B_BITS | b[j]


def fragment(t: tuple, first: bool) -> Fragment:
    """The fragment of the tokens that begin in one byte range; ``first``: they begin a document."""
    a, a_end, b, b_end = t
    i, j, both = all_ends(a_end, b_end)
    common = np.flatnonzero(both)
    if not len(common) and not first:
        return Fragment(t, NONE, False, len(a), len(b))
    lo, hi = (0 if first else common[0] + 1), (common[-1] + 1 if len(common) else 0)
    p, q = (0, 0) if first else (int(i[common[0]]) + 1, int(j[common[0]]) + 1)
    x, y = (int(i[common[-1]]) + 1, int(j[common[-1]]) + 1) if len(common) else (0, 0)
    n, text, pairs = closed(a[p:x], b[q:y], i[lo:hi] - p, j[lo:hi] - q, both[lo:hi])
    return Fragment((a[:p], a_end[:p], b[:q], b_end[:q]), (a[x:], a_end[x:], b[y:], b_end[y:]), True, len(a), len(b), n, text, pairs)


def compose(l: Fragment, r: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges; associative.

    What is open between them is a fragment itself: a token from each side may end at one byte, so it can hold cuts that neither side sees.
    """
    middle = fragment(_joined(l.suf if l.cut else l.pre, r.pre), l.cut)
    closed_ = [x for x, use in ((l, l.cut), (middle, True), (r, r.cut)) if use and x.n_groups]
    return Fragment(l.pre if l.cut else middle.pre, r.suf if r.cut else middle.suf, middle.cut, l.n_a + r.n_a, l.n_b + r.n_b,
                    sum(x.n_groups for x in closed_), ";".join(x.groups for x in closed_), np.concatenate([NONE[0], *[x.pairs for x in closed_]]))


def of_segment(t: tuple, start: int, width: int = RANGE) -> Fragment:
    """Fragments of the byte ranges of one segment's tokens, which begin at byte ``start``, joined."""
    a, a_end, b, b_end = t
    end = int(a_end[-1])
    if end - start <= width:
        return fragment(t, start == 0)
    a_from, b_from = np.r_[start, a_end[:-1]], np.r_[start, b_end[:-1]]
    edges = range(start, end, width)
    parts = []
    for lo in edges:
        i, k = np.searchsorted(a_from, [lo, lo + width])
        j, m = np.searchsorted(b_from, [lo, lo + width])
        parts.append(fragment((a[i:k], a_end[i:k], b[j:m], b_end[j:m]), lo == 0))
    while len(parts) > 1:
        parts = [compose(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """``text`` in parts of ``size`` characters or more, cut before single spaces that neither vocabulary joins with what is before.

    Every part after the first begins with that space; a stretch without such a space stays whole.
    """
    out, at = [], 0
    while len(text) - at > size:
        cut = at + size
        while (cut := text.find(" ", cut)) >= 0 and (text[cut - 1].isspace() or text[cut + 1:cut + 2].isspace() or cut + 1 == len(text)):
            cut += 1
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


_STATS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair array<long>, times array<int>"
_ROW = f"doc_id long, {_STATS}"


def _done(f: Fragment | None) -> tuple:
    if f is None:
        return 0, 0, 0, 0, "", [], []
    pair, times = np.unique(f.pairs, return_counts=True)
    return f.n_a, f.n_b, f.n_groups, len(f.pairs), hashlib.sha256(f.groups.encode()).hexdigest(), pair, times


def _columns(rows: list[tuple], names: list[str], ids: pa.Array) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 7
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([ids, *[pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]], names)


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens = Tokenizers()
    names = [f.split()[0] for f in _ROW.split(", ")]
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            b, rows = batch.slice(lo, ROWS), []
            for text in b.column(1).to_pylist():
                t = tokens(text) if text else None
                rows.append(_done(None if t is None else of_segment(t, 0)))
            yield _columns(rows, names, b.column(0))


def _cut_up(size: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (row, text) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
                parts = segments(text, size)
                n = len(parts)
                sizes = np.cumsum([0, *[len(p.encode()) for p in parts[:-1]]])
                start = [0, *(sizes[1:] + 1).tolist()]   # the leading space counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * n, pa.int64()), pa.array(b.column(1).slice(k, 1).to_pylist() * n, pa.int64()), pa.array(range(n), pa.int32()),
                     pa.array(start, pa.int64()), pa.array(parts, pa.string())], ["row", "doc_id", "i", "start", "text"])
    return rows


_OPEN = [f"{s}_{c}" for s in ("pre", "suf") for c in ("a", "a_end", "b", "b_end")]
_FRAGMENT = ("row long, doc_id long, i int, good boolean, cut boolean, n_a long, n_b long, n_groups long, groups string, pairs array<long>, "
             + ", ".join(f"{c} array<long>" for c in _OPEN))


def _packed(row, doc, i, f: Fragment | None) -> tuple:
    if f is None:
        return row, doc, i, False, False, 0, 0, 0, "", [], *[[]] * 8
    return row, doc, i, True, f.cut, f.n_a, f.n_b, f.n_groups, f.groups, f.pairs, *f.pre, *f.suf


def _unpacked(r) -> Fragment:
    arrays = [np.asarray(getattr(r, c), np.int64) for c in _OPEN]
    return Fragment(tuple(arrays[:4]), tuple(arrays[4:]), bool(r.cut), r.n_a, r.n_b, r.n_groups, r.groups, np.asarray(r.pairs, np.int64))


def _tokenised(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    tokens = Tokenizers()
    names = [f.split()[0] for f in _FRAGMENT.split(", ")]
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            t = tokens(r.text if r.i == 0 else r.text[1:])   # the tokenizers add or get one space
            doc = None if pd.isna(r.doc_id) else int(r.doc_id)
            if t is None:
                out.append(_packed(r.row, doc, r.i, None))
                continue
            a, a_end, b, b_end = t
            out.append(_packed(r.row, doc, r.i, of_segment((a, a_end + r.start, b, b_end + r.start), r.start)))
        got = pd.DataFrame(out, columns=names)
        yield got.assign(doc_id=got["doc_id"].astype("Int64"))


def _compose_group(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = list(pdf.sort_values("i").itertuples(index=False))
    doc = None if pd.isna(rows[0].doc_id) else int(rows[0].doc_id)
    total = None
    if all(r.good for r in rows):
        parts = [_unpacked(r) for r in rows]
        while len(parts) > 1:
            parts = [compose(*parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        total = parts[0]
    got = pd.DataFrame([_packed(rows[0].row, doc, rows[0].i // FAN, total)], columns=pdf.columns)
    return got.assign(doc_id=got["doc_id"].astype("Int64"))


def _finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.split()[0] for f in _ROW.split(", ")]
    for pdf in batches:
        rows = [(None if pd.isna(r.doc_id) else int(r.doc_id), *_done(_unpacked(r) if r.good else None)) for r in pdf.itertuples(index=False)]
        got = pd.DataFrame(rows, columns=names)
        yield got.assign(doc_id=got["doc_id"].astype("Int64"))


def long_documents(docs: DataFrame, size: int = SEGMENT) -> DataFrame:
    """``_ROW`` of documents longer than a segment: segments are dealt over all tasks, fragments joined in a tree."""
    # a stored number tells rows apart, so repeated rows and null ids stay documents of their own
    parts = stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        _cut_up(size), "row long, doc_id long, i int, start long, text string"))
    found = stored(parts.repartition("row", "i").mapInPandas(_tokenised, _FRAGMENT))
    most = parts.agg(F.max("i")).first()[0] or 0
    while most > 0:
        found = found.groupBy("row", F.floor(F.col("i") / FAN).alias("_up")).applyInPandas(_compose_group, _FRAGMENT)
        most //= FAN
    return found.mapInPandas(_finished, _ROW)


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by pair, combined in the task."""
    held, size = [], 0

    def sums() -> pa.RecordBatch:
        pair, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        times = np.zeros(len(pair), np.int64)
        np.add.at(times, at, np.concatenate([y for _, y in held]))
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(times)], ["pair", "times"])

    for b in batches:
        held.append((b.column(0).flatten().to_numpy(), b.column(1).flatten().to_numpy().astype(np.int64)))
        size += len(held[-1][0])
        if size > FLUSH_PAIRS:
            one = sums()
            if one.num_rows > FLUSH_PAIRS // 2:
                yield one
                held, size = [], 0
            else:   # few distinct ones: go on with their sums
                held, size = [(one.column(0).to_numpy(), one.column(1).to_numpy())], one.num_rows
    if held:
        yield sums()


def _weighed(table):
    """Adds a part of the pair table to each row's ``n_best`` and ``count_sum``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, times, best = table.value
        for b in batches:
            pairs, n = b.column("pair"), b.column("times").flatten().to_numpy().astype(np.int64)
            flat = pairs.flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), pairs.value_lengths().to_numpy())
            at = np.minimum(np.searchsorted(key, flat), len(key) - 1)
            hit = key[at] == flat
            row, n, at = row[hit], n[hit], at[hit]
            n_best, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(n_best, row, n * best[at])
            np.add.at(total, row, n * times[at])
            cols = {c: b.column(c) for c in b.schema.names}
            cols["n_best"] = pa.array(cols["n_best"].to_numpy() + n_best)
            cols["count_sum"] = pa.array(cols["count_sum"].to_numpy() + total)
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))
    return rows


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, times, best`` from rows with ``pair`` and ``times`` lists; ``best``: no pair of the same B id has more links."""
    sums = rows.select("pair", "times").mapInArrow(_pair_sums, "pair long, times long")
    counts = stored(sums.groupBy("pair").agg(F.sum("times").alias("times")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << B_BITS) - 1))))
    top = counts.groupBy("b").agg(F.max("times").alias("top"))
    return counts.join(top, "b").select("pair", "times", (F.col("times") == F.col("top")).alias("best"))


def align(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", segment: int = SEGMENT, part_pairs: int = PART_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    A null or empty text has no tokens: zeros and an empty ``groups_sha256``; so has a text whose bytes a vocabulary
    changes, such as one that holds U+2581. Texts above ``segment`` bytes are tokenised in segments by many tasks and
    give what they would give whole. Repeated rows and rows without an id are documents of their own; an empty
    table gives no rows; other columns are not read. ``n_best``: links whose pair is among the most linked of its B id.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    is_long = F.coalesce(F.octet_length("text") > segment, F.lit(False))
    short, folder = stored_at(plain.filter(~is_long).mapInArrow(_short, _ROW))
    long_, other = stored_at(long_documents(plain.filter(is_long), segment))
    rows = short.unionAll(long_)
    pairs = stored(pair_counts(rows))
    n = pairs.count()
    parts = max(1, -(-n // part_pairs))
    out = rows.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    schema = f"{_ROW}, n_best long, count_sum long"
    for i in range(parts if n else 0):
        t = pairs.filter(F.pmod(F.xxhash64("pair"), F.lit(parts)) == i).toArrow()   # a bounded part
        order = np.argsort(key := t.column("pair").to_numpy())
        table = (key[order], t.column("times").to_numpy()[order], t.column("best").to_numpy()[order].astype(np.int64))
        out = out.mapInArrow(_weighed(spark.sparkContext.broadcast(table)), schema)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
