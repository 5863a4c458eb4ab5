"""Ranked lexical search by a document FP-tree.

Documents are reduced to the terms that some item asks for. In each task, blocks of these vectors are
put in one global term order, the most frequent first, and sorted, so that documents with a common
start share a path of a trie; single branches are one edge, and small siblings one leaf. Every node
knows, over the documents below it, the greatest frequency of each term and the least ``m``; a
document's score never falls with the first and never rises with the second, so both bound it. For each
item the trie is walked depth first, the most promising child first, and a subtree whose bound is below
the item's twentieth best score so far is left out. Only an item's best documents leave a task.

Scores are 64-bit integers, as is every bound, so nothing is lost to rounding.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

TOP = 20
LEAF = 32                  # documents below which a range of siblings is not divided further
BLOCK_DOCS = 8_192         # documents of one trie
BLOCK_POSTINGS = 2_000_000
BLOCK_TERMS = 500_000      # occurrences of terms in a block of items: what a task is sent
SEED_DOCS = 20_000         # documents that give each item a first bound
#: Digits, letters and all bytes of longer code points stay; other ASCII divides terms.
_DIVIDE = bytes(32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms in order, A-Z lower-cased."""
    return (text or "").encode().lower().translate(_DIVIDE).split()


def gains(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one unit of weight earns: ``(1000000000 * tf) div (1000 * tf + 12 * m)``."""
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _restrict(vocabulary: dict[bytes, int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, size, ends, terms, often = [], [], [0], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                words = terms_of(t)
                if not words:
                    continue
                held = [(vocabulary[w], n) for w, n in Counter(words).items() if w in vocabulary]
                at.append(i)
                size.append(len(words))
                terms.extend(x for x, _ in held)
                often.extend(n for _, n in held)
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at, pa.int64())), pa.array(size, pa.int64()),
                 pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(often, pa.int32()))],
                ["doc_id", "n", "terms", "tf"])
    return rows


class Tree:
    """A trie over sorted vectors, its nodes in breadth-first order, each a range of documents.

    ``node[i]``: ``(terms, child, gain, first, leaf)``: sorted terms of its children with what each
    earns there at most; ``first`` is the first child node, or the first document of a leaf.
    """

    def __init__(self, seqs: list[np.ndarray], tfs: list[np.ndarray], m: np.ndarray):
        self.seqs, self.tfs, self.m = seqs, tfs, m
        ranges, kids = [(0, len(m))], []
        for lo, hi in ranges:   # grows while it is read
            parts = self._divide(lo, hi) if hi - lo > LEAF else []
            kids.append((len(ranges), len(parts)))
            ranges.extend(parts)
        self.node: list = [None] * len(ranges)
        most: list = [None] * len(ranges)
        for i in range(len(ranges) - 1, -1, -1):
            (lo, hi), (first, n) = ranges[i], kids[i]
            below = most[first:first + n] if n else [(seqs[d], tfs[d], m[d]) for d in range(lo, hi)]
            terms = np.concatenate([x[0] for x in below])
            tf = np.concatenate([x[1] for x in below])
            width = [len(x[0]) for x in below]
            child = np.repeat(np.arange(len(below)), width)
            gain = gains(tf, np.repeat(np.array([x[2] for x in below], np.int64), width))
            order = np.argsort(terms, kind="stable")
            terms, tf, child, gain = terms[order], tf[order], child[order], gain[order]
            self.node[i] = (terms, child, gain, first if n else lo, len(below), not n)
            starts = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
            most[i] = (terms[starts], np.maximum.reduceat(tf, starts) if len(starts) else tf, min(x[2] for x in below))
            most[first:first + n] = [None] * n

    def _divide(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """Ranges of the documents that share one more term; neighbours that are few together stay together."""
        a, b = self.seqs[lo], self.seqs[hi - 1]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        depth = int(differ[0]) if len(differ) else n
        if depth == n and len(a) == len(b):
            return []   # equal vectors
        at = np.array([s[depth] if len(s) > depth else -1 for s in self.seqs[lo:hi]])
        edges = [lo, *(np.flatnonzero(at[1:] != at[:-1]) + 1 + lo).tolist(), hi]
        out = [(edges[0], edges[1])]
        for x, y in zip(edges[1:], edges[2:]):
            if y - out[-1][0] <= LEAF:
                out[-1] = (out[-1][0], y)
            else:
                out.append((x, y))
        return out

    def scores(self, i: int, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of node ``i``'s children: scores of documents in a leaf, bounds elsewhere."""
        held, child, gain, _, n, _ = self.node[i]
        lo, hi = np.searchsorted(held, terms), np.searchsorted(held, terms, "right")
        width = hi - lo
        at = np.arange(width.sum()) + np.repeat(lo - np.cumsum(width) + width, width)
        out = np.zeros(n, np.int64)
        np.add.at(out, child[at], gain[at] * np.repeat(weight, width))
        return out


class Best:
    """The ``top`` best documents of one item: score descending, then id, rows without an id last."""

    def __init__(self, top: int, floor: int):
        self.top, self.floor = top, max(1, floor)
        self.score, self.null, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        s, z, d = np.r_[self.score, score], np.r_[self.null, null], np.r_[self.doc, doc]
        first = np.lexsort((d, z, -s))[:self.top]
        self.score, self.null, self.doc = s[first], z[first], d[first]
        if len(first) == self.top:
            self.floor = max(self.floor, int(self.score[-1]))


def walk(tree: Tree, null: np.ndarray, doc: np.ndarray, terms: np.ndarray, weight: np.ndarray, best: Best) -> int:
    """Depth-first branch and bound; returns the number of nodes visited."""
    stack, visited = [(best.floor, 0)], 0
    while stack:
        bound, i = stack.pop()
        if bound < best.floor:
            continue
        visited += 1
        s = tree.scores(i, terms, weight)
        keep = np.flatnonzero(s >= best.floor)
        first, leaf = tree.node[i][3], tree.node[i][5]
        if leaf and len(keep):
            best.add(s[keep], null[first + keep], doc[first + keep])
        elif not leaf:
            stack.extend((int(s[k]), first + int(k)) for k in keep[np.argsort(s[keep], kind="stable")])
    return visited


def _search(asked, place: np.ndarray, n_docs: int, n_terms: int, top: int, floors: list[int]):
    """``asked``: broadcast list of (places, weights) per item; ``place``: of each term in the common order."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = asked.value
        found = [Best(top, f) for f in floors]
        visited, size = 0, 0
        held: list[pa.RecordBatch] = []

        def search() -> None:
            nonlocal visited
            t = pa.Table.from_batches(held).combine_chunks()
            n = t.column("n").to_numpy().astype(np.int64)
            m = 75 + 25 * n * n_docs // n_terms
            ids = t.column("doc_id").combine_chunks()
            null, doc = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            lists = t.column("terms").combine_chunks()
            edges = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            at = place[lists.flatten().to_numpy()]
            tf = t.column("tf").combine_chunks().flatten().to_numpy().astype(np.int64)
            order = np.lexsort((at, np.repeat(np.arange(len(n)), np.diff(edges))))
            at, tf = at[order], tf[order]
            raw = at.astype(">u4").tobytes()
            by = sorted(range(len(n)), key=lambda d: raw[4 * edges[d]:4 * edges[d + 1]])
            tree = Tree([at[edges[d]:edges[d + 1]] for d in by], [tf[edges[d]:edges[d + 1]] for d in by], m[by])
            null, doc = null[by], doc[by]
            for (terms, weight), best in zip(items, found, strict=True):
                visited += walk(tree, null, doc, terms, weight, best) if len(terms) else 0

        for b in batches:
            for lo in range(0, b.num_rows, BLOCK_DOCS):
                part = b.slice(lo, BLOCK_DOCS)
                held.append(part)
                size += len(part.column("terms").flatten())
                if sum(x.num_rows for x in held) >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                    search()
                    held, size = [], 0
        if held:
            search()
        item = np.repeat(np.arange(len(found)), [len(x.doc) for x in found])
        cat = lambda xs, kind: np.concatenate([*xs, np.zeros(0, kind)])
        docs = pa.array(cat([x.doc for x in found], np.int64), mask=cat([x.null for x in found], bool).astype(bool))
        cols = [pa.array(item, pa.int32()), docs, pa.array(cat([x.score for x in found], np.int64))]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(item), visited), pa.int64())], ["item", "doc_id", "score", "visited"])
    return rows


FOUND = "item int, doc_id long, score long, visited long"


def _best_of_all(found: DataFrame, top: int, n_docs: int) -> DataFrame:
    """The best of what the tasks found, first in cells of each item, then of each item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    cells = 1 + math.isqrt(n_docs // BLOCK_DOCS)
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(cells))
    first = found.withColumn("cell", cell).withColumn("rank", F.row_number().over(Window.partitionBy("item", "cell").orderBy(*order)))
    some = first.filter(F.col("rank") <= top).drop("rank", "cell")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)


def ranked(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id",
           top: int = TOP, block_terms: int = BLOCK_TERMS, seed_docs: int = SEED_DOCS) -> DataFrame:
    """The ``top`` documents of each item: ``item_id, rank, doc_id, score``, score above 0, equal scores by ascending ``doc_id``.

    Terms, weights and scores are as described for the search contract (README). Whole texts count, of any
    length; a null or empty text has no terms, and such a document counts nowhere, such an item has no
    rows. Rows without an id are documents too, and stand last among equal scores with a null
    ``doc_id``; repeated rows are documents of their own, as are items that share an id. Tables without
    rows give no rows; other columns are not read.

    Items are dealt to blocks of about ``block_terms`` term occurrences, so what a task is sent is bounded at any
    number of items. From ``4 * seed_docs`` documents on, a hashed sample of about ``seed_docs`` is searched
    first: the score an item reaches there is a bound for the whole search.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter(F.length("text") > 0)
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (4 * block_terms)))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    kind = asked.schema["item_id"].dataType.simpleString()
    out = []
    for i in range(blocks):
        held = sorted(((r["item_id"], r["text"]) for r in asked.filter(block == i).collect()), key=lambda r: (str(r[0]), r[1]))   # a bounded block
        part = _search_block(plain, [x for _, x in held], top, seed_docs)
        names = spark.createDataFrame([(k, x) for k, (x, _) in enumerate(held)], f"item int, item_id {kind}")
        out.append(part.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    total = out[0]
    for x in out[1:]:
        total = total.unionAll(x)
    return total


def _search_block(docs: DataFrame, texts: list[str], top: int, seed_docs: int) -> DataFrame:
    spark = docs.sparkSession
    counts = [Counter(terms_of(t)) for t in texts]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*counts)))}
    vectors = stored(docs.mapInArrow(_restrict(vocabulary), "doc_id long, n long, terms array<int>, tf array<int>"))
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).collect():   # one row a term of the block
        df[r["t"]] = r["df"]
    place = np.empty(len(df), np.int64)
    place[np.lexsort((np.arange(len(df)), -df))] = np.arange(len(df))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
    queries = []
    for c in counts:
        held = sorted((int(place[vocabulary[w]]), int(weight[vocabulary[w]]) * n) for w, n in c.items() if df[vocabulary[w]])
        held = [x for x in held if x[1] > 0]
        queries.append((np.array([p for p, _ in held], np.int64), np.array([w for _, w in held], np.int64)))
    sent = spark.sparkContext.broadcast(queries)
    floors = [0] * len(queries)
    if n_docs >= 4 * seed_docs:
        sample = vectors.filter(F.pmod(F.xxhash64("doc_id", "n"), F.lit(n_docs // seed_docs)) == 0)
        seen = sample.mapInArrow(_search(sent, place, n_docs, n_terms, top, floors), FOUND)
        for r in _best_of_all(seen, top, seed_docs).filter(F.col("rank") == top).collect():   # one row an item of the block
            floors[r["item"]] = r["score"]
    return _best_of_all(vectors.mapInArrow(_search(sent, place, n_docs, n_terms, top, floors), FOUND), top, n_docs)
