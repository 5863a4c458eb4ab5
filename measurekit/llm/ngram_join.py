"""Exact Jaccard self-join of word n-gram sets by universe partition and the pigeonhole principle.

Two sets of sizes k and l with ``100 * |A & B| >= percent * |A | B|`` differ in at most
``k + l - 2 * ceil(percent * (k + l) / (100 + percent))`` elements. All hashed n-grams are divided
into ``m`` segments, ``m`` set by the band of sizes; a set's part in one segment is a token.

* Small bands: ``m`` is about half the allowed difference, so in one segment two linked sets
  differ by one element at most. The index holds every part and its one-deletion neighbours.
* Other bands: ``m`` exceeds the allowed difference by ``spare + 1``, so linked sets share more than
  ``spare`` equal parts. Each set leaves out its ``spare`` most frequent ones, in one global order of
  (frequency, hash): the costliest tokens, such as common passages and empty parts, go unused
  wherever a set can afford it, and two linked sets still share one of the rest.

Both spend the same allowance; neighbours cost a row for each element, which pays for small sets only. Shared
tokens bring candidates; a bound from parity sketches (the sketches of two sets differ in no more
bits than the sets in elements) drops most, in the join with 256 bits and then with a bit or more for each
element of the band, and again with two bits an element; whole texts decide the rest exactly.

Equal sets are one node. Near copies meet the least node of their token first, so a group of
copies costs as many pairs as it has nodes; only nodes then still in different components are
compared with each other, inside the join and under the sketch bound.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dist import join_measured, settled
from ..operators.graph import components
from .common import discard, fresh, stored, stored_at

SKETCH_BITS = 256
SMALL = 40            # sizes up to here take one-deletion neighbours
GROWTH = 1.5          # upper bound of a band by its lower one
SPARE = .1            # share of a band's needed tokens added as spare ones
WIDE_BITS = 1024      # most bits of a sketch that is compared inside a join
BROADCAST_IDS = 1_000_000
ROWS = 500              # texts that a task holds as sets at a time
KNOWN_WORDS = 150_000   # words whose hashes a task remembers
SAMPLE = 64           # one in so many nodes tells which tokens are frequent
FREQUENT = 8          # times in the sample; others are counted where they meet, about ``SAMPLE * FREQUENT`` rows at most
SALTS = 1024          # places over which the rows of a frequent token stay spread
PIVOTS_PAY = 20       # a round of pivots is followed by another while one in so many of its candidates is a link
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
T_SCHEMA = "doc_id long, n long, d1 long, d2 long, b0 long, b1 long, b2 long, b3 long, sketch binary, bands array<int>, tokens array<array<long>>"


def allowed(k: int, l: int, percent: int) -> int:
    """Most elements in which linked sets of these sizes differ."""
    return k + l - 2 * -(-percent * (k + l) // (100 + percent))


class Bands:
    """Bands of set sizes; every pair of linked sets is in one band together."""

    def __init__(self, percent: int, top: int = 2 ** 40):
        self.percent = percent
        self.starts = [1]
        while self.starts[-1] < top:
            self.starts.append(max(self.starts[-1] + 1, int(self.starts[-1] * GROWTH)))

    def of(self, n: int) -> range:
        """The band of ``n`` and those of larger partners."""
        last = bisect_right(self.starts, n * 100 // self.percent) - 1
        return range(bisect_right(self.starts, n) - 1, last + 1)

    def width(self, band: int) -> int:
        """Bits of the sketches that two sets of a band are compared by."""
        return min(WIDE_BITS, max(SKETCH_BITS, 1 << (self.starts[band + 1] - 2).bit_length()))

    def form(self, band: int) -> tuple[int, int, bool]:
        """Segments, spare tokens, and whether parts get one-deletion neighbours."""
        u = self.starts[band + 1] - 1
        h = max(allowed(u, u, self.percent), allowed(u, u - 1, self.percent))
        if u <= SMALL:
            return (h + 2) // 2, 0, h > 0
        spare = max(1, int(SPARE * (h + 1)))
        return h + 1 + spare, spare, False


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def grams(words: list[bytes], size: int) -> set:
    """The n-grams themselves; fewer words than ``size`` are one n-gram, no words none."""
    if len(words) <= size:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(size)]))


def hashed_grams(words: list[bytes], size: int, known: dict[bytes, int]) -> np.ndarray:
    """Distinct 64-bit hashes of ``grams``, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    for w in set(words):
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(size, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ (out >> np.uint64(29))) * _A + h[j:j + n]
    return np.unique(_mix(out))


def tokens(g: np.ndarray, band: int, bands: Bands) -> np.ndarray:
    """Distinct tokens of a set in one band."""
    m, _, deletions = bands.form(band)
    x = _mix(g + np.uint64(band))
    seg = ((x >> np.uint64(40)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
    order = np.argsort(seg, kind="stable")
    x, seg = x[order], seg[order]
    total = np.zeros(m, np.uint64)
    first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    total[seg[first]] = np.add.reduceat(x, first)
    salt = _mix(np.arange(m, dtype=np.uint64) * _B + np.uint64(band))
    out = _mix(total + salt)
    if deletions:
        out = np.r_[out, _mix(total[seg] - x + salt[seg])]
    return np.unique(out)


def sketch(g: np.ndarray) -> np.ndarray:
    """Parity bits of a set in 64-bit words, two bits or more for an element. Halving it by XOR gives the smaller sketch."""
    width = max(SKETCH_BITS, 1 << (2 * len(g) - 1).bit_length())
    at = ((g >> np.uint64(7)) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=width).astype(np.uint8) & 1, bitorder="little").view(np.uint64)


def differing(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two sketches differ, folded to the shorter: the sets differ in as many elements at least."""
    n = min(len(a), len(b))
    fold = lambda x: np.bitwise_xor.reduce(x.reshape(-1, n), axis=0)
    return int(np.bitwise_count(fold(a) ^ fold(b)).sum())


def _set_rows(size: int, percent: int):
    def rows(batches):
        bands, known = Bands(percent), {}
        for b in (whole.slice(lo, ROWS) for whole in batches for lo in range(0, whole.num_rows, ROWS)):
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(known) > KNOWN_WORDS:
                    known.clear()
                g = hashed_grams(words_of(text), size, known)
                if not len(g):
                    out.append((doc, 0, 0, 0, 0, 0, 0, 0, b"", [], []))
                    continue
                fine = sketch(g)
                bits = np.bitwise_xor.reduce(fine.reshape(-1, SKETCH_BITS // 64), axis=0)
                digest = np.frombuffer(xxhash.xxh3_128_digest(g.tobytes()), np.int64)
                own = list(bands.of(len(g))) if doc is not None else []
                out.append((doc, len(g), *digest.tolist(), *bits.view(np.int64).tolist(), fine.tobytes(), own,
                            [tokens(g, i, bands).view(np.int64) for i in own]))
            cols = list(zip(*out)) if out else [()] * 11
            kinds = [pa.int64()] * 8 + [pa.binary(), pa.list_(pa.int32()), pa.list_(pa.list_(pa.int64()))]
            names = [f.split()[0] for f in T_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
    return rows


BITS = ["b0", "b1", "b2", "b3"]


def small(ids: DataFrame) -> DataFrame:
    """``ids`` marked for broadcast when they are counted to be few, else as they are."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def with_frequency(flat: DataFrame, sample: DataFrame) -> DataFrame:
    """``node, band, sig`` with ``f``, which puts tokens in an order of frequency; tokens of one row are left out.

    Rows meet once, at their token, and are counted there. Tokens that a ``sample`` of the nodes shows to be frequent would make large
    groups: ``f`` is then the estimate from the sample, the same for all their rows, which stay spread.
    """
    often = settled(sample.groupBy("sig").agg(F.count(F.lit(1)).alias("seen")).filter(F.col("seen") >= FREQUENT))
    marked = join_measured(flat, often, ["sig"])
    salt = F.when(F.col("seen").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    counted = marked.withColumn("salt", salt).withColumn("f", F.count(F.lit(1)).over(Window.partitionBy("sig", "salt")))
    return counted.withColumn("f", F.coalesce(F.col("seen") * SAMPLE, "f")).filter("f > 1").drop("seen", "salt")


def index(wide: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """``sig, node, band, n, b0..b3``: the tokens by which candidates are found.

    Only tokens of at least two nodes are kept; each node leaves out its band's spare number of
    them, the most frequent first.
    """
    bands = Bands(percent)
    spare = F.array(*[F.lit(bands.form(i)[1]) for i in range(len(bands.starts) - 1)])
    key = ["doc_id", "d1", "d2"]
    copies = stored(sets.select(*key).join(nodes, ["d1", "d2"]).filter("doc_id <> node").select(*key).distinct())
    own = wide.select(*key, "bands", "tokens").join(small(copies), key, "left_anti")
    exploded = lambda d: d.select(F.col("doc_id").alias("node"), F.explode(F.arrays_zip("bands", "tokens")).alias("z")).select(
        "node", F.col("z.bands").alias("band"), F.explode("z.tokens").alias("sig"))
    some = exploded(own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0))
    common = with_frequency(exploded(own), some).repartition("node")   # for the ranks and the join
    place = F.row_number().over(Window.partitionBy("node", "band").orderBy(F.desc("f"), F.desc("sig")))
    used = common.withColumn("skip", F.element_at(spare, F.col("band") + 1)).withColumn("at", place).filter("at > skip").select("sig", "node", "band")
    return used.join(sets.select(F.col("doc_id").alias("node"), "n", *BITS).distinct(), "node")


def _close(l: str, r: str, percent: int, wide: bool = False) -> Column:
    """A necessary condition for a link, from sizes and sketches; ``wide``: from ``fine`` too, where there is one."""
    a, b = F.col(f"{l}.n"), F.col(f"{r}.n")
    total = a + b
    most = total - 2 * F.ceil(percent * total / (100 + percent))
    differ = sum((F.bit_count(F.col(f"{l}.{x}").bitwiseXOR(F.col(f"{r}.{x}"))) for x in BITS[1:]),
                 F.bit_count(F.col(f"{l}.b0").bitwiseXOR(F.col(f"{r}.b0"))))
    near = (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (differ <= most)
    if not wide:
        return near
    each = F.zip_with(F.col(f"{l}.fine"), F.col(f"{r}.fine"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return near & F.coalesce(F.aggregate(each, F.lit(0), lambda u, v: u + v) <= most, F.lit(True))


def _folded(percent: int):
    """Adds ``fine``, the sketch as wide as the band compares it; null where the 256 bits are that."""
    def rows(batches):
        bands = Bands(percent)
        for b in batches:
            out = []
            for band, raw in zip(b.column("band").to_pylist(), b.column("sketch"), strict=True):
                width = bands.width(band) // 64
                out.append(np.bitwise_xor.reduce(np.frombuffer(raw.as_buffer(), np.uint64).reshape(-1, width), axis=0).view(np.int64)
                           if width > SKETCH_BITS // 64 else None)
            cols = {c: b.column(c) for c in b.schema.names if c != "sketch"}
            yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(out, pa.list_(pa.int64()))], [*cols, "fine"])
    return rows


def _verified(size: int, percent: int):
    def rows(batches):
        last, left = None, None
        for b in batches:
            ok = []
            for p, q in zip(b.column(2), b.column(3), strict=True):
                text = p.as_py()
                if text != last:   # pairs of one source follow one another
                    last, left = text, grams(words_of(text), size)
                right = grams(words_of(q.as_py()), size)
                same = len(left & right)
                ok.append(100 * same >= percent * (len(left) + len(right) - same))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["src", "dst"])
    return rows


def _plausible(percent: int):
    def rows(batches):
        for b in batches:
            src, dst, n, m = (b.column(i).to_pylist() for i in range(4))
            keep = pa.array([differing(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) <= allowed(k, l, percent)
                             for k, l, x, y in zip(n, m, b.column(4), b.column(5), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["src", "dst"])
    return rows


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("src").alias("doc_id")).union(pairs.select(F.col("dst").alias("doc_id"))).distinct()


def verify(pairs: DataFrame, sets: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``src, dst`` that are linked: sketches as fine as the sets drop most others, whole texts decide."""
    pairs = stored(pairs)
    fine = sets.join(small(_ends(pairs)), "doc_id", "left_semi").select("doc_id", "n", *BITS, "sketch").dropDuplicates(["doc_id", "n", *BITS])
    sides = pairs.join(fine.select(F.col("doc_id").alias("dst"), F.col("n").alias("m"), F.col("sketch").alias("y")), "dst").join(
        fine.select(F.col("doc_id").alias("src"), "n", F.col("sketch").alias("x")), "src")
    pairs = stored(sides.select("src", "dst", "n", "m", "x", "y").mapInArrow(_plausible(percent), "src long, dst long").distinct())
    texts = docs.join(small(stored(_ends(pairs))), "doc_id", "left_semi")
    right = pairs.join(texts.select(F.col("doc_id").alias("dst"), F.col("text").alias("q")), "dst")
    both = right.join(texts.select(F.col("doc_id").alias("src"), F.col("text").alias("p")), "src")
    return both.select("src", "dst", "p", "q").mapInArrow(_verified(size, percent), "src long, dst long")


def clusters(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, links_seen``.

    ``n_shingles`` is the number of distinct n-grams of ``size`` words (A-Z lower-cased). Documents
    link when ``100 * |A & B| >= percent * |A | B|``; ``component_id`` is the least id reachable by
    links, its own at least; ``links_seen`` counts the verified links that the search came upon at its set, not all it has.
    A null or empty text has no n-grams and links with nothing. Rows that share an id and a text
    are one document; rows that share an id only are linked as their texts are. Rows without an
    id get a null component and link nothing. Sets are told apart by 128-bit digests.
    """
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spark, usable = docs.sparkSession, "n > 0 and doc_id is not null"
    wide, folder = stored_at(plain.mapInArrow(_set_rows(size, percent), T_SCHEMA))
    sets = stored(wide.drop("bands", "tokens"))
    real = sets.filter(usable)
    nodes = stored(real.groupBy("d1", "d2").agg(F.min("doc_id").alias("node")))
    idx = stored(index(wide.filter(usable), real, nodes, percent))
    discard(spark, folder)   # the tokens, by far the largest table, live on in the index
    pivot = idx.groupBy("sig").agg(F.min(F.struct("node", "n", *BITS)).alias("m")).select("sig", "m.*")
    star = idx.alias("x").join(pivot.alias("p"), "sig").filter(F.col("x.node") != F.col("p.node")).filter(_close("x", "p", percent))
    links = stored(verify(star.select(F.col("p.node").alias("src"), F.col("x.node").alias("dst")).distinct(), real, plain, size, percent))
    rounds = [links]
    label = stored(_labels(links))
    while True:
        marked = idx.join(label, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
        mixed = marked.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("sig", "lo")
        open_, was = stored_at(marked.join(mixed, "sig"))
        # comparing all would cost the square of a token's nodes, less those of one component: first join each to one more pivot
        parts = open_.groupBy("sig", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("sig").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("pairs"), F.sum("n").alias("n"))
        pairs, seen = parts.agg(F.coalesce(F.sum("pairs"), F.lit(0)) / 2, F.coalesce(F.sum("n"), F.lit(0))).first()
        more, pays = None, False
        if pairs > 4 * seen:
            pivot = open_.filter("c > lo").groupBy("sig").agg(F.min(F.struct("c", "node", "n", *BITS)).alias("m")).select("sig", "m.*")
            star = open_.alias("x").join(pivot.alias("p"), "sig").filter(F.col("x.c") != F.col("p.c")).filter(_close("x", "p", percent))
            tried = stored(star.select(F.col("p.node").alias("src"), F.col("x.node").alias("dst")).distinct())
            more = stored(verify(tried, real, plain, size, percent))
            rounds.append(more)
            pays = more.count() * PIVOTS_PAY >= max(1, tried.count())
        if not pays:
            key = [F.col("doc_id").alias("node"), "n", *BITS]
            fine = open_.drop("lo").join(real.select(*key, "sketch").dropDuplicates(["node", "n", *BITS]), ["node", "n", *BITS])
            names = ["node", "n", *BITS, "sig", "band", "c", "sketch"]
            fine, folder = stored_at(fine.select(*names).mapInArrow(_folded(percent), f"{', '.join(f'{x} long' for x in names[:7])}, band int, c long, fine array<long>"))
            cross = fine.alias("x").join(fine.alias("y"), "sig").filter(
                (F.col("x.node") < F.col("y.node")) & (F.col("x.c") != F.col("y.c"))).filter(_close("x", "y", percent, wide=True))
            rounds.append(stored(verify(cross.select(F.col("x.node").alias("src"), F.col("y.node").alias("dst")).distinct(), real, plain, size, percent)))
            discard(spark, folder)
            break
        label = stored(_labels(_all(rounds)))
        discard(spark, was)
    found = _all(rounds)
    found = stored(found.distinct())
    ends = found.select(F.col("src").alias("node")).unionAll(found.select(F.col("dst").alias("node")))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("links_seen"))
    label = stored(_labels(found))
    by_node = stored(nodes.join(label, "node", "left").join(degree, "node", "left").select(
        "d1", "d2", F.coalesce("component", "node").alias("c"), F.coalesce("links_seen", F.lit(0)).alias("links_seen")))
    out = sets.join(by_node, ["d1", "d2"], "left")
    named = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(named, F.coalesce("c", "doc_id")).alias("component_id"),
                      F.when(named, F.coalesce("links_seen", F.lit(0))).otherwise(0).alias("links_seen"))


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _labels(links: DataFrame) -> DataFrame:
    return components(links.select(F.lit(0).alias("grp"), "src", "dst")).select("node", "component")


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that have a smaller id in their group; columns as they were."""
    gone, = fresh(docs.columns, "_gone")
    lost = stored(clusters(docs, text, doc_id, size, percent).filter("component_id < doc_id").select(F.col("doc_id").alias(gone)).distinct())
    return docs.join(small(lost), F.col(doc_id) == F.col(gone), "left_anti")
