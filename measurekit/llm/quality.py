"""Quality rules by compression: zstandard ratios of whole texts and of fixed chunks, in bands of length.

Repetitive text compresses far better than prose of its length, random or encoded text far
worse. Short texts carry the codec's overhead and little context, and languages differ, so every
language and band of lengths has its own limits, taken from the ratio quantiles of all documents
that pass the word rules. Two narrow passes over whole texts; between them one aggregate of
histograms that tasks have summed already.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dist import join_small
from .common import SPACES, fresh, stored

SYMBOLS = "#*$%&|<>"
CHUNK = 2048
LEVEL = 3
#: (least bytes, lowest ratio, highest ratio) of a whole text; below the first band nothing is judged.
#: These hold for bands with too few texts for quantiles of their own. The low limits are about three
#: quarters of what prose of the length compresses to, the high ones lie just above it.
BANDS = ((128, .45, 1.02), (256, .42, .80), (384, .41, .76), (512, .40, .74), (768, .38, .68), (1024, .37, .64), (1536, .36, .60),
         (2048, .35, .57), (4096, .34, .56), (16384, .31, .56), (65536, .28, .56))
#: The same for one full chunk; a text goes when more than this share of its chunks lies outside.
CHUNK_LIMITS = (.30, .58)
CHUNK_SHARE = .5
#: No quantile moves a limit past these, whatever fills a band: random letters and digits reach .778 at
#: 1,023 bytes, .754 at 2,047, .742 at 4,095 and .732 beyond.
LEAST_LOW = .15
MOST_HIGH = ((0, 1.02), (256, .80), (512, .75), (1024, .73), (2048, .71), (4096, .70))
#: Texts, or chunks, that a language needs in a band for limits of its own.
ENOUGH = 200
QUANTILES = (.05, .25, .5, .75)
#: Distance of the limits from the median: times the 5 % tail below, times the range of the quartiles above.
LOW_TAILS, HIGH_RANGES = 3.0, 5.0
CHUNKS = -1    # the "band" of chunks
FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "ratio double, low_chunks long, high_chunks long, n_chunks long")


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that are found twice or more, the first find included."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    size = len(ids)
    pair = w[:-1] * size + w[1:]
    if size ** 3 >= 2 ** 63:
        pair = np.unique(pair, return_inverse=True)[1]
    key = pair[:-1] * size + w[2:]
    ranked = np.sort(key)
    if not (ranked[1:] == ranked[:-1]).any():
        return 0
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:shift + n] |= hit
    return int(covered.sum())


def chunk_ratios(raw: bytes, zip_: zstandard.ZstdCompressor) -> list[float]:
    """The ratio of each full chunk."""
    return [len(zip_.compress(raw[at:at + CHUNK])) / CHUNK for at in range(0, len(raw) - CHUNK + 1, CHUNK)]


def word_rules_fail(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def measure(text: str, zip_: zstandard.ZstdCompressor, limits: Sequence[float] = CHUNK_LIMITS) -> tuple:
    """One row of ``FIELDS``."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    chunks = chunk_ratios(raw, zip_)
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeat_words(words),
            len(zip_.compress(raw)) / len(raw) if raw else None,
            sum(r < limits[0] for r in chunks), sum(r > limits[1] for r in chunks), len(chunks))


def _histogram_rows(starts: Sequence[int]):
    """``lang, band, ratio, n`` of the texts that pass the word rules, and of their chunks, ratios to three digits."""
    def rows(batches):
        zip_ = zstandard.ZstdCompressor(level=LEVEL)
        seen: Counter = Counter()
        for b in batches:
            for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = (t or "").encode()
                words = raw.split()
                if len(raw) < starts[0] or len(words) < 50 or word_rules_fail(len(words), repeat_words(words)):
                    continue
                seen[lang, bisect_right(starts, len(raw)) - 1, round(1000 * len(zip_.compress(raw)) / len(raw))] += 1
                seen.update((lang, CHUNKS, round(1000 * r)) for r in chunk_ratios(raw, zip_))
            if len(seen) > 100_000:
                yield _histogram(seen)
                seen.clear()
        yield _histogram(seen)
    return rows


def _histogram(seen: Counter) -> pa.RecordBatch:
    langs, bands, ratios = zip(*seen) if seen else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(bands, pa.int32()), pa.array(ratios, pa.int32()),
                                       pa.array(list(seen.values()), pa.int64())], ["lang", "band", "ratio", "n"])


def limits_of(band: tuple[int, float, float], quantiles: Sequence[float] | None) -> tuple[float, float]:
    """Low and high limit of one band: by the quantiles of its ratios, or as ``band`` has them."""
    low, high = band[1:]
    if quantiles:
        tail, q1, mid, q3 = quantiles
        low, high = max(LEAST_LOW, mid - LOW_TAILS * (mid - tail)), mid + HIGH_RANGES * (q3 - q1)
    return low, min(high, MOST_HIGH[bisect_right([s for s, _ in MOST_HIGH], band[0]) - 1][1])


def ratio_limits(docs: DataFrame, text: str, lang: Column, bands: Sequence[tuple[int, float, float]]) -> tuple[DataFrame, list[float]]:
    """``lang, limits`` for each language with limits of its own, and the limits of all others.

    Limits are low and high of each band in turn and then of chunks. A language has its own in the
    bands where it has ``ENOUGH`` texts; elsewhere all languages together count, and where these are
    too few as well, ``bands`` and ``CHUNK_LIMITS`` hold.
    """
    starts = [b[0] for b in bands]
    hist = docs.select(F.col(text), lang.alias("lang")).mapInArrow(_histogram_rows(starts), "lang string, band int, ratio int, n long")
    hist = stored(hist.groupBy("lang", "band", "ratio").agg(F.sum("n").alias("n")))
    points = F.percentile("ratio", F.array(*map(F.lit, QUANTILES)), F.col("n")).alias("q")
    enough = F.sum("n") >= ENOUGH
    common = {r["band"]: [x / 1000 for x in r["q"]] for r in hist.groupBy("band").agg(points, enough.alias("enough")).filter("enough").collect()}
    judged = {**dict(enumerate(bands)), CHUNKS: (CHUNK, *CHUNK_LIMITS)}

    @F.udf("array<double>")
    def limits(own: list) -> list[float]:
        q = common | {r["band"]: [x / 1000 for x in r["q"]] for r in own}
        return [x for b, band in judged.items() for x in limits_of(band, q.get(b))]

    own = hist.groupBy("lang", "band").agg(points, enough.alias("enough")).filter("enough")
    by_lang = own.groupBy("lang").agg(limits(F.collect_list(F.struct("band", "q"))).alias("limits"))
    return by_lang, [x for b, band in judged.items() for x in limits_of(band, common.get(b))]


def with_quality(docs: DataFrame, text: str = "text", name: str = "quality",
                 bands: Sequence[tuple[int, float, float]] = BANDS, lang: str = "lang") -> DataFrame:
    """``docs`` with a struct ``name``: the fields of ``FIELDS``, ``base_failed`` and ``kept``.

    A null text has no words, no ratio, and fails. Texts under the first band, and texts without
    a full chunk, pass the rule that cannot judge them. Null languages are one language, and so are
    all rows of a table without the column ``lang``. Rows are judged one by one against limits of the whole
    table (``ratio_limits``), so repeated rows get equal verdicts and an empty table stays empty.
    """
    starts = [b[0] for b in bands]
    spoken = F.coalesce(F.col(lang).cast("string"), F.lit("")) if lang in docs.columns else F.lit("")
    by_lang, others = ratio_limits(docs, text, spoken, bands)

    @F.arrow_udf(f"struct<{FIELDS}, verdict boolean>")
    def judged(texts: pa.Array, limits: pa.Array) -> pa.Array:
        zip_ = zstandard.ZstdCompressor(level=LEVEL)
        rows = []
        for t, own in zip(texts.to_pylist(), limits.to_pylist(), strict=True):
            own = own or others
            row = measure(t or "", zip_, own[-2:])
            size = len((t or "").encode())
            band = bisect_right(starts, size) - 1
            fine = band < 0 or own[2 * band] <= row[5] <= own[2 * band + 1]
            rows.append((*row, fine and row[6] + row[7] <= CHUNK_SHARE * row[8]))
        cols = list(zip(*rows)) if rows else [()] * 10
        kinds = [pa.int64()] * 5 + [pa.float64()] + [pa.int64()] * 3 + [pa.bool_()]
        names = [f.split()[0] for f in FIELDS.split(", ")] + ["verdict"]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    m, key, own = fresh(docs.columns, "_measured", "_spoken", "_limits")
    q = join_small(docs.withColumn(key, spoken), by_lang.select(F.col("lang").alias(key), F.col("limits").alias(own)), key, "left")
    return q.withColumn(m, judged(F.col(text), F.col(own))).withColumn(name, _verdict(F.col(m))).drop(m, key, own)


def _verdict(m: Column) -> Column:
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    fields = [m[f.split()[0]].alias(f.split()[0]) for f in FIELDS.split(", ")]
    return F.struct(*fields, failed.alias("base_failed"), (~failed & m["verdict"]).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows whose text passes, with the columns they came with."""
    q, = fresh(docs.columns, "_quality")
    return with_quality(docs, text, q).filter(F.col(q)["kept"]).drop(q)
