"""Language identification: a blended-spectrum string kernel with Nystroem landmarks and ridge regression.

A text's features are the presence of its character n-grams of one to four letters (the blended spectrum), hashed to
``2**bits`` places; the kernel of two texts is the number of places both hold, over the geometric mean of what
each holds. A few landmark texts span the kernel: with ``K`` their own kernel matrix, ``K^(-1/2) k(x)`` is
a text's Nystroem map, in which ridge regression is solved once per language against all others. What a fit
needs is a sum over rows, so tasks send matrices as wide as there are landmarks.

``k(x)`` is itself a product of presences and landmarks. Scoring multiplies a batch of texts by the
landmarks and then by the weights, or by the product of both where there are fewer languages than landmarks: the same numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dist import join_small
from .common import stored

NONE = "und"
FIT_TASKS = 16
BATCH = 128
_OTHER = re.compile(r"[\W\d_]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Settings:
    """About ``max_rows`` labelled rows are fitted, in equal shares of the languages as far as these have so many."""
    max_rows: int = 16_000
    landmarks: int = 128
    longest: int = 4
    bits: int = 16
    ridge: float = 1e-3     # penalty for each fitted row


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def presence(text: str, s: Settings) -> np.ndarray:
    """Places of the n-grams of lower-cased letters; all else is one space, also at both ends."""
    plain = f" {_OTHER.sub(' ', text.lower()).strip()} "
    c = np.frombuffer(plain.encode("utf-32-le"), "<u4").astype(np.uint64)
    held = np.zeros(1 << s.bits, bool)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, min(s.longest, len(c)) + 1):
        h = (h[:len(c) - n + 1] + c[n - 1:]) * _A
        h ^= h >> np.uint64(29)
        held[(h * _B) >> np.uint64(64 - s.bits)] = True
    return np.flatnonzero(held)


def products(texts: list[str], matrix: np.ndarray, s: Settings) -> np.ndarray:
    """Rows of normalised presences times ``matrix``."""
    at = [presence(t, s) for t in texts]
    if not at:
        return np.zeros((0, matrix.shape[1]))
    size = np.array(list(map(len, at)))
    return np.add.reduceat(matrix[np.concatenate(at)], np.r_[0, np.cumsum(size)[:-1]], axis=0) / np.sqrt(size)[:, None]


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray   # places x landmarks, columns of equal length
    weights: np.ndarray     # landmarks x languages, the map K^(-1/2) included
    bias: np.ndarray

    def factors(self) -> list[np.ndarray]:
        few = self.weights.shape[1] < self.weights.shape[0]
        return [self.landmarks @ self.weights] if few else [self.landmarks, self.weights]


def fold(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text leaves 2 when divided by 4; a null id counts as one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sample(docs: DataFrame, s: Settings) -> DataFrame:
    """``text, lang, h``: the labelled rows that are fitted, chosen by the hash of their id alone."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~fold(F.col("doc_id")))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
    share = counts.select("lang", (F.lit(s.max_rows / max(1, counts.count())) / F.col("_n")).alias("_share"))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 53))
    return join_small(known.withColumn("h", h), share, "lang").filter(F.col("h") < F.col("_share") * float(1 << 53)).select("text", "lang", "h")


def _moments(model: Model, s: Settings):
    """Sums over a task's rows of ``z z'``, and of ``z`` by language, for ``z`` the Nystroem map and 1."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = model.weights.shape[1] + 1
        total, by = np.zeros((r, r)), {}
        for b in batches:
            texts, langs = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(texts), BATCH):
                z = products(texts[lo:lo + BATCH], model.landmarks, s) @ model.weights
                z = np.column_stack([z, np.ones(len(z))])
                total += z.T @ z
                for row, lang in zip(z, langs[lo:lo + BATCH], strict=True):
                    by[lang] = by.get(lang, 0) + row
        names = [None, *sorted(by)]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total.ravel(), *[by[x] for x in names[1:]]], pa.list_(pa.float64()))], ["lang", "v"])
    return rows


def fit(docs: DataFrame, s: Settings = Settings()) -> Model | None:
    """The model of ``docs`` (``doc_id, text, lang``); None when no row is labelled."""
    rows = stored(sample(docs, s))
    distinct = rows.withColumn("_t", F.xxhash64("text")).dropDuplicates(["lang", "_t"])
    first = Window.partitionBy("lang").orderBy("_t")   # a bounded sample
    picked = distinct.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= s.landmarks).orderBy("_r", "_t").limit(s.landmarks).select("text").collect()
    marks = sorted({r["text"] for r in picked})
    if not marks:
        return None
    held = np.zeros((1 << s.bits, len(marks)))
    for j, t in enumerate(marks):
        at = presence(t, s)
        held[at, j] = 1 / np.sqrt(len(at))
    value, vector = np.linalg.eigh(held.T @ held)
    real = value > 1e-8 * value[-1]
    root = vector[:, real] / np.sqrt(value[real])   # K^(-1/2) on the span of the landmarks
    start = Model([], held.astype(np.float32), root, np.zeros(0))
    sums = rows.repartition(FIT_TASKS, "h").select("text", "lang").mapInArrow(_moments(start, s), "lang string, v array<double>")
    by: dict[str | None, np.ndarray] = {}
    for x in sums.collect():   # for each of FIT_TASKS tasks a matrix, and a row for each language of the sample
        by[x["lang"]] = by.get(x["lang"], 0) + np.array(x["v"])
    width = root.shape[1] + 1
    moments = by.pop(None).reshape(width, width)
    languages = sorted(by)
    sides = np.column_stack([2 * by[x] - moments[-1] for x in languages])   # 1 for the language, -1 for the others
    penalty = np.eye(width) * s.ridge * moments[-1, -1]
    penalty[-1, -1] = 0
    w = np.linalg.solve(moments + penalty, sides)
    return Model(languages, start.landmarks, root @ w[:-1], w[-1])


def scored(docs: DataFrame, model: Model | None, s: Settings, text: str, lang: str, score: str) -> DataFrame:
    if model is None:
        return docs.withColumns({lang: F.lit(NONE), score: F.lit(0.0)})
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.factors(), model.bias))
    out = f"_{lang}_{score}"

    @F.arrow_udf("struct<lang string, score double>")
    def guess(texts: pa.Array) -> pa.Array:
        languages, factors, bias = sent.value
        names, value = [], []
        every = texts.to_pylist()
        for lo in range(0, len(every), BATCH):
            part = every[lo:lo + BATCH]
            real = [t is not None and has_letter(t) for t in part]
            f = products([t for t, ok in zip(part, real) if ok], factors[0], s)
            for m in factors[1:]:
                f = f @ m
            rows = iter(f + bias)
            for ok in real:
                row = next(rows) if ok else None
                names.append(languages[int(row.argmax())] if ok else NONE)
                value.append(float(min(1.0, max(0.0, (row.max() + 1) / 2))) if ok else 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(value, pa.float64())], ["lang", "score"])

    return docs.withColumn(out, guess(F.col(text))).withColumns({lang: F.col(f"{out}.lang"), score: F.col(f"{out}.score")}).drop(out)


def language(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs`` (``doc_id, text, lang``).

    Learns from rows with an id, a text and a ``lang`` that are not held out. A null text, or one without a letter, is
    ``und`` with score 0, as is every text when no row is labelled; all other texts get a learnt language, equal scores the
    first by name, and the score is ``(1 + f) / 2`` of its regression value, cut to 0 to 1. Texts count whole, of any
    length. Every row is scored, repeated ones and those without an id (held out) too; other columns are not read.
    """
    plain = docs.select(F.col("doc_id"), F.col("text"), F.col("lang"))
    out = scored(plain.select("doc_id", "text"), fit(plain, s), s, "text", "lang_pred", "score")
    return out.select("doc_id", fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
