"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates fit rare and frequent features alike, and the L1 term holds most
weights at exactly zero, so the model is a short list of (feature, weight). Shards of a bounded
sample are fitted side by side and their weights averaged; all texts are then scored in one narrow
pass with the list broadcast. Only the text enters a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: ASCII punctuation becomes a space; other bytes, so all letters of any script, stay.
_PLAIN = bytes(32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b for b in range(256))
_A = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """``max_rows`` bounds the labelled rows that the fit sees, dealt to shards of ``shard_rows`` at least; the model has at most ``2**bits`` weights."""
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = .1
    epochs: int = 6
    shard_rows: int = 8_000
    max_rows: int = 48_000


def features(text: str | None, bits: int, known: dict[bytes, int]) -> np.ndarray:
    """Distinct buckets of the text's words, word pairs and pairs with one word between; 0 is the bias."""
    words = (text or "").encode().lower().translate(_PLAIN).split()
    for w in set(words).difference(known):
        known[w] = zlib.crc32(w) | zlib.adler32(w) << 32
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words)) * _A
    h ^= h >> np.uint64(32)
    pairs = (h[:-1] * np.uint64(3) + h[1:]) * _A
    skips = (h[:-2] * np.uint64(5) + h[2:] + np.uint64(1)) * _A
    every = np.concatenate([h * _A, pairs, skips]) >> np.uint64(64 - bits)
    return np.unique(np.append(every, np.uint64(0))).astype(np.int64)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-min(35.0, max(-35.0, x)))))


class Ftrl:
    def __init__(self, s: Settings):
        self.s = s
        self.z, self.n = np.zeros(1 << s.bits), np.zeros(1 << s.bits)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n, s = self.z[at], self.n[at], self.s
        w = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)
        return np.where(np.abs(z) <= s.l1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        grown = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (grown - np.sqrt(self.n[at])) / self.s.alpha * w
        self.n[at] += g * g


def _fit_shards(s: Settings):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        shards: dict[int, list] = {}   # one as a rule; a task may be dealt several
        for b in batches:
            for k, t, y in zip(*[c.to_pylist() for c in b.columns], strict=True):
                shards.setdefault(k, []).append((features(t, s.bits, known).astype(np.int32), y))
        for seen in shards.values():
            model = Ftrl(s)
            for _ in range(s.epochs):
                for at, y in seen:
                    model.learn(at, y)
            w = model.weights(slice(None))
            w[0] = w[0] or 1e-12   # every fitted shard is counted by its bias
            used = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(w[used])], ["feature", "weight"])
    return rows


def fit(texts: DataFrame, labels: DataFrame, s: Settings = Settings()) -> dict[int, float]:
    """Weights by feature from ``doc_id, text`` and ``doc_id, label``; empty when nothing is labelled.

    About ``max_rows`` labels are used, those with the least hashes of their id; they are chosen
    before any text is read and meet the texts by a broadcast that this bound keeps small. A shard
    holds its share in hashed order, so a rerun fits the same model.
    """
    order = F.pmod(F.xxhash64("doc_id"), F.lit(2 ** 62))
    chosen = labels.withColumn("_o", order)
    total = chosen.count()
    if total > s.max_rows:
        chosen = chosen.filter(F.col("_o") < int(2 ** 62 * (s.max_rows / total)))
    rows = texts.join(F.broadcast(chosen), "doc_id")
    shards = max(1, min(total, s.max_rows) // s.shard_rows)
    dealt = rows.withColumn("_shard", F.pmod("_o", F.lit(shards))).repartition(shards, "_shard").sortWithinPartitions("_shard", "_o", "doc_id", F.xxhash64("text"))
    per_shard = stored(dealt.select("_shard", "text", F.col("label").cast("int")).mapInArrow(_fit_shards(s), "feature int, weight double"))
    fitted = per_shard.filter("feature = 0").count()
    found = per_shard.groupBy("feature").agg((F.sum("weight") / F.lit(float(max(1, fitted)))).alias("w")).collect()   # 2**bits at most
    return {r["feature"]: r["w"] for r in found}


def scored(docs: DataFrame, weights: dict[int, float], s: Settings, text: str, name: str) -> DataFrame:
    at = np.array(sorted(weights), np.int64)
    model = docs.sparkSession.sparkContext.broadcast((at, np.array([weights[i] for i in at], np.float64)))
    bits = s.bits

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        used, w = model.value
        dense = np.zeros(1 << bits)
        dense[used] = w
        known: dict[bytes, int] = {}
        out = []
        for t in texts.to_pylist():
            if len(known) > 500_000:
                known.clear()
            out.append(sigmoid(dense[features(t, bits, known)].sum()))
        return pa.array(out, pa.float64())

    return docs.withColumn(name, score(F.col(text)))


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def toxicity(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Learns from the rows of ``labels`` (``doc_id, toxic``) that are not held out; of several labels
    of an id the highest counts, null labels and ids are left out. A null or empty text gets the
    bias alone, a null id counts as held out, and without labels every score is a half.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    texts = docs.select("doc_id", "text")
    weights = fit(texts, known.filter(~held_out(F.col("doc_id"))), s)
    out = scored(texts, weights, s, "text", "score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= .5).cast("int").alias("predicted"))
