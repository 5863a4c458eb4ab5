"""Plain versions: FTRL-proximal step by step, order MinHash by its definition, and what is planted for both."""
import math
import random

import numpy as np
import pytest

from measurekit.llm import fingerprints, toxicity


def plain_ftrl(rows, s):
    """Per-coordinate FTRL-proximal with dictionaries, one row after the other."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= s.l1 else -(zi - math.copysign(s.l1, zi)) / ((s.beta + math.sqrt(n.get(i, 0.0))) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for features, label in rows:
            w = {i: weight(i) for i in features}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values())))))
            g = p - label
            for i in features:
                step = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / s.alpha
                z[i] = z.get(i, 0.0) + g - step * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


@pytest.fixture(scope="module")
def labelled():
    r = random.Random(3)
    mild, bad = [f"w{i}" for i in range(60)], ["vile", "nasty", "foul"]
    rows = []
    for i in range(300):
        y = int(r.random() < .4)
        rows.append((i, " ".join(r.choice(bad if y and r.random() < .3 else mild) for _ in range(20)), y))
    return rows


def test_weights_and_scores_equal_a_plain_fit(spark, labelled):
    from pyspark.sql import functions as F
    s = toxicity.Settings(bits=14, l1=.5, epochs=2, shard_rows=1000, max_rows=1000)
    docs = spark.createDataFrame(labelled, "doc_id long, text string, label int")
    order = {r["doc_id"]: r["o"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2 ** 62)).alias("o")).collect()}
    known = {}
    rows = [(toxicity.features(t, s.bits, known).tolist(), y) for d, t, y in sorted(labelled, key=lambda r: order[r[0]])]
    want = plain_ftrl(rows, s)
    got = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "label"), s)
    assert set(got) | {0} == set(want) | {0}
    np.testing.assert_allclose([got[i] for i in sorted(want)], [want[i] for i in sorted(want)], rtol=1e-7, atol=1e-11)
    out = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, got, s, "text", "score").collect()}
    for d, t, _ in labelled[:50]:
        x = sum(want.get(i, 0.0) for i in toxicity.features(t, s.bits, known).tolist())
        assert out[d] == pytest.approx(1 / (1 + math.exp(-x)), rel=1e-6)


def test_labels_at_the_bound_of_rows_are_cut_by_hash_alone(spark, labelled):
    s = toxicity.Settings(bits=12, max_rows=100, shard_rows=40, epochs=1)
    rows = labelled + [(d, t, y) for d, t, y in labelled[:30]]   # repeated ids and texts
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    a = sorted(map(tuple, toxicity.toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), s).collect()))
    b = sorted(map(tuple, toxicity.toxicity(docs.repartition(7).select("doc_id", "text"), docs.select("doc_id", "toxic"), s).collect()))
    assert a == b and len(a) == len(rows)


def plain_signature(raw):
    """Order MinHash from its definition, on whole numbers: least occurrence-numbered k-mers, put back in text order, hashed as tuples."""
    m64, m32, a, b = 2 ** 64 - 1, 2 ** 32 - 1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9

    def mix(x):
        x = (x ^ (x >> 31)) * a & m64
        x = (x ^ (x >> 29)) * b & m64
        return x ^ (x >> 32)

    k = fingerprints.K
    raw = raw if len(raw) >= k or not raw else raw.ljust(k, b"\0")
    grams = [raw[i:i + k] for i in range(len(raw) - k + 1)]
    if not grams:
        return [0] * fingerprints.TUPLES
    seen, x = {}, []
    for g in grams:   # the n-th occurrence of a k-mer is an element of its own
        h = mix(int.from_bytes(g, "big")) >> 32
        turn = seen[h] = seen.get(h, -1) + 1
        x.append(mix(h + turn * b & m64) >> 32)
    out = []
    for t in range(1, fingerprints.TUPLES + 1):
        mult, shift = (t * 0xD1342543DE82EF95 & m64) >> 13 & m32 | 1, (t * 0xC2B2AE3D27D4EB4F & m64) >> 17 & m32
        least = sorted(range(len(x)), key=lambda i: ((x[i] * mult + shift) & m32, i))[:fingerprints.PICKS]
        least = sorted(least * (fingerprints.PICKS // len(least)))   # a single k-mer stands for itself twice
        value = t - 1
        for i in least:
            value = mix((value * a + x[i]) & m64)
        out.append(value >> 32)
    return out


def test_signatures_equal_order_minhash_by_definition():
    r = random.Random(5)
    texts = ["", "a", "abcdefgh", "abcdefghi", "ab" * 300, "x" * 500, "".join(r.choice("abc ") for _ in range(900)), "Äö " * 900,
             " ".join(r.choice(["one", "two", "three"]) for _ in range(1200))]
    for t in texts:
        assert fingerprints.signature(t.encode()).tolist() == plain_signature(t.encode())


def test_signatures_feel_the_order_of_blocks():
    """The same k-mers in another order: a set of k-mers hardly changes, the signature does."""
    r = random.Random(6)
    blocks = [" ".join(f"{r.choice('bcdfg')}{r.choice('aeiou')}{r.randint(0, 99)}" for _ in range(40)) for _ in range(6)]
    a, b, c = " ".join(blocks).encode(), " ".join(reversed(blocks)).encode(), " ".join([*blocks[:5], blocks[5][:-12] + "zz"]).encode()
    swapped, slight = (fingerprints.likeness(fingerprints.signature(a), fingerprints.signature(x)) for x in (b, c))
    assert slight > .6 and swapped < slight - .2
