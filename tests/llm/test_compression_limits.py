"""Compression limits: noise of every band goes, and verdicts equal a plain version with limits from quantiles."""
import random
import string
from collections import defaultdict

import numpy as np
import pytest
import zstandard

from measurekit.llm import quality

from . import brute
from .test_edges import words

SIZES = (512, 767, 1_023, 1_535, 2_047, 3_000, 4_095, 10_000, 20_000, 70_000)
LETTERS = string.ascii_letters + string.digits


def spaced(alphabet, size, seed, width=9):
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(width)) for _ in range(size // (width + 1) + 1))[:size]


def plain_kept(docs):
    """``{doc_id: kept}`` of (doc_id, text, lang), one by one with numpy percentiles."""
    zip_ = zstandard.ZstdCompressor(level=3)
    ratio = lambda b: len(zip_.compress(b)) / len(b)
    starts = [b[0] for b in quality.BANDS]
    rows, own = [], defaultdict(list)
    for d, t, lang in docs:
        raw = (t or "").encode()
        band = sum(s <= len(raw) for s in starts) - 1
        whole = ratio(raw) if raw else None
        chunks = [ratio(raw[i:i + 2048]) for i in range(0, len(raw) - 2047, 2048)]
        failed = brute.quality(t)[-1]
        rows.append((d, lang or "", band, whole, chunks, failed))
        if not failed and band >= 0:
            for key in ((lang or "",), ()):
                own[*key, band].append(round(1000 * whole))
                own[*key, "chunk"].extend(round(1000 * x) for x in chunks)

    def limits(lang, band):
        at, low, high = (2048, *quality.CHUNK_LIMITS) if band == "chunk" else quality.BANDS[band]
        v = next((v for key in ((lang, band), (band,)) if len(v := own.get(key, ())) >= 200), None)
        if v is not None:
            tail, q1, mid, q3 = np.percentile(v, [5, 25, 50, 75]) / 1000
            low, high = max(.15, mid - 3 * (mid - tail)), mid + 5 * (q3 - q1)
        return low, min(high, [m for s, m in quality.MOST_HIGH if s <= at][-1])

    out = {}
    for d, lang, band, whole, chunks, failed in rows:
        low, high = limits(lang, "chunk")
        bad = sum(not low <= x <= high for x in chunks)
        low, high = limits(lang, band) if band >= 0 else (0, 9)
        out[d] = not failed and low <= (whole or 0) <= high and bad <= .5 * len(chunks)
    return out


def noise():
    unit = " ".join(words(60, 99).split())
    for n, size in enumerate(SIZES):
        yield f"base64-{size}", spaced(LETTERS + "+/", size, n)
        yield f"alphanumeric-{size}", spaced(LETTERS, size, n)
        if size > 3_000:
            yield f"long-words-{size}", spaced(LETTERS + "+/", size, n, 76)
        yield f"repeated-{size}", (unit[:size // 8] + "\n") * 8


@pytest.mark.parametrize("corpus", ["none", "prose", "half noise"])
def test_noise_fails_in_every_band(spark, corpus):
    own = [(k, t, "en") for k, t in noise()]
    prose = [(f"prose-{n}", words(n, n), "en") for n in (150, 300, 700, 2_000, 8_000)]
    more = {"none": 0, "prose": 250, "half noise": 250}[corpus]
    rest = [(f"more-{i}", words(random.Random(i).randint(200, 220), i), "en") for i in range(more)]
    rest += [(f"junk-{i}", spaced(LETTERS, 1_200, i), "en") for i in range(more * (corpus == "half noise"))]
    docs = own + prose + rest
    got = {r["doc_id"] for r in quality.keep_good(spark.createDataFrame(docs, "doc_id string, text string, lang string")).collect()}
    assert not [k for k, _, _ in own if k in got] and not [k for k, _, _ in rest if k[:4] == "junk" and k in got]
    assert all(k in got for k, _, _ in prose)
    assert got == {k for k, v in plain_kept(docs).items() if v}


def test_a_language_has_limits_of_its_own(spark):
    """Dense writing is kept where it is the rule and goes where it is not."""
    dense = lambda i: spaced("".join(map(chr, range(0x4E00, 0x4E00 + 900))), 700, i, 12)
    docs = [(f"zh-{i}", dense(i), "zh") for i in range(220)] + [(f"en-{i}", words(270, i), "en") for i in range(220)]
    docs += [("stray", dense(999), "en"), ("free", words(270, 999), None), ("none", None, "zh"), ("short", "x", None)]
    got = {r["doc_id"] for r in quality.keep_good(spark.createDataFrame(docs, "doc_id string, text string, lang string")).collect()}
    assert got == {k for k, v in plain_kept(docs).items() if v}
    assert sum(k[:2] == "zh" for k in got) > 200 and sum(k[:2] == "en" for k in got) > 200 and "stray" not in got and "free" in got
