"""Near duplicates: frequent tokens, sketches inside the join, and groups of heavily edited copies."""
import random

import numpy as np
import pytest

from measurekit.llm import ngram_join as N
from . import brute


def edited_copies(n_words, copies, edits, seed, first=0):
    r = random.Random(seed)
    text = [f"v{r.randint(0, 3000)}" for _ in range(n_words)]
    out = []
    for i in range(copies):
        own = list(text)
        for _ in range(edits[i % len(edits)]):
            own[r.randrange(n_words)] = f"x{r.randint(0, 10 ** 6)}"
        out.append((first + i, " ".join(own)))
    return out


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect())


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
@pytest.mark.parametrize("frequent", [False, True])
def test_groups_of_edited_copies(spark, monkeypatch, size, percent, frequent):
    if frequent:   # every token that two sampled nodes hold goes the way of frequent ones
        monkeypatch.setattr(N, "SAMPLE", 2)
        monkeypatch.setattr(N, "FREQUENT", 2)
    docs = edited_copies(700, 25, [2, 10, 25, 60, 90], 1) + edited_copies(120, 25, [0, 1, 3, 5, 8], 2, 100) + edited_copies(1500, 8, [20, 60], 3, 200)
    common = " ".join(f"c{i}" for i in range(60))
    docs += [(300 + i, f"{t} {common}") for i, t in edited_copies(150, 20, [150], 4)]   # a passage that unlike texts share
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert rows(N.clusters(df, size=size, percent=percent)) == brute.near(docs, size, percent)


def test_a_sketch_never_differs_more_than_its_sets():
    rng = np.random.default_rng(1)
    bands = N.Bands(80)
    for n in (30, 300, 900, 5000):
        a = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64))
        b = np.unique(np.r_[a[: int(n * .9)], rng.integers(0, 2 ** 63, n // 10, dtype=np.uint64)])
        apart = len(np.setxor1d(a, b))
        for band in set(bands.of(len(a))) & set(bands.of(len(b))):
            width = bands.width(band) // 64
            x, y = (np.bitwise_xor.reduce(N.sketch(s).reshape(-1, width), axis=0) for s in (a, b))
            assert int(np.bitwise_count(x ^ y).sum()) <= apart
