"""Ranked search: exact against the definition, at the edges, in blocks and with seeded bounds."""
import numpy as np
import pytest

from measurekit.llm import fp_search as S
from . import brute

KEYS = "doc_id long, text string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (str(r[0]), r[1]))


def random_docs(seed=1, n=900):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(300)] + ["Été", "straße", "W1", "x-y", "日本"])
    p = 1 / np.arange(1, len(words) + 1)
    docs = [(int(i), " ".join(rng.choice(words, rng.integers(1, 60), p=p / p.sum()))) for i in rng.permutation(n)]
    return docs + docs[:40] + [(10_000 + i, docs[3][1]) for i in range(60)] + [(None, docs[5][1]), (None, None), (20_000, ""), (20_001, " .,; ")]


ITEMS = [(0, "w1 w2 w3 w40 w41"), (1, "w299 w298 Été été ÉTÉ"), (2, "w1 w1 w1 w7"), (3, None), (4, ""), (5, "none of these"), (5, "w9,w10;w11"), (None, "w12 日本"), (7, "...")]


@pytest.fixture(scope="module")
def small(spark):
    docs = random_docs()
    return docs, spark.createDataFrame(docs, KEYS).repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string")


def want(docs, items, top=20):
    return sorted(brute.ranked(docs, items, top), key=lambda r: (str(r[0]), r[1]))


def test_equals_the_definition(small):
    docs, d, i = small
    assert rows(S.ranked(d, i)) == want(docs, ITEMS)


@pytest.mark.parametrize("args", [{"block_terms": 3}, {"seed_docs": 50}, {"top": 3}, {"top": 3, "seed_docs": 20, "block_terms": 5}])
def test_blocks_of_items_and_seeded_bounds_change_nothing(small, args):
    docs, d, i = small
    assert rows(S.ranked(d, i, **args)) == want(docs, ITEMS, args.get("top", 20))


def test_many_small_tries_find_the_same(small, monkeypatch):
    docs, d, i = small
    monkeypatch.setattr(S, "BLOCK_DOCS", 37)
    monkeypatch.setattr(S, "LEAF", 2)
    assert rows(S.ranked(d, i)) == want(docs, ITEMS)


def test_bounds_hold_and_leave_subtrees_out():
    rng = np.random.default_rng(3)
    seqs = [np.unique(rng.integers(0, 60, 12)) for _ in range(2000)]
    tfs = [rng.integers(1, 6, len(s)) for s in seqs]
    by = sorted(range(2000), key=lambda d: seqs[d].astype(">u4").tobytes())
    seqs, tfs = [seqs[d] for d in by], [tfs[d] for d in by]
    m = rng.integers(75, 130, 2000)
    tree = S.Tree(seqs, tfs, m)
    terms, weight = np.array([0, 5, 30, 59]), np.array([10, 500, 900, 4000])
    score = np.array([sum(w * (10 ** 9 * tf[s == t][0] // (1000 * tf[s == t][0] + 12 * k)) for t, w in zip(terms, weight) if t in s)
                      for s, tf, k in zip(seqs, tfs, m)])

    def check(i):
        """The greatest score below a node, which its parent's bound must reach."""
        _, _, _, first, n, leaf = tree.node[i]
        got = tree.scores(i, terms, weight)
        if leaf:
            assert (got == score[first:first + n]).all()
            return got.max()
        below = [check(first + k) for k in range(n)]
        assert (got >= below).all()
        return max(below)

    assert check(0) == score.max()
    best = S.Best(5, 0)
    visited = S.walk(tree, np.zeros(2000, bool), np.arange(2000), terms, weight, best)
    assert best.score.tolist() == sorted(score, reverse=True)[:5]
    assert visited < .8 * len(tree.node)


def test_empty_tables_and_clashing_columns(spark, small):
    docs, d, i = small
    none_d, none_i = d.limit(0), i.limit(0)
    assert S.ranked(none_d, i).collect() == S.ranked(d, none_i).collect() == S.ranked(none_d, none_i).collect() == []
    cols = ["n", "tf", "terms", "item", "rank", "score", "cell", "visited"]
    more = d.selectExpr("*", *[f"'x' as {c}" for c in cols])
    assert rows(S.ranked(more, i.selectExpr("*", *[f"1 as {c}" for c in cols]))) == want(docs, ITEMS)


def test_a_very_long_text_counts_whole(spark):
    docs = [(1, "a b " * 40_000 + "zebra"), (2, "a b"), (3, "zebra")]
    items = [(1, "zebra"), (2, "a")]
    got = S.ranked(spark.createDataFrame(docs, KEYS), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == want(docs, items)
