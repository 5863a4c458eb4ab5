"""Tokenizer alignment against the definition, and the fragments' laws."""
import functools

import numpy as np
import pytest

from measurekit.llm import alignment as A
from . import brute

KEYS = "doc_id long, text string"
WORDS = ["hello", "wörld", "日本語テキスト", "antidisestablishmentarianism", "x", "<|endoftext|>", "<s>", "1234567", "ﬁ", "\n", "\t\t", "é", "🙂🙂", "", "...", "don't"]


@functools.cache
def tokenizers():
    import public_tokenizers as public
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders
    whole = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    own = A.Tokenizers()
    pieces = SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))

    def b_bytes(i):
        p = pieces.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()
    return (lambda t: [(i, own.a_bytes[i]) for i in whole.encode(f" {t}", add_special_tokens=False).ids],
            lambda t: [(i, b_bytes(i)) for i in pieces.encode(t)])


def random_text(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(5)
    long_ = random_text(rng, 3000)
    return [(i, random_text(rng, int(rng.integers(1, 40)))) for i in range(60)] + [
        (100, None), (101, ""), (102, " "), (103, "a▁b"), (104, "  two  spaces "), (105, long_), (105, long_), (None, long_ + " end"), (None, "x"),
        (106, "nospace" * 900), (107, "日本" * 700 + " z " + "q" * 900), (108, "ok " * 900 + "▁")]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equals_the_definition(spark, docs):
    want = sorted(brute.aligned(docs, *tokenizers()), key=str)
    table = spark.createDataFrame(docs, KEYS).repartition(3)
    assert rows(A.align(table)) == want


@pytest.mark.parametrize("segment, width, fan, part", [(200, 64, 2, 2_000_000), (1000, 50, 3, 100)])
def test_small_segments_ranges_and_parts_change_nothing(spark, docs, monkeypatch, segment, width, fan, part):
    """Long documents go through many segments, several levels of joins and several parts of the pair table."""
    monkeypatch.setattr(A, "FAN", fan)
    monkeypatch.setattr(A.of_segment, "__defaults__", (width,))
    want = sorted(brute.aligned(docs, *tokenizers()), key=str)
    table = spark.createDataFrame(docs, KEYS).repartition(3)
    assert rows(A.align(table, segment=segment, part_pairs=part)) == want


def test_fragments_compose_in_any_grouping():
    rng = np.random.default_rng(9)
    t = A.Tokenizers()(random_text(rng, 400))
    a, a_end, b, b_end = t
    total = int(a_end[-1])
    whole = A.fragment(t, True)
    assert whole.cut and not len(whole.suf[0]) and not len(whole.pre[0])
    for width in (1, 3, 17, 200):
        a_from, b_from = np.r_[0, a_end[:-1]], np.r_[0, b_end[:-1]]
        parts = []
        for lo in range(0, total, width):
            i, k = np.searchsorted(a_from, [lo, lo + width])
            j, m = np.searchsorted(b_from, [lo, lo + width])
            parts.append(A.fragment((a[i:k], a_end[i:k], b[j:m], b_end[j:m]), lo == 0))
        assert any(len(p.pre[0]) + len(p.suf[0]) for p in parts)
        for _ in range(3):   # any order of joining neighbours
            left = list(parts)
            while len(left) > 1:
                i = int(rng.integers(len(left) - 1))
                left[i:i + 2] = [A.compose(left[i], left[i + 1])]
            got = left[0]
            assert (got.n_a, got.n_b, got.n_groups, got.groups) == (whole.n_a, whole.n_b, whole.n_groups, whole.groups)
            assert sorted(got.pairs) == sorted(whole.pairs) and not len(got.suf[0])


def test_segments_tokenise_as_the_whole():
    rng = np.random.default_rng(11)
    tokens = A.Tokenizers()
    for size in (5, 50, 300):
        text = random_text(rng, 500)
        parts = A.segments(text, size)
        assert "".join(parts) == text and len(parts) > 2
        got = [tokens(p if i == 0 else p[1:]) for i, p in enumerate(parts)]
        want = tokens(text)
        assert np.concatenate([g[0] for g in got]).tolist() == want[0].tolist()
        assert np.concatenate([g[2] for g in got]).tolist() == want[2].tolist()


def test_empty_table_and_clashing_columns(spark, docs):
    table = spark.createDataFrame(docs, KEYS)
    assert A.align(table.limit(0)).collect() == []
    some = docs[:30]
    more = spark.createDataFrame(some, KEYS).selectExpr("*", "1 as pair", "2 as times", "'x' as row", "3 as i", "4 as n_best", "5 as start")
    assert rows(A.align(more)) == sorted(brute.aligned(some, *tokenizers()), key=str)


@pytest.mark.parametrize("top", [300, 70_000])
def test_groups_are_written_from_a_table_of_ids(top):
    """Text and links of a fragment against plain loops; also for ids that need a larger table."""
    rng = np.random.default_rng(top)
    for n in (1, 2, 40):
        cuts = [np.unique(np.r_[rng.choice(4 * n, min(4 * n, 2 * n), replace=False) + 1, 4 * n]) for _ in range(2)]
        a, b = (rng.integers(0, top, len(c)) for c in cuts)
        got = A.fragment((a, cuts[0], b, cuts[1]), True)
        groups, links, lo = [], [], 0
        for hi in np.intersect1d(*cuts):
            own = [[(int(i), int(e)) for i, e in zip(ids, ends) if lo < e <= hi] for ids, ends in ((a, cuts[0]), (b, cuts[1]))]
            groups.append("|".join(",".join(str(i) for i, _ in some) for some in own))
            spans = [[(i, s, e) for (i, e), s in zip(some, [lo, *[e for _, e in some]])] for some in own]
            links += [x << A.B_BITS | y for x, s, e in spans[0] for y, s2, e2 in spans[1] if s < e2 and s2 < e]
            lo = hi
        assert got.groups == ";".join(groups) and got.n_groups == len(groups)
        assert sorted(got.pairs.tolist()) == sorted(links)
    assert A.written(8)[[0, 9, 23]].tolist() == [b"0,", b"1|", b"7;"]
