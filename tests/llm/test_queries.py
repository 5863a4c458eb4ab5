"""Registered corpus queries over the given tables, against SQL or the plain versions of ``brute``."""
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from . import brute

QUERIES = {k.split("_")[0]: k for k in entry.queries() if k.startswith("op")}


@pytest.fixture(scope="module")
def docs(sf):
    return duckdb.sql(f"select doc_id, text, source from '{sf}/documents.parquet' order by doc_id").fetchall()


def rows(spark, sf, op, *cols):
    return sorted(map(tuple, entry.queries()[QUERIES[op]](spark, sf).select(*cols).collect()))


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if k.startswith("op")))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, sf).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    assert sorted(map(tuple, got[cols].values.tolist())) == sorted(map(tuple, want[cols].values.tolist()))


def test_toxicity(spark, sf, docs):
    got = rows(spark, sf, "op1", "doc_id", "held_out", "score", "predicted")
    assert [r[0] for r in got] == [d for d, *_ in docs]
    assert all(r[1] == (zlib.crc32(str(r[0]).encode()) % 5 == 0) and 0 <= r[2] <= 1 and r[3] == (r[2] >= .5) for r in got)
    assert got == rows(spark, sf, "op1", "doc_id", "held_out", "score", "predicted")


def test_near_duplicates(spark, sf, docs):
    assert rows(spark, sf, "op2", "doc_id", "n_shingles", "component_id") == brute.near([d[:2] for d in docs], 4, 85)


def test_personal_data(spark, sf, docs):
    got = rows(spark, sf, "op3", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    for r, (d, t, _) in zip(got, docs, strict=True):
        n, spans = brute.personal(t)
        assert r[:-1] == (d, *n, brute.sha(",".join(spans)))
        assert r[-1].startswith(",".join(spans))


def test_packing(spark, sf, docs):
    import public_tokenizers as public
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = []
    for d, t, _ in docs:
        ids = own.encode(t or "", add_special_tokens=False).ids + [2]
        edges = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        want += [(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    got = rows(spark, sf, "op4", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    assert [r[:5] for r in got] == want
    filled = {}
    for *_, length, _, seq, offset in sorted(got, key=lambda r: r[5:]):
        assert filled.get(seq, 0) == offset
        filled[seq] = offset + length
    assert max(filled.values()) <= 1024
    assert len(filled) <= 1.01 * sum(filled.values()) / 1024 + 2


def test_token_counts(spark, sf, docs):
    from measurekit.llm.token_counts import MARK, Trie, piece_scores
    scores = piece_scores()
    floor, longest = Trie(scores).floor, max(map(len, scores))

    def viterbi(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            wide = len(word[end - 1].encode())
            options = [(best[end - 1][0] + wide * floor, best[end - 1][1] - wide)]
            options += [(best[a][0] + scores[word[a:end]], best[a][1] - 1) for a in range(max(0, end - longest), end) if word[a:end] in scores]
            best.append(max(options))
        return -best[-1][1]

    known = {w: viterbi(MARK + w) for w in {w for _, t, _ in docs for w in brute.WORD.findall(t)}}
    want = [(d, len(w), sum(known[x] for x in w)) for d, t, _ in docs for w in [brute.WORD.findall(t)]]
    assert rows(spark, sf, "op5", "doc_id", "n_words", "n_tokens") == want


def test_secrets(spark, sf, docs):
    got = rows(spark, sf, "op6", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    for r, (d, t, _) in zip(got, docs, strict=True):
        n, spans = brute.secret(t)
        assert r[:-1] == (d, *n, brute.sha(",".join(spans)))
        assert set(spans) <= set(r[-1].split(",")) | {""}


def test_quality(spark, sf, docs):
    got = rows(spark, sf, "op7", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert [r[:-1] for r in got] == [(d, *brute.quality(t)) for d, t, _ in docs]
    assert not any(r[-1] and r[-2] for r in got)


def test_fingerprints(spark, sf, docs):
    got = rows(spark, sf, "op8", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    want = brute.edited([d[:2] for d in docs])
    assert {r[0]: r[1:3] for r in got} == want
    texts = {d: t for d, t, _ in docs}
    by_text = {}
    for r in got:
        assert by_text.setdefault(texts[r[0]], r[3]) == r[3]
    share = lambda a, b: np.mean([a[i:i + 8] == b[i:i + 8] for i in range(0, len(a), 8)])
    follower = {r[0]: got[i - 1] for i, r in enumerate(got)}
    assert all(r[5] == share(r[3], r[4]) and r[6] == share(r[3], follower[r[0]][3]) for r in got)
    assert np.mean([r[5] > r[6] for r in got]) > .95


def test_mixing(spark, sf, docs):
    sizes = {d: len(brute.WORD.findall(t)) for d, t, _ in docs}
    total = Counter()
    for d, _, s in docs:
        total[s] += sizes[d]
    goal = brute.targets(dict(total))
    got = rows(spark, sf, "op9", "doc_id", "size", "source_size", "target", "taken", "source")
    taken = Counter()
    for (d, size, of, target, took, source), (e, _, s) in zip(got, docs, strict=True):
        assert (d, size, of, source) == (e, sizes[e], total[s], s) and target == pytest.approx(goal[s])
        assert took <= 3 * size
        taken[source] += took
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    assert got == rows(spark, sf, "op9", "doc_id", "size", "source_size", "target", "taken", "source")
