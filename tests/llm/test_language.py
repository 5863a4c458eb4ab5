"""Language identification: held-out accuracy, a plain kernel fit, what is never read, and edges."""
import re
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from measurekit.llm import language as L

KEYS = "doc_id long, text string, lang string"


def out_of_fold(d):
    return d is None or zlib.crc32(str(d).encode()) % 4 == 2


def test_query_over_the_given_table(spark, sf):
    rows = duckdb.sql(f"select doc_id, text, lang from '{sf}/documents.parquet' order by 1").fetchall()
    got = sorted(map(tuple, entry.queries()["op13_language_id"](spark, sf).collect()))
    assert [r[0] for r in got] == [r[0] for r in rows]
    assert all(g[1] == out_of_fold(g[0]) and 0 <= g[3] <= 1 for g in got)
    held = [g[2] == lang for g, (_, _, lang) in zip(got, rows) if g[1]]
    assert len(held) > 20 and np.mean(held) > .97
    assert got == sorted(map(tuple, entry.queries()["op13_language_id"](spark, sf).collect()))


SYLLABLES = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ei", "ung"], "cc": ["ão", "çe", "nh"]}


def planted(n=240, seed=2):
    rng = np.random.default_rng(seed)
    langs = sorted(SYLLABLES)
    return [(i, " ".join("".join(rng.choice(SYLLABLES[lang], 3)) for _ in range(12)), lang) for i in range(n) for lang in [langs[i % 3]]]


def plain_scores(rows, s, texts):
    """Ridge regression on all n-gram sets without hashing; landmarks and rows as the operator picks them from so few."""
    def grams(t):
        t = f" {re.sub(r'[^a-zçãõ]+', ' ', t.lower()).strip()} "
        return {t[i:i + n] for n in range(1, s.longest + 1) for i in range(len(t) - n + 1)}
    kernel = lambda a, b: np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in b] for x in a])
    train = [(grams(t), lang) for d, t, lang in rows if not out_of_fold(d)]
    marks = [g for g, _ in train]
    value, vector = np.linalg.eigh(kernel(marks, marks))
    real = value > 1e-8 * value[-1]
    root = vector[:, real] / np.sqrt(value[real])
    z = np.column_stack([kernel(marks, marks) @ root, np.ones(len(marks))])
    langs = sorted({lang for _, lang in train})
    y = np.array([[1.0 if lang == x else -1.0 for x in langs] for _, lang in train])
    penalty = np.eye(z.shape[1]) * s.ridge * len(train)
    penalty[-1, -1] = 0
    w = np.linalg.solve(z.T @ z + penalty, z.T @ y)
    f = np.column_stack([kernel([grams(t) for t in texts], marks) @ root, np.ones(len(texts))]) @ w
    return langs, f


def test_equals_a_plain_kernel_fit(spark):
    """Every distinct text a landmark, places so many that hashes hardly meet."""
    rows = planted()
    s = L.Settings(landmarks=10_000, bits=20, ridge=1e-2)
    got = sorted(map(tuple, L.language(spark.createDataFrame(rows, KEYS), s).collect()))
    langs, f = plain_scores(rows, s, [t for _, t, _ in rows])
    assert [g[2] for g in got] == [langs[i] for i in f.argmax(1)]
    np.testing.assert_allclose([g[3] for g in got], np.clip((f.max(1) + 1) / 2, 0, 1), atol=5e-3)


def test_fewer_languages_or_fewer_landmarks_score_alike():
    rng = np.random.default_rng(0)
    s = L.Settings(bits=8)
    m = L.Model(["a", "b"], rng.normal(size=(256, 5)), rng.normal(size=(5, 2)), np.zeros(2))
    texts = ["hello there", "wörld", "abc def ghi"]
    assert len(m.factors()) == 1
    np.testing.assert_allclose(L.products(texts, m.factors()[0], s), L.products(texts, m.landmarks, s) @ m.weights)
    assert len(L.Model([], m.landmarks, rng.normal(size=(5, 9)), np.zeros(9)).factors()) == 2


def test_labels_of_held_out_rows_and_other_columns_are_never_read(spark):
    rows = planted()
    base = sorted(map(tuple, L.language(spark.createDataFrame(rows, KEYS)).collect()))
    other = [(d, t, "zz" if out_of_fold(d) else lang) for d, t, lang in rows]
    more = spark.createDataFrame(other, KEYS).selectExpr("*", "'q' as h", "1 as score", "2 as held_out", "'r' as source", "'s' as _share")
    assert sorted(map(tuple, L.language(more).collect())) == base
    assert np.mean([g[2] == r[2] for g, r in zip(base, rows)]) == 1


def test_edges(spark):
    rows = planted()
    odd = [(9001, None, "aa"), (9002, "", "bb"), (9003, "123 ... ²½ _", "cc"), (None, "kaloka milo", "aa"), (9004, "kaloka milo " * 20_000, None),
           (9005, "ǅ", None), (0, rows[0][1], "aa"), (0, rows[0][1], "aa")]
    got = {}
    for d, held, lang, score in L.language(spark.createDataFrame(rows + odd, KEYS)).collect():
        got.setdefault(d, []).append((held, lang, score))
    assert [got[d] for d in (9001, 9002, 9003)] == [[(out_of_fold(d), "und", 0.0)] for d in (9001, 9002, 9003)]
    assert got[None][0][:2] == (True, "aa") and got[9004][0][1] == "aa" and got[9005][0][1] in SYLLABLES
    assert len(got[0]) == 3 and len(set(got[0])) == 1


@pytest.mark.parametrize("rows", [[], [(1, "some text", None), (2, None, "aa")], [(6, "", "aa")]])
def test_nothing_to_learn_from(spark, rows):
    got = L.language(spark.createDataFrame(rows, KEYS)).collect()
    assert len(got) == len(rows) and all(r["lang_pred"] in ("und", "aa") and 0 <= r["score"] <= 1 for r in got)
