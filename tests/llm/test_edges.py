"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names."""
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from measurekit.llm import fingerprints, lines, mixing, ngram_join, packing, pii, quality, secrets, spans, token_counts, toxicity

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("quality", "lines", "tokens", "personal", "_measured", "_doc", "_drops", "_gone", "version", "copy", "size", "rank", "target",
         "n_words", "kept", "_Text", "node", "sig", "score", "_times", "p", "k")


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(n))


BASE = words(80, 1) + "\nA Shared Line of text.\n" + words(40, 2)
NEAR = BASE + " tail"
ROWS = [(1, BASE, "en", "a", 1), (1, BASE, "en", "a", 1), (2, NEAR, None, None, None), (3, None, "en", "b", 0), (4, "", "en", "b", 0),
        (5, " \t\n ", "en", None, 4), (None, BASE, "en", "a", 1), (None, None, None, None, None), (6, words(30_000, 3), "en", "a", 1),
        (7, "é" * 50_000, "fr", "c", 1), (8, "x", "fr", "c", 1), (9, words(60, 4) + "\n  a shared line OF text.\t", "en", "b", 1),
        (10, BASE.upper(), "en", "b", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_quality(docs, empty):
    out = quality.with_quality(docs, name="q")
    assert out.columns == [*docs.columns, "q"]
    got = pairs(out, "doc_id", "text", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "q.base_failed")
    assert got == sorted(((d, t, *brute.quality(t)) for d, t, *_ in ROWS), key=str)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.filter("kept <> 'own kept'").isEmpty()
    assert {r[0] for r in kept.select("doc_id").collect()} == {1, 2, None, 6, 9, 10}
    assert quality.keep_good(empty).count() == 0


def test_compression_bands(spark):
    bad = [(1, "one two three four five six seven eight nine ten eleven twelve " * 300),
           (2, words(400, 5) + " " + "zz zq " * 12_000), (3, words(2_000, 6))]
    noise = random.Random(7)
    bad.append((4, " ".join("".join(chr(noise.randint(33, 126)) for _ in range(8)) for _ in range(800))))
    kept = quality.keep_good(spark.createDataFrame(bad, "doc_id long, text string"))
    assert [r[0] for r in kept.select("doc_id").collect()] == [3]


def test_lines(docs, empty):
    known = [(d, t) for d, t, *_ in ROWS if d is not None]
    out = lines.dedup_lines(docs, name="q")
    got = pairs(out.filter("doc_id is not null"), "doc_id", "q.n_lines", "q.n_dropped", F.sha2("q.text", 256).alias("h"))
    want = sorted(((d, *x[1:]) for (d, _), x in zip(known, brute.line_dedup(known), strict=True)), key=str)
    assert [(*r[:3], r[3] or brute.sha("")) for r in got] == want
    free = out.filter("doc_id is null and text is not null").select("q.text", "q.n_dropped").first()
    assert tuple(free) == (BASE, 0)
    assert lines.deduplicated(docs).columns == docs.columns
    assert lines.deduplicated(empty).count() == 0
    three = lines.dedup_lines(docs, name="q", min_docs=5).filter("doc_id = 9").select("q.n_dropped").first()
    assert three[0] == 0


def test_lines_of_an_id_with_a_null_text(spark):
    rows = [(1, "a line that is shared"), (2, None), (2, "a line that is shared\nand one of its own"), (2, "")]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), name="q")
    got = sorted(((r["doc_id"], r["text"], r["q"]["text"], r["q"]["n_lines"], r["q"]["n_dropped"]) for r in out.collect()), key=str)
    assert got == sorted([(1, rows[0][1], rows[0][1], 1, 0), (2, None, None, 1, 0), (2, "", "", 1, 0),
                          (2, rows[2][1], "and one of its own", 2, 1)], key=str)


def test_near_duplicates(docs, empty):
    known = [(d, t) for d, t, *_ in ROWS if d is not None]
    got = ngram_join.clusters(docs)
    assert pairs(got.filter("doc_id is not null"), "doc_id", "n_shingles", "component_id") == sorted(brute.near(known, 4, 85), key=str)
    assert pairs(got.filter("doc_id is null"), "component_id", "links_seen")[0][0] is None
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r[0] for r in kept.filter("doc_id is not null").select("doc_id").collect()) == [1, 1, 3, 4, 5, 6, 7, 8, 9]
    assert ngram_join.clusters(empty).count() == 0 and ngram_join.one_of_each(empty).count() == 0


def test_texts_that_share_an_id_are_each_linked(spark):
    a, b = words(300, 21), words(500, 22)
    rows = [(5, a), (5, b), (7, a + " end"), (8, b + " end"), (9, words(300, 23))]
    got = ngram_join.clusters(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(5, 5), (7, 5), (8, 5), (9, 9)}


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_near_duplicates_at_the_threshold(spark, size, percent):
    """Chains of edits of every length, sizes from one word on: links just above and just below."""
    r, docs = random.Random(11), []
    for base in range(120):
        n = r.choice([1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 30, 45, 70, 120, 300])
        text = [f"w{r.randint(0, 400)}" for _ in range(n)]
        for _ in range(r.randint(1, 9)):
            docs.append((len(docs), " ".join(text)))
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                at = r.randrange(len(text))
                text = text[:at] + [f"w{r.randint(0, 400)}"] * r.choice([0, 1, 2]) + text[at + 1:] or ["w"]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert pairs(ngram_join.clusters(df, size=size, percent=percent), "doc_id", "n_shingles", "component_id") == sorted(
        brute.near(docs, size, percent), key=str)


def test_bands_hold_every_pair():
    for percent in (80, 85):
        b = ngram_join.Bands(percent)
        for n in [*range(1, 400), 5_000, 77_777]:
            own = set(b.of(n))
            for m in {n, n + 1, n * 100 // percent}:
                if 100 * n >= percent * m:
                    both = own & set(b.of(m))
                    assert both
                    for band in both:
                        parts, spare, deletions = b.form(band)
                        most = ngram_join.allowed(n, m, percent)
                        assert 2 * parts > most if deletions or parts == 1 and not spare else parts - most > spare


def test_mixing(docs, empty):
    mixed, taken = mixing.mix(docs)
    rows = taken.collect()
    assert len(rows) == len(ROWS)
    sizes = sorted(len(brute.WORD.findall(t or "")) for _, t, *_ in ROWS)
    assert sorted(r["size"] for r in rows) == sizes and all(r["taken"] <= 3 * r["size"] for r in rows)
    total = {}
    for _, t, _, s, _ in ROWS:
        total[s] = total.get(s, 0) + len(brute.WORD.findall(t or ""))
    goal = brute.targets(total)
    for s in total:
        assert abs(sum(r["taken"] for r in rows if r["source"] == s) - goal[s]) <= 1
    assert sum(r["tokens"] for r in mixed.collect()) == sum(r["taken"] for r in rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.filter("size <> 'own size'").isEmpty()
    assert mixing.mix(empty)[1].count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_schedule_is_even(spark):
    sources = spark.createDataFrame([("a", 400_000, 10, 0, 1, 200_000.0), ("b", 90_000, 10, 1, 2, 270_000.0), ("c", 500, 10, 2, 3, 700.0)],
                                    "source string, source_size long, n_docs long, rank long, weight int, target double")
    slots = mixing.schedule(sources, block=1000).orderBy("slot").collect()
    took = {}
    for s in slots:
        took[s["source"]] = took.get(s["source"], 0) + s["to"] - s["from"]
    assert took == {"a": 200_000, "b": 270_000, "c": 700}
    share = [sum(s["source"] == "b" for s in slots[i:i + 100]) for i in range(0, 400, 100)]
    assert all(54 <= x <= 61 for x in share)


def test_packing(docs, empty):
    out = packing.pack(docs).collect()
    assert sum(r["piece"] == 0 for r in out) == len(ROWS)
    filled = {}
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 1024
    assert packing.pack(empty).count() == 0


def test_encoder_agrees_with_the_tokenizer_file():
    import public_tokenizers as public
    import numpy as np
    from tokenizers import Tokenizer
    own, other = packing.Encoder(), Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    r = random.Random(3)
    texts = ["", "a <|endoftext|> b", "it's\n\nx  ", *("".join(r.choice("ab \n\t1'.éß日 s$") for _ in range(r.randint(0, 40))) for _ in range(2000))]
    assert all(np.frombuffer(own(t), "<u4").tolist() == other.encode(t, add_special_tokens=False).ids for t in texts)


def test_plan_packs_tightly():
    r = random.Random(5)
    counts = {n: r.randint(0, 400) for n in range(1, 1024)}
    runs = packing.plan(counts, 1024)
    bins = {}
    for run in runs:
        for i in range(run.count):
            bins.setdefault(run.bin + i, []).append((run.offset, run.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024 and sum(3 * n > 1024 for _, n in b) <= 2
    got = {}
    for run in runs:
        got[run.length] = got.get(run.length, 0) + run.count
    assert got == {n: c for n, c in counts.items() if c}
    assert len(bins) <= 1.02 * sum(n * c for n, c in counts.items()) / 1024


def test_personal_data(spark, docs, empty):
    text = "é write to a.b@c-d.example.org or +1 (017) 555-7713, card 4111 1111 1111 1111 host 10.0.0.256 10.0.0.1\n" \
           "IBAN DE89 3704 0044 0532 0130 00, ssn 219-09-9999, 219-09-9999 of nothing near it at all and on and on, born 1980-02-03."
    df = spark.createDataFrame([(1, text), (2, None), (3, "1 " * 3000 + "a@b.c"), (4, "9" * 20_000), (5, "x@y.z " * 700)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest(df).collect()}
    for d, t in [(1, text), (2, None), (3, "1 " * 3000 + "a@b.c"), (4, "9" * 20_000), (5, "x@y.z " * 700)]:
        n, base = brute.personal(t)
        assert (tuple(got[d][f"n_{k}"] for k in pii.BASE), got[d]["base_sha256"]) == (n, brute.sha(",".join(base)))
    kinds = [x.split(":")[0] for x in got[1]["spans"].split(",")]
    assert kinds == ["email", "ip", "card", "phone", "iban", "ssn", "birth"]   # the second ssn has no word beside it
    assert pii.find_personal(docs, name="z").columns == [*docs.columns, "z"]
    assert pii.digest(docs).count() == len(ROWS) and pii.digest(empty).count() == 0


def test_starts_are_running_sums(spark):
    lengths = [random.Random(1).randint(0, 9) for _ in range(1000)]
    for n in (0, 1, 255, 256, 257, 1000):
        got = spark.range(1).select(spans.starts(F.array(*map(F.lit, lengths[:n])).cast("array<int>"))).first()[0]
        assert got == [sum(lengths[:i]) for i in range(n)]


def test_secrets(spark, docs, empty):
    live, copied = "q8Zr5Tn1Lk9Wp3Xs7Vb2", "EXAMPLEkey1234567890abcd"
    rows = [(1, f"Api_Key = '{live}' AKIA{'A1' * 8} token: token: abcdefgh", "a"), (2, f"see {copied}", "a"), (3, f"see {copied}", "b"),
            (4, f"see {live[::-1]}", None), (4, f"see {live[::-1]}", None), (None, "password=hunter22 " + "0f" * 14, "c"), (5, None, "a"), (6, "", "b")]
    got = secrets.digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = [(d, *brute.secret(t)[0], brute.sha(",".join(brute.secret(t)[1]))) for d, t, _ in rows]
    assert sorted(((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got), key=str) == sorted(want, key=str)
    by = {r["doc_id"]: r["spans"] for r in got}
    assert "generic" in by[1] and "generic" not in by[2] and by[4] == "generic:4:24"
    assert secrets.digest(docs).count() == len(ROWS) and secrets.digest(empty).count() == 0


def test_token_counts(docs, empty):
    out = token_counts.count_tokens(docs, name="q")
    assert out.columns == [*docs.columns, "q"]
    by = {(r[0], r[1]): r[2:] for r in out.select("doc_id", "text", "q.n_words", "q.n_tokens").collect()}
    assert by[3, None] == by[4, ""] == by[5, " \t\n "] == (0, 0)
    assert by[7, "é" * 50_000][0] == 1 and by[7, "é" * 50_000][1] > 1000
    assert token_counts.count_tokens(empty, name="q").count() == 0
    scores = token_counts.piece_scores()
    tight = token_counts.Trie(scores, max_nodes=3)
    wide = token_counts.Trie(scores)
    assert all(tight.count(w.encode()) == wide.count(w.encode()) for w in words(500, 8).split())


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (6, 0), (9, 0), (99, 1)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (3, 4, 5)}) == 1
    assert toxicity.toxicity(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {.5}


def test_toxicity_learns(spark):
    r = random.Random(2)
    rows = [(i, words(30, i) + (" you utter moron" if i % 4 == 0 else "")) for i in range(1200)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = toxicity.toxicity(df, df.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))).filter("held_out").collect()
    assert len(out) > 150 and all((r["doc_id"] % 4 == 0) == r["predicted"] for r in out)


def test_fingerprints(docs, empty):
    out = fingerprints.fingerprint_pairs(docs).collect()
    assert len(out) == len(ROWS)
    prints = {}
    for r in out:
        prints.setdefault(r["n_chars"], set()).add(r["fingerprint"])
    assert len(prints[len(BASE)]) <= 2 and len(prints[0]) == 1
    assert fingerprints.fingerprint_pairs(empty).count() == 0
    alone = fingerprints.fingerprint_pairs(docs.filter("doc_id = 8")).first()
    assert (alone["n_chars"], alone["near_next"]) == (1, 1.0)


def test_pipeline(spark, docs, empty):
    for frame in (docs, empty):
        out = frame
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, out, "")
            if i < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == frame.columns
        n = out.count()
    assert n == 0
