import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from measurekit.functions.scalars import array_stats, clip, coarse_key, finite, literal_count, normalize_key
from measurekit.functions.text import fingerprint, sentences, shingles, words
from measurekit.operators import audit, clean, lookup


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_keys_fall_back_and_go_null(spark):
    df = spark.createDataFrame([("  A  b ", "x"), (" ", "Y"), (None, None), ("", " ")], "a string, b string")
    assert [r[0] for r in rows(df.select(normalize_key(F.col("a"), F.col("b"))))] == ["a b", "y", None, None]
    assert [r[0] for r in rows(df.select(coarse_key(F.col("a"))))] == ["187ef4436122d1cc2f40dc2b92f0eba0", None, None, None]   # md5 of "ab"


def test_finite_and_array_stats_edges(spark):
    df = spark.createDataFrame([([1.0, float("nan"), 3.0],), ([],), (None,), ([float("inf"), None],)], "v array<double>")
    got = rows(df.select(*array_stats(F.col("v")).values()))
    assert got[0] == (3.0, 1.0, 2.0, 4.0, 1.0)
    assert got[1:] == [(0.0,) * 5] * 3
    one = spark.createDataFrame([(float("-inf"),), (2.0,), (None,)], "x double")
    assert [r[0] for r in rows(one.select(finite(F.col("x"))))] == [None, 2.0, None]


def test_text_expressions(spark):
    df = spark.createDataFrame([("One two, two THREE",), ("solo",), ("",)], "t string")
    assert rows(df.select(sentences(F.col("t")))) == [(["one", "one two", "two", "two two", "two", "two three", "three"],), (["solo"],), ([],)]
    assert rows(df.select(shingles(words(F.col("t")), 3))) == [(["one two two", "two two three"],), ([],), ([],)]
    assert [len(r[0]) for r in rows(df.select(fingerprint(F.col("t"), 64, 2)))][1:] == [1, 0]
    assert [r[0] for r in rows(df.select(literal_count(F.col("t"), "o")))] == [2, 2, 0]


def test_clip_is_idempotent_and_keeps_null(spark):
    df = spark.createDataFrame([(5.0,), (-5.0,), (None,), (0.5,)], "p double")
    once = df.select(clip(F.col("p"), F.lit(0.0), F.lit(1.0)).alias("p"))
    twice = once.select(clip(F.col("p"), F.lit(0.0), F.lit(1.0)).alias("p"))
    assert rows(once) == rows(twice) == [(1.0,), (0.0,), (None,), (0.5,)]


def test_drop_invalid_reports_counts(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    kept, seen = clean.drop_invalid(df, F.col("x") > 1)
    assert rows(kept) == [(3,)]
    assert seen.get == {"total": 3, "dropped": 2}


def test_sample_is_exact_and_independent_of_partitioning(spark):
    df = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    a = sorted(rows(clean.sample_n(df, "k", 150, 1)))
    b = sorted(rows(clean.sample_n(df.repartition(7).union(df), "k", 150, 1)))
    assert a == b and len(a) == 150
    assert a != sorted(rows(clean.sample_n(df, "k", 150, 2)))


def test_row_ids_number_equal_rows(spark):
    df = spark.createDataFrame([(1, "a")] * 50 + [(2, "b")], "x int, y string").repartition(5)
    ids = [r.row_id for r in clean.with_row_id(df, ["x", "y"]).collect()]
    assert len(set(ids)) == 51 and sorted(int(i.split("-")[1]) for i in ids)[-1] == 50


MEASURED = pd.DataFrame([
    ("a", "k1", "K-1", 1.0), ("a", "k1", "K-1", 1.0), ("a", "k1", "K-1", 1.001), ("a", "k2", "k 1", 9.0), ("a", "k3", "z", 2.0),
    ("a", "k3", "z", 5.0), ("b", "k9", "q", 4.0), ("c", "k1", "n", 3.0), ("c", "k5", "n", 3.0)], columns=["target_type", "entity", "raw", "target"])


def test_duplicate_report_totals(spark):
    df = spark.createDataFrame(MEASURED)
    got = {r.target_type: r for r in audit.duplicate_report(df, coarse_key(F.col("raw"))).collect()}
    assert (got["a"].exact_groups, got["a"].exact_rows, got["a"].exact_consistent, got["a"].exact_conflicting) == (2, 5, 1, 1)
    assert (got["a"].near_groups, got["a"].near_rows, got["a"].near_conflicting) == (1, 4, 1)
    assert (got["c"].near_groups, got["c"].near_consistent) == (1, 1)
    assert (got["b"].exact_groups, got["b"].near_groups) == (0, 0)
    assert (got[None].n, got[None].exact_groups, got[None].near_groups) == (9, 2, 2)


def test_distribution_of_tiny_and_flat_types(spark):
    df = spark.createDataFrame([("one", 2.0), ("flat", 3.0), ("flat", 3.0), ("flat", 3.0), ("two", 1.0), ("two", 2.0)], "target_type string, target double")
    got = {r.target_type: r for r in audit.distribution(df).collect()}
    assert got["one"].y_std is None and got["one"].y_skew is None and got["two"].y_skew is None
    assert got["flat"].y_std == 0.0
    stats = {r.target_type: r.y_std for r in audit.target_stats(df).collect()}
    assert stats["flat"] == 1.0 and stats["one"] == 1.0 and stats["two"] == 0.5


def test_skew_matches_pandas(spark):
    x = np.random.default_rng(0).exponential(size=200)
    df = spark.createDataFrame(pd.DataFrame({"target_type": "t", "target": x}))
    r = audit.distribution(df).first()
    assert math.isclose(r.y_skew, pd.Series(x).skew(), rel_tol=1e-9)
    q = pd.Series(x).quantile([.25, .75])
    lo, hi = q.iloc[0] - 1.5 * (q.iloc[1] - q.iloc[0]), q.iloc[1] + 1.5 * (q.iloc[1] - q.iloc[0])
    o = audit.iqr_outliers(df).first()
    assert o.n_outliers == int(((x < lo) | (x > hi)).sum()) and math.isclose(o.fence_hi, hi)


def test_clip_bounds_floor(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 11.0), ("b", 1.0), ("b", 11.0)], "target_type string, target double")
    got = {r.target_type: (r.clip_lo, r.clip_hi) for r in audit.clip_bounds(df, floors={"b": 0.5}).collect()}
    assert got == {"a": (0.0, 12.0), "b": (0.5, 12.0)}


def test_cross_features_never_show_own_type(spark):
    df = spark.createDataFrame([("k", "a", 1.0), ("k", "a", 3.0), ("k", "b", 10.0), ("z", "b", 4.0), (None, "a", 5.0)], "entity string, target_type string, target double")
    look = lookup.cross_lookup(df, ["a", "b", "absent"])
    got = lookup.cross_features(df, look, ["a", "b", "absent"])
    for r in got.collect():
        assert r[f"xtarget_{r.target_type}"] is None and r[f"known_{r.target_type}"] == 0 and r.xtarget_absent is None
    b = {r.entity: r for r in got.filter("target_type = 'b'").collect()}
    assert b["k"].xtarget_a == 2.0 and b["z"].known_a == 0
    out = lookup.derived_features(got, {"s": ("sum", ["xtarget_a", "xtarget_b"]), "q": ("root", ["xtarget_a"])})
    assert all(r.s is None for r in out.collect())


def test_delta_and_ratio_rules(spark):
    base = spark.createDataFrame([(1, 2.0, 0.0), (2, 4.0, 1.0), (3, float("nan"), 1.0), (4, 1.0, 1.0)], "id int, u double, v double")
    var = spark.createDataFrame([(1, 5.0, 1.0), (2, None, 3.0), (3, 1.0, 1.0)], "id int, u double, v double")
    d = {r.id: (r.delta_u, r.delta_v) for r in lookup.delta_features(base, var, "id", ["u", "v"]).collect()}
    assert d == {1: (3.0, 1.0), 2: (None, 2.0), 3: (None, 0.0), 4: (0.0, 0.0)}
    q = {r.id: (r.ratio_u, r.ratio_v) for r in lookup.ratio_features(base, var, "id", ["u", "v"]).collect()}
    assert q == {1: (2.5, None), 2: (None, 3.0), 3: (None, 1.0), 4: (None, None)}


def test_feature_policy_and_alignment(spark):
    assert clean.feature_cols(["d1", "fp_1", "emb_1"], "t", {"t": ["fp_"]}, ["fp_", "emb_"]) == ["d1", "fp_1"]
    df = spark.createDataFrame([(1, 2.0)], "row_id int, a double")
    assert rows(clean.align(df, ["row_id"], ["b", "a"])) == [(1, None, 2.0)]
