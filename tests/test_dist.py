import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from measurekit import dist


def _frame(spark, kind):
    rng = np.random.default_rng(3)
    n = 4000
    x = {"normal": rng.normal(size=n), "heavy": rng.standard_cauchy(n) ** 3, "ties": rng.integers(0, 3, n).astype(float),
         "one": np.full(n, 7.0)}[kind]
    return pd.DataFrame({"g": np.where(np.arange(n) % 3 == 0, "a", "b"), "x": x})


@pytest.mark.parametrize("kind", ["normal", "heavy", "ties", "one"])
@pytest.mark.parametrize("limit", [50, 10_000])
def test_quantiles_exact_on_both_paths(spark, kind, limit):
    pdf = _frame(spark, kind)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = dist.exact_quantiles(spark.createDataFrame(pdf), "g", "x", probs, group_rows=limit).toPandas().set_index("g")
    want = pdf.groupby("g")["x"].quantile(probs).unstack()
    np.testing.assert_allclose(got.loc[want.index, [f"q{i}" for i in range(5)]].to_numpy(float), want.to_numpy(), rtol=1e-9, atol=1e-9)


def test_quantiles_mixed_group_sizes_and_nulls(spark):
    pdf = pd.DataFrame({"g": ["big"] * 300 + ["small"] * 5 + ["none"] * 2, "x": [*map(float, range(300)), 1., 2., 3., 4., None, None, None]})
    got = dist.exact_quantiles(spark.createDataFrame(pdf), "g", "x", [0.5], group_rows=100).toPandas().set_index("g")["q0"]
    assert got.to_dict() == {"big": 149.5, "small": 2.5}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(3000).select(F.when(F.col("id") < 1500, 1).when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 97).alias("k"), "id")
    right = spark.range(0, 90, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    hot = dist.hot_keys(left, "k", rows=100).collect()
    assert [(r["k"], r["_salts"]) for r in hot] == [(1, 16)]
    assert dist.hot_keys(left, "k", rows=5000) is None
    a = dist.join_salted(left, right, "k", how, rows=100)
    b = left.join(right, "k", how)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_join_small_beyond_its_bound(spark):
    left = spark.range(500).select((F.col("id") % 40).alias("k"), "id")
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") + 1).alias("v"))
    a, b = (dist.join_small(left, right, "k", bound=n) for n in (10, 100))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert "BroadcastHashJoin" in b._jdf.queryExecution().toString()


@pytest.mark.parametrize("k", [2, 5, 7])
def test_cell_ranks_and_tiles_match_windows(spark, k):
    df = spark.range(1003).select(F.when(F.col("id") < 4, "tiny").otherwise("big").alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    got = dist.row_number_by_cell(df, "g", F.substring("h", 1, 2), [F.col("h")], "rn", "tot")
    got = got.withColumn("t", dist.tile(F.col("rn"), F.col("tot"), k))
    want = df.selectExpr("g", "h", "row_number() over (partition by g order by h) rn", f"ntile({k}) over (partition by g order by h) - 1 as t")
    assert sorted(map(tuple, got.select("g", "h", "rn", "t").collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("how", ["left", "left_anti"])
def test_salted_join_spreads_rows_without_a_key(spark, how):
    left = spark.range(2000).select(F.when(F.col("id") < 200, F.col("id") % 7).alias("k"), "id")
    right = spark.range(5).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    a, b = dist.join_salted(left, right, "k", how, rows=100), left.join(right, "k", how)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_samples_are_exact_whatever_the_threshold(spark):
    from measurekit.functions.hashing import hash_order
    from measurekit.operators.clean import sample_n
    df = spark.range(3000).select((F.col("id") % 1000).alias("k"))
    order = [r["k"] for r in df.distinct().orderBy(hash_order(5, F.col("k")), "k").collect()]
    for n in (0, 1, 10, 990, 1000, 2000):
        assert sorted(r["k"] for r in sample_n(df, "k", n, 5).collect()) == sorted(order[:n])
