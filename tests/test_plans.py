"""What plans must not do: hash again below a filter, count through one task, pair all columns in one group."""
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from measurekit import dist
from measurekit.operators import folds, gram, graph, linear, prune, stack
from measurekit.plans.views import items


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_gram_pass_hashes_each_fold_once(spark, sf, monkeypatch):
    seen = []
    means = gram.column_means

    def watched(df, cols, known):
        of = F.col(known).isNotNull()
        seen.append(optimised(df.agg(*[F.avg(F.when(of, F.col(c))) for c in cols])))
        return means(df, cols, known)
    monkeypatch.setattr(gram, "column_means", watched)
    g = gram.fold_gram(folds.fold_columns(items(spark, sf), 5, 3), ["x1", "x2"], "target_type", folds.fold_names(3))
    assert len(re.findall(r"md5\(", optimised(g.table))) <= 5
    assert len(re.findall(r"md5\(", seen[0])) <= 2


def test_hot_keys_are_counted_in_the_tasks(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.lit(1).alias("v"))
    hot = dist.hot_keys(df, "k", 100)
    assert sorted(r["k"] for r in hot.collect()) == list(range(7)) and all(r["_salts"] == 2 for r in hot.collect())
    assert dist.hot_keys(df, "k", 1000) is None
    right = spark.range(5).select(F.col("id").alias("k"), F.lit("x").alias("w"))
    assert dist.join_salted(df, right, "k", "left", rows=50).filter("w is null").count() == dist.join_salted(df, right, "k", "left").filter("w is null").count()


GRAPHS = {"chain": [(i, i + 1) for i in range(300)], "star": [(500, i) for i in range(200)], "hubs": [(i % 3 + 1000, i) for i in range(300)] + [(1000, 1001), (1001, 1002)],
          "apart": [(2 * i, 2 * i + 1) for i in range(200)]}


@pytest.mark.parametrize("name", sorted(GRAPHS))
@pytest.mark.parametrize("held", [10 ** 6, 40])
def test_components_without_the_last_task(spark, monkeypatch, name, held):
    """Star rounds alone, with partitions that hold few edges at a time, give what one task gives; partitions leave one edge a node."""
    monkeypatch.setattr(graph, "HELD_EDGES", held)
    df = spark.createDataFrame([("g", a, b) for a, b in GRAPHS[name]], "grp string, src long, dst long").repartition(5)
    one = sorted(map(tuple, graph.components(df).collect()))
    assert sorted(map(tuple, graph.components(df, local_edges=0).collect())) == one
    first = graph._contracted(df.select("grp", F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")))
    assert first.count() <= len(GRAPHS[name])
    if held > len(GRAPHS[name]):
        assert first.groupBy(F.spark_partition_id(), "grp", "u").count().filter("count > 1").isEmpty()


@pytest.mark.parametrize("block, pass_bytes", [(32, 1 << 28), (3, 1 << 28), (2, 1)])
def test_tiled_correlations_equal_pandas(spark, block, pass_bytes):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 7))
    x[:, 3] = x[:, 0] * 2 + .01 * x[:, 3]
    x[:, 5] = 4.0
    x[::6, 1], x[1::7, 4] = np.nan, np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(7)])
    df = spark.createDataFrame(pdf).repartition(4)
    got = prune.correlations(df, list(pdf.columns), block, pass_bytes).toPandas()
    want = pdf.drop(columns="c5").corr()
    assert len(got) == 21 and (got.pos_i < got.pos_j).all()
    for r in got.itertuples():
        if "c5" in (r.i, r.j):
            assert r.r is None or np.isnan(r.r)
        else:
            assert r.r == pytest.approx(want.at[r.i, r.j], abs=1e-9)
    plan = optimised(prune.correlations(df, list(pdf.columns)))
    assert "_all" not in plan


def test_medians_stay_a_table(spark):
    rng = np.random.default_rng(4)
    n = 400
    pdf = pd.DataFrame({"row_id": range(n), "entity": rng.integers(0, 90, n), "target_type": rng.choice(["a", "b"], n), "x": rng.normal(size=n), "z": rng.normal(size=n), "target": rng.normal(size=n)})
    pdf.loc[::4, "x"] = np.nan
    df = folds.fold_columns(spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None))), 3, 2)
    own = df.toPandas()
    g = gram.fold_gram(df, ["x", "z"], "target_type", folds.fold_names(2))
    med = gram.train_medians(df, g, folds.fold_names(2), 3).toPandas()
    assert len(med) == 2 * (1 + 2 * 3)
    for r in med.itertuples():
        side = own[own.target_type == r.target_type]
        if r.fold >= 0:
            side = side[side[f"fold_{r.repeat}"] != r.fold]
        assert r.fill[0] == pytest.approx(side.x.median())


def test_gaps_in_an_ensemble_and_null_keys_in_a_bag(spark):
    rng = np.random.default_rng(6)
    n = 300
    pdf = pd.DataFrame({"row_id": range(n), "entity": rng.integers(0, 60, n), "target_type": np.where(np.arange(n) % 3 == 0, "b", "a"), "x": rng.normal(size=n), "target": rng.normal(size=n)})
    df = spark.createDataFrame(pdf).withColumn("entity", F.when(F.col("row_id") % 10 != 0, F.col("entity")))
    spec = {"r": {"kind": "ridge", "alpha": 1.0}}
    models = linear.fit_linear(folds.fold_columns(df, 5, 1).filter("target_type = 'a'"), ["x"], spec)
    odd = df.limit(4).withColumn("x", F.element_at(F.array(F.lit(float("nan")), F.lit(float("inf")), F.lit(float("-inf")), F.lit(None).cast("double")), (F.col("row_id") % 4 + 1).cast("int")))
    out = [r["pred_r"] for r in linear.predict_ensemble(odd, ["x"], models, "a", ["r"]).collect()]
    assert len(out) == 4 and np.isfinite(out).all() and np.ptp(out) < 1e-12
    bag = stack.seed_bag(df, ["x"], spec, [1, 2])
    assert bag.filter("entity is null and pred_r is not null").isEmpty() and bag.filter("entity is not null and pred_r is null").isEmpty()
    other = stack.seed_bag(df.withColumn("target", F.when(F.col("entity").isNull(), 1e6).otherwise(F.col("target"))), ["x"], spec, [1, 2])
    a, b = (d.filter("entity is not null").orderBy("row_id").toPandas()["pred_r"] for d in (bag, other))
    np.testing.assert_allclose(a, b)
