"""NaN and infinities, rows without keys, write buckets, ambiguous predictions, and running away from the source."""
import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from measurekit.operators import folds, linear, prune
from measurekit.sources import tables

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    pdf = pd.DataFrame({"row_id": range(400), "entity": rng.integers(0, 80, 400), "target_type": "t", "x1": x[:, 0], "x2": x[:, 1],
                        "target": 3 * x[:, 0] - x[:, 1] + rng.normal(scale=.1, size=400)})
    return spark.createDataFrame(pdf)


def broken(df, values):
    out = df
    for i, v in enumerate(values):
        out = out.withColumn("x1", F.when(F.col("row_id") == 7 + i, F.lit(v).cast("double")).otherwise(F.col("x1")))
    return out


def r2(df):
    f = folds.fold_columns(df, 5, 1)
    models = linear.fit_linear(f, ["x1", "x2"], {"m": {"kind": "ridge", "alpha": 1.0}})
    p = linear.predict_oof(f, ["x1", "x2"], models, ["m"]).select("target", "pred_m").toPandas()
    return 1 - ((p.target - p.pred_m) ** 2).sum() / ((p.target - p.target.mean()) ** 2).sum()


@pytest.mark.parametrize("values", [["NaN"], ["Infinity", "-Infinity", "NaN"]])
def test_broken_numbers_count_as_missing(rows, values):
    bad, null = broken(rows, values), broken(rows, [None] * len(values))
    assert r2(bad) == pytest.approx(r2(null), abs=1e-9) and r2(bad) > .98
    for fn in (lambda d: prune.correlations(d, ["x1", "x2"]), lambda d: prune.feature_variances(d, ["x1", "x2"]),
               lambda d: prune.medians(d, ["x1", "x2"]), lambda d: prune.univariate_scores(d, ["x1", "x2"], "target", "target_type")):
        a, b = ([tuple(r) for r in fn(d).orderBy(*fn(d).columns[:2]).collect()] for d in (bad, null))
        assert str(a) == str(b)
    assert prune.scale_stats(bad, ["x1"])["x1"] == pytest.approx(prune.scale_stats(null, ["x1"])["x1"])


def test_rows_without_a_key_are_on_no_side(rows):
    df = rows.withColumn("entity", F.when(F.col("row_id") >= 100, F.col("entity")))
    both = folds.group_kfold(folds.group_kfold(df, name="a"), mode="balanced", name="b")
    got = both.groupBy(F.col("entity").isNull().alias("none")).agg(F.count(F.lit(1)).alias("n"), F.count("a").alias("a"), F.count("b").alias("b")).collect()
    assert {r["none"]: (r["n"], r["a"], r["b"]) for r in got} == {True: (100, 0, 0), False: (300, 300, 300)}
    assert r2(df) > .98


def test_stages_are_written_in_buckets(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "ROWS_PER_FILE", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    back = tables.write_stage(rows, f"file://{tmp_path}/stage")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert back.count() == 400
    files = [f for _, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")]
    assert 2 <= len(files) <= 4


def test_ambiguous_predictions_cover_nothing(spark, rows):
    ext = rows.select("row_id", F.lit(1.0).alias("pred"))
    assert tables.attach_predictions(rows, ext).filter("covered").count() == 400
    twice = ext.union(spark.createDataFrame([(15, 2.0)], "row_id long, pred double"))
    out = tables.attach_predictions(rows.withColumn("target_type", F.when(F.col("row_id") > 9, F.col("target_type"))), twice)
    assert out.count() == 400 and out.filter("covered or pred is not null").isEmpty()


def test_readers_clean_every_floating_column(spark, tmp_path):
    path = f"file://{tmp_path}/m.parquet"
    spark.createDataFrame([(1, "a", "t", float("nan"), float("inf"))], "row_id long, entity string, target_type string, target double, x1 double").write.parquet(path)
    got = tables.read_measurements(spark, path, {c: c for c in ("row_id", "entity", "target_type", "target", "x1")}).first()
    assert got["target"] is None and got["x1"] is None


def test_runs_from_any_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
from measurekit.session import local_session
spark = local_session(2, 2)
print(e.queries()["ridge_fold_imputed"](spark, "/root/testdata/sf0.001").count(), "rows")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.stdout.strip().endswith("rows"), done.stderr[-2000:]
