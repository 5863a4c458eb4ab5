"""What a task holds, and how often rows are computed."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from measurekit import dist
from measurekit.operators import augment, embed, evaluate, folds, linear, search, similarity, stack
from measurekit.sources import tables


def test_small_inputs_are_dealt_out_by_size(spark, tmp_path, monkeypatch):
    spark.range(200_000).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(tables, "SPREAD_TASK", 50_000)
    assert tables.spread(spark.read.parquet(str(tmp_path / "t"))).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_leak_check_holds_a_key_once_for_all_repeats(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"target_type": rng.choice(["a", "b"], 600), "entity": rng.integers(0, 150, 600), "repeat": rng.integers(0, 3, 600),
                        "fold": rng.choice([0, 1, None], 600)})
    rows = spark.createDataFrame(pdf.astype({"fold": "Int32", "repeat": "int32"}).astype(object).where(pdf.notna(), None),
                                 "target_type string, entity long, repeat int, fold int")
    known = pdf[pdf["fold"].notna()]
    per = known.groupby(["target_type", "repeat", "entity"])["fold"].nunique().reset_index()
    want = per.groupby(["target_type", "repeat"])["fold"].agg([("n", "size"), ("s", lambda f: int((f > 1).sum()))]).reset_index()
    for got in (folds.leak_check(rows), folds.leak_check(rows, repeats=range(4))):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.itertuples(index=False)))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [target_type#" in plan
        assert not any("repeat" in line.split("],")[0] for line in plan.splitlines() if "Aggregate [" in line)


def test_quantiles_compute_their_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(x):
        seen.add(1)
        return float(x)

    n = 4_000
    rows = spark.range(n).select(F.lit("g").alias("g"), watched.asNondeterministic()("id").alias("x"))
    got = dist.exact_quantiles(rows, "g", "x", [0.5], group_rows=200).first()["q0"]
    assert got == (n - 1) / 2 and seen.value == n


def test_queries_stay_with_their_crowd(spark, monkeypatch):
    """Each query is dealt out once, whatever the cells it visits; ties go to the least ids."""
    monkeypatch.setattr(similarity, "CROWD_ROWS", 40)
    monkeypatch.setattr(similarity, "TILE", 7)
    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.normal(size=(250, 12)), rng.integers(0, 2, (150, 12))]).round(3)
    df = spark.createDataFrame([(f"r{i:03d}", p.tolist()) for i, p in enumerate(pts)], "id string, v array<double>")
    met, streamed = similarity._met, []
    monkeypatch.setattr(similarity, "_met", lambda crowds, refs, n, *rest: (streamed.append((crowds.count(), refs.count(), n)), met(crowds, refs, n, *rest))[1])
    got = similarity.neighbours(df, "id", "v", df, "id", "v", 5, exclude_self=True, block_rows=20).orderBy("qid", "rank").toPandas()
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    at = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert got["rid"].tolist() == [f"r{j:03d}" for j in at.ravel()]
    np.testing.assert_allclose(got["distance"], np.take_along_axis(d, at, 1).ravel(), atol=1e-9)
    assert [s[0] for s in streamed] == [400, 400] and all(refs <= 400 * n for _, refs, n in streamed)


def test_pca_density_projects_once(spark, monkeypatch):
    """The searches read points from a checkpoint, and columns come back scaled as before."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, *map(float, rng.normal(size=12))) for i in range(60)], "id long, " + ", ".join(f"c{i} double" for i in range(12)))
    plans, search = [], embed.neighbour_density
    monkeypatch.setattr(embed, "neighbour_density", lambda d, *rest, **more: (plans.append(d._jdf.queryExecution().optimizedPlan().toString()), search(d, *rest, **more))[1])
    out = embed.pca_density(df.filter("id < 40"), df, "id", [f"c{i}" for i in range(12)], n=3, k=5)
    assert out.count() == 60 and out.columns == [*df.columns, "mean_distance", "sparse"]
    assert len(plans) == 2 and all("UDF" not in p and "LogicalRDD" in p for p in plans)


def test_linear_search_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(x):
        seen.add(1)
        return float(x % 17)

    n = 600
    rows = spark.range(n).select(F.lit("t").alias("target_type"), F.col("id").alias("entity"), (F.col("id") % 13).cast("double").alias("x"),
                                 watched.asNondeterministic()("id").alias("target"))
    got = search.search_linear(rows, ["x"], {"kind": "ridge", "alpha": 1.0}, {"alpha": (1e-3, 1e3)}, n=2, repeats=1).collect()
    assert len(got) == 1 and seen.value == n


def _watched_rows(spark, seen, n=600):
    @F.udf("double")
    def watched(x):
        seen.add(1)
        return float(x % 17)

    return spark.range(n).select(
        F.col("id").cast("string").alias("row_id"), F.col("id").alias("entity"), F.element_at(F.array(*map(F.lit, "abc")), (F.col("id") % 3 + 1).cast("int")).alias("target_type"),
        (F.col("id") % 13).cast("double").alias("target"), watched.asNondeterministic()("id").alias("x1"), (F.col("id") % 7).cast("double").alias("x2"))


def test_cross_model_computes_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = folds.fold_columns(_watched_rows(spark, seen), 5, 1).withColumn("xtarget_a", F.when(F.col("target_type") != "a", F.col("x1")))
    got = evaluate.nested_score(augment.cross_model_oof(rows, ["xtarget_a", "x2"], {"kind": "ridge", "alpha": 1.0}), "pred_cross").toPandas()
    assert seen.value == 600 and got["n"].sum() == 400   # type a has no cross value, so no prediction


def test_scores_of_predictions_look_coefficients_up_once(spark):
    """The condition on a prediction is not pushed below its lookup, where it would be repeated for each feature."""
    rows = folds.fold_columns(_watched_rows(spark, spark.sparkContext.accumulator(0)), 5, 1)
    models = linear.fit_linear(rows, ["x1", "x2"], {"ols": {"kind": "ridge", "alpha": 0.0}})
    plan = evaluate.nested_score(linear.predict_oof(rows, ["x1", "x2"], models, ["ols"]), "pred_ols")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("element_at(_m_ols") + plan.count("try_element_at(_m_ols") <= 2


def test_scores_leave_out_rows_without_target_or_prediction(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 3.0), ("a", None, 1.0), ("a", 9.0, None), ("b", 4.0, None)], "target_type string, target double, pred double")
    assert [tuple(r) for r in evaluate.r2_rmse(rows, ["target_type"]).collect()] == [("a", 2, 0.5, 0.5 ** 0.5)]


def test_tree_search_computes_its_rows_once_and_sends_a_group_once_for_several_fits(spark, monkeypatch):
    from measurekit.operators import histograms
    seen, sent, grow = spark.sparkContext.accumulator(0), [], histograms.grown_here
    monkeypatch.setattr(histograms, "HERE_TASKS", 1)
    monkeypatch.setattr(histograms, "grown_here", lambda rows, fits, groups: (sent.append((len(fits), groups)), grow(rows, fits, groups))[1])
    rows = _watched_rows(spark, seen)
    got = search.search_roster(rows, ["x1", "x2"], {"kind": "gbt", "maxIter": 3, "maxDepth": 2, "stepSize": .3}, {"maxDepth": [1, 2]}, n=2, repeats=1)
    assert got.count() == 3 and seen.value == 600
    assert sent[0] == (6, 3)      # all candidates and folds


def test_fits_out_of_fold_store_their_rows_once_and_no_bins(spark, monkeypatch):
    from measurekit.operators import histograms, trees
    spec, kept, whole = {"kind": "gbt", "maxIter": 2, "maxDepth": 2, "stepSize": .3}, [], histograms.cut
    monkeypatch.setattr(histograms, "cut", lambda df: (kept.append(df.columns), whole(df))[1])
    for fit in (lambda df: trees.shared_oof(df, ["a", "b", "c"], ["x1", "x2"], spec), lambda df: trees.tree_oof(df, ["x1", "x2"], spec, "p", by="target_type")):
        seen = spark.sparkContext.accumulator(0)
        out = fit(folds.fold_columns(_watched_rows(spark, seen), 5, 1))
        assert out.count() == 600 and seen.value == 600 and "_s" not in out.columns
    assert kept and not [c for c in kept if "bins" in c]      # trees alone are written to checkpoints


def test_dense_chain_computes_a_step_once(spark, monkeypatch):
    """Each source's rows and each consumer's widened rows go through one cut, whatever the passes of the fits."""
    kept, whole = [], augment.cut
    monkeypatch.setattr(augment, "cut", lambda df: (kept.append(df.columns), whole(df))[1])
    seen = spark.sparkContext.accumulator(0)
    rows = _watched_rows(spark, seen).localCheckpoint()
    augment.dense_chain(rows, rows, [("a", ["b"])], ["x1", "x2"], {"ols": {"kind": "ridge", "alpha": 0.0}})
    assert [c for c in kept if "dense_a" in c] == [["target_type", "target", "x1", "x2", "dense_a", "fold_0", "fold_1", "fold_2"]]
    assert ["target_type", "target", "x1", "x2", "fold_0"] in kept


def test_dense_chain_reaches_models_of_some_features(spark, monkeypatch):
    """The gate's second model has the new column, and an accepted one is part of the consumer's own models as a source."""
    given, whole = [], stack.oof_matrix
    monkeypatch.setattr(stack, "oof_matrix", lambda df, feats, specs, *more: (given.append(specs), whole(df, feats, specs, *more))[1])
    i = F.col("id")
    rows = spark.range(900).select(
        i.cast("string").alias("row_id"), (i % 60).cast("string").alias("entity"), F.element_at(F.array(*map(F.lit, "abc")), (i % 3 + 1).cast("int")).alias("target_type"),
        F.pmod(F.xxhash64(i), F.lit(100)).cast("double").alias("x1"), F.pmod(F.xxhash64(i + 5000), F.lit(100)).cast("double").alias("x2"), (i % 11).alias("n"))
    rows = rows.withColumn("target", F.col("x1") + 3 * F.col("x2") + F.col("n")).localCheckpoint()
    specs = {"one": {"kind": "ridge", "alpha": 0.0, "only": ["x1"]}, "two": {"kind": "ridge", "alpha": 0.0, "only": {"a": ["x2"], "b": ["x2"]}}}
    tr, _sc, verdicts = augment.dense_chain(rows, rows, [("a", ["b"]), ("b", ["c"])], ["x1", "x2"], specs)
    got = {(r["source"], r["target_type"]): r for r in verdicts.collect()}
    assert got["a", "b"]["accepted"] and got["a", "b"]["delta"] > .5 and got["b", "c"]["accepted"] and got["b", "c"]["delta"] > .5
    assert [s["one"]["only"] for s in given] == [["x1"], ["x1", "dense_a"]] and given[1]["two"]["only"]["b"] == ["x2", "dense_a"]
    assert tr.filter("target_type = 'c'").agg(F.count("dense_b")).first()[0] == 300


def test_edges_read_texts_once_and_leave_out_keys_of_one_document(spark, monkeypatch):
    from measurekit.plans import q_audit
    seen, line = spark.sparkContext.accumulator(0), "a line of more than forty characters, number {}"

    @F.udf("string")
    def watched(text):
        seen.add(1)
        return text

    texts = [(1, "s", "Same text!"), (2, "s", "same TEXT"), (3, "s", line.format(1)), (4, "s", line.format(1) + "\n" + line.format(2)), (5, "s", "alone\n" + line.format(3)),
             (6, "t", "same text"), (7, "s", None), (8, "s", "x\n" + line.format(2)), (9, "s", "y\n" + "\n".join([line.format(4)] * 2))]
    rows = spark.createDataFrame(texts, "doc_id long, source string, text string").localCheckpoint()
    monkeypatch.setattr(q_audit, "table", lambda *_: rows.withColumn("text", watched.asNondeterministic()("text")))
    edges, _nodes = q_audit._edges(spark, "")
    assert sorted({tuple(r) for r in edges.collect()}) == [("s", 2, 1), ("s", 4, 3), ("s", 8, 4)]
    assert seen.value <= 2 * len(texts)      # once for whole texts, once for lines


def test_cells_travel_without_the_package(spark):
    """Executors have no package: the broadcast is bytes that name no module of it."""
    import subprocess
    import sys
    import tempfile

    from pyspark import cloudpickle
    sent = cloudpickle.dumps(similarity.Cells(np.eye(2), "euclidean", 0, {"": np.ones(2)}, {"": np.ones(2)}))
    code = "import sys; from pyspark import cloudpickle; c = cloudpickle.loads(sys.stdin.buffer.read()); print(c.distances([[1.0, 0.0]]).round(3).tolist())"
    with tempfile.TemporaryDirectory() as away:
        done = subprocess.run([sys.executable, "-c", code], input=sent, capture_output=True, cwd=away, env={"PATH": ""})
    assert done.stdout.decode().strip() == "[[0.0, 1.414]]", done.stderr.decode()[-500:]
    held, whole = [], spark.sparkContext.broadcast
    df = spark.createDataFrame([(str(i), [float(i % 7), float(i)]) for i in range(60)], "id string, v array<double>")
    try:
        spark.sparkContext.broadcast = lambda x: (held.append(x), whole(x))[1]
        assert similarity.neighbours(df, "id", "v", df, "id", "v", 2, exclude_self=True, block_rows=20).count() == 120
    finally:
        del spark.sparkContext.broadcast
    assert held and all(isinstance(x, bytes) for x in held)
