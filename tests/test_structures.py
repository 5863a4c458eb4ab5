import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from measurekit.operators import embed, folds, graph, similarity
from measurekit.sources import tables


def union_find(pairs):
    parent = {}
    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("pairs", [
    [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(9, i) for i in range(9)] + [(9, 50), (60, 61)],
    [(int(a), int(b)) for a, b in np.random.default_rng(1).integers(0, 60, (45, 2)) if a != b]])
def test_components_match_union_find(spark, pairs):
    df = spark.createDataFrame([("g", a, b) for a, b in pairs] + [("h", a + 1000, b + 1000) for a, b in pairs[:3]] + [("g", 5, 5)], "grp string, src long, dst long")
    got = {(r.grp, r.node): r.component for r in graph.components(df).collect()}
    want = {("g", k): v for k, v in union_find(pairs).items()}
    want |= {("h", k + 1000): v + 1000 for k, v in union_find(pairs[:3]).items()}
    assert got == want


def test_component_stats_without_edges(spark):
    edges = spark.createDataFrame([], "grp string, src long, dst long")
    sizes = spark.createDataFrame([("g", 3)], "grp string, n_nodes long")
    assert [tuple(r) for r in graph.component_stats(edges, sizes).collect()] == [("g", 0, 0.0, 0)]


def test_blocked_neighbours_equal_broadcast(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(70, 5)).round(1); v[10] = v[11] = v[12]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id int, v array<double>")
    a, b = (similarity.neighbours(df, "id", "v", df, "id", "v", 6, exclude_self=True, block_rows=n).toPandas().sort_values(["qid", "rank"]) for n in (1000, 20))
    np.testing.assert_allclose(a.distance, b.distance)
    assert (a.rid.values == b.rid.values).all() and len(a) == 70 * 6
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2)); np.fill_diagonal(d, np.inf)
    for q, g in a.groupby("qid"):
        np.testing.assert_allclose(g.distance, np.sort(d[int(q)])[:6], atol=1e-12)


def test_density_edges(spark):
    q = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, [9])], "id int, bits array<int>")
    r = spark.createDataFrame([(1, [1, 2, 3]), (2, [3, 4])], "rid int, bits array<int>")
    got = {x.id: (x.sim_max, x.sim_mean) for x in similarity.density(q, "id", "bits", r, "rid", "bits", 16).collect()}
    assert got == {1: (1.0, (1.0 + .25) / 2), 2: (None, None), 3: (0.0, 0.0)}
    small = {x.id: (x.sim_max, x.sim_mean) for x in similarity.density(q, "id", "bits", r, "rid", "bits", 16, block_rows=1).collect()}
    assert small == got
    none = similarity.density(q, "id", "bits", r.limit(0), "rid", "bits", 16).collect()
    assert all(x.sim_max is None for x in none)


def test_knn_exact_match_averages_matches(spark):
    df = spark.createDataFrame([(1, "t", 0, [0.0], 1.0), (2, "t", 1, [0.0], 5.0), (3, "t", 1, [0.0], 7.0), (4, "t", 1, [2.0], 100.0), (5, "u", 1, [0.0], 9.0)],
                               "id int, target_type string, fold int, vec array<double>, target double")
    got = {r.id: r.pred for r in similarity.knn_regression(df, "id", "vec", 3).collect()}
    assert got[1] == 6.0 and got[5] is None


@pytest.mark.parametrize("mode", ["hash", "balanced"])
def test_folds_keep_keys_together_and_ignore_layout(spark, mode):
    df = spark.range(900).select(F.col("id").alias("row_id"), (F.col("id") % 101).cast("string").alias("entity"), F.when(F.col("id") < 600, "a").otherwise("b").alias("target_type"))
    a = folds.group_kfold(df, 5, mode=mode)
    assert a.groupBy("target_type", "entity").agg(F.count_distinct("fold").alias("n")).filter("n > 1").isEmpty()
    b = folds.group_kfold(df.repartition(6), 5, mode=mode)
    key = lambda d: sorted((r.row_id, r.fold) for r in d.collect())
    assert key(a) == key(b) and len(key(a)) == 900
    if mode == "balanced":
        n = a.select("target_type", "entity", "fold").distinct().groupBy("target_type", "fold").count().toPandas()
        assert (n.groupby("target_type")["count"].agg(np.ptp) <= 1).all()
    leak = folds.leak_check(folds.paired_folds(df)).collect()
    assert len(leak) == 6 and all(r.n_shared == 0 for r in leak)


def test_every_row_has_one_fold_per_repeat(spark):
    df = spark.range(50).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("entity"), F.when(F.col("id") < 10, "s").otherwise("l").alias("target_type"))
    out = folds.repeated_folds(df, folds.repeat_policy(df, 10))
    n = {r.target_type: r["count"] for r in out.groupBy("target_type").count().collect()}
    assert n == {"s": 30, "l": 40} and out.groupBy("row_id", "repeat").count().filter("count > 1").isEmpty()


def test_embedding_averages_known_tokens_only(spark):
    docs = spark.createDataFrame([(1, "red red blue"), (2, "none"), (3, "")], "id int, text string")
    vec = spark.createDataFrame([("red", [1.0, 0.0]), ("blue", [0.0, 3.0])], "word string, v array<double>")
    from pyspark.ml.functions import array_to_vector
    got = {r.id: r.emb for r in embed.embed(docs, "id", "text", vec.select("word", array_to_vector("v").alias("vector")), 2).collect()}
    np.testing.assert_allclose(got[1], [2 / 3, 1.0])
    assert got[2] == [0.0, 0.0] and got[3] == [0.0, 0.0]


def test_sources(spark, tmp_path):
    p = str(tmp_path / "t.csv")
    with open(p, "w") as f:
        f.write("id,name,kind,val\n1,x,a,2.5\n2,y,b,NaN\n")
    m = tables.read_measurements(spark, p, {"row_id": "id", "entity": "name", "target_type": "kind", "target": "val"}, "id long, name string, kind string, val double")
    assert [tuple(r) for r in m.orderBy("row_id").collect()] == [(1, "x", "a", 2.5), (2, "y", "b", None)]
    assert tables.resolve_column([" Other ", "my_NAME"], "NAME", "name") == "my_NAME"
    assert tables.resolve_column(["name_x", " NAME "], "NAME", "name") == " NAME "
    with pytest.raises(ValueError):
        tables.resolve_column(["a", "b"], "NAME", "name")
    with pytest.raises(FileNotFoundError):
        tables.load_decisions(spark, str(tmp_path / "absent"))
    with pytest.raises(ValueError):
        tables.read_measurements(spark, p, {"row_id": "id"})


def test_materialisation_key_covers_labels_and_order(spark):
    a = spark.createDataFrame([(1, "x", 2.0), (2, "y", 3.0)], "id int, s string, y double")
    assert tables.content_key(a) == tables.content_key(a.orderBy(F.desc("id")).repartition(3))
    assert tables.content_key(a) != tables.content_key(a.withColumn("y", F.col("y") + 1))
    assert tables.content_key(a) != tables.content_key(a, "other")
    assert tables.content_key(a) != tables.content_key(a.union(a))


def test_external_predictions_need_full_cover(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "row_id int, target_type string")
    ext = spark.createDataFrame([(1, .5), (3, .7)], "row_id int, pred double")
    got = {r.row_id: (r.covered, r.pred) for r in tables.attach_predictions(df, ext).collect()}
    assert got == {1: (False, None), 2: (False, None), 3: (True, .7)}


def test_stream_scores_like_a_batch(spark, sf, tmp_path):
    from measurekit.operators.audit import clip_bounds
    from measurekit.operators.folds import fold_columns
    from measurekit.operators.linear import fit_linear
    from measurekit.plans.views import items
    from measurekit.streaming.scoring import score_stream, write_stream
    m = items(spark, sf)
    models = fit_linear(fold_columns(m, 5, 1), ["x1", "x2"], {"r": {"kind": "ridge", "alpha": 1.0}})
    bounds = clip_bounds(m)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    m.select("row_id", "target_type", "x1", "x2").write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    q = write_stream(score_stream(stream, models, ["x1", "x2"], "r", bounds), out, str(tmp_path / "ck"))
    q.awaitTermination(120)
    a = spark.read.parquet(out).toPandas().sort_values(["row_id", "pred"])
    b = score_stream(spark.read.parquet(src), models, ["x1", "x2"], "r", bounds).toPandas().sort_values(["row_id", "pred"])
    assert len(a) == m.count() and np.allclose(a.pred.values, b.pred.values)


def test_cells_leave_most_pairs_uncompared(spark, monkeypatch):
    """Exact answers while clustered references keep queries out of far cells."""
    from measurekit.operators.similarity import Cells
    rng = np.random.default_rng(9)
    centres = rng.normal(scale=50, size=(12, 4))
    pts = np.concatenate([c + rng.normal(size=(60, 4)) for c in centres])
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id long, v array<double>")
    got = similarity.neighbours(df, "id", "v", df, "id", "v", 4, exclude_self=True, block_rows=30).toPandas()
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :4]
    have = got.assign(q=got.qid.astype(int)).sort_values(["q", "rank"])["distance"].to_numpy().reshape(-1, 4)
    np.testing.assert_allclose(have, want, atol=1e-9)
    refs = df.selectExpr("cast(id as string) as rid", "'' as grp", "'r' as part", "v as vec", "0.0 as payload")
    cells, dealt = similarity._cells(refs, len(pts), "euclidean", 0, 30)
    held = {(r["cell"], r["block"]): r["n"] for r in dealt.groupBy("cell", "block").agg(F.count("*").alias("n")).collect()}
    vec, grp = pd.Series(list(pts)), pd.Series([""] * len(pts))
    visits = cells.visits(vec, grp, None), cells.visits(vec, grp, pd.Series(want[:, 3]))
    compared = sum(held[v["cell"], v["block"]] for round_ in visits for q in round_ for v in q)
    assert compared < 0.5 * len(pts) ** 2
    assert isinstance(cells, Cells)


def test_equal_points_are_searched_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    n = 600
    pdf = pd.DataFrame({"row_id": [f"r{i:04d}" for i in rng.permutation(n)], "target_type": rng.choice(["a", "b"], n), "fold": rng.integers(0, 3, n),
                        "target": rng.normal(size=n), "vec": [[float(a), float(b)] for a, b in rng.integers(0, 4, (n, 2))]})
    df = spark.createDataFrame(pdf)
    asked = []
    by_cells = similarity._by_cells
    monkeypatch.setattr(similarity, "_by_cells", lambda q, r, *rest: (asked.append((q.count(), r.count())), by_cells(q, r, *rest))[1])
    got = {r["row_id"]: [(x["rid"], x["score"]) for x in r["near"]] for r in similarity.with_neighbours(df, "row_id", "vec", 3, block_rows=20).collect()}
    size = pdf.assign(vec=pdf.vec.map(tuple)).groupby(["target_type", "fold", "vec"]).size()
    assert asked == [(len(size), int(size.clip(upper=3).sum()))] and len(size) <= 96      # 2 types x 3 folds x 16 points
    for r in pdf.itertuples():
        o = pdf[(pdf.target_type == r.target_type) & (pdf.fold != r.fold)]
        d = np.sqrt(((np.stack(o.vec.tolist()) - np.array(r.vec)) ** 2).sum(1))
        want = sorted(zip(d, o.row_id))[:3]
        assert [i for i, _ in got[r.row_id]] == [i for _, i in want] and np.allclose([-s for _, s in got[r.row_id]], [x for x, _ in want])
