"""Queries over models, fold scores, rankings and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..columns import FOLD, KEY, MODEL, PRED, REPEAT, ROW, TYPE, Y
from ..functions.scalars import TRANSFORMS, rounded
from ..operators import audit, clean, evaluate, linear, output, stack, trees
from ..operators.folds import SEED, fold_columns, fold_names
from ..operators.linear import coefficients, fit_linear, gram_scores, long_oof, predict_ensemble, predict_full, predict_oof
from ..sources.tables import check_output
from .registry import query
from .views import (ITEM_TYPES, R2, RMSE, events, items, r6, scoring_side, sql_fold, sql_linear, sql_linear2, sql_long,
                    sql_pred, table, with_)

OLS = {"kind": "ridge", "alpha": 0.0}
RIDGE = {"kind": "ridge", "alpha": 5.0}
MEAN = {"kind": "mean"}
ROSTER = ["mean", "ridge1", "ols1"]


def cte(*parts: str) -> str:
    return with_(*parts)


def rounds(df, *cols, digits=6):
    return df.withColumns({c: rounded(F.col(c), digits) for c in cols})


# Three one-feature models on the items, scored per fold; the base of most gates below.
def _scores_sql(repeats=3, src="m_items"):
    parts = [sql_long("a", src, repeats)]
    spec = {"mean": (None, 0.0), "ols1": ("x1", 0.0), "ridge1": ("x1", 500000.0), "ols3": ("x3", 0.0)}
    for n, (x, a) in spec.items():
        parts += sql_linear(n, "a_f", x, a) + [sql_pred(n, "a_f", x, f"{n}_p")]
    union = " union all ".join(
        f"select target_type, '{n}' as model, repeat, fold, count(*) as n, {R2} as r2, {RMSE} as rmse from {n}_p group by all" for n in spec)
    return parts + [f"sc as ({union})",
                    "su as (select target_type, model, avg(r2) as mean_r2, stddev_pop(r2) as std_r2, count(r2) as n_folds from sc group by all)"]


SCORES = _scores_sql()


def _models(m, repeats=3):
    """The same models from one Gram pass; each looks at its own feature only."""
    return fit_linear(m, ["x1", "x3"], {
        "mean": MEAN, "ols1": {**OLS, "only": ["x1"]}, "ols3": {**OLS, "only": ["x3"]},
        "ridge1": {"kind": "ridge", "alpha": 500000.0, "only": ["x1"]}}, repeats=repeats)


def _long(spark, d, repeats=3):
    m = fold_columns(items(spark, d).select(ROW, KEY, TYPE, Y, "x1", "x3"), 5, repeats)
    names = ["mean", "ols1", "ridge1", "ols3"]
    p = predict_oof(m, ["x1", "x3"], _models(m, repeats), names, repeats, per_repeat=True)
    return long_oof(p, names, repeats, [ROW, TYPE, Y])


def _scores(spark, d):
    """Fold scores from the held-out Grams: no row is predicted to score a linear model."""
    return gram_scores(_models(fold_columns(items(spark, d).select(KEY, TYPE, Y, "x1", "x3"), 5, 3)))


def _summary(spark, d):
    s = evaluate.summarize_scores(_scores(spark, d))
    return spark.createDataFrame(s.collect(), s.schema)   # types x models rows


@query("cv_r2_baseline", "J1 K12 L1 L2 L3 B1", cte("m_items", sql_long("a", "m_items", 1), *sql_linear("o", "a_f", "x1"), sql_pred("o", "a_f", "x1", "p")) + f""",
s as (select target_type, repeat, fold, {R2} as r2 from p group by all), u as (select target_type, avg(r2) m, stddev_pop(r2) s from s group by 1)
select target_type, {r6('m', 'mean_r2')}, {r6('s', 'std_r2')}, {r6('avg(m) over ()', 'headline')} from u""")
def _(spark, d):
    m = fold_columns(items(spark, d).select(KEY, TYPE, Y, "x1"), 5, 1)
    s = evaluate.summarize_scores(gram_scores(fit_linear(m, ["x1"], {"ols1": OLS})))
    head = evaluate.mean_r2(s).select(MODEL, F.col("mean_r2").alias("headline"))
    return rounds(s.join(head, MODEL), "mean_r2", "std_r2", "headline").select(TYPE, "mean_r2", "std_r2", "headline")


@query("mean_predictor", "K11", cte("m_items", sql_long("a", "m_items", 1), *sql_linear("o", "a_f", None)) + f"""
select target_type, fold, n::double as n_train, {r6('b0', 'b0')} from o_c""")
def _(spark, d):
    m = fold_columns(items(spark, d), 5, 1)
    return rounds(fit_linear(m, ["x1"], {"mean": MEAN}).select(TYPE, FOLD, "n_train", "b0"), "b0")


@query("one_feature_ols", "K12 K1", cte("m_items", sql_long("a", "m_items", 3), *sql_linear("o", "a_f", "x1")) + f"""
select target_type, repeat, fold, {r6('b0', 'b0')}, {r6('b', 'b1')} from o_c""")
def _(spark, d):
    m = fold_columns(items(spark, d), 5, 3)
    out = fit_linear(m, ["x1"], {"ols1": OLS}, repeats=3)
    return rounds(out.select(TYPE, REPEAT, FOLD, "b0", F.col("coefs")[0].alias("b1")), "b0", "b1")


@query("ridge_two_features", "K1", cte("m_items", sql_long("a", "m_items", 1), *sql_linear2("o", "a_f", "x1", "x3", 5.0)) + f"""
select target_type, fold, {r6('b0', 'b0')}, {r6('b1', 'b1')}, {r6('b2', 'b2')} from o_c""")
def _(spark, d):
    m = fold_columns(items(spark, d), 5, 1)
    out = fit_linear(m, ["x1", "x3"], {"ridge": RIDGE})
    return rounds(out.select(TYPE, FOLD, "b0", F.col("coefs")[0].alias("b1"), F.col("coefs")[1].alias("b2")), "b0", "b1", "b2")


@query("ridge_fold_imputed", "K1 G14", cte("m_items", sql_long("z", "m_items", 1), """
k as (select distinct target_type, fold from z_f)""", """
md as (select k.target_type, k.fold, median(x4) as md from k join z_f z on z.target_type = k.target_type and z.fold <> k.fold group by all)""", """
t as (select md.target_type, md.fold, count(*)::double n, sum(coalesce(x4, md)) sx, sum(target) sy, sum(coalesce(x4, md)*coalesce(x4, md)) sxx,
  sum(coalesce(x4, md)*target) sxy from md join z_f z on z.target_type = md.target_type and z.fold <> md.fold group by all)""", """
c as (select *, (sxy - sx*sy/n)/(sxx - sx*sx/n + 5) as b from t)""") + f"""
select target_type, fold, {r6('(sy - b*sx)/n', 'b0')}, {r6('b', 'b1')} from c""")
def _(spark, d):
    m = fold_columns(items(spark, d), 5, 1)
    out = fit_linear(m, ["x4"], {"ridge": RIDGE}).filter(F.col(FOLD) >= 0)
    return rounds(out.select(TYPE, FOLD, "b0", F.col("coefs")[0].alias("b1")), "b0", "b1")


ALPHAS = [10 ** (-10 + 11 * i / 19) for i in range(20)]


@query("ridge_alpha_grid", "K2 E7", cte("m_items", sql_long("a", "m_items", 1), *sql_linear("o", "a_f", "x1"), f"""
al as (select unnest(range(20))::int as i, unnest({ALPHAS}::double[]) as alpha)""", """
g as (select target_type, repeat, fold, i, alpha, (sxy - sx*sy/n)/(sxx - sx*sx/n + alpha) as b, sx, sy, n from o_t, al where fold >= 0)""", """
e as (select f.target_type, f.fold, g.i, sqrt(avg(power(f.target - ((g.sy - g.b*g.sx)/g.n + g.b*f.x1), 2))) as rmse from a_f f join g using (target_type, repeat, fold) group by all)""") + """
select target_type, i as alpha_index, round(avg(rmse), 6) as rmse from e group by all""")
def _(spark, d):
    m = fold_columns(items(spark, d), 5, 1)
    grid = {f"{i}": {"kind": "ridge", "alpha": a} for i, a in enumerate(ALPHAS)}
    s = gram_scores(fit_linear(m, ["x1"], grid))
    return s.groupBy(TYPE, F.col(MODEL).cast("int").alias("alpha_index")).agg(rounded(F.avg("rmse")).alias("rmse"))


@query("ridge_grid_refit", "K2 K10 E6 E7")
def _(spark, d):
    """Best penalty by cross-validated error, coefficients ranked, refit on the leading features."""
    from ..operators.search import grid_refit
    out = grid_refit(fold_columns(items(spark, d), 5, 1, key=ROW), ["x1", "x2", "x3", "x4"], ALPHAS, top=3)
    out = rounds(out, "cv_rmse", "train_rmse", "first_cv_rmse", digits=4)
    return out.select(TYPE, F.concat_ws(",", "features").alias("features"), "cv_rmse", "train_rmse", "first_cv_rmse")


@query("coefficient_ranking", "E6", cte("m_items", sql_long("a", "m_items", 1), *sql_linear2("o", "a_f", "x1", "x3", 5.0), """
u as (select target_type, 'x1' as feature, b1 as coef from o_c where fold = -1 union all select target_type, 'x3', b2 from o_c where fold = -1)""") + """
select target_type, feature, round(coef, 6) as coef, (row_number() over (partition by target_type order by abs(coef) desc, feature))::int as "rank" from u""")
def _(spark, d):
    m = fold_columns(items(spark, d), 5, 1)
    co = coefficients(fit_linear(m, ["x1", "x3"], {"ridge": RIDGE}), ["x1", "x3"])
    return rounds(evaluate.top_features(co).select(TYPE, "feature", "coef", F.col("rank").cast("int").alias("rank")), "coef")


def _model_rows(spark, d, specs, feats=("x1", "x2", "x3", "x4"), digits=4):
    m = fold_columns(items(spark, d), 5, 1)
    s = evaluate.summarize_scores(gram_scores(fit_linear(m, list(feats), specs)))
    return rounds(s, "mean_r2", "std_r2", digits=digits)


@query("ridge_cv_models", "K3")
def _(spark, d):
    return _model_rows(spark, d, {
        "wide_grid": {"kind": "ridge_cv", "alphas": [10 ** (-3 + 6 * i / 24) for i in range(25)], "scale": True},
        "narrow_grid": {"kind": "ridge_cv", "alphas": [10 ** (-2 + 4 * i / 19) for i in range(20)], "scale": True}})


_CV_ALPHAS = [100.0, 100000.0, 400000.0, 2000000.0]
_SIDES = ["""s as (select target_type, fold, count(*)::double n, sum(x1) sx, sum(target) sy, sum(x1*x1) sxx, sum(x1*target) sxy, sum(target*target) syy
  from a_f group by all)""", """t as (select target_type, sum(n) n, sum(sx) sx, sum(sy) sy, sum(sxx) sxx, sum(sxy) sxy, sum(syy) syy from s group by 1)""",
  """side as (select target_type, -1 as fold, n, sx, sy, sxx, sxy, syy from t union all
  select t.target_type, s.fold, t.n-s.n, t.sx-s.sx, t.sy-s.sy, t.sxx-s.sxx, t.sxy-s.sxy, t.syy-s.syy from t join s using (target_type))""",
  f"""al as (select unnest(range({len(_CV_ALPHAS)}))::int as i, unnest({_CV_ALPHAS}::double[]) as alpha)""",
  """fit as (select q.target_type, q.fold, i, alpha, h.n hn, h.sx hx, h.sy hy, h.sxx hxx, h.sxy hxy, h.syy hyy, q.n-h.n n, q.sx-h.sx sx, q.sy-h.sy sy,
  ((q.sxy-h.sxy) - (q.sx-h.sx)*(q.sy-h.sy)/(q.n-h.n)) / ((q.sxx-h.sxx) - power(q.sx-h.sx, 2)/(q.n-h.n) + alpha) as b
  from side q join s h on h.target_type = q.target_type and h.fold <> q.fold, al)""",
  """folded as (select target_type, fold, i, alpha, sum((hyy - 2*b0*hy - 2*b*hxy + hn*b0*b0 + 2*b0*b*hx + b*b*hxx)/hn) as err
  from (select *, (sy - b*sx)/n as b0 from fit) group by all)""",
  """left_out as (select target_type, fold, i, alpha, n*(syc - 2*b*sxc + b*b*xc)/power(n - 1 - xc/(xc+alpha), 2) as err from
  (select *, sxc/(xc+alpha) as b from (select *, sxx-sx*sx/n as xc, sxy-sx*sy/n as sxc, syy-sy*sy/n as syc from side), al))""",
  """pick as (select 'folded' as model, target_type, fold, arg_min(alpha, err) as alpha from folded group by all
  union all select 'left_out', target_type, fold, arg_min(alpha, err) from left_out group by all)"""]


@query("ridge_cv_one_feature", "K3", cte("m_items", sql_long("a", "m_items", 1), *_SIDES) + f"""
select model, target_type, p.fold, alpha, {r6('(sxy-sx*sy/n)/(sxx-sx*sx/n+alpha)', 'b1')} from pick p join side using (target_type, fold)""")
def _(spark, d):
    """Penalties chosen inside each training side, by folds and by generalised leave-one-out error."""
    m = fold_columns(items(spark, d), 5, 1)
    out = fit_linear(m, ["x1"], {"folded": {"kind": "ridge_cv", "alphas": _CV_ALPHAS}, "left_out": {"kind": "ridge_gcv", "alphas": _CV_ALPHAS}})
    return rounds(out.select(MODEL, TYPE, FOLD, "alpha", F.col("coefs")[0].alias("b1")), "b1")


@query("nonnegative_two_features", "K4", cte("m_items", sql_long("a", "m_items", 1), *sql_linear2("o", "a_f", "x1", "x2", 1.0), """
c as (select target_type, fold, n, s1, s2, sy, b1 as w1, b2 as w2, case when b1 >= 0 and b2 >= 0 then -(u*b1 + v*b2) else 1e300 end as f from o_b
 union all select target_type, fold, n, s1, s2, sy, u/a, 0.0, case when u >= 0 then -u*u/a else 1e300 end from o_b
 union all select target_type, fold, n, s1, s2, sy, 0.0, v/d, case when v >= 0 then -v*v/d else 1e300 end from o_b
 union all select target_type, fold, n, s1, s2, sy, 0.0, 0.0, 0.0 from o_b)""", """
w as (select *, row_number() over (partition by target_type, fold order by f) as r from c)""") + f"""
select target_type, fold, {r6('(sy-w1*s1-w2*s2)/n', 'b0')}, {r6('w1', 'b1')}, {r6('w2', 'b2')} from w where r = 1""")
def _(spark, d):
    out = fit_linear(fold_columns(items(spark, d), 5, 1), ["x1", "x2"], {"nonneg": {"kind": "nonneg", "alpha": 1.0}})
    return rounds(out.select(TYPE, FOLD, "b0", F.col("coefs")[0].alias("b1"), F.col("coefs")[1].alias("b2")), "b0", "b1", "b2")


@query("elastic_net_one_feature", "K5", cte("m_items", sql_long("a", "m_items", 1), *sql_linear("o", "a_f", "x1"), """
q as (select *, sqrt((sxx-sx*sx/n)/n) as d, (sxy-sx*sy/n)/n as c from o_t)""", """
w as (select *, sign(c/d)*greatest(abs(c/d) - 5.0*0.4, 0)/(1 + 5.0*0.6)/d as slope from q)""") + f"""
select target_type, fold, {r6('(sy-slope*sx)/n', 'b0')}, {r6('slope', 'b1')} from w""")
def _(spark, d):
    out = fit_linear(fold_columns(items(spark, d), 5, 1), ["x1"], {"enet": {"kind": "enet", "alpha": 5.0, "l1": 0.4, "scale": True}})
    return rounds(out.select(TYPE, FOLD, "b0", F.col("coefs")[0].alias("b1")), "b0", "b1")


@query("nonnegative_ridge", "K4")
def _(spark, d):
    return _model_rows(spark, d, {"nonneg": {"kind": "nonneg", "alpha": 1.0}})


@query("elastic_net", "K5")
def _(spark, d):
    return _model_rows(spark, d, {"enet": {"kind": "enet", "alpha": 0.01, "l1": 0.3, "scale": True}})


@query("selected_ridge", "G17 G18 K1")
def _(spark, d):
    return _model_rows(spark, d, {"top2": {**RIDGE, "scale": True, "select": 2},
                                  "adaptive": {**RIDGE, "scale": True, "select": "adaptive"}})


def _tree_scores(spark, d, name, spec):
    m = fold_columns(items(spark, d).select(ROW, KEY, TYPE, Y, "x1", "x2", "x3", "x4"), 5, 1)
    p = trees.tree_oof_by_type(m, ITEM_TYPES, ["x1", "x2", "x3", "x4"], spec, name)
    return rounds(evaluate.nested_score(p, f"pred_{name}"), "r2", "rmse", digits=3)


@query("random_forest", "K7")
def _(spark, d):
    """Out-of-fold forest of every type."""
    return _tree_scores(spark, d, "forest", trees.PRESETS["forest"])


@query("boosted_trees", "K8")
def _(spark, d):
    """Out-of-fold boosting of every type."""
    return _tree_scores(spark, d, "gbm", trees.PRESETS["gbm"])


_EDGES = ", ".join(f"{i}/32.0" for i in range(1, 32))


@query("one_split_boosting", "K8", cte("m_items", sql_long("a", "m_items", 1), f"""
ed as (select target_type, unnest(list_distinct(quantile_cont(x1, [{_EDGES}]))) as edge from m_items group by 1)""", """
gr as (select f.target_type, k.fold as fit, x1, count(*) as n, sum(target) as s from a_f f join (select unnest(range(5)) as fold) k on f.fold <> k.fold group by all)""", """
ba as (select target_type, fit, sum(n) as n, sum(s)/sum(n) as base from gr group by all)""", """
sp as (select gr.target_type, gr.fit, edge, ba.n, base, sum(case when x1 <= edge then gr.n else 0 end) as nl, sum(case when x1 <= edge then gr.s - gr.n*base else 0 end) as sl,
  sum(case when x1 > edge then gr.s - gr.n*base else 0 end) as sr from gr join ba using (target_type, fit) join ed using (target_type) group by all)""", """
be as (select *, row_number() over (partition by target_type, fit order by round(sl*sl/nl + sr*sr/(n-nl), 4) desc, edge) as k from sp where nl > 0 and nl < n)""") + f"""
select row_id, {r6('base + 0.5*(case when x1 <= edge then sl/nl else sr/(n-nl) end)', 'pred')} from a_f f join be on f.target_type = be.target_type and f.fold = be.fit where k = 1""")
def _(spark, d):
    """One round of depth one at rate .5: the only split is the best quantile edge of each type and fold."""
    m = fold_columns(items(spark, d), 5, 1)
    p = trees.tree_oof_by_type(m, ITEM_TYPES, ["x1"], {"kind": "gbt", "maxIter": 1, "maxDepth": 1, "stepSize": 0.5}, "stump")
    return p.select(ROW, rounded(F.col("pred_stump")).alias("pred"))


@query("shared_model", "K9 B11 D11")
def _(spark, d):
    """One boosted model for every type, scored per fold and averaged."""
    m = fold_columns(items(spark, d).select(ROW, KEY, TYPE, Y, "x1", "x2", "x3"), 5, 1)
    p = trees.shared_oof(m, ITEM_TYPES, ["x1", "x2", "x3"], trees.PRESETS["gbm"])
    per_fold = evaluate.r2_rmse(p, [TYPE, "fold_0"])
    return rounds(per_fold.groupBy(TYPE).agg(F.avg("r2").alias("r2"), F.avg("rmse").alias("rmse")), "r2", "rmse", digits=3)


@query("zoo_roster", "K13 L9 L2")
def _(spark, d):
    """The linear roster on all features from a single Gram pass, scored per type."""
    from .zoo import LINEAR_ZOO
    return _model_rows(spark, d, LINEAR_ZOO)


@query("log_target_model", "G20", cte("m_events", "l as (select *, ln(target) as ly from m_events where target > 0)", sql_long("a", "l", 1), *sql_linear("o", "a_f", "x2", 5.0, target="ly"), sql_pred("o", "a_f", "x2", "p")) + f"""
select row_id, {r6('exp(pred)', 'pred')} from p""")
def _(spark, d):
    log = TRANSFORMS["log"]
    m = fold_columns(events(spark, d).withColumn("ly", log.forward(F.col(Y))).filter("ly is not null"), 5, 1)
    models = fit_linear(m, ["x2"], {"ridge": RIDGE}, target="ly")
    p = predict_oof(m, ["x2"], models, ["ridge"])
    return p.select(ROW, rounded(log.inverse(F.col("pred_ridge"))).alias("pred"))


# --- scores and gates ----------------------------------------------------------

@query("fold_scores", "L1", cte("m_items", *SCORES) + f"select target_type, model, repeat, fold, n, {r6('r2','r2')}, {r6('rmse','rmse')} from sc")
def _(spark, d):
    return rounds(evaluate.fold_scores(_long(spark, d)), "r2", "rmse")


@query("fold_scores_from_gram", "L1 L8", cte("m_items", *SCORES) + f"select target_type, model, repeat, fold, {r6('r2','r2')}, {r6('rmse','rmse')} from sc")
def _(spark, d):
    return rounds(gram_scores(_models(fold_columns(items(spark, d), 5, 3))), "r2", "rmse")


@query("score_summary", "L2", cte("m_items", *SCORES) + f"select target_type, model, {r6('mean_r2','mean_r2')}, {r6('std_r2','std_r2')}, n_folds from su")
def _(spark, d):
    return rounds(_summary(spark, d), "mean_r2", "std_r2")


@query("headline_metric", "L3", cte("m_items", *SCORES) + f"select model, {r6('avg(mean_r2)','mean_r2')} from su group by 1")
def _(spark, d):
    return rounds(evaluate.mean_r2(_summary(spark, d)), "mean_r2")


@query("unpaired_gate", "L4", cte("m_items", *SCORES) + f"""
select a.target_type, {r6('b.mean_r2 - a.mean_r2','delta')}, {r6('greatest(a.std_r2, b.std_r2)','floor')}, b.mean_r2 - a.mean_r2 > greatest(a.std_r2, b.std_r2) as accepted
from su a join su b using (target_type) where a.model = 'ridge1' and b.model = 'ols1'""")
def _(spark, d):
    return rounds(evaluate.gate_unpaired(_summary(spark, d), "ridge1", "ols1").select(TYPE, "delta", "floor", "accepted"), "delta", "floor")


_PAIRED = """, pd as (select a.target_type, avg(a.r2) as am, avg(b.r2) as bm, avg(b.r2-a.r2) as delta, stddev_pop(b.r2-a.r2) as floor
 from sc a join sc b using (target_type, repeat, fold) where a.model = 'ridge1' and b.model = 'ols1' group by 1)"""


@query("paired_gate", "L5", cte("m_items", *SCORES) + _PAIRED + f"""
select target_type, {r6('am','a_mean')}, {r6('bm','b_mean')}, {r6('delta','delta')}, {r6('floor','floor')}, delta > floor as accepted from pd""")
def _(spark, d):
    return rounds(evaluate.gate_paired(_scores(spark, d), "ridge1", "ols1"), "a_mean", "b_mean", "delta", "floor")


@query("paired_gate_standard_error", "L5", cte("m_items", *SCORES) + f"""
select a.target_type, {r6('avg(b.r2-a.r2)','delta')}, {r6('stddev_pop(b.r2-a.r2)/sqrt(count(*))','floor')}, avg(b.r2-a.r2) > stddev_pop(b.r2-a.r2)/sqrt(count(*)) as accepted
 from sc a join sc b using (target_type, repeat, fold) where a.model = 'ridge1' and b.model = 'ols1' group by 1""")
def _(spark, d):
    return rounds(evaluate.gate_paired(_scores(spark, d), "ridge1", "ols1", floor="se").select(TYPE, "delta", "floor", "accepted"), "delta", "floor")


@query("feature_block_verdicts", "L6", cte("m_items", *SCORES) + _PAIRED + f"""
select target_type, {r6('delta','delta')}, delta > floor as accepted, {r6('avg(delta) over ()','pooled_delta')} from pd""")
def _(spark, d):
    out = evaluate.evaluate_block(_scores(spark, d), "ridge1", "ols1")
    return rounds(out.select(TYPE, "delta", "accepted", "pooled_delta"), "delta", "pooled_delta")


_KEEP = """, kv as (select s.target_type, s.model, s.mean_r2 - b.mean_r2 as margin, greatest(s.std_r2, b.std_r2) as floor
 from su s join su b using (target_type) where b.model = 'mean' and s.model <> 'mean'),
kw as (select t.target_type, coalesce(arg_max(model, margin) filter (margin > floor), 'mean') as keep, coalesce(max(margin) filter (margin > floor), 0) as margin
 from (select distinct target_type from su) t left join kv using (target_type) group by 1)"""


@query("ablation_table", "L7", cte("m_items", *SCORES) + _KEEP + f"""
select kw.target_type, {r6("max(mean_r2) filter (model = 'ols1')", 'ols1_mean')}, {r6("max(std_r2) filter (model = 'ols1')", 'ols1_std')},
 {r6("max(mean_r2) filter (model = 'ols3')", 'ols3_mean')}, {r6("max(std_r2) filter (model = 'ols3')", 'ols3_std')}, keep
from kw join su using (target_type) group by kw.target_type, keep""")
def _(spark, d):
    out = evaluate.ablation(_scores(spark, d), ["mean", "ols1", "ols3", "ridge1"], "mean")
    return rounds(out.select(TYPE, "ols1_mean", "ols1_std", "ols3_mean", "ols3_std", "keep"), "ols1_mean", "ols1_std", "ols3_mean", "ols3_std")


@query("kept_variant", "E5", cte("m_items", *SCORES) + _KEEP + f"select target_type, keep, {r6('margin','margin')} from kw")
def _(spark, d):
    return rounds(evaluate.keep_variant(_summary(spark, d), "mean"), "margin")


@query("top_two_models", "E1", cte("m_items", *SCORES) + """
select target_type, model, r as "rank" from (select *, (row_number() over (partition by target_type order by mean_r2 desc, model))::int r from su) where r <= 2""")
def _(spark, d):
    return evaluate.rank_models(_summary(spark, d)).select(TYPE, MODEL, F.col("rank").cast("int").alias("rank"))


_WEIGHTS = """, tw as (select * from (select *, row_number() over (partition by target_type order by mean_r2 desc, model) r from su) where r <= 2),
we as (select target_type, model, exp(5*(mean_r2 - max(mean_r2) over (partition by target_type))) as e from tw),
wt as (select target_type, model, e/sum(e) over (partition by target_type) as weight from we)"""


@query("softmax_weights", "E2", cte("m_items", *SCORES) + _WEIGHTS + f"select target_type, model, {r6('weight','weight')} from wt")
def _(spark, d):
    return rounds(evaluate.softmax_weights(_summary(spark, d)).select(TYPE, MODEL, "weight"), "weight")


_ORDER = "case model when 'mean' then 1 when 'ridge1' then 2 when 'ols1' then 3 when 'ols3' then 4 end"


@query("best_model", "E3", cte("m_items", *SCORES) + f"""
select target_type, model, {r6('mean_r2','mean_r2')} from (select *, row_number() over (partition by target_type order by mean_r2 desc, {_ORDER}) r from su) where r = 1""")
def _(spark, d):
    return rounds(evaluate.best_model(_summary(spark, d), [*ROSTER, "ols3"]).select(TYPE, MODEL, "mean_r2"), "mean_r2")


@query("non_dominated_models", "E4", cte("m_items", *SCORES) + """,
b as (select target_type, max(mean_r2) bm, arg_max(std_r2, mean_r2) bs from su group by 1)
select target_type, model from su join b using (target_type) where bm - mean_r2 <= greatest(bs, std_r2)""")
def _(spark, d):
    return evaluate.non_dominated(_summary(spark, d), [*ROSTER, "ols3"]).select(TYPE, MODEL)


@query("best_penalty", "E7", cte("m_items", sql_long("a", "m_items", 1), *sql_linear("o", "a_f", "x1"), """
al as (select unnest([0.1, 1000.0, 100000.0, 1000000.0]::double[]) as alpha)""", """
g as (select target_type, repeat, fold, alpha, (sxy - sx*sy/n)/(sxx - sx*sx/n + alpha) as b, sx, sy, n from o_t, al where fold >= 0)""", """
e as (select f.target_type, f.fold, alpha, sqrt(avg(power(f.target - ((g.sy - g.b*g.sx)/g.n + g.b*f.x1), 2))) as rmse from a_f f join g using (target_type, repeat, fold) group by all)""", """
m as (select target_type, alpha, avg(rmse) as rmse from e group by all)""") + """
select target_type, arg_min(alpha, rmse) as alpha, round(min(rmse), 6) as rmse from m group by 1""")
def _(spark, d):
    m = fold_columns(items(spark, d), 5, 1)
    grid = {str(a): {"kind": "ridge", "alpha": a} for a in (0.1, 1000.0, 100000.0, 1000000.0)}
    cv = gram_scores(fit_linear(m, ["x1"], grid)).groupBy(TYPE, F.col(MODEL).cast("double").alias("alpha")).agg(F.avg("rmse").alias("rmse"))
    return rounds(evaluate.best_alpha(cv), "rmse")


# --- out-of-fold and refitted predictions ----------------------------------------

@query("oof_predictions", "L9", cte("m_items", sql_long("a", "m_items", 3), *sql_linear("o", "a_f", "x1"), sql_pred("o", "a_f", "x1", "p")) + f"""
select row_id, {r6('avg(pred)','pred')} from p group by row_id, target, x1""")
def _(spark, d):
    m = fold_columns(items(spark, d), 5, 3)
    p = predict_oof(m, ["x1"], fit_linear(m, ["x1"], {"ols1": OLS}, repeats=3), ["ols1"], 3)
    return p.select(ROW, rounded(F.col("pred_ols1")).alias("pred"))


@query("fold_ensemble_on_other_types", "L10", cte("m_items", sql_long("a", "m_items", 1), *sql_linear("o", "a_f", "x1")) + f"""
select row_id, {r6('avg(c.b0 + c.b*x1)','pred')} from m_items m, o_c c where c.target_type = 'AF' and c.fold >= 0 and m.target_type <> 'AF' group by row_id, target, x1""")
def _(spark, d):
    m = fold_columns(items(spark, d), 5, 1)
    models = fit_linear(m.filter(F.col(TYPE) == "AF"), ["x1"], {"ols1": OLS})
    p = predict_ensemble(m.filter(F.col(TYPE) != "AF"), ["x1"], models, "AF", ["ols1"])
    return p.select(ROW, rounded(F.col("pred_ols1")).alias("pred"))


@query("full_refit_weighted", "L11", cte("m_items", "tr as (select *, case when line > 4 then 0.5 else 1.0 end::double as w from m_items where supp % 10 <> 0)", sql_long("a", "tr", 1), *sql_linear("o", "a_f", "x1", 5.0, weight="w")) + f"""
select row_id, {r6('b0 + b*x1','pred')} from m_items m join o_c c using (target_type) where c.fold = -1 and supp % 10 = 0""")
def _(spark, d):
    tr, sc = scoring_side(items(spark, d))
    tr = fold_columns(tr.withColumn("w", F.when(F.col("line") > 4, 0.5).otherwise(1.0)), 5, 1)
    models = fit_linear(tr, ["x1"], {"ridge": RIDGE}, weight="w")
    return predict_full(sc, ["x1"], models, ["ridge"]).select(ROW, rounded(F.col("pred_ridge")).alias("pred"))


@query("hyperparameter_search", "L8 J3 J2")
def _(spark, d):
    from ..operators.search import search_linear
    m = items(spark, d)
    out = search_linear(m, ["x1", "x2", "x3", "x4"], {"kind": "ridge", "alpha": 1.0, "scale": True},
                        {"alpha": (1e-3, 1e3), "select": [2, 3, 4]}, n=12)
    return rounds(out.select(TYPE, "winner", "delta", "accepted"), "delta", digits=5)


@query("tree_search", "L8 K8")
def _(spark, d):
    """Boosting candidates by successive halving, types and folds together, then the gate on the full split."""
    from ..operators.search import search_roster
    out = search_roster(items(spark, d), ["x1", "x2", "x3", "x4"], {**trees.PRESETS["gbm"], "l2": 0.0},
                        {"maxDepth": [3, 4, 5, 6], "stepSize": (0.02, 0.2), "subsamplingRate": [0.6, 0.8, 1.0], "l2": [0.0, 1.0, 5.0]}, n=9, repeats=1)
    return rounds(out.select(TYPE, "winner", "params", "delta", "accepted"), "delta", digits=4)


@query("neighbour_search", "L8 K6")
def _(spark, d):
    """Numbers of neighbours from one search for the largest, gated on the full split."""
    from ..operators.search import search_roster
    out = search_roster(events(spark, d).filter(F.col(Y).isNotNull()), ["x1", "x2"], {"kind": "knn", "k": 10}, {"k": [1, 3, 5, 20, 40]}, n=6, repeats=1)
    return rounds(out.select(TYPE, "winner", "params", "delta", "accepted"), "delta", digits=4)


@query("clip_and_contract", "D13 L26 A9", cte("m_items", sql_long("a", "m_items", 1), *sql_linear("o", "a_f", "x1"), sql_pred("o", "a_f", "x1", "p"), """
b as (select target_type, min(target) - 0.1*(max(target)-min(target)) lo, max(target) + 0.1*(max(target)-min(target)) hi from m_items group by 1)""", """
q as (select p.row_id, greatest(lo, least(hi, pred)) as target from p join b using (target_type))""") + """
select u."check", u.violations::bigint as violations from (select count(*) - count(target) as nulls, 0 as dup from q) x,
 lateral (values ('columns', 0), ('row_count', 0), ('null_target', nulls), ('duplicate_id', dup), ('absent_id', 0), ('unknown_id', 0)) u("check", violations)""")
def _(spark, d):
    m = fold_columns(items(spark, d), 5, 1)
    p = predict_oof(m, ["x1"], fit_linear(m, ["x1"], {"ols1": OLS}), ["ols1"]).withColumnRenamed("pred_ols1", PRED)
    out = output.clip_predictions(p, audit.clip_bounds(m)).select(F.col(ROW).alias("id"), F.col(PRED).alias("target"))
    return check_output(out, ["id", "target"], m)
