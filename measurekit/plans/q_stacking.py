"""Queries over stacking, blending, bagging, anchors, dense features and pseudo-labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..columns import FOLD, KEY, MODEL, PRED, REPEAT, ROW, TYPE, Y
from ..functions.scalars import rounded
from ..operators import augment, evaluate, lookup, stack, trees
from ..operators.folds import fold_columns
from ..operators.linear import fit_linear, gram_scores, long_oof, predict_full, predict_oof
from ..session import cut
from .q_features import _cross_sql, cross_items
from .q_models import MEAN, OLS, RIDGE, _WEIGHTS, SCORES, _long, _summary, cte, rounds
from .registry import query
from .views import (ITEM_TYPES, R2, RMSE, items, r6, scoring_side, sql_fold, sql_hash, sql_linear, sql_linear2, sql_long,
                    sql_pred, with_)

BASE = {"ols1": {**OLS, "only": ["x1"]}, "ols3": {**OLS, "only": ["x3"]}}
FEATS = ["x1", "x3"]
COLS = ["pred_ols1", "pred_ols3"]

# Out-of-fold matrix of the two base models, one repeat: m(.., fold, p1, p2).
MATRIX = [sql_long("a", "m_items", 1), *sql_linear("o1", "a_f", "x1"), *sql_linear("o3", "a_f", "x3"), """m as (
 select f.*, c1.b0 + c1.b*x1 as p1, c3.b0 + c3.b*x3 as p2 from a_f f join o1_c c1 using (target_type, repeat, fold) join o3_c c3 using (target_type, repeat, fold))"""]
STACKED = [*MATRIX, *sql_linear2("st", "m", "p1", "p2", 1.0),
           "sp as (select m.*, c.b0 + c.b1*p1 + c.b2*p2 as pred from m join st_c c using (target_type, repeat, fold))"]


def _matrix(spark, d):
    m = fold_columns(items(spark, d).select(ROW, KEY, TYPE, Y, *FEATS, "supp"), 5, 1)
    return stack.oof_matrix(m, FEATS, BASE)[0]


@query("oof_matrix_long_to_wide", "L9 L12", cte("m_items", *MATRIX) + f"select target_type, row_id, {r6('p1','pred_ols1')}, {r6('p2','pred_ols3')} from m")
def _(spark, d):
    m = fold_columns(items(spark, d), 5, 1)
    p = predict_oof(m, FEATS, fit_linear(m, FEATS, BASE), list(BASE), per_repeat=True)
    wide = stack.pivot_oof(long_oof(p, list(BASE), 1, [ROW, TYPE]), list(BASE))
    return rounds(wide, *COLS)


@query("ensemble_spread", "D16", cte("m_items", *MATRIX) + f"select target_type, row_id, {r6('(p1+p2)/2','mean_pred')}, {r6('abs(p1-p2)/2','spread')} from m")
def _(spark, d):
    m = fold_columns(items(spark, d), 5, 1)
    p = predict_oof(m, FEATS, fit_linear(m, FEATS, BASE), list(BASE), per_repeat=True)
    return rounds(stack.row_spread(long_oof(p, list(BASE), 1, [ROW, TYPE])), "mean_pred", "spread")


@query("ensemble_spread_row_wise", "D16", cte("m_items", *MATRIX) + f"select row_id, {r6('(p1+p2)/2','mean_pred')}, {r6('abs(p1-p2)/2','spread')} from m")
def _(spark, d):
    return rounds(stack.row_spread_wide(_matrix(spark, d), COLS).select(ROW, "mean_pred", "spread"), "mean_pred", "spread")


@query("stack_coefficients", "L12", cte("m_items", *STACKED) + f"select target_type, fold, {r6('b0','b0')}, {r6('b1','w_ols1')}, {r6('b2','w_ols3')} from st_c")
def _(spark, d):
    m = fold_columns(items(spark, d).select(KEY, TYPE, Y, *FEATS), 5, 1)
    _base, s = stack.stack_linear(m, FEATS, BASE)
    return rounds(s.select(TYPE, FOLD, "b0", F.col("coefs")[0].alias("w_ols1"), F.col("coefs")[1].alias("w_ols3")), "b0", "w_ols1", "w_ols3")


@query("stack_fold_scores", "L12 L1", cte("m_items", *STACKED) + f"select target_type, fold, {r6(R2,'r2')} from sp group by all")
def _(spark, d):
    m = fold_columns(items(spark, d).select(KEY, TYPE, Y, *FEATS), 5, 1)
    return rounds(gram_scores(stack.stack_linear(m, FEATS, BASE)[1]).select(TYPE, FOLD, "r2"), "r2")


@query("stack_rmse_from_rows", "L12 L9", cte("m_items", *STACKED) + f"select target_type, fold, {r6(RMSE,'rmse')} from sp group by all")
def _(spark, d):
    return rounds(stack.stack_scores(_matrix(spark, d), COLS).select(TYPE, FOLD, "rmse"), "rmse")


@query("nested_stack_score", "L13", cte("m_items", *STACKED) + f"select target_type, count(*) as n, {r6(R2,'r2')} from sp group by 1")
def _(spark, d):
    return rounds(stack.nested_stack_score(_matrix(spark, d), COLS).select(TYPE, "n", "r2"), "r2")


@query("meta_learner_choice", "L14 K3 K4")
def _(spark, d):
    return stack.select_meta(_matrix(spark, d), COLS, 1, {
        "ridge": {"kind": "ridge", "alpha": 1.0}, "ridge_positive": {"kind": "nonneg", "alpha": 1.0},
        "ridge_cv": {"kind": "ridge_cv", "alphas": [10 ** (-3 + 6 * i / 24) for i in range(25)]}}, "ridge")


_BLEND = """, lp as (select target_type, 'ols1' as model, row_id, avg(pred) as pred from ols1_p group by all union all
 select target_type, 'ols3', row_id, avg(pred) from ols3_p group by all union all select target_type, 'mean', row_id, avg(pred) from mean_p group by all
 union all select target_type, 'ridge1', row_id, avg(pred) from ridge1_p group by all),
bl as (select target_type, row_id, sum(weight*pred) as blend from lp join wt using (target_type, model) group by all)"""


@query("softmax_blend", "L15 E1 E2", cte("m_items", *SCORES) + _WEIGHTS + _BLEND + f"select target_type, row_id, {r6('blend','blend')} from bl")
def _(spark, d):
    long = _long(spark, d)
    s = evaluate.summarize_scores(evaluate.fold_scores(long))
    w = evaluate.softmax_weights(spark.createDataFrame(s.collect(), s.schema))
    per_row = stack.mean_over_repeats(long, ["mean", "ols1", "ridge1", "ols3"])
    return rounds(stack.blend(per_row, w), "blend")


@query("stack_or_blend", "L16", cte("m_items", *STACKED, """
eq as (select target_type, target, (p1+p2)/2 as pred from m)""") + f""",
a as (select target_type, {R2} as s from sp group by 1), b as (select target_type, {R2} as b from eq group by 1)
select target_type, case when s > b then 'stack' else 'blend' end as combiner, {r6('greatest(s, b)','r2')} from a join b using (target_type)""")
def _(spark, d):
    m = _matrix(spark, d)
    s = stack.nested_stack_score(m, COLS).select(TYPE, F.col("r2").alias("stack_r2"))
    half = spark.createDataFrame([(t, n, 0.5) for t in ITEM_TYPES for n in BASE], f"{TYPE} string, {MODEL} string, weight double")
    b = evaluate.nested_score(stack.blend_wide(m, half, list(BASE)), "pred_blend").select(TYPE, F.col("r2").alias("blend_r2"))
    return rounds(evaluate.choose_combiner(s.join(b, TYPE)), "r2")


_SEEDS = [42, 43, 44]


@query("seed_bagging", "L17", cte("m_items", sql_long("a", "m_items", 3), *sql_linear("o", "a_f", "x1"), sql_pred("o", "a_f", "x1", "p"), """
bg as (select row_id, target_type, any_value(target) as target, avg(pred) as pred, max(pred) filter (repeat = 0) as one from p group by 1, 2)""") + f"""
, a as (select target_type, {R2} as bagged from bg group by 1), b as (select target_type, {R2.replace('pred', 'one')} as single from bg group by 1)
select target_type, {r6('single','single_r2')}, {r6('bagged','bagged_r2')}, bagged > single as keep from a join b using (target_type)""")
def _(spark, d):
    m = items(spark, d).select(ROW, KEY, TYPE, Y, "x1")
    bag = stack.seed_bag(m, ["x1"], {"ols1": OLS}, _SEEDS)
    return rounds(stack.keep_bag(bag, "ols1"), "single_r2", "bagged_r2")


@query("bagged_refit", "L18 L11")
def _(spark, d):
    """Final forests of every type on all its training rows, averaged over seed offsets."""
    tr, sc = scoring_side(items(spark, d))
    [out] = trees.tree_fit_predict(tr, [sc], ["x1", "x2", "x3"], trees.PRESETS["forest"], "forest", seeds=(42, 43, 44), by=TYPE)
    return rounds(evaluate.nested_score(out, "pred_forest"), "r2", "rmse", digits=3)


@query("gated_stack_column", "L19", cte("m_items", *MATRIX, "mm as (select * exclude (repeat, fold) from m)", sql_long("g", "mm", 3),
       *sql_linear("b", "g_f", "p1", 1.0), *sql_linear2("e", "g_f", "p1", "p2", 1.0), sql_pred("b", "g_f", "p1", "bp"), """
ep as (select f.*, c.b0 + c.b1*p1 + c.b2*p2 as pred from g_f f join e_c c using (target_type, repeat, fold))""") + f""",
x as (select target_type, repeat, fold, {R2} as r2 from bp group by all), y as (select target_type, repeat, fold, {R2} as r2 from ep group by all)
select target_type, {r6('avg(y.r2-x.r2)','delta')}, {r6('stddev_pop(y.r2-x.r2)','floor')}, avg(y.r2-x.r2) > stddev_pop(y.r2-x.r2) as accepted
from x join y using (target_type, repeat, fold) group by 1""")
def _(spark, d):
    g = stack.gate_column(_matrix(spark, d), ["pred_ols1"], "pred_ols3")
    return rounds(g.select(TYPE, "delta", "floor", "accepted"), "delta", "floor")


_XCOLS = [*[f"xtarget_{t}" for t in ITEM_TYPES], *[f"known_{t}" for t in ITEM_TYPES], "gap"]


@query("cross_only_model", "L20 G2 G3")
def _(spark, d):
    m = lookup.derived_features(cross_items(spark, d), {"gap": ("difference", ["xtarget_NF", "xtarget_NO"])})
    p = augment.cross_model_oof(fold_columns(m.select(KEY, TYPE, Y, *_XCOLS), 5, 1), _XCOLS, {"kind": "ridge", "alpha": 1.0, "scale": True})
    return rounds(evaluate.nested_score(p, "pred_cross").select(TYPE, "n", "r2"), "r2", digits=4)


_RULES_SQL = """an as (select *, case target_type when 'AF' then "xtarget_AO" - 10 when 'NF' then ("xtarget_NO" + "xtarget_RO")/2
 when 'RO' then sqrt(greatest("xtarget_RF", 0))*9 end as anchor from cf)"""


def _anchored(spark, d):
    m = cross_items(spark, d)
    c = lambda t: F.col(f"xtarget_{t}")
    rules = {"AF": c("AO") - 10, "NF": (c("NO") + c("RO")) / 2,
             "RO": F.when(c("RF").isNotNull(), F.sqrt(F.greatest(c("RF"), F.lit(0.0)))) * 9}
    return augment.anchor_column(m, rules)


@query("anchor_residual_model", "L21", cte("m_items", _cross_sql("m_items", ITEM_TYPES), _RULES_SQL.replace(
    "greatest(\"xtarget_RF\", 0)", "case when \"xtarget_RF\" is not null then greatest(\"xtarget_RF\", 0) end"), "ar as (select *, target - anchor as resid from an)", sql_long("a", "ar", 1),
    *sql_linear("o", "a_f", "x1"), *sql_linear("r", "a_f", "x1", target="resid")) + f"""
select row_id, {r6('o_c.b0 + o_c.b*x1', 'pred_direct')}, {r6('coalesce(case when r_c.n >= 5 then anchor + r_c.b0 + r_c.b*x1 end, o_c.b0 + o_c.b*x1)', 'pred_anchor')}
from a_f f join o_c using (target_type, repeat, fold) left join r_c using (target_type, repeat, fold)""")
def _(spark, d):
    p = augment.anchor_oof(fold_columns(_anchored(spark, d), 5, 1), ["x1"], OLS)
    return rounds(p.select(ROW, "pred_direct", "pred_anchor"), "pred_direct", "pred_anchor")


@query("anchor_imputed", "L22", cte("m_items", _cross_sql("m_items", ITEM_TYPES), _RULES_SQL.replace(
    "greatest(\"xtarget_RF\", 0)", "case when \"xtarget_RF\" is not null then greatest(\"xtarget_RF\", 0) end")) + f"""
select row_id, {r6('coalesce(anchor, x1*2 + 20)', 'anchor')}, anchor is null as anchor_imputed from an""")
def _(spark, d):
    p = augment.impute_anchor(_anchored(spark, d), F.col("x1") * 2 + 20)
    return rounds(p.select(ROW, "anchor", "anchor_imputed"), "anchor")


_TRAIN_MATRIX = ["tr as (select * from m_items where supp % 10 <> 0)", sql_long("a", "tr", 1), *sql_linear("o1", "a_f", "x1"),
                 *sql_linear("o3", "a_f", "x3"), """m as (
 select f.*, c1.b0 + c1.b*x1 as p1, c3.b0 + c3.b*x3 as p2 from a_f f join o1_c c1 using (target_type, repeat, fold) join o3_c c3 using (target_type, repeat, fold))""",
                 *sql_linear2("st", "m", "p1", "p2", 1.0)]


@query("dense_cross_prediction", "L23 L10", cte("m_items", *_TRAIN_MATRIX) + f""",
me as (select b0, b1, b2 from st_c where target_type = 'AF' and fold = -1),
e as (select t.row_id, avg(c1.b0 + c1.b*x1) as p1, avg(c3.b0 + c3.b*x3) as p2 from tr t, o1_c c1, o3_c c3
  where t.target_type in ('NF', 'RO') and c1.target_type = 'AF' and c3.target_type = 'AF' and c1.fold >= 0 and c3.fold = c1.fold group by 1),
s as (select t.row_id, c1.b0 + c1.b*x1 as p1, c3.b0 + c3.b*x3 as p2 from m_items t, o1_c c1, o3_c c3
  where supp % 10 = 0 and t.target_type in ('NF', 'RO') and c1.target_type = 'AF' and c3.target_type = 'AF' and c1.fold = -1 and c3.fold = -1)
select row_id, side, {r6('b0 + b1*p1 + b2*p2', 'dense')} from (select 'train' as side, * from e union all select 'score', * from s), me""")
def _(spark, d):
    tr, sc = scoring_side(items(spark, d))
    own = fold_columns(tr.filter(F.col(TYPE) == "AF"), 5, 1)
    meta = stack.stack(stack.oof_matrix(own, FEATS, BASE)[0], COLS)
    a, b = augment.dense_feature(tr, sc, "AF", ["NF", "RO"], FEATS, BASE, meta)
    out = a.select(ROW, F.lit("train").alias("side"), "dense_AF").unionByName(b.select(ROW, F.lit("score").alias("side"), "dense_AF"))
    return out.select(ROW, "side", rounded(F.col("dense_AF")).alias("dense"))


@query("dense_chain_verdicts", "L24")
def _(spark, d):
    tr, sc = scoring_side(cut(items(spark, d).select(ROW, KEY, TYPE, Y, *FEATS, "supp")))   # read by every step
    _t, _s, verdicts = augment.dense_chain(tr, sc, [("AF", ["NF", "RO"]), ("NF", ["RO"])], FEATS, BASE)
    return rounds(verdicts.select("source", TYPE, "delta", "accepted"), "delta", digits=5)


def _pseudo_setup(spark, d):
    tr, sc = scoring_side(items(spark, d).select(ROW, KEY, TYPE, Y, *FEATS, "supp"))
    rows = fold_columns(tr, 5, 1)
    models, meta = stack.stack_linear(rows, FEATS, BASE)
    oof = predict_oof(predict_oof(rows, FEATS, models, list(BASE)), COLS, meta, ["stack"])
    return tr, sc, models, meta, evaluate.nested_score(oof, "pred_stack")


_PSEUDO = [*_TRAIN_MATRIX, """
sp as (select m.*, c.b0 + c.b1*p1 + c.b2*p2 as pred from m join st_c c using (target_type, repeat, fold))""", f"""
cv as (select target_type, {R2} as r2 from sp group by 1)""", """
lim as (select target_type, stddev_samp(target) as sd, min(target) - 0.1*(max(target)-min(target)) lo, max(target) + 0.1*(max(target)-min(target)) hi from tr group by 1)""", """
fp as (select t.row_id, t.target_type, t.x1, t.x3, c1.b0 + c1.b*x1 as p1, c3.b0 + c3.b*x3 as p2 from m_items t join o1_c c1 using (target_type) join o3_c c3 using (target_type)
  where supp % 10 = 0 and c1.fold = -1 and c3.fold = -1)""", """
ok as (select fp.*, c.b0 + c.b1*p1 + c.b2*p2 as first, lo, hi from fp join st_c c using (target_type) join cv using (target_type) join lim using (target_type)
  where c.fold = -1 and abs(p1-p2)/2 < 0.5*sd*sqrt(greatest(1-r2, 0.01)))""", """
pl as (select *, greatest(lo, least(hi, first)) as pseudo from ok where target_type in (select target_type from ok group by 1 having count(*) >= 5))"""]


@query("pseudo_label_selection", "L25 D16 F1", cte("m_items", *_PSEUDO) + f"select row_id, target_type, {r6('pseudo', 'pseudo')} from pl")
def _(spark, d):
    tr, sc, models, meta, cv = _pseudo_setup(spark, d)
    scored = stack.row_spread_wide(predict_full(sc, FEATS, models, list(BASE)), COLS)
    scored = predict_full(scored, COLS, meta, ["stack"]).withColumnRenamed("pred_stack", "first_pass")
    return rounds(augment.select_confident(scored, tr, cv).select(ROW, TYPE, "pseudo"), "pseudo")


@query("pseudo_label_round", "L25 L11", cte("m_items", *_PSEUDO, """
pool as (select target_type, x1, x3, target, 1.0::double as w, 0 as repeat, 0 as fold from tr
  union all select target_type, x1, x3, pseudo, 0.5::double, 0, 0 from pl)""", *sql_linear("q1", "pool", "x1", weight="w"),
  *sql_linear("q3", "pool", "x3", weight="w")) + f"""
select row_id, {r6('c.b0 + c.b1*p1 + c.b2*p2', 'first_pass')}, {r6('c.b0 + c.b1*(q1_c.b0 + q1_c.b*x1) + c.b2*(q3_c.b0 + q3_c.b*x3)', 'pred')}
from fp join st_c c using (target_type) join q1_c using (target_type) join q3_c using (target_type)
where c.fold = -1 and q1_c.fold = -1 and q3_c.fold = -1""")
def _(spark, d):
    tr, sc, _m, meta, cv = _pseudo_setup(spark, d)
    out = augment.pseudo_label(tr, sc, FEATS, BASE, meta, cv)
    return rounds(out.select(ROW, "first_pass", "pred"), "first_pass", "pred")


@query("pseudo_label_two_rounds", "L25c")
def _(spark, d):
    tr, sc, _m, meta, cv = _pseudo_setup(spark, d)
    out = augment.pseudo_label(tr, sc, FEATS, BASE, meta, cv, rounds=2)
    return out.groupBy(TYPE).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("first_pass"), 4).alias("first_pass"), rounded(F.avg("pred"), 4).alias("pred"))


@query("pseudo_label_fraction", "L25b E8")
def _(spark, d):
    tr, sc, _m, _meta, cv = _pseudo_setup(spark, d)
    return augment.search_fraction(tr, sc, FEATS, BASE, cv)


def _run_config(**more):
    """Linear, neighbour and boosted columns; the forest and the other boosting variants of ``ZOO`` are the default of ``Config``."""
    from .whole_run import Config
    from .zoo import LINEAR_ZOO, ZOO
    return Config(features=["x1", "x2", "x3", "x4"], zoo={**LINEAR_ZOO, "knn": ZOO["knn"], "gbm": ZOO["gbm"]}, dense=[("AF", ["NF", "RO"])],
                  seeds=(42, 43), **more)


@query("per_type_process", "L29 L18 K13")
def _(spark, d):
    """Every step of a type's process on the full roster, and what was decided."""
    from .whole_run import run
    tr, sc = scoring_side(items(spark, d))
    return run(tr, sc, _run_config()).report


@query("whole_run", "L30")
def _(spark, d):
    from .whole_run import run
    tr, sc = scoring_side(items(spark, d))
    result = run(tr, sc, _run_config(anchors={"AF": F.col("xtarget_AO") - 10}, pseudo_rounds=2))
    back = result.predictions.join(sc.select(ROW, Y), ROW)
    return rounds(evaluate.r2_rmse(back, [TYPE]), "r2", "rmse", digits=3)
