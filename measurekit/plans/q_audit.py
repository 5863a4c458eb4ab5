"""Queries over audits, distributions, groups and rankings of raw tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..columns import FOLD, KEY, REPEAT, ROW, TYPE, Y
from ..dist import join_salted
from ..functions.scalars import (TRANSFORMS, array_stats, class_counts, literal_count, pattern_counts, rounded)
from ..operators import audit, folds, graph, output
from ..session import cut
from .registry import query
from .views import (ITEM_TYPES, daily, docs, events, items, r6, scoring_side, sql_fold, sql_long, table, with_)

I, E, DY, DO = with_("m_items"), with_("m_events"), with_("m_daily"), with_("m_docs")
CONSISTENT = "((y_max-y_min)/(abs(y_mean)+1e-9) < 0.01 or y_max-y_min < 1e-6)"
COARSE = "md5(nullif(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), ''))"


def _coarse():
    from ..functions.scalars import coarse_key
    return coarse_key(F.col("text"))


def _exact(src):
    return f"""ex as (select *, {CONSISTENT} as consistent from (select target_type, entity, count(*) n_rows, min(target) y_min,
  max(target) y_max, avg(target) y_mean from {src} group by all) where n_rows > 1)"""


def _near(src):
    return f"""ne as (select *, {CONSISTENT} as consistent from (select target_type, coarse, count(distinct entity) n_variants,
  count(*) n_rows, min(target) y_min, max(target) y_max, avg(target) y_mean
  from (select *, {COARSE} as coarse from {src}) where coarse is not null group by all) where n_variants > 1)"""


def _report(src):
    return f""", {_exact(src)}, {_near(src)},
r as (select t.target_type, n, coalesce(eg,0) eg, coalesce(er,0) er, coalesce(ec,0) ec, coalesce(ef,0) ef,
   coalesce(ng,0) ng, coalesce(nr,0) nr, coalesce(nc,0) nc, coalesce(nf,0) nf
  from (select target_type, count(*) n from {src} group by 1) t
  left join (select target_type, count(*) eg, sum(n_rows) er, count(*) filter (consistent) ec, count(*) filter (not consistent) ef from ex group by 1) using (target_type)
  left join (select target_type, count(*) ng, sum(n_rows) nr, count(*) filter (consistent) nc, count(*) filter (not consistent) nf from ne group by 1) using (target_type))
select target_type, sum(n)::bigint as n, sum(eg)::bigint as exact_groups, sum(er)::bigint as exact_rows, sum(ec)::bigint as exact_consistent,
  sum(ef)::bigint as exact_conflicting, sum(ng)::bigint as near_groups, sum(nr)::bigint as near_rows, sum(nc)::bigint as near_consistent,
  sum(nf)::bigint as near_conflicting from r group by rollup(target_type)"""


@query("exact_duplicate_groups", "D1 D3", DY + f", {_exact('m_daily')} " + f"""
select target_type, entity, n_rows, {r6('y_min','y_min')}, {r6('y_max','y_max')}, consistent from ex""")
def _(spark, d):
    return audit.exact_duplicates(daily(spark, d)).select(
        TYPE, KEY, "n_rows", rounded(F.col("y_min")).alias("y_min"), rounded(F.col("y_max")).alias("y_max"), "consistent")


@query("strict_conflicts", "D3", DY + """
select target_type, count(*) as n_groups, count(*) filter (hi - lo > 1e-6) as n_conflicting from
 (select target_type, entity, min(target) lo, max(target) hi, count(*) n from m_daily group by all) where n > 1 group by 1""")
def _(spark, d):
    g = audit.exact_duplicates(daily(spark, d))
    return g.groupBy(TYPE).agg(F.count(F.lit(1)).alias("n_groups"),
                               F.count_if(F.col("y_max") - F.col("y_min") > 1e-6).alias("n_conflicting"))


@query("near_duplicate_groups", "D2 D3", DO + f", {_near('m_docs')} " + """
select target_type, coarse, n_variants, n_rows, round(y_mean, 6) as y_mean, consistent from ne""")
def _(spark, d):
    return audit.near_duplicates(docs(spark, d), _coarse()).select(
        TYPE, "coarse", "n_variants", "n_rows", rounded(F.col("y_mean")).alias("y_mean"), "consistent")


@query("duplicate_report", "D4", DO + _report("m_docs"))
def _(spark, d):
    return audit.duplicate_report(docs(spark, d), _coarse())


@query("conflict_examples", "D5", DY + f", {_exact('m_daily')}, " + """
pick as (select target_type, entity, row_number() over (partition by target_type order by entity) as example from ex where not consistent)
select m.target_type, m.entity, example::int as example, m.target, count(*) as n_rows from m_daily m join pick p using (target_type, entity)
where example <= 3 group by all""")
def _(spark, d):
    return audit.conflict_examples(daily(spark, d))


@query("near_conflict_examples", "D5", DO + f", {_near('m_docs')}, " + f"""
pick as (select target_type, coarse, row_number() over (partition by target_type order by coarse) as example from ne where not consistent)
select m.target_type, m.coarse, example::int as example, m.entity, m.target, count(*) as n_rows
from (select *, {COARSE} as coarse from m_docs) m join pick p using (target_type, coarse) where example <= 3 group by all""")
def _(spark, d):
    return audit.near_conflict_examples(docs(spark, d), _coarse())


@query("target_distribution", "D6", E + f"""
select target_type, count(target) as n, min(target) as y_min, max(target) as y_max, {r6('avg(target)','y_mean')},
 {r6('stddev_samp(target)','y_std')}, {r6('skewness(target)','y_skew')} from m_events group by 1""")
def _(spark, d):
    out = audit.distribution(events(spark, d))
    return out.withColumns({c: rounded(F.col(c)) for c in ("y_mean", "y_std", "y_skew")})


_FENCE = """, f as (select target_type, quantile_cont(target, 0.25) q1, quantile_cont(target, 0.75) q3 from m_events group by 1),
g as (select target_type, q1 - 1.5*(q3-q1) as fence_lo, q3 + 1.5*(q3-q1) as fence_hi from f),
o as (select m.target_type, m.target, fence_lo, fence_hi, (target < fence_lo or target > fence_hi) as out from m_events m join g using (target_type))
"""


@query("iqr_outliers", "D7", E + _FENCE + f"""
select target_type, {r6('min(fence_lo)','fence_lo')}, {r6('min(fence_hi)','fence_hi')}, count(*) filter (out) as n_outliers,
 {r6('count(*) filter (out)*100.0/count(*)','pct_outliers')} from o group by 1""")
def _(spark, d):
    out = audit.iqr_outliers(events(spark, d))
    return out.withColumns({c: rounded(F.col(c)) for c in ("fence_lo", "fence_hi", "pct_outliers")})


@query("extreme_outliers", "D8", E + _FENCE + """
select distinct target_type, target from (select *, row_number() over (partition by target_type order by target) a,
 row_number() over (partition by target_type order by target desc) b from o where out) where a <= 3 or b <= 3""")
def _(spark, d):
    return audit.extremes(events(spark, d))


@query("group_size_histogram", "D9", DY + """
select target_type, size, count(*) as n_groups from (select target_type, entity, count(*) size from m_daily group by all) group by all""")
def _(spark, d):
    return audit.group_sizes(daily(spark, d))


@query("target_standardized", "D11", I + f""", s as (select target_type, avg(target) m, case when stddev_pop(target) <= 1e-8 then 1 else stddev_pop(target) end sd from m_items group by 1)
select row_id, {r6('(target-m)/sd','y_z')} from m_items join s using (target_type)""")
def _(spark, d):
    return audit.standardize_target(items(spark, d)).select(ROW, rounded(F.col("y_z")).alias("y_z"))


@query("target_means", "D12", I + f"select target_type, {r6('avg(target)','y_mean')} from m_items group by 1")
def _(spark, d):
    return audit.target_means(items(spark, d)).withColumn("y_mean", rounded(F.col("y_mean")))


_BOUNDS = """, b as (select target_type, case when target_type in ('AF','RO') then greatest(lo - 0.1*(hi-lo), 0.0) else lo - 0.1*(hi-lo) end as clip_lo,
 hi + 0.1*(hi-lo) as clip_hi from (select target_type, min(target)::double lo, max(target)::double hi from m_items where supp % 10 <> 0 group by 1))"""
_FLOORS = {"AF": 0.0, "RO": 0.0}


@query("clip_bounds", "D13", I + _BOUNDS + f"select target_type, {r6('clip_lo','clip_lo')}, {r6('clip_hi','clip_hi')} from b")
def _(spark, d):
    tr, _s = scoring_side(items(spark, d))
    out = audit.clip_bounds(tr, floors=_FLOORS)
    return out.withColumns({c: rounded(F.col(c)) for c in ("clip_lo", "clip_hi")})


@query("cross_type_coverage", "D14", DY + """
select n_types, count(*) as n_keys, sum(n)::bigint as n_rows from (select entity, count(distinct target_type) n_types, count(*) n from m_daily group by 1) group by 1""")
def _(spark, d):
    return audit.cross_coverage(daily(spark, d))


@query("flag_rates_by_split", "D15", I + f"""
select target_type, {r6("avg((x1 > 40)::int) filter (supp % 10 <> 0)", 'rate_train')}, {r6("avg((x1 > 40)::int) filter (supp % 10 = 0)", 'rate_score')}
from m_items group by 1""")
def _(spark, d):
    m = items(spark, d).withColumn("split", F.when(F.col("supp") % 10 == 0, "score").otherwise("train")).withColumn(
        "sparse", F.col("x1") > 40)
    out = audit.flag_rates(m, "split", ["train", "score"], "sparse")
    return out.withColumns({c: rounded(F.col(c)) for c in ("rate_train", "rate_score")})


@query("clip_counts", "D17", I + _BOUNDS + """
select target_type, count(*) filter (target*1.5-40 < clip_lo) as n_below, count(*) filter (target*1.5-40 > clip_hi) as n_above
from m_items join b using (target_type) group by 1""")
def _(spark, d):
    m = items(spark, d)
    tr, _s = scoring_side(m)
    return audit.clip_counts(m.withColumn("p", F.col(Y) * 1.5 - 40), "p", audit.clip_bounds(tr, floors=_FLOORS))


@query("clipped_predictions", "B15 L26", I + _BOUNDS + f"""
select row_id, {r6('greatest(clip_lo, least(clip_hi, target*1.5-40))', 'pred')} from m_items join b using (target_type)""")
def _(spark, d):
    m = items(spark, d)
    tr, _s = scoring_side(m)
    out = output.clip_predictions(m.withColumn("pred", F.col(Y) * 1.5 - 40), audit.clip_bounds(tr, floors=_FLOORS))
    return out.select(ROW, rounded(F.col("pred")).alias("pred"))


@query("fallback_predictions", "L28", I + f"""
, m as (select target_type, avg(target) as y_mean from m_items where supp % 10 <> 0 group by 1)
select row_id, {r6('coalesce(case when line = 1 then null else x1*2 end, y_mean)', 'pred')} from m_items join m using (target_type) where supp % 10 = 0""")
def _(spark, d):
    tr, sc = scoring_side(items(spark, d))
    sc = sc.withColumn("pred", F.when(F.col("line") != 1, F.col("x1") * 2))
    return output.fill_fallback(sc, tr).select(ROW, rounded(F.col("pred")).alias("pred"))


@query("array_statistics", "D18", """
select vec_id, round(list_max(e), 6) as a_max, round(list_min(e), 6) as a_min, round(list_avg(e), 6) as a_mean,
 round(list_sum(e), 6) as a_sum, round(list_stddev_pop(e), 6) as a_std from (select vec_id, embedding::double[] as e from embeddings)""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", *[rounded(v).alias(k) for k, v in array_stats(F.col("embedding").cast("array<double>")).items()])


_CLASSES = {"vowel": "[aeiouy]", "digit": "[0-9]", "upper": "[A-Z]", "space": "[ ]"}


@query("character_class_counts", "D19", "select doc_id, " + ", ".join(
    f"len(regexp_extract_all(text, '{p}'))::bigint as n_{n}, round(len(regexp_extract_all(text, '{p}'))/greatest(length(text), 1.0), 6) as frac_{n}"
    for n, p in _CLASSES.items()) + " from documents")
def _(spark, d):
    cols = class_counts(F.col("text"), _CLASSES)
    return table(spark, d, "documents").select("doc_id", *[
        (rounded(c) if n.startswith("frac") else c).alias(n) for n, c in cols.items()])


@query("literal_occurrences", "D20", """
select doc_id, ((length(text) - length(replace(text, 'on', '')))/2)::bigint as n_hits,
 ((length(text) - length(replace(text, 'on', '')))/2)::bigint = 2 as valid from documents""")
def _(spark, d):
    n = literal_count(F.col("text"), "on")
    return table(spark, d, "documents").select("doc_id", n.alias("n_hits"), (n == 2).alias("valid"))


_RULES = {"has_code": "[{};]", "has_url": "https?://", "has_mail": "[a-z0-9.]+@[a-z0-9.]+", "has_double": "tt|ll|ss"}


@query("pattern_key_block", "G6b", "select doc_id, " + ", ".join(
    f"len(regexp_extract_all(text, '{p}'))::bigint as {n}" for n, p in _RULES.items()) + " from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", *pattern_counts(F.col("text"), _RULES))


_EDGES = f"""nodes as (select doc_id, source as grp, text from documents),
held as (select grp, doc_id, {COARSE} as k from nodes
  union select grp, doc_id, md5(line) from (select grp, doc_id, unnest(string_split(text, chr(10))) as line from nodes) where length(line) >= 40),
edges as (select grp, doc_id as src, min(doc_id) over (partition by grp, k) as dst from held where k is not null),
"""


def _edges(spark, d):
    """Documents of a source are tied when their whole texts are near duplicates or they share a whole line.

    Texts are read and digested once, to a checkpoint; a key that one document alone holds ties nothing and is not joined.
    """
    n = table(spark, d, "documents").select("doc_id", F.col("source").alias("grp"), "text")
    same_line = n.select("grp", "doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.length("line") >= 40)
    held = cut(n.select("grp", "doc_id", _coarse().alias("k")).union(same_line.select("grp", "doc_id", F.md5("line"))).filter("k is not null"))
    least = held.groupBy("grp", "k").agg(F.min("doc_id").alias("dst"), F.max("doc_id").alias("_last")).filter("dst < _last").drop("_last")
    return join_salted(held, least, ["grp", "k"]).filter("doc_id <> dst").select("grp", F.col("doc_id").alias("src"), "dst"), n


@query("connected_components", "D21", "with recursive " + _EDGES + """
sym as (select distinct * from (select grp, src as u, dst as v from edges where src <> dst union all select grp, dst, src from edges where src <> dst)),
reach as (select grp, u, v from sym union select r.grp, r.u, s.v from reach r join sym s on r.grp = s.grp and r.v = s.u),
lab as (select grp, u, least(u, min(v)) as c from reach group by grp, u),
comp as (select grp, c, count(*) n from lab group by all),
per as (select grp, max(n) as mx, count(*) as k from comp group by 1),
sz as (select grp, count(*) n_nodes from nodes group by 1)
select sz.grp, coalesce(mx, 0)::bigint as max_size, round(coalesce(mx, 0)/n_nodes, 6) as max_frac, coalesce(k, 0)::bigint as n_components
from sz left join per using (grp)""")
def _(spark, d):
    edges, nodes = _edges(spark, d)
    sizes = nodes.groupBy("grp").agg(F.count(F.lit(1)).alias("n_nodes"))
    return graph.component_stats(edges, sizes).withColumn("max_frac", rounded(F.col("max_frac")))


@query("percentile_threshold", "D22", I + f"select target_type, {r6('quantile_cont(target, 0.9)','threshold')} from m_items group by 1")
def _(spark, d):
    return audit.percentile_threshold(items(spark, d), TYPE, Y, 0.9).withColumn("threshold", rounded(F.col("threshold")))


# --- folds -------------------------------------------------------------------

@query("group_folds_hashed", "J1", I + f"select row_id, {sql_fold(42)} as fold from m_items")
def _(spark, d):
    return folds.group_kfold(items(spark, d)).select(ROW, FOLD)


@query("group_folds_balanced", "J1", I + """,
k as (select target_type, entity, ntile(5) over (partition by target_type order by md5('42:'||entity::varchar), entity) - 1 as fold
 from (select distinct target_type, entity from m_items))
select row_id, fold::int as fold from m_items join k using (target_type, entity)""")
def _(spark, d):
    return folds.group_kfold(items(spark, d), mode="balanced").select(ROW, FOLD)


_POLICY = ", p as (select target_type, case when count(*) <= 10000 then 3 else 1 end as repeats from m_items group by 1)"


@query("group_folds_null_keys", "J1", I + f""",
n as (select row_id, target_type, case when line = 3 then null else entity end as entity from m_items),
k as (select target_type, entity, ntile(5) over (partition by target_type order by md5('42:'||entity::varchar), entity) - 1 as fold
 from (select distinct target_type, entity from n where entity is not null))
select row_id, case when entity is not null then {sql_fold(42)} end as hashed, k.fold::int as balanced from n left join k using (target_type, entity)""")
def _(spark, d):
    m = items(spark, d).withColumn(KEY, F.when(F.col("line") != 3, F.col(KEY)))
    m = folds.group_kfold(m, name="hashed")
    return folds.group_kfold(m, mode="balanced", name="balanced").select(ROW, "hashed", "balanced")


@query("repeated_folds_by_size", "J2", I + "," + sql_long("a", "m_items", 3) + _POLICY + """
select row_id, repeat, fold from a_f join p using (target_type) where repeat < repeats""")
def _(spark, d):
    m = items(spark, d)
    return folds.repeated_folds(m, folds.repeat_policy(m, 10000)).select(ROW, REPEAT, FOLD)


@query("search_folds", "J3", I + "," + sql_long("a", "m_items", 1, 3) + "select row_id, repeat, fold from a_f")
def _(spark, d):
    return folds.search_folds(items(spark, d)).select(ROW, REPEAT, FOLD)


@query("paired_folds", "J4", I + "," + sql_long("a", "m_items", 3) + "select row_id, repeat, fold from a_f")
def _(spark, d):
    return folds.paired_folds(items(spark, d)).select(ROW, REPEAT, FOLD)


@query("ungrouped_folds", "J5", I + f"select row_id, {sql_fold(42, 'row_id')} as fold from m_items")
def _(spark, d):
    return folds.row_kfold(items(spark, d)).select(ROW, FOLD)


@query("fold_sizes", "J6", I + "," + sql_long("a", "m_items", 3) + """
select target_type, repeat, fold, (sum(count(*)) over (partition by target_type, repeat) - count(*))::bigint as n_train, count(*) as n_val
from a_f group by target_type, repeat, fold""")
def _(spark, d):
    return folds.fold_report(folds.paired_folds(items(spark, d)))


@query("leak_check_grouped", "J7 C8", I + "," + sql_long("a", "m_items", 3) + """
select target_type, repeat, count(*) as n_keys, count(*) filter (k > 1) as n_shared from
 (select target_type, repeat, entity, count(distinct fold) k from a_f group by all) group by all""")
def _(spark, d):
    return folds.leak_check(folds.paired_folds(items(spark, d)), repeats=range(3))


@query("leak_check_ungrouped", "J5 J7", I + f"""
select target_type, 0 as repeat, count(*) as n_keys, count(*) filter (k > 1) as n_shared from
 (select target_type, entity, count(distinct {sql_fold(42, 'row_id')}) k from m_items group by all) group by all""")
def _(spark, d):
    return folds.leak_check(folds.row_kfold(items(spark, d)).withColumn(REPEAT, F.lit(0)), repeats=[0])


@query("target_transform_round_trip", "G20", E + f"""
select row_id, {r6('ln(case when target > 0 then target end)','y_log')}, {r6('sqrt(target)','y_sqrt')} , {r6('target','y_back')} from m_events""")
def _(spark, d):
    log, root = TRANSFORMS["log"], TRANSFORMS["sqrt"]
    y = F.col(Y)
    return events(spark, d).select(ROW, rounded(log.forward(y)).alias("y_log"), rounded(root.forward(y)).alias("y_sqrt"),
                                   rounded(root.inverse(root.forward(y))).alias("y_back"))
