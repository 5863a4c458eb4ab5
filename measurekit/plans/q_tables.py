"""Queries over sources, sinks, cleaning, joins and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..columns import KEY, PRED, ROW, TYPE, Y
from ..functions.hashing import hash_fold, md5_number
from ..functions.scalars import coarse_key, finite, normalize_key, rounded
from ..operators import audit, clean, lookup
from ..session import shared_dir
from ..sources import tables
from .registry import query
from .views import ITEM_TYPES, daily, events, items, r6, scoring_side, sql_hash, table, with_

I = with_("m_items")


def scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("read_measurements", "A1", """
select event_id as row_id, user_id as entity, event_type as target_type, value as target from events""")
def _(spark, d):
    return tables.read_measurements(spark, f"{d}/events.parquet", {
        ROW: "event_id", KEY: "user_id", TYPE: "event_type", Y: "value"})


@query("read_scoring", "A2", """
select o_orderkey as row_id, o_custkey as entity, o_orderstatus as target_type, null::double as target from orders""")
def _(spark, d):
    return tables.read_scoring(spark, f"{d}/orders.parquet", {
        ROW: "o_orderkey", KEY: "o_custkey", TYPE: "o_orderstatus"})


@query("read_corpus", "A3", "select text from documents where text is not null")
def _(spark, d):
    return tables.read_corpus(spark, f"{d}/documents.parquet", exact="TEXT", contains="tex")


@query("write_predictions_round_trip", "A4", I + f"select row_id as id, {r6('target', 'target')} from m_items")
def _(spark, d):
    path = scratch(spark, "predictions")
    tables.write_predictions(items(spark, d).withColumn(PRED, rounded(F.col(Y))), path)
    return spark.read.schema("id string, target double").option("header", True).csv(path)


@query("write_stage_round_trip", "A5", I + f"select row_id, target_type, {r6('target', 'pred')} from m_items")
def _(spark, d):
    df = items(spark, d).select(ROW, TYPE, rounded(F.col(Y)).alias(PRED))
    return tables.write_stage(df, scratch(spark, "stage")).select(ROW, TYPE, PRED)


@query("decisions_round_trip", "A6", I + """
select target_type, case when avg(x1) > 25.5 then 'ridge' else 'mean' end as model, round(avg(x1), 6) as score
from m_items group by all""")
def _(spark, d):
    best = items(spark, d).groupBy(TYPE).agg(F.avg("x1").alias("score")).select(TYPE, F.struct(
        F.when(F.col("score") > 25.5, "ridge").otherwise("mean").alias("model"), rounded(F.col("score")).alias("score")).alias("best"))
    path = scratch(spark, "decisions")
    tables.save_decisions(best, path)
    return tables.load_decisions(spark, path).select(TYPE, "best.model", "best.score")


@query("materialized_features", "A7", I + f"""
select row_id, {r6('x1*x2', 'x12')}, {r6('coalesce(x4, 0) + x3', 'x34')} from m_items""")
def _(spark, d):
    src = items(spark, d)
    feats = src.select(ROW, rounded(F.col("x1") * F.col("x2")).alias("x12"),
                       rounded(F.coalesce("x4", F.lit(0.0)) + F.col("x3")).alias("x34"))
    folder = scratch(spark, "features")
    tables.materialize(feats, src, folder, "x12,x34")
    return tables.materialize(feats, src, folder, "x12,x34")


@query("materialized_by_file", "A7", "select doc_id, lang, length(coalesce(text, ''))::bigint as n_text, md5(text) as text_md5 from documents")
def _(spark, d):
    """Features of every document, taken from the store where their file has not changed."""
    feats = lambda rows: rows.select("doc_id", "lang", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_text"),
                                     F.md5("text").alias("text_md5"), "file_key")
    folder = scratch(spark, "by_file")
    tables.materialize_files(spark, f"{d}/documents.parquet", folder, feats, "length,md5")
    return tables.materialize_files(spark, f"{d}/documents.parquet", folder, feats, "length,md5")


@query("attach_external_predictions", "A8", I + f""",
raw as (select row_id, supp + 1.5 * entity as pred from m_items where not (target_type = 'AF' and line = 3)
  union all select row_id, -1.0 from m_items where target_type = 'RO' and line = 2),
ext as (select row_id, case when min(pred) = max(pred) then min(pred) end as pred from raw group by 1),
j as (select m.row_id, m.target_type, e.pred from m_items m left join ext e using (row_id)),
c as (select target_type, count(pred) = count(*) as covered from j group by 1)
select row_id, target_type, covered, {r6('case when covered then pred end', 'pred')} from j join c using (target_type)""")
def _(spark, d):
    m = items(spark, d)
    ext = m.filter(~((F.col(TYPE) == "AF") & (F.col("line") == 3))).select(ROW, (F.col("supp") + 1.5 * F.col(KEY)).alias(PRED))
    ext = ext.union(m.filter((F.col(TYPE) == "RO") & (F.col("line") == 2)).select(ROW, F.lit(-1.0)))
    return tables.attach_predictions(m.select(ROW, TYPE), ext).select(
        ROW, TYPE, "covered", rounded(F.col(PRED)).alias(PRED))


@query("output_contract", "A9 C5", I + """,
sub as (select row_id as id, case when line = 2 then null else target end as target from m_items where line <> 4
  union all select row_id, target from m_items where line = 5 union all select 'x'||row_id, target from m_items where line = 6),
per as (select id, count(*) n, count(*) - count(target) as nulls from sub group by 1),
mm as (select row_id, count(*) as w from m_items group by 1),
b as (select p.id, n, nulls, m.row_id, w from per p full join mm m on p.id = m.row_id),
a as (select sum(n)::bigint as row_n, sum(w)::bigint as wanted, sum(nulls)::bigint as nulls, count(*) filter (n > coalesce(w, 1)) as dup,
  count(*) filter (id is null) as absent, count(*) filter (row_id is null) as unknown from b)
select u."check", u.violations::bigint as violations from a, lateral (values ('columns', 0), ('row_count', abs(row_n - wanted)), ('null_target', nulls),
  ('duplicate_id', dup), ('absent_id', absent), ('unknown_id', unknown)) u("check", violations)""")
def _(spark, d):
    m = items(spark, d)
    out = m.filter("line <> 4").select(F.col(ROW).alias("id"), F.when(F.col("line") != 2, F.col(Y)).alias(Y))
    out = out.union(m.filter("line = 5").select(ROW, Y)).union(
        m.filter("line = 6").select(F.concat(F.lit("x"), ROW), Y))
    return tables.check_output(out, ["id", "target"], m)


@query("slice_one_type", "B1", I + f"select row_id, {r6('target', 'target')} from m_items where target_type = 'RF'")
def _(spark, d):
    return clean.slice_type(items(spark, d), "RF").select(ROW, rounded(F.col(Y)).alias(Y))


@query("invalid_rows_by_type", "B2", I + """
select target_type, count(*) filter (x4 > 0.01) as n_kept, count(*) - count(*) filter (x4 > 0.01) as n_dropped from m_items group by 1""")
def _(spark, d):
    return clean.invalid_report(items(spark, d), F.col("x4") > 0.01)


@query("drop_unusable_rows", "B2", I + "select row_id, x4 from m_items where x4 > 0.01")
def _(spark, d):
    return clean.drop_invalid(items(spark, d), F.col("x4") > 0.01)[0].select(ROW, "x4")


@query("normalized_keys", "B3", """
with k as (select doc_id, case when doc_id % 5 = 0 then '  ' else text end as t, source from documents)
select doc_id, md5(coalesce(nullif(trim(regexp_replace(lower(t), '[ \\t\\r\\n]+', ' ', 'g')), ''),
  nullif(trim(regexp_replace(lower(source), '[ \\t\\r\\n]+', ' ', 'g')), ''))) as key_md5 from k""")
def _(spark, d):
    t = F.when(F.col("doc_id") % 5 == 0, F.lit("  ")).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(normalize_key(t, F.col("source"))).alias("key_md5"))


@query("coarse_keys", "B4", """
select doc_id, md5(nullif(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'), '')) as coarse from documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", coarse_key(F.col("text")).alias("coarse"))


@query("content_row_ids", "B5", """
with h as (select md5(length(l_orderkey::varchar)||':'||l_orderkey||length(l_linenumber::varchar)||':'||l_linenumber) as h from lineitem)
select h||'-'||(row_number() over (partition by h)) as row_id from h""")
def _(spark, d):
    return clean.with_row_id(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"),
                             ["l_orderkey", "l_linenumber"]).select(ROW)


_BROKEN = """case when line = 1 then 'nan'::double when line = 2 then 'inf'::double when line = 3 then '-inf'::double else x1 end"""


def _broken():
    bad = [F.lit(v).cast("double") for v in ("NaN", "Infinity", "-Infinity")]
    return F.when(F.col("line") == 1, bad[0]).when(F.col("line") == 2, bad[1]).when(
        F.col("line") == 3, bad[2]).otherwise(F.col("x1"))


@query("finite_values", "B6", I + f"""
select row_id, case when isfinite(v) then v end as x1 from (select row_id, {_BROKEN} as v from m_items)""")
def _(spark, d):
    return items(spark, d).select(ROW, finite(_broken()).alias("x1"))


@query("mean_filled", "B7", I + f"""
select row_id, {r6('coalesce(x4, avg(x4) over ())', 'x4')} from m_items""")
def _(spark, d):
    return clean.fill_mean(items(spark, d), ["x4"]).select(ROW, rounded(F.col("x4")).alias("x4"))


@query("mean_filled_by_type", "B7", I + f"""
select row_id, {r6('coalesce(x4, avg(x4) over (partition by target_type))', 'x4')} from m_items""")
def _(spark, d):
    return clean.fill_mean(items(spark, d), ["x4"], TYPE).select(ROW, rounded(F.col("x4")).alias("x4"))


@query("feature_families_by_type", "B8", I + f"""
select target_type, 'x1' as feature, {r6('avg(x1)', 'mean')} from m_items group by 1
union all select target_type, 'x2', {r6('avg(x2)', 'mean')} from m_items where target_type = 'AF' group by 1
union all select target_type, 'x3', {r6('avg(x3)', 'mean')} from m_items where target_type in ('AF', 'RO') group by 1""")
def _(spark, d):
    m = items(spark, d)
    cols = {t: clean.feature_cols(["x1", "x2", "x3"], t, {"AF": ["x2", "x3"], "RO": ["x3"]}, ["x2", "x3"]) for t in ITEM_TYPES}
    wanted = F.create_map(*[x for t in ITEM_TYPES for x in (F.lit(t), F.array(*[F.lit(c) for c in cols[t]]))])
    means = m.groupBy(TYPE).agg(*[F.avg(c).alias(c) for c in ("x1", "x2", "x3")])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), rounded(F.col(c)).alias("mean")) for c in ("x1", "x2", "x3")])
    return means.select(TYPE, F.explode(cells).alias("v")).select(TYPE, "v.*").filter(
        F.array_contains(wanted[F.col(TYPE)], F.col("feature")))


@query("aligned_columns", "B9", I + "select row_id, x3, null::double as x9, x1 from m_items")
def _(spark, d):
    return clean.align(items(spark, d), [ROW], ["x3", "x9", "x1"])


@query("own_type_blanked", "B10", I + f"""
select row_id, case when target_type = 'NO' then null else x1 end as seen from m_items""")
def _(spark, d):
    return items(spark, d).select(ROW, lookup.blank_own("NO", F.col("x1")).alias("seen"))


@query("one_hot_types", "B11", I + "select row_id, " + ", ".join(
    f"(target_type = '{t}')::int as \"is_{t}\"" for t in ITEM_TYPES) + " from m_items")
def _(spark, d):
    return clean.one_hot(items(spark, d), TYPE, ITEM_TYPES).select(ROW, *[f"is_{t}" for t in ITEM_TYPES])


@query("prefixed_columns", "B12", I + "select row_id, x1 as desc_x1, x2 as desc_x2 from m_items")
def _(spark, d):
    return clean.with_prefix(items(spark, d).select(ROW, "x1", "x2"), "desc_", [ROW])


@query("sample_fixed_size", "B13", """
select text from (select distinct text from documents where text is not null)
order by md5('42:'||text), text limit 300""")
def _(spark, d):
    return clean.sample_n(table(spark, d, "documents"), "text", 300, 42)


@query("sample_fraction", "B13", f"""
select doc_id from documents where {sql_hash("'7:'||doc_id::varchar")} < 1288490188""")
def _(spark, d):
    return clean.sample_fraction(table(spark, d, "documents"), "doc_id", 0.3, 7).select("doc_id")


@query("distinct_texts", "B14", "select distinct text, lang from documents")
def _(spark, d):
    return clean.distinct_rows(table(spark, d, "documents"), ["text", "lang"])


@query("two_feature_blocks", "C2", I + f"""
select row_id, {r6('x1*x1', 'a_sq')}, {r6('sqrt(x3)', 'a_root')}, {r6('x1*x2', 'b_prod')} from m_items""")
def _(spark, d):
    block_a = [rounded(F.col("x1") * F.col("x1")).alias("a_sq"), rounded(F.sqrt("x3")).alias("a_root")]
    block_b = [rounded(F.col("x1") * F.col("x2")).alias("b_prod")]
    return items(spark, d).select(ROW, *block_a, *block_b)


@query("scatter_by_row_id", "C3", I + f"""
select m.row_id, {r6('p.pred', 'pred')} from m_items m left join (select row_id, target*0.5::double as pred from m_items where x1 > 10) p using (row_id)""")
def _(spark, d):
    m = items(spark, d)
    preds = m.filter("x1 > 10").select(ROW, rounded(F.col(Y) * 0.5).alias("pred"))
    return lookup.attach(m.select(ROW), preds)


@query("semi_join_types", "C4", I + "select row_id, target_type from m_items where target_type in ('AF', 'RO')")
def _(spark, d):
    return clean.semi_types(items(spark, d), ["AF", "RO"]).select(ROW, TYPE)


_SIDES = ", tr as (select * from m_daily where row_id % 3 <> 0), sc as (select * from m_daily where row_id % 3 = 0)"


def _sides(spark, d):
    m = daily(spark, d)
    return m.filter("row_id % 3 <> 0"), m.filter("row_id % 3 = 0")


@query("scoring_key_overlap", "C5", with_("m_daily") + _SIDES + """,
k as (select distinct target_type, entity from sc), s as (select distinct entity, 1 as seen from tr)
select target_type, count(seen) as n_seen, count(*) - count(seen) as n_unseen, round(count(seen)/count(*), 6) as seen_rate
from k left join s using (entity) group by 1""")
def _(spark, d):
    out = lookup.key_overlap(*_sides(spark, d))
    return out.withColumn("seen_rate", rounded(F.col("seen_rate")))


@query("unseen_scoring_keys", "C5", with_("m_daily") + _SIDES + """
select distinct target_type, entity from sc where entity not in (select entity from tr)""")
def _(spark, d):
    return lookup.unseen_keys(*_sides(spark, d))


@query("union_with_weights", "F1", with_("m_events") + f"""
select row_id, target_type, {r6('target', 'target')}, 1.0::double as weight from m_events where row_id % 4 <> 0
union all select row_id, target_type, {r6('greatest(target, 5)', 'target')}, 0.5::double from m_events where row_id % 4 = 0""")
def _(spark, d):
    from ..operators.augment import augmented
    m = events(spark, d)
    pseudo = m.filter("row_id % 4 = 0").withColumn("pseudo", F.greatest(F.col(Y), F.lit(5.0)))
    return augmented(m.filter("row_id % 4 <> 0"), pseudo, [ROW, TYPE]).drop("is_pseudo").withColumn(Y, rounded(F.col(Y)))


@query("union_common_columns", "F2", with_("m_items", "m_events") + """
select x1, x2 from m_items union all select x1, x2 from m_events""")
def _(spark, d):
    a, b = items(spark, d), events(spark, d)
    common = [c for c in ("x1", "x2", "x3") if c in a.columns and c in b.columns]
    return a.select(*common).unionByName(b.select(*common))


@query("union_then_distinct", "F3", with_("m_items", "m_events") + """
select entity, target_type from m_items union select entity, target_type from m_events""")
def _(spark, d):
    a, b = items(spark, d), events(spark, d)
    return a.select(KEY, TYPE).union(b.select(KEY, TYPE)).distinct()


@query("kept_columns_of_both_fits", "F4", I + """
, a as (select unnest(['x1','x2','x3','x4']) as feature, unnest([var_samp(x1), var_samp(x2), var_samp(x3), var_samp(x4)]) as v from m_items where target_type='AF'),
b as (select unnest(['x1','x2','x3','x4']) as feature, unnest([var_samp(x1), var_samp(x2), var_samp(x3), var_samp(x4)]) as v from m_items where target_type='RO')
select feature from a where v > 0.001 intersect select feature from b where v > 0.0005""")
def _(spark, d):
    from ..operators.prune import common_columns, feature_variances
    cols = ["x1", "x2", "x3", "x4"]
    m = items(spark, d)
    a = feature_variances(m.filter(F.col(TYPE) == "AF"), cols).filter("variance > 0.001")
    b = feature_variances(m.filter(F.col(TYPE) == "RO"), cols).filter("variance > 0.0005")
    return common_columns(a, b)


@query("keys_on_both_sides", "F5", with_("m_daily") + _SIDES + """
select entity from tr intersect select entity from sc""")
def _(spark, d):
    tr, sc = _sides(spark, d)
    return tr.select(KEY).intersect(sc.select(KEY))
