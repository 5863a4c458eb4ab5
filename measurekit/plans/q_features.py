"""Queries over feature blocks: cross-type, paired-variant, text, similarity, pruning, scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..columns import FOLD, KEY, MODEL, REPEAT, ROW, TYPE, Y
from ..functions.hashing import md5_number
from ..functions.scalars import rounded
from ..functions.text import fingerprint, sentences, words
from ..operators import embed, evaluate, lookup, prune, similarity, stack
from ..operators.folds import fold_columns, group_kfold
from ..operators.gram import Moments, fold_gram
from ..operators.linear import univariate_f
from ..session import cut
from .registry import query
from .views import (EVENT_TYPES, ITEM_TYPES, daily, events, items, r6, scoring_side, sql_fold, sql_hash, table, wide_table, with_)

I, DY = with_("m_items"), with_("m_daily")


def _pivot_sql(src, types, name="lk"):
    cols = ", ".join(f"avg(target) filter (target_type = '{t}') as \"xtarget_{t}\"" for t in types)
    return f"{name} as (select entity, {cols} from {src} group by 1)"


@query("cross_type_lookup", "D10 G1", DY + "," + _pivot_sql("m_daily", EVENT_TYPES) + "select entity, " + ", ".join(
    r6(f'"xtarget_{t}"', f'"xtarget_{t}"') for t in EVENT_TYPES) + " from lk")
def _(spark, d):
    out = lookup.cross_lookup(daily(spark, d), EVENT_TYPES)
    return out.select(KEY, *[rounded(F.col(f"xtarget_{t}")).alias(f"xtarget_{t}") for t in EVENT_TYPES])


@query("lookup_join", "C1", DY + "," + _pivot_sql("m_daily", EVENT_TYPES) + "select row_id, " + ", ".join(
    r6(f'"xtarget_{t}"', f'"xtarget_{t}"') for t in EVENT_TYPES) + " from m_daily left join lk using (entity)")
def _(spark, d):
    m = daily(spark, d)
    out = lookup.lookup_join(m, lookup.cross_lookup(m, EVENT_TYPES))
    return out.select(ROW, *[rounded(F.col(f"xtarget_{t}")).alias(f"xtarget_{t}") for t in EVENT_TYPES])


def _cross_sql(src, types, name="cf"):
    v = ", ".join(f"case when target_type <> '{t}' then \"xtarget_{t}\" end as \"xtarget_{t}\"" for t in types)
    k = ", ".join(f"(target_type <> '{t}' and \"xtarget_{t}\" is not null)::int as \"known_{t}\"" for t in types)
    return _pivot_sql(src, types) + f", {name} as (select m.* , {v}, {k} from {src} m left join lk using (entity))"


def cross_items(spark, d):
    m = items(spark, d)
    return lookup.cross_features(m, lookup.cross_lookup(m, ITEM_TYPES), ITEM_TYPES)


@query("cross_type_features", "G2 B10", I + "," + _cross_sql("m_items", ITEM_TYPES) + "select row_id, " + ", ".join(
    [r6(f'"xtarget_{t}"', f'"xtarget_{t}"') for t in ITEM_TYPES] + [f'"known_{t}"' for t in ITEM_TYPES]) + " from cf")
def _(spark, d):
    return cross_items(spark, d).select(ROW, *[rounded(F.col(f"xtarget_{t}")).alias(f"xtarget_{t}") for t in ITEM_TYPES],
                                        *[f"known_{t}" for t in ITEM_TYPES])


@query("rows_with_cross_value", "D14", DY + "," + _cross_sql("m_daily", EVENT_TYPES) + """
select target_type, count(*) filter (coalesce(""" + ", ".join(f'"xtarget_{t}"' for t in EVENT_TYPES) + """) is not null) as n_covered, count(*) as n from cf group by 1""")
def _(spark, d):
    m = daily(spark, d)
    cf = lookup.cross_features(m, lookup.cross_lookup(m, EVENT_TYPES), EVENT_TYPES)
    known = F.coalesce(*[F.col(f"xtarget_{t}") for t in EVENT_TYPES]).isNotNull()
    return cf.groupBy(TYPE).agg(F.count_if(known).alias("n_covered"), F.count(F.lit(1)).alias("n"))


_DERIVED = {"sq_AF": ("square", ["xtarget_AF"]), "rt_AO": ("root", ["xtarget_AO"]),
            "gap": ("difference", ["xtarget_NF", "xtarget_NO"]), "tot": ("sum", ["xtarget_RF", "xtarget_RO"])}


@query("derived_cross_features", "G3", I + "," + _cross_sql("m_items", ITEM_TYPES) + f"""
select row_id, {r6('"xtarget_AF"*"xtarget_AF"', '"sq_AF"')}, {r6('case when "xtarget_AO" is not null then sqrt(greatest("xtarget_AO", 0)) end', '"rt_AO"')},
 {r6('"xtarget_NF"-"xtarget_NO"', 'gap')}, {r6('"xtarget_RF"+"xtarget_RO"', 'tot')} from cf""")
def _(spark, d):
    out = lookup.derived_features(cross_items(spark, d), _DERIVED)
    return out.select(ROW, *[rounded(F.col(c)).alias(c) for c in _DERIVED])


# Variant of a document: the next document of the same source, with its own length and word count.
_VARIANTS = """with b as (select doc_id, source, n_chars::double as len, len(regexp_extract_all(lower(text), '[a-z0-9]+'))::double as words,
  lead(doc_id) over (partition by source order by doc_id) as nxt from documents),
v as (select b.doc_id, c.len as vlen, c.words as vwords from b join b c on c.doc_id = b.nxt)
"""


def _variants(spark, d):
    n = wide_table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").cast("double").alias("len"),
                                            F.size(words(F.col("text"))).cast("double").alias("words"))
    from ..dist import row_number_by_cell
    ranked = row_number_by_cell(n.select("doc_id", "source"), "source", F.floor(F.col("doc_id") / 65536), [F.col("doc_id")])
    nxt = ranked.select("source", (F.col("rn") - 1).alias("rn"), F.col("doc_id").alias("vid"))
    pairs = ranked.join(nxt, ["source", "rn"]).select("doc_id", "vid")
    variant = pairs.join(n.withColumnsRenamed({"doc_id": "vid"}), "vid").select("doc_id", "len", "words")
    return n, variant


@query("variant_deltas", "G4", _VARIANTS + """
select doc_id, case when vlen is null then 0.0 else vlen - len end as delta_len, case when vlen is null then 0.0 else vwords - words end as delta_words
from b left join v using (doc_id)""")
def _(spark, d):
    base, variant = _variants(spark, d)
    return lookup.delta_features(base, variant, "doc_id", ["len", "words"]).select("doc_id", "delta_len", "delta_words")


@query("variant_ratios", "G5", _VARIANTS + """
select doc_id, round(case when abs(len) > 1e-9 then vlen/len end, 6) as ratio_len, round(case when abs(words) > 1e-9 then vwords/words end, 6) as ratio_words
from b left join v using (doc_id)""")
def _(spark, d):
    base, variant = _variants(spark, d)
    out = lookup.ratio_features(base, variant, "doc_id", ["len", "words"])
    return out.select("doc_id", rounded(F.col("ratio_len")).alias("ratio_len"), rounded(F.col("ratio_words")).alias("ratio_words"))


def _bits_sql(name, table_, idc, n_bits, n, exact=False):
    sizes = [n] if exact else range(1, n + 1)
    grams = " union all ".join(
        f"select id, array_to_string(w[i:i+{s - 1}], ' ') as g from {name}_w, lateral (select unnest(range(1, len(w) - {s} + 2)) as i) x" for s in sizes)
    return f"""{name}_w as (select {idc} as id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from {table_}),
{name} as (select distinct id, ({sql_hash('g')} % {n_bits})::int as bit from ({grams}))"""


def _fp_query(name, n_bits, n, kind):
    @query(name, "G6", "with " + _bits_sql("b", "documents", "doc_id", n_bits, n, kind == "exact") + """
select doc_id, coalesce(n, 0) as n_on, coalesce(s, 0)::bigint as bit_sum, coalesce(q, 0)::bigint as bit_sq from documents
left join (select id as doc_id, count(*) n, sum(bit) s, sum(bit::bigint*bit) q from b group by 1) using (doc_id)""")
    def _(spark, d):
        out = wide_table(spark, d, "documents").select("doc_id", fingerprint(F.col("text"), n_bits, n, kind).alias("bits"))
        lng = F.col("bits").cast("array<bigint>")
        add = lambda a, v: a + v
        return out.select("doc_id", F.size("bits").cast("bigint").alias("n_on"),
                          F.aggregate(lng, F.lit(0).cast("bigint"), add).alias("bit_sum"),
                          F.aggregate(F.transform(lng, lambda v: v * v), F.lit(0).cast("bigint"), add).alias("bit_sq"))


for _n, _b, _s, _k in (("fingerprint_256_runs2", 256, 2, "run"), ("fingerprint_1024_runs3", 1024, 3, "run"),
                       ("fingerprint_2048_runs3", 2048, 3, "run"), ("fingerprint_512_pairs", 512, 2, "exact"),
                       ("fingerprint_256_quads", 256, 4, "exact")):
    _fp_query(_n, _b, _s, _k)


@query("similarity_density", "G7 C6", "with " + _bits_sql("q", "documents", "doc_id", 1024, 2) + "," + _bits_sql("r", "benchmark", "item_id", 1024, 2) + """,
qn as (select id, count(*) n from q group by 1), rn as (select id, count(*) n from r group by 1),
c as (select q.id as qid, r.id as rid, count(*) as c from q join r using (bit) group by all),
s as (select qn.id as qid, rn.id as rid, coalesce(c.c, 0)/(qn.n + rn.n - coalesce(c.c, 0))::double as sim
  from qn cross join rn left join c on c.qid = qn.id and c.rid = rn.id),
t as (select qid, sim, row_number() over (partition by qid order by sim desc, rid) as k from s)
select d.doc_id, round(max(sim), 6) as sim_max, round(avg(sim), 6) as sim_mean from documents d left join t on t.qid = d.doc_id and k <= 7 group by 1""")
def _(spark, d):
    bits = fingerprint(F.col("text"), 1024, 2)
    docs = wide_table(spark, d, "documents").select("doc_id", bits.alias("bits"))
    ref = table(spark, d, "benchmark").select("item_id", bits.alias("bits"))
    return similarity.density(docs, "doc_id", "bits", ref, "item_id", "bits", 1024).select(
        "doc_id", rounded(F.col("sim_max")).alias("sim_max"), rounded(F.col("sim_mean")).alias("sim_mean"))


_KNN = """with e as (select vec_id, embedding::double[] as v, label from embeddings),
p as (select q.vec_id as qid, r.vec_id as rid, list_distance(q.v, r.v) as dist from e q, e r where q.label = 0 and r.label <> 0),
t as (select *, row_number() over (partition by qid order by dist, rid::varchar) as k from p)
"""


@query("nearest_neighbours", "C7", _KNN + """
select qid::varchar as qid, rid::varchar as rid, round(dist, 6) as distance, k::int as "rank" from t where k <= 20""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    out = similarity.neighbours(e.filter("label = 0"), "vec_id", "embedding", e.filter("label <> 0"), "vec_id", "embedding", 20)
    return out.select("qid", "rid", rounded(F.col("distance")).alias("distance"), F.col("rank").cast("int").alias("rank"))


@query("neighbour_density", "G10 C7", """with e as (select vec_id, embedding::double[] as v from embeddings),
t as (select q.vec_id as qid, list_distance(q.v, r.v) as dist, row_number() over (partition by q.vec_id order by list_distance(q.v, r.v)) as k
 from e q join e r on q.vec_id <> r.vec_id),
m as (select qid, avg(dist) as md from t where k <= 20 group by 1), th as (select quantile_cont(md, 0.9) as x from m)
select qid::varchar as qid, round(md, 6) as mean_distance, md > x as sparse from m, th""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    m = similarity.neighbour_density(e, "vec_id", "embedding", e, "vec_id", "embedding", 20, exclude_self=True)
    m = cut(m.select(F.col("vec_id").cast("string").alias("qid"), "mean_distance"))
    from ..operators.audit import percentile_threshold
    th = percentile_threshold(m.withColumn("_all", F.lit(1)), "_all", "mean_distance", 0.9).first()["threshold"]
    return m.select("qid", rounded(F.col("mean_distance")).alias("mean_distance"), (F.col("mean_distance") > F.lit(th)).alias("sparse"))


@query("pca_density", "G10 L27")
def _(spark, d):
    e = table(spark, d, "embeddings")
    cols = [f"e{i}" for i in range(64)]
    wide = e.select("vec_id", F.col("label").cast("string").alias(TYPE), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(cols)])
    out = embed.pca_density(wide.filter("target_type <> '0'"), wide, "vec_id", cols)
    from ..operators.output import risk_flags
    return risk_flags(out).select(TYPE, rounded(F.col("sparse_rate"), 4).alias("sparse_rate"), "at_risk")


@query("knn_regression", "K6", f"""with e as (select vec_id, embedding::double[] as v, (label % 2)::varchar as target_type, label::double as target,
  {sql_fold(42, 'vec_id')} as fold from embeddings),
p as (select q.vec_id, r.target, list_distance(q.v, r.v) as dist, row_number() over (partition by q.vec_id order by list_distance(q.v, r.v), r.vec_id::varchar) as k
 from e q join e r on q.target_type = r.target_type and q.fold <> r.fold)
select vec_id::varchar as vec_id, round(case when count(*) filter (dist = 0) > 0 then avg(target) filter (dist = 0)
  else sum(target/nullif(dist, 0))/sum(1/nullif(dist, 0)) end, 6) as pred from p where k <= 10 group by 1""")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"),
                                             (F.col("label") % 2).cast("string").alias(TYPE), F.col("label").cast("double").alias(Y))
    out = similarity.knn_regression(group_kfold(e, key="vec_id"), "vec_id", "vec", 10)
    return out.select(F.col("vec_id").cast("string").alias("vec_id"), rounded(F.col("pred")).alias("pred"))


@query("interleaved_sentences", "G8", """
with w as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents),
t as (select doc_id, w, i, w[i] as u, case when i < len(w) then w[i]||' '||w[i+1] end as p from w, lateral (select unnest(range(1, len(w)+1)) as i) x),
k as (select doc_id, count(u) + count(p) as n_tokens, string_agg(u||coalesce('/'||p, ''), '/' order by i) as s from t group by 1)
select doc_id, coalesce(n_tokens, 0) as n_tokens, md5(coalesce(s, '')) as sentence_md5 from documents left join k using (doc_id)""")
def _(spark, d):
    s = wide_table(spark, d, "documents").select("doc_id", sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("n_tokens"), F.md5(F.concat_ws("/", "s")).alias("sentence_md5"))


@query("text_embedding", "G9")
def _(spark, d):
    docs = wide_table(spark, d, "documents").select("doc_id", "text")
    vectors = embed.train_embedding(docs)
    out = embed.embed(docs, "doc_id", "text", vectors, embed.DIM)
    norm = F.sqrt(F.aggregate("emb", F.lit(0.0), lambda a, v: a + v * v))
    return out.select("doc_id", F.size("emb").alias("dim"), rounded(norm, 3).alias("norm"))


# --- pruning, imputation, scaling ---------------------------------------------

WIDE = ["x1", "x2", "x3", "x4", "neg1", "dup2", "flat", "mix", "gap3"]
_WIDE_SQL = """, w as (select *, -x1 + x2*0.01 as neg1, x2*3 + 1 as dup2, 7.0::double as flat, x1 + 20*x3 as mix,
  case when line % 3 = 0 then null else x3 + x1*0.1 end as gap3 from m_items)"""


def wide_items(spark, d):
    m = items(spark, d)
    return m.withColumns({"neg1": -F.col("x1") + F.col("x2") * 0.01, "dup2": F.col("x2") * 3 + 1, "flat": F.lit(7.0),
                          "mix": F.col("x1") + 20 * F.col("x3"),
                          "gap3": F.when(F.col("line") % 3 != 0, F.col("x3") + F.col("x1") * 0.1)})


def _unpivot(expr, cols=WIDE, src="w", where="true", extra=""):
    return " union all ".join(f"select {extra}'{c}' as feature, {expr.format(c=c)} from {src} where {where}" for c in cols)


@query("variance_prune", "G11", I + _WIDE_SQL + f", v as ({_unpivot('var_samp({c}) as v')}) select feature, round(v, 6) as variance, v > 1e-6 as kept from v")
def _(spark, d):
    return prune.feature_variances(wide_items(spark, d), WIDE).select(
        "feature", rounded(F.col("variance")).alias("variance"), (F.col("variance") > prune.VAR_FLOOR).alias("kept"))


@query("variance_prune_population", "G11", I + _WIDE_SQL + f", v as ({_unpivot('var_pop({c}) as v')}) select feature, round(v, 6) as variance, v > 1e-6 as kept from v")
def _(spark, d):
    return prune.feature_variances(wide_items(spark, d), WIDE, ddof=0).select(
        "feature", rounded(F.col("variance")).alias("variance"), (F.col("variance") > prune.VAR_FLOOR).alias("kept"))


_PAIRS = [(WIDE[i], WIDE[j]) for i in range(len(WIDE)) for j in range(i + 1, len(WIDE)) if "flat" not in (WIDE[i], WIDE[j])]
_CORR_SQL = ", r as (" + " union all ".join(
    f"select '{a}' as i, '{b}' as j, corr({a}, {b}) as r from w" for a, b in _PAIRS) + ")"


@query("pairwise_correlations", "G12", I + _WIDE_SQL + _CORR_SQL + "select i, j, round(r, 6) as r from r")
def _(spark, d):
    cols = [c for c in WIDE if c != "flat"]
    return prune.correlations(wide_items(spark, d), cols).select("i", "j", rounded(F.col("r")).alias("r"))


@query("correlation_prune", "G12 G21", I + _WIDE_SQL + _CORR_SQL + f""", v as ({_unpivot('var_samp({c}) as v')})
select feature from v where v > 1e-6 and feature not in (select j from r where abs(r) > 0.98)""")
def _(spark, d):
    kept = prune.prune(wide_items(spark, d), WIDE)
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@query("pooled_prune", "G13 F2", with_("m_items", "m_events") + """, pool as (select x1, x2, x3 from m_items),
u as (select x1, x2 from m_items union all select x1, x2 from m_events),
v as (select 'x1' as feature, var_samp(x1) v from u union all select 'x2', var_samp(x2) from u),
c as (select corr(x1, x2) as r from u)
select feature from v, c where v > 1e-6 and not (feature = 'x2' and abs(r) > 0.98) union all select 'x3'""")
def _(spark, d):
    kept = prune.prune_pooled(items(spark, d), events(spark, d), ["x1", "x2", "x3"])
    return spark.createDataFrame([(c,) for c in kept], "feature string")


@query("median_imputed", "G14", I + f""", m as (select target_type, median(x4) as md from m_items where supp % 10 <> 0 group by 1)
select row_id, {r6('coalesce(x4, md)', 'x4')} from m_items join m using (target_type) where supp % 10 = 0""")
def _(spark, d):
    tr, sc = scoring_side(items(spark, d))
    return prune.impute_median(tr, sc, ["x4"], TYPE).select(ROW, rounded(F.col("x4")).alias("x4"))


@query("standard_scaled", "G15", I + f""", m as (select avg(x1) a1, stddev_pop(x1) s1, avg(x3) a3, stddev_pop(x3) s3 from m_items where supp % 10 <> 0)
select row_id, {r6('(x1-a1)/s1', 'x1')}, {r6('(x3-a3)/s3', 'x3')} from m_items, m where supp % 10 = 0""")
def _(spark, d):
    tr, sc = scoring_side(items(spark, d))
    out = prune.standardize(tr, sc, ["x1", "x3"])
    return out.select(ROW, rounded(F.col("x1")).alias("x1"), rounded(F.col("x3")).alias("x3"))


@query("pooled_impute_and_scale", "G16", with_("m_items", "m_events") + f""", u as (select x2, x4 from m_items union all select x2, null from m_events),
md as (select median(x4) as m4 from u), f as (select x2, coalesce(x4, m4) as x4 from u, md),
s as (select avg(x2) a2, stddev_pop(x2) s2, avg(x4) a4, stddev_pop(x4) s4 from f)
select row_id, {r6('(x2-a2)/s2', 'x2')}, {r6('(coalesce(x4, m4)-a4)/s4', 'x4')} from m_items, md, s""")
def _(spark, d):
    m, ev = items(spark, d), events(spark, d).withColumn("x4", F.lit(None).cast("double"))
    out = prune.pooled_scaler(m, ev, ["x2", "x4"])(m)
    return out.select(ROW, rounded(F.col("x2")).alias("x2"), rounded(F.col("x4")).alias("x4"))


_SEL = ["x1", "x2", "x3", "mix"]


@query("univariate_select", "G17 G18", I + _WIDE_SQL + ", s as (" + _unpivot(
    "count(*) as n, power(corr({c}, target), 2) as r2", _SEL, extra="target_type, ").replace("where true", "where true group by target_type") + """),
f as (select *, r2/(1-r2)*(n-2) as f, row_number() over (partition by target_type order by r2 desc, feature) as k from s)
select target_type, feature, round(r2, 6) as r2, round(f, 3) as f from f where k <= 2""")
def _(spark, d):
    from ..operators.clean import top_rows
    sc = prune.univariate_scores(wide_items(spark, d), _SEL, Y, TYPE)
    return top_rows(sc, [TYPE], [F.desc("r2"), F.col("feature")], 2, "k").select(
        TYPE, "feature", rounded(F.col("r2")).alias("r2"), rounded(F.col("f"), 3).alias("f"))


@query("adaptive_feature_budget", "G18", I + """
select target_type, case when count(*) >= 10000 then 10000 else greatest(30, (count(*)//5)::int) end::int as k from m_items group by 1""")
def _(spark, d):
    n, p = F.count(F.lit(1)), 10000
    return items(spark, d).groupBy(TYPE).agg(
        F.when(n >= p, p).otherwise(F.greatest(F.lit(30), F.floor(n / 5).cast("int"))).cast("int").alias("k"))


@query("constant_in_fold", "G19", I + f""", w as (select *, {sql_fold(42)} as fold, 7.0::double as flat from m_items),
z as (select *, case when fold = 2 then x1 else 1.0 end as late from w), k as (select distinct target_type, fold from z)
select k.target_type, k.fold, u.feature from k join z on z.target_type = k.target_type and z.fold <> k.fold,
 lateral (values ('flat', z.flat), ('late', z.late), ('x1', z.x1)) u(feature, x) group by all having min(x) = max(x)""")
def _(spark, d):
    m = group_kfold(items(spark, d)).withColumn("flat", F.lit(7.0))
    m = m.withColumn("late", F.when(F.col(FOLD) == 2, F.col("x1")).otherwise(1.0))
    return prune.constant_in_training(m, ["flat", "late", "x1"], TYPE, FOLD)


@query("distinct_candidate_masks", "E8", I + """, c as (select unnest([20, 20.5, 30, 45.5, 45]) as candidate),
s as (select candidate, count(*) n, sum(hash(row_id) % 1000003) h from m_items, c where x1 > candidate group by 1)
select n as n_rows, min(candidate)::double as representative, count(*) as n_same from s group by n, h""")
def _(spark, d):
    cand = F.explode(F.array(*[F.lit(v) for v in (20.0, 20.5, 30.0, 45.5, 45.0)]))
    picked = items(spark, d).select(ROW, "x1", cand.alias("candidate")).filter("x1 > candidate")
    return evaluate.distinct_masks(picked)
