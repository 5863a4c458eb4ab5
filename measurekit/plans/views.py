"""Measurement views over the given tables, once as DataFrames and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import KEY, ROW, TYPE, Y
from ..functions.hashing import md5_number
from ..sources.tables import spread

ITEM_TYPES = ["AF", "AO", "NF", "NO", "RF", "RO"]
EVENT_TYPES = ["click", "error", "purchase", "scroll", "view"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


SPREAD = {"lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax",
                       "l_returnflag", "l_linestatus"]}


def wide_table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The same, dealt out over all cores when the file is small; for compute-heavy use."""
    df = table(spark, d, name)
    return spread(df.select(*SPREAD[name]) if name in SPREAD else df)


def items(spark: SparkSession, d: str) -> DataFrame:
    """Line items with a planted target: x1..x3 act linearly, the key has its own effect."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    j = wide_table(spark, d, "lineitem").join(part, "l_partkey")
    ids = [F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    noise = F.pmod(md5_number(F.concat_ws(":", *ids[:3])), F.lit(1000)) / 50.0
    y = (2 * F.col("l_quantity") - 100 * F.col("l_discount") + 0.5 * F.col("p_size")
         + F.col("l_partkey") % 50 + F.when(F.col("l_linestatus") == "O", 10).otherwise(0) + noise)
    return j.select(
        F.concat_ws("-", *ids).alias(ROW), F.col("l_partkey").alias(KEY),
        F.concat("l_returnflag", "l_linestatus").alias(TYPE), y.alias(Y), F.col("l_quantity").alias("x1"),
        F.col("l_discount").alias("x2"), F.col("p_size").cast("double").alias("x3"),
        F.when(F.col("l_linenumber") % 7 == 0, None).otherwise(F.col("l_tax")).alias("x4"),
        F.col("l_suppkey").alias("supp"), F.col("l_linenumber").alias("line"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias(ROW), F.col("user_id").alias(KEY), F.col("event_type").alias(TYPE),
        F.col("value").alias(Y), F.hour("ts").cast("double").alias("x1"),
        F.get_json_object("props", "$.k").cast("double").alias("x2"))


def daily(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias(ROW),
        F.concat_ws("|", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias(KEY),
        F.col("event_type").alias(TYPE), F.col("value").alias(Y))


def docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a measurement table of their length, a quarter of them also re-punctuated.

    The key is a digest of the whole text, so that grouping shuffles 32 characters a row.
    """
    plain = wide_table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars", "source")
    varied = plain.filter("doc_id % 4 = 1").select(
        (-F.col("doc_id")).alias("doc_id"), F.concat(F.replace("text", F.lit(" "), F.lit(", ")), F.lit(" !")).alias("text"), "lang",
        F.when(F.col("doc_id") % 8 == 1, F.col("n_chars")).otherwise(2 * F.col("n_chars")).alias("n_chars"), "source")
    return plain.union(varied).select(
        F.col("doc_id").alias(ROW), F.md5("text").alias(KEY), F.col("lang").alias(TYPE),
        F.col("n_chars").cast("double").alias(Y), "source", "text")


def scoring_side(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled rows, and the rows of every tenth supplier as an unlabelled scoring side."""
    held = F.col("supp") % 10 == 0
    return df.filter(~held), df.filter(held)


_HEX = "(('0x'||substr(md5({}),1,8))::bigint)"


def sql_hash(expr: str) -> str:
    return _HEX.format(expr)


def sql_fold(seed: str | int, key: str = "entity", k: int = 5) -> str:
    return f"({sql_hash(f'({seed})::varchar||chr(58)||({key})::varchar')} % {k})::int"


SQL: dict[str, str] = {
    "m_items": f"""m_items as (
  select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as row_id, l_partkey as entity,
    l_returnflag||l_linestatus as target_type,
    2*l_quantity - 100*l_discount + 0.5::double*p_size + (l_partkey % 50)
      + case when l_linestatus='O' then 10 else 0 end
      + ({sql_hash("concat_ws(':', l_orderkey, l_linenumber, l_partkey)")} % 1000)/50.0::double as target,
    l_quantity as x1, l_discount as x2, p_size::double as x3,
    case when l_linenumber % 7 = 0 then null else l_tax end as x4, l_suppkey as supp, l_linenumber as line
  from lineitem join part on l_partkey = p_partkey)""",
    "m_events": """m_events as (
  select event_id as row_id, user_id as entity, event_type as target_type, value as target,
    extract(hour from ts)::double as x1, json_extract_string(props,'$.k')::double as x2 from events)""",
    "m_daily": """m_daily as (
  select event_id as row_id, user_id||'|'||strftime(ts, '%Y-%m-%d') as entity, event_type as target_type,
    value as target from events)""",
    "m_docs": """m_docs as (
  select doc_id as row_id, md5(text) as entity, lang as target_type, n_chars::double as target, source, text from
   (select doc_id, text, lang, n_chars, source from documents union all
    select -doc_id, replace(text, ' ', ', ')||' !', lang, case when doc_id % 8 = 1 then n_chars else 2*n_chars end, source
    from documents where doc_id % 4 = 1))""",
}


def with_(*parts: str) -> str:
    """WITH clause from view names and literal CTEs."""
    return "with recursive " + ",\n".join(SQL.get(p, p) for p in parts) + "\n"


def r6(expr: str, name: str) -> str:
    return f"round(({expr})::double, 6) as {name}"


# SQL text of one-feature (or mean-only) ridge by fold complements, and what follows from it.

def sql_long(prefix: str, src: str, repeats: int, k: int = 5, seed: int = 42, key: str = "entity") -> str:
    return f"""{prefix}_f as (select s.*, rep as repeat, {sql_fold(f'{seed}+rep', f's.{key}', k)} as fold
  from {src} s, (select unnest(range({repeats}))::int as rep) r)"""


def sql_linear(prefix: str, folds: str, x: str | None, alpha: float = 0.0, target: str = "target",
               where: str = "true", weight: str = "1.0::double") -> list[str]:
    """CTEs <prefix>_c: (target_type, repeat, fold, n, b0, b); fold -1 is the fit on all rows."""
    xx = x or "0.0::double"
    w = weight
    slope = "0.0::double" if x is None else f"(sxy - sx*sy/n)/nullif(sxx - sx*sx/n + {alpha}, 0)"
    return [
        f"""{prefix}_s as (select target_type, repeat, fold, sum({w}) as n, sum({w}*{xx}) as sx, sum({w}*{target}) as sy,
  sum({w}*{xx}*{xx}) as sxx, sum({w}*{xx}*{target}) as sxy from {folds} where {where} and {target} is not null group by all)""",
        f"""{prefix}_a as (select target_type, repeat, sum(n) n, sum(sx) sx, sum(sy) sy, sum(sxx) sxx, sum(sxy) sxy
  from {prefix}_s group by all)""",
        f"""{prefix}_k as (select distinct target_type, repeat, fold from {folds})""",
        f"""{prefix}_t as (select q.target_type, q.repeat, q.fold, a.n-coalesce(s.n,0) n, a.sx-coalesce(s.sx,0) sx,
  a.sy-coalesce(s.sy,0) sy, a.sxx-coalesce(s.sxx,0) sxx, a.sxy-coalesce(s.sxy,0) sxy
  from {prefix}_k q join {prefix}_a a using (target_type, repeat) left join {prefix}_s s using (target_type, repeat, fold)
  union all select target_type, repeat, -1, n, sx, sy, sxx, sxy from {prefix}_a where repeat = 0)""",
        f"""{prefix}_b as (select *, coalesce({slope}, 0) as b from {prefix}_t)""",
        f"""{prefix}_c as (select target_type, repeat, fold, n, (sy - b*sx)/n as b0, b from {prefix}_b)""",
    ]


def sql_linear2(prefix: str, folds: str, x: str, z: str, alpha: float, target: str = "target") -> list[str]:
    """The same with two features, solved by determinants: columns b0, b1, b2."""
    names = ["n", "s1", "s2", "sy", "s11", "s12", "s22", "s1y", "s2y", "syy"]
    exprs = ["count(*)::double", f"sum({x})", f"sum({z})", f"sum({target})", f"sum({x}*{x})", f"sum({x}*{z})",
             f"sum({z}*{z})", f"sum({x}*{target})", f"sum({z}*{target})", f"sum({target}*{target})"]
    sel = ", ".join(f"{e} as {n}" for e, n in zip(exprs, names))
    tot = ", ".join(f"sum({n}) as {n}" for n in names)
    diff = ", ".join(f"a.{n} - s.{n} as {n}" for n in names)
    return [
        f"{prefix}_s as (select target_type, repeat, fold, {sel} from {folds} group by all)",
        f"{prefix}_a as (select target_type, repeat, {tot} from {prefix}_s group by all)",
        f"""{prefix}_t as (select s.target_type, s.repeat, s.fold, {diff} from {prefix}_s s join {prefix}_a a using (target_type, repeat)
  union all select target_type, repeat, -1, {', '.join(names)} from {prefix}_a where repeat = 0)""",
        f"""{prefix}_g as (select *, s11-s1*s1/n+{alpha} as a, s12-s1*s2/n as h, s22-s2*s2/n+{alpha} as d,
  s1y-s1*sy/n as u, s2y-s2*sy/n as v from {prefix}_t)""",
        f"""{prefix}_b as (select *, (u*d-v*h)/(a*d-h*h) as b1, (v*a-u*h)/(a*d-h*h) as b2 from {prefix}_g)""",
        f"""{prefix}_c as (select target_type, repeat, fold, n, (sy-b1*s1-b2*s2)/n as b0, b1, b2 from {prefix}_b)""",
    ]


def sql_pred(prefix: str, folds: str, x: str | None, name: str) -> str:
    """CTE <name>: rows x repeats with ``pred`` of the fit that excluded the row's fold."""
    xx = x or "0.0::double"
    return f"""{name} as (select f.*, c.b0 + c.b*{xx} as pred from {folds} f join {prefix}_c c
  on f.target_type=c.target_type and f.repeat=c.repeat and f.fold=c.fold)"""


R2 = "1 - sum((target-pred)*(target-pred)) / nullif(var_pop(target)*count(*), 0)"
RMSE = "sqrt(sum((target-pred)*(target-pred))/count(*))"
