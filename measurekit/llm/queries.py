"""One registered query per corpus operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, fingerprints, fp_search, language, lines, mixing, ngram_join, packing, pii, quality, secrets, token_counts, toxicity
from .common import documents

Run = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity(documents(spark, d), spark.read.parquet(f"{d}/labels.parquet"))


def op2_ngram_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.clusters(documents(spark, d)).select("doc_id", "n_shingles", "component_id")


def op3_personal_data(spark: SparkSession, d: str) -> DataFrame:
    return pii.digest(documents(spark, d))


def op4_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(documents(spark, d))


def op5_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, d).select("doc_id", "text"), name="q").select("doc_id", "q.*")


def op6_secret_scans(spark: SparkSession, d: str) -> DataFrame:
    return secrets.digest(documents(spark, d))


def op7_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    q = quality.with_quality(documents(spark, d).select("doc_id", "text", "lang"), name="q")
    return q.select("doc_id", *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                  "base_failed", "kept", "ratio", "low_chunks", "high_chunks", "n_chunks")])


def op8_order_minhash(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(documents(spark, d))


def op9_source_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(documents(spark, d))[1].select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = lines.dedup_lines(documents(spark, d).select("doc_id", "text"), name="q")
    return out.select("doc_id", "q.n_lines", "q.n_dropped", F.sha2(F.col("q.text"), 256).alias("kept_sha256"))


def op11_ranked_search(spark: SparkSession, d: str) -> DataFrame:
    return fp_search.ranked(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"))


def op12_tokenizer_alignment(spark: SparkSession, d: str) -> DataFrame:
    return alignment.align(documents(spark, d))


def op13_language_id(spark: SparkSession, d: str) -> DataFrame:
    return language.language(documents(spark, d))


QUERIES: dict[str, Run] = {f.__name__: f for f in (
    op1_toxicity, op2_ngram_jaccard_join, op3_personal_data, op4_best_fit_packing, op5_token_counts, op6_secret_scans,
    op7_quality_rules, op8_order_minhash, op9_source_mixing, op10_line_dedup, op11_ranked_search,
    op12_tokenizer_alignment, op13_language_id)}
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL: dict[str, str] = {
    "op2_ngram_jaccard_join": f"""
with recursive w as (select doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+') if x <> ''] as w
  from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
  else [array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)] end) as g from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * i >= 85 * (a.n + b.n - i)),
both_ways as (select x, y from links union all select y, x from links),
r as (select doc_id, doc_id as c from documents union select y, c from r join both_ways on x = r.doc_id and c < y)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, min(c) as component_id from documents d join r using (doc_id) left join n using (doc_id) group by all""",
    "op10_line_dedup": f"""
with l as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from
  (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents)),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') as k from l),
o as (select k, min(doc_id) as owner from k where length(k) >= 10 group by k having count(distinct doc_id) >= 2),
m as (select doc_id, line, pos, owner is not null and owner <> doc_id as gone from k left join o using (k))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256 from m group by 1""",
    "op11_ranked_search": f"""
with b as (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) as t from benchmark),
q as (select item_id, t, count(*) as k from b group by all),
d as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) as t from documents),
f as (select doc_id, t, count(*) as tf from d group by all),
n as (select doc_id, count(*) as n from d group by 1),
s as (select count(*) as docs, sum(n)::bigint as terms from n),
v as (select t, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint as w from (select t, count(*) as df from f group by 1), s),
m as (select doc_id, 100 - 25 + (25 * n * docs) // terms as m from n, s),
r as (select item_id, doc_id, sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from q join v using (t) join f using (t) join m using (doc_id) group by all)
select item_id, rank, doc_id, score from
  (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from r where score > 0) where rank <= 20""",
}
