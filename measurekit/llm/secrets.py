"""Secrets: patterns propose candidates, corpus-wide ownership tells live ones from copied examples.

Every candidate value is hashed; the hashes are counted by distinct repositories (texts, so that
copies of one document count once) and distinct owners (sources). A value that several texts of
several owners hold, or many texts of a single owner, is an example that was copied around; one that
few hold looks live, however often its document was copied. Column expressions and aggregates only; the
counts go through (hash, text) and (hash, owner) first, so a value that a third of all documents hold
is summed by many tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .spans import found

ASSIGN = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]++)")
ACCESS = r"AKIA[A-Z0-9]++"
HEX = r"[0-9a-f]{24,}+"
GENERIC = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "generic")
OWNERS = 2         # an example has so many owners
REPOSITORIES = 3   # and so many texts
MANY = 20          # or so many texts, whoever owns them
NAMED = "(?i)example"   # a value that says so itself needs the owners only


def mixed_token(v: Column) -> Column:
    """Letters and digits both, several of each: not a long word, not a number."""
    return (F.length(F.regexp_replace(v, "[^0-9]", "")) >= 4) & (F.length(F.regexp_replace(v, "[^A-Za-z]", "")) >= 4)


def _secret(kind: str, v: Column) -> Column:
    return F.regexp_extract(v, ASSIGN, 1) if kind == "assign" else v


def proposals(text: Column) -> Column:
    """All candidates ``at, rank, kind, to, secret`` (a hash) and ``named``, by start and then kind."""
    tries = {
        "assign": (ASSIGN, text.rlike(ASSIGN), lambda v: F.length(_secret("assign", v)) >= 6),
        "access": (ACCESS, F.contains(text, F.lit("AKIA")), lambda v: F.length(v) >= 20),
        "hex": (HEX, text.rlike(HEX), None),
        "generic": (GENERIC, text.rlike(GENERIC), mixed_token),
    }
    one = lambda i, kind: lambda s: F.struct(
        s["at"].alias("at"), F.lit(i).alias("rank"), F.lit(kind).alias("kind"), s["to"].alias("to"), F.md5(_secret(kind, s["value"])).alias("secret"),
                                           _secret(kind, s["value"]).rlike(NAMED).alias("named"))
    return F.array_sort(F.concat(*[F.transform(found(text, *t), one(i, k)) for i, (k, t) in enumerate(tries.items())]))


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source", owners: int = OWNERS,
                 repositories: int = REPOSITORIES, many: int = MANY) -> DataFrame:
    """``doc_id, version, found``: per row its candidates ``at, rank, kind, to, secret, repositories, owners, live``.

    A value is an example when ``repositories`` distinct texts and ``owners`` owners hold it, or
    ``many`` texts at all; a value that calls itself an example is one as soon as ``owners`` owners hold it. Base
    kinds keep every match; a generic token stays unless it is an example. ``version`` is a hash of
    the text. Null and empty texts have no candidates; a null owner counts as one owner. Equal texts
    are one repository, under whatever ids, and get equal results, each row its own.
    """
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), F.col(owner).alias("owner"), F.xxhash64(text).alias("version"),
                              proposals(F.coalesce(F.col(text), F.lit(""))).alias("found")))
    each = rows.filter(F.size("found") > 0).select("doc_id", "version", "owner", F.explode("found").alias("c"))
    held = lambda by: each.select("c.secret", by).distinct().groupBy("secret")
    counts = held("version").agg(F.count(F.lit(1)).alias("repositories")).join(held("owner").agg(F.count(F.lit(1)).alias("owners")), "secret")
    copied = (F.col("owners") >= owners) & ((F.col("repositories") >= repositories) | F.col("named"))
    judged = each.select("doc_id", "version", "c.*").distinct().join(counts, "secret").withColumn(
        "live", ~(copied | (F.col("repositories") >= many)))
    kept = judged.filter((F.col("kind") != "generic") | F.col("live"))
    lists = kept.groupBy("doc_id", "version").agg(F.array_sort(F.collect_list(F.struct(
        "at", "rank", "kind", "to", "secret", "repositories", "owners", "live"))).alias("found")).alias("k")
    same = F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.version") == F.col("k.version"))
    out = rows.alias("r").join(lists, same, "left")
    none = F.array().cast(lists.schema["found"].dataType)
    return out.select("r.doc_id", "r.version", F.coalesce("k.found", none).alias("found"))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def digest(docs: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans, all spans, and how many look live."""
    s = find_secrets(docs)
    shown = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["at"].cast("string"), x["to"].cast("string"))), ",")
    base = F.filter("found", lambda x: x["kind"] != "generic")
    count = lambda test: F.size(F.filter("found", test)).cast("long")
    return s.select("doc_id", *[count(_is(k)).alias(f"n_{k}") for k in KINDS[:3]],
                    F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"),
                    count(lambda x: x["live"]).alias("n_live"), count(lambda x: ~x["live"]).alias("n_example"))
