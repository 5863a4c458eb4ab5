"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Column expressions only: one narrow pass over whole texts. A cheap test of the text decides first
whether a pattern is tried at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .spans import found, listed

EMAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
BIRTH = r"(?<![0-9-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])"
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "birth")
#: Score of a confirmed match alone; a context word nearby adds ``CONTEXT``; added kinds need ``LEAST``.
SCORES = {"email": .9, "ip": .6, "card": .8, "phone": .7, "iban": .9, "ssn": .3, "birth": .2}
CONTEXT, LEAST = .35, .5
WORDS = {
    "email": "mail|contact|write|escri|schreib", "ip": "ip|addr|host|server|client", "card": "card|visa|master|amex|tarjeta|carte|karte",
    "phone": "phone|tel|call|mobile|fax|llama|appel", "iban": "iban|bank|account|konto|cuenta|compte",
    "ssn": "ssn|social|security|tax", "birth": "born|birth|dob|geb|nacid|naiss",
}


def small_number(part: Column) -> Column:
    """A run of digits that is 255 at most."""
    plain = F.regexp_replace(part, "^0+", "")
    return (F.length(plain) <= 3) & (F.coalesce(plain.try_cast("int"), F.lit(0)) <= 255)


def card_number(value: Column) -> Column:
    digits = F.translate(value, " -", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def iban_number(value: Column) -> Column:
    """ISO 7064 mod 97-10 over the rearranged characters."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    step = lambda a, c: F.when(F.ascii(c) < 58, a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.length(plain).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(F.length(c) == 0, a).otherwise(step(a, c))) == 1)


def _scored(kind: str, spans: Column) -> Column:
    near = lambda s: F.concat_ws(" ", s["before"], s["after"]).rlike(f"(?i)(?:{WORDS[kind]})")
    return F.transform(spans, lambda s: F.struct(s["at"].alias("at"), s["to"].alias("to"), s["value"].alias("value"),
                                                (F.lit(SCORES[kind]) + F.when(near(s), F.lit(CONTEXT)).otherwise(F.lit(0.0))).alias("score")))


def proposals(text: Column) -> dict[str, Column]:
    """Confirmed and scored spans of every kind."""
    has = lambda x: F.contains(text, F.lit(x))
    tries = {
        "email": (EMAIL, has("@"), None),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]"), lambda v: F.forall(F.split(v, r"\."), small_number)),
        "card": (CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), card_number),
        "phone": (PHONE, has("+"), lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")).between(9, 15)),
        "iban": (IBAN, text.rlike(r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]{11}"), iban_number),
        "ssn": (SSN, text.rlike(r"[0-9]-[0-9]{2}-[0-9]"), None),
        "birth": (BIRTH, text.rlike(r"[0-9]-[0-9]{2}-[0-9]"), None),
    }
    spans = {kind: _scored(kind, found(text, *t)) for kind, t in tries.items()}
    return {k: F.filter(s, lambda x: x["score"] >= LEAST) if k in ADDED else s for k, s in spans.items()}


def find_personal(docs: DataFrame, text: str = "text", name: str = "personal") -> DataFrame:
    """``docs`` with a struct ``name`` of one array per kind: ``at, to, value, score``.

    Spans are code point offsets, end exclusive, leftmost and non-overlapping within a kind; kinds
    may overlap. Base kinds keep every confirmed match; added ones need enough score. Null and
    empty texts have empty arrays. Rows are searched one by one.
    """
    t, = fresh([*docs.columns, name], "_text")
    withtext = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    return withtext.withColumn(name, F.struct(*[c.alias(k) for k, c in proposals(F.col(t)).items()])).drop(t)


def digest(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Counts per base kind, the hash of the base spans, all spans and their scores."""
    p = find_personal(docs.select(doc_id, text), text, "p")
    base = F.array_join(F.concat(*[listed(k, F.col(f"p.{k}")) for k in BASE]), ",")
    every = F.array_join(F.concat(*[listed(k, F.col(f"p.{k}")) for k in BASE + ADDED]), ",")
    scores = F.array_join(F.transform(F.concat(*[F.col(f"p.{k}") for k in BASE + ADDED]), lambda s: F.format_number(s["score"], 2)), ",")
    return p.select(doc_id, *[F.size(f"p.{k}").cast("long").alias(f"n_{k}") for k in BASE],
                    F.sha2(base, 256).alias("base_sha256"), every.alias("spans"), scores.alias("scores"))
