"""Corpus-wide line deduplication: explode normalised lines, hash them, count documents, reassemble.

A key found in enough documents keeps its lines in the document with the least id only. Keys
travel as 128-bit hashes. Counts combine on the map side and the join that follows can be split
by Spark, so a line that a third of all documents share is handled like any other; texts move
once, to meet their document's drop list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, stored

STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the stripped line, ASCII letters already lower-cased; None when too short."""
    x = line.strip(STRIP)
    if len(x) < min_chars or len(x) < 4 * min_chars and len(x.decode("utf-8")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(x)


def _line_rows(min_chars: int):
    """The distinct keys of every document: ``doc, h1, h2``."""
    def rows(batches):
        for b in batches:
            keys, owned = [], []
            for t in b.column(1).to_pylist():
                own = {k for x in (t or "").encode().lower().split(b"\n") if (k := line_key(x, min_chars))}
                keys.extend(own)
                owned.append(len(own))
            h = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), owned), pa.int64()),
                                              pa.array(h[:, 0]), pa.array(h[:, 1])], ["doc", "h1", "h2"])
    return rows


def _reassemble(least: int):
    """Lines in their order, without those whose key is on the document's drop list."""
    @F.arrow_udf("struct<text:string,n_lines:long,n_dropped:long>")
    def reassembled(texts: pa.Array, drops: pa.Array) -> pa.Array:
        out, total, gone = [], [], []
        for t, d in zip(texts.to_pylist(), drops.to_pylist(), strict=True):
            lines = kept = (t or "").split("\n")
            if d:
                bad = {a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True) for a, b in zip(d[::2], d[1::2], strict=True)}
                kept = [x for x, low in zip(lines, (t or "").encode().lower().split(b"\n"), strict=True) if line_key(low, least) not in bad]
            out.append(t if len(kept) == len(lines) else "\n".join(kept))
            total.append(len(lines))
            gone.append(len(lines) - len(kept))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                                          ["text", "n_lines", "n_dropped"])
    return reassembled


def drop_lists(docs: DataFrame, text: str, doc_id: str, min_chars: int, min_docs: int) -> DataFrame:
    """``doc, drops``: the keys a document loses, each as two longs in a row."""
    lines = docs.select(F.col(doc_id).cast("long").alias("doc"), text).filter("doc is not null").mapInArrow(
        _line_rows(min_chars), "doc long, h1 long, h2 long")
    if min_docs == 2:
        shared = lines.groupBy("h1", "h2").agg(F.min("doc").alias("owner"), F.max("doc").alias("last")).filter("owner < last")
    else:
        shared = lines.distinct().groupBy("h1", "h2").agg(
            F.min("doc").alias("owner"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)
    shared = stored(shared.select("h1", "h2", "owner"))   # by itself, so that the join reads plain shuffles and Spark can split a hot key
    lost = lines.join(shared, ["h1", "h2"]).filter(F.col("doc") != F.col("owner"))
    return lost.groupBy("doc").agg(F.flatten(F.collect_set(F.array("h1", "h2"))).alias("drops"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 10, min_docs: int = 2,
                name: str = "lines") -> DataFrame:
    """``docs`` with a struct ``name`` (``text`` after dropping, ``n_lines``, ``n_dropped``).

    A key is a line stripped of ASCII space with A-Z lower-cased. Keys of ``min_chars`` code points
    found in ``min_docs`` documents lose all lines but those of the least ``doc_id`` holding them.
    A null or empty text is one empty line and stays as it is. Rows of one ``doc_id`` are one
    document; rows without an id take no part and stay whole.
    """
    doc, drops = fresh(docs.columns, "_doc", "_drops")
    lists = drop_lists(docs, text, doc_id, min_chars, min_docs).select(F.col("doc").alias(doc), F.col("drops").alias(drops))
    joined = docs.withColumn(doc, F.col(doc_id).cast("long")).join(lists, doc, "left")
    return joined.withColumn(name, _reassemble(min_chars)(text, drops)).drop(doc, drops)


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with shared lines dropped from the text; all columns as they were."""
    r, = fresh(docs.columns, "_lines")
    return dedup_lines(docs, text, doc_id, name=r).withColumn(text, F.col(r)["text"]).select(*docs.columns)
