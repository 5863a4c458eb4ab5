"""A corpus pipeline: quality rules, line dedup, near-duplicate groups, source mixing, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; all but
the last return the columns of ``documents``. Nulls, empty tables and extra columns are handled
as the operators in ``measurekit.llm`` say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from measurekit.llm import lines, mixing, ngram_join, packing, quality
from measurekit.llm.common import documents, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and the compression bands."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without lines that an earlier document holds."""
    return lines.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group linked at 0.8 on five-word shingles."""
    return ngram_join.one_of_each(docs, size=5, percent=80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in a sequence."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", source_mixing), ("best-fit packing", best_fit_packing)]
#: zstandard ratios, token ids and the exact joins of the stages are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again by the next."""
    out = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, out if i == 0 else stored(out), sf_dir)
    return out
