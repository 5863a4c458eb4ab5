"""What the corpus operators share: words, column names that cannot clash, stored tables, prefix sums.

Words are runs of ``[^\\x20\\x09-\\x0D]``: exactly what ``bytes.split()`` gives in Python.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_dir

SPACE = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
WORD = f"[^{SPACE}]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each prefixed until it differs from every taken column, whatever its case."""
    have = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: computed once, lineage cut."""
    return stored_at(df)[0]


def stored_at(df: DataFrame) -> tuple[DataFrame, str]:
    """The same with the folder written, for a table to be discarded once what it served is stored itself."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def word_count(text: Column) -> Column:
    """Number of words, without building an array of them: every word becomes one letter."""
    marked = F.regexp_replace(text, f"[{SPACE}]*+{WORD}++", "w")
    return F.coalesce(F.length(F.translate(marked, SPACES, "")), F.lit(0)).cast("long")


def running_totals(df: DataFrame, by: list[str], cell: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name of ``sums``, the total of its column over the rows before (exclusive).

    ``cell`` must not decrease in the wanted order. Rows are summed inside their cell and shifted
    by the totals of earlier cells, so no group, however large, has to pass through one task.
    """
    celled = df.withColumn("_cell", cell)
    totals = celled.groupBy(*by, "_cell").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*by, "_cell", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums])
    inside = Window.partitionBy(*by, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = celled.join(shifts, [*by, "_cell"])
    return out.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_s_{n}") for n, c in sums.items()}).drop(
        "_cell", *[f"_s_{n}" for n in sums])
