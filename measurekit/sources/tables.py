"""Readers and writers for measurement tables, corpora, predictions and decisions."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import KEY, PRED, ROW, TYPE, Y
from ..functions.scalars import finite

SPREAD_BELOW = 1 << 30
SPREAD_TASK = 16 << 20    # bytes of a small input that one task gets
ROWS_PER_FILE = 5_000_000
MANY_FILES = 10_000      # changed files that are named one by one; beyond, all are listed and joined
CODE_VERSION = "1"   # part of every materialisation key; raise when feature code changes


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly when the input is too small to occupy every core by itself.

    A file with one row group is one task however many cores wait. Inputs of more
    than ``SPREAD_BELOW`` bytes have splits enough and are left alone: no shuffle at scale. A task gets at most
    ``SPREAD_TASK`` bytes, so that what it holds does not grow with the input.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // SPREAD_TASK))) if size < SPREAD_BELOW else df


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV (header) or parquet by suffix. CSV needs a declared schema for typed columns."""
    if path.rstrip("/").endswith(".csv"):
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader).csv(path)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def _mapped(df: DataFrame, mapping: Mapping[str, str]) -> list:
    return [F.expr(expr).alias(name) for name, expr in mapping.items()]


def _finite(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating column become null."""
    return df.withColumns({f.name: finite(F.col(f.name)).cast(f.dataType) for f in df.schema.fields
                           if f.dataType.typeName() in ("float", "double")})


def read_measurements(spark: SparkSession, path: str, mapping: Mapping[str, str],
                      schema: T.StructType | str | None = None) -> DataFrame:
    """Long labelled table. ``mapping`` gives the SQL expression of each standard column."""
    missing = {ROW, KEY, TYPE, Y} - set(mapping)
    if missing:
        raise ValueError(f"mapping lacks {sorted(missing)}")
    df = read_table(spark, path, schema)
    return _finite(df.select(*_mapped(df, mapping)).withColumn(Y, F.col(Y).cast("double")))


def read_scoring(spark: SparkSession, path: str, mapping: Mapping[str, str],
                 schema: T.StructType | str | None = None) -> DataFrame:
    """Unlabelled table of the same shape; the target is null."""
    missing = {ROW, KEY, TYPE} - set(mapping)
    if missing:
        raise ValueError(f"mapping lacks {sorted(missing)}")
    df = read_table(spark, path, schema)
    return _finite(df.select(*_mapped(df, mapping))).withColumn(Y, F.lit(None).cast("double"))


def resolve_column(columns: Sequence[str], exact: str, contains: str) -> str:
    """Exact header first, then the first header containing ``contains`` in any case."""
    stripped = {c.strip(): c for c in columns}
    if exact in stripped:
        return stripped[exact]
    for name, raw in stripped.items():
        if contains.lower() in name.lower():
            return raw
    raise ValueError(f"no column named {exact!r} or containing {contains!r} in {list(stripped)}")


def read_corpus(spark: SparkSession, path: str, exact: str, contains: str) -> DataFrame:
    """One-column corpus ``text`` with nulls dropped."""
    df = read_table(spark, path)
    found = resolve_column(df.columns, exact, contains)
    return df.select(F.col(f"`{found}`").alias("text")).dropna()


def write_predictions(df: DataFrame, path: str, id_col: str = ROW, pred: str = PRED) -> None:
    """``id,target`` CSV with a header, in as many part files as the data needs."""
    df.select(F.col(id_col).alias("id"), F.col(pred).alias("target")).write.mode(
        "overwrite").option("header", True).csv(path)


def write_stage(df: DataFrame, path: str, by: str = TYPE) -> DataFrame:
    """Persist an intermediate table partitioned by type and read it back.

    Rows are spread over as many buckets of their type as its count needs, so that one
    large type is written by many tasks and a small one makes one file.
    """
    from ..dist import as_list, join_small
    sizes = df.groupBy(*as_list(by)).agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_FILE).alias("_files"))
    spread_ = F.pmod(F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() != "map"]), F.coalesce("_files", F.lit(1)))
    df = join_small(df, sizes, by, "left").withColumn("_bucket", spread_).repartition(by, "_bucket").select(*df.columns)
    df.write.mode("overwrite").partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(
        T.StructType([f for f in df.schema.fields if f.name != by] + [df.schema[by]])).parquet(path)


def save_decisions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decisions of an earlier stage; missing or empty decisions are an error, not a default."""
    try:
        df = spark.read.parquet(path)
    except Exception as err:
        raise FileNotFoundError(f"no decisions at {path}: run the selection stage first") from err
    if df.isEmpty():
        raise ValueError(f"decisions at {path} are empty")
    return df


def content_key(df: DataFrame, params: str = "") -> str:
    """Order-free key over every column's content, the schema, the parameters and the code version."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    row = df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)") % 1_000_003)).first()
    seed = "|".join([CODE_VERSION, params, df.schema.simpleString(), *map(str, row)])
    return hashlib.sha256(seed.encode()).hexdigest()[:32]


def materialize(df: DataFrame, source: DataFrame, folder: str, params: str = "") -> DataFrame:
    """Features ``df`` computed from ``source``, reused when the same content was stored before."""
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/{content_key(source, params)}"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jpath):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def source_files(spark: SparkSession, source: str, params: str = "") -> DataFrame:
    """``path, length, changed, file_key`` of a Parquet source's files; only their listing is read."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(source)
    key = F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"), F.lit(CODE_VERSION), F.lit(params)), 256)
    return listed.select("path", "length", F.col("modificationTime").alias("changed"), key.alias("file_key"))


def materialize_files(spark: SparkSession, source: str, folder: str, compute: Callable[[DataFrame], DataFrame], params: str = "") -> DataFrame:
    """Row-wise features of a Parquet source, computed anew only for files that are new or have changed.

    ``compute`` maps rows to features, each from its row alone. Every call adds a batch with the rows of the files it
    computed and a manifest of all files it saw; rows of files that have gone or changed since are left out. A batch is
    complete once its manifest is there, so one that a lost job left behind is never read. Files are told apart by path, length
    and modification time; their content is read once.
    """
    from ..dist import join_small, settled
    root = folder.rstrip("/")
    now = settled(source_files(spark, source, params))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = [x.getPath().toString() for x in (fs.globStatus(path.suffix("/batch-*/files/_SUCCESS")) or [])]   # one for each call that found changes
    batches = [x[:-len("/files/_SUCCESS")] for x in done]
    known = None
    for b in batches:
        part = spark.read.parquet(f"{b}/files").select("file_key")
        known = part if known is None else known.unionAll(part)
    fresh = now if known is None else settled(now.join(known.distinct(), "file_key", "left_anti"))
    if not fresh.isEmpty():
        batch = f"{root}/batch-{uuid.uuid4().hex}"
        rows = spark.read.option("recursiveFileLookup", True).parquet(source)
        few = fresh.limit(MANY_FILES + 1).collect()
        if len(few) <= MANY_FILES:
            rows = spark.read.parquet(*[r["path"] for r in few])
        # the path names the file a row comes from: a slash more or less after the scheme is the same file
        plain = lambda c: F.regexp_replace(c, "^([a-z0-9+.-]+):/+", "$1:/")
        keys = fresh.select(plain(F.col("path")).alias("_path"), "file_key")
        tagged = join_small(rows.withColumn("_path", plain(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")))), keys, "_path").drop("_path")
        compute(tagged).write.parquet(f"{batch}/rows")
        fresh.write.parquet(f"{batch}/files")
        batches.append(batch)
    if not batches:
        raise FileNotFoundError(f"no Parquet files in {source}")
    held = spark.read.parquet(*[f"{b}/rows" for b in batches])
    return join_small(held, now.select("file_key"), "file_key", "left_semi").drop("file_key")


def attach_predictions(df: DataFrame, external: DataFrame, pred: str = PRED) -> DataFrame:
    """Externally computed predictions joined by row id, kept only for fully covered types.

    A type with any uncovered row has the column nulled and ``covered`` false. An id that comes
    with several different predictions covers nothing; rows without a type are kept, uncovered.
    """
    from ..dist import join_small
    value = finite(F.col(pred))
    ext = external.groupBy(ROW).agg(F.when(F.min(value) == F.max(value), F.min(value)).alias(pred))
    joined = df.drop(pred).join(ext, ROW, "left")
    cover = joined.groupBy(TYPE).agg((F.count(pred) == F.count(F.lit(1))).alias("covered"))
    return join_small(joined, cover, TYPE, "left").withColumn("covered", F.coalesce("covered", F.lit(False))).withColumn(
        pred, F.when(F.col("covered"), F.col(pred)))


def check_output(df: DataFrame, template: Sequence[str], scoring: DataFrame) -> DataFrame:
    """Violations of the output contract, one row per check; all zero means it holds."""
    out = df.select(F.col(template[0]).alias("id"), F.col(template[1]).alias("target"))
    per = out.groupBy("id").agg(F.count(F.lit(1)).alias("n"),
                                F.count_if(F.col("target").isNull()).alias("nulls"))
    want = scoring.groupBy(F.col(ROW).alias("id")).agg(F.count(F.lit(1)).alias("wanted"))
    both = per.join(want, "id", "full").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("wanted"), F.lit(0)).alias("wanted"),
        F.coalesce(F.sum("nulls"), F.lit(0)).alias("nulls"),
        F.count_if(F.col("n") > F.coalesce("wanted", F.lit(1))).alias("dup"),
        F.count_if(F.col("n").isNull()).alias("absent"),
        F.count_if(F.col("wanted").isNull()).alias("unknown"))
    cols_off = len(set(df.columns) ^ set(template))
    checks = [("columns", F.lit(cols_off)), ("row_count", F.abs(F.col("rows") - F.col("wanted"))),
              ("null_target", F.col("nulls")), ("duplicate_id", F.col("dup")),
              ("absent_id", F.col("absent")), ("unknown_id", F.col("unknown"))]
    return both.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("check"), v.cast("bigint").alias("violations")) for n, v in checks
    ])).alias("v")).select("v.*")
