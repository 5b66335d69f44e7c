"""Sources and sinks: JSON lines, hashes, incremental loads, content-addressed vectors, checked files."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("doc_id", "source", "title", "url", "landing_url", "doc_type", "status", "center", "docket", "issue_date", "sha256")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("offices", "product_areas", "topics")]
    + [T.StructField("extra", T.MapType(T.StringType(), T.StringType()))]
)
FETCHED = T.StructType(
    [T.StructField("doc_id", T.StringType()), T.StructField("ok", T.BooleanType())]
    + [T.StructField(n, T.LongType()) for n in ("bytes", "pages", "image_only_pages", "text_chars", "table_like_lines", "docket_like_tokens", "registry_like_tokens")]
    + [T.StructField(n, T.StringType()) for n in ("text_layer", "sha256", "error")]
)


def durable(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder of spark.checkpoint.dir; where that is unset and all tasks run on
    this machine, in one of our own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="parchment-"))
    return df.checkpoint(eager=True)


#: Bytes that may be broadcast.
FEW = 32 << 20


def few(df: DataFrame) -> DataFrame:
    """df, of numbers and strings, marked for broadcast if it is measured to have at most FEW bytes."""
    width = F.lit(24)
    for f in df.schema.fields:
        width = width + (F.coalesce(F.octet_length(f.name), F.lit(0)) + 16 if isinstance(f.dataType, T.StringType) else F.lit(8))
    size = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= FEW else df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines under a fixed schema: unknown keys go, missing ones are NULL, blank lines are skipped, a missing path is empty."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key: the last by order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def write_jsonl(rows: DataFrame, path: str, key: str, one_file: bool = False) -> None:
    """Sorted by key and with columns in order of name, so that equal tables give equal files; parts
    follow the order. one_file is for tables that one task can sort, such as manifests."""
    out = rows.select(*sorted(rows.columns))
    out = out.coalesce(1).sortWithinPartitions(key) if one_file else out.orderBy(key)
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


GOLDEN = "pair_id string, doc_id string, question string, answer string, evidence array<struct<chunk_id:string,quote:string>>, shape string, answerable boolean, status string, reason string, evidence_methods array<string>"


def write_golden(pairs: DataFrame, path: str) -> None:
    """Reference pairs, rejected ones too: what was rejected and why is what explains the yield."""
    write_jsonl(pairs, path, "pair_id", one_file=True)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Pairs with defaults for what older files lack: answerable, a draft, without reason and methods."""
    p = read_jsonl(spark, path, T.StructType.fromDDL(GOLDEN))
    none = F.array().cast("array<string>")
    return p.withColumns(
        {"answerable": F.coalesce("answerable", F.lit(True)), "status": F.coalesce("status", F.lit("draft")), "reason": F.coalesce("reason", F.lit("")), "evidence_methods": F.coalesce("evidence_methods", none)}
    )


def write_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").partitionBy("strategy").parquet(path)


def read_chunks(spark: SparkSession, path: str, strategy: str | None = None) -> DataFrame:
    c = spark.read.parquet(path)
    return c if strategy is None else c.where(F.col("strategy") == strategy)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def hash_mismatches(files: DataFrame, pins: DataFrame) -> DataFrame:
    """Files whose pin (path, pin) differs."""
    return files.join(pins, "path").where("sha256 <> pin")


def to_process(now: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("doc_id", "sha256")) -> DataFrame:
    """Rows whose id and content hash weren't processed; an unreadable result counts as none."""
    return now.join(done.select(*keys).distinct(), list(keys), "left_anti")


def cache_key(prepared: Column, model: str, window: int, prefixed: bool, version: int = 1) -> Column:
    """Content address of a prepared text under a model and its preparation."""
    return F.sha2(F.concat_ws("\u0000", F.lit(model), F.lit(str(version)), F.lit(str(window)), F.lit(str(prefixed)), prepared), 256)


def encode_missing(requests: DataFrame, cache: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, embedding) of keys that the cache lacks, each encoded once; append them to the cache, then join back."""
    todo = requests.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    return encode(todo).select("key", "embedding")


def cache_counts(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: requested = hits + misses + deduped, by distinct keys."""
    r = requests.groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(cache.select("key", F.lit(True).alias("hit")), "key", "left")
    return r.agg(
        F.sum("n").alias("requested"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("hits"),
        F.count_if(F.col("hit").isNull()).alias("misses"), F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("n") - 1)), F.lit(0)).alias("deduped"),
    )


def one_dimension(cache: DataFrame, dim: int) -> DataFrame:
    """The cache if its vectors have the model's dimension, else a cold one."""
    return cache if cache.where(F.size("embedding") != dim).isEmpty() else cache.limit(0)


def require_empty(rows: DataFrame, what: str) -> None:
    """Raise with the first offending row."""
    if bad := rows.limit(1).collect():
        raise ValueError(f"{what}: {bad[0].asDict()}")


def checked_verdicts(verdicts: DataFrame, amendments: DataFrame) -> DataFrame:
    """Verdicts (pair_id, verdict) with known values whose last amendment (pair_id, seq, verdict) says the same."""
    require_empty(verdicts.where(~F.col("verdict").isin("keep", "reject", "edit")), "unknown verdict")
    last = amendments.groupBy("pair_id").agg(F.max_by("verdict", "seq").alias("last"))
    require_empty(last.join(verdicts, "pair_id").where("last <> verdict"), "verdict differs from its last amendment")
    require_empty(last.join(verdicts, "pair_id", "left_anti"), "amendment of no verdict")
    return verdicts


def tables_present(spark: SparkSession, paths: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables that can be read, and (name) of those that are missing."""
    found, missing = {}, []
    for name, path in paths.items():
        try:
            found[name] = spark.read.parquet(path)
        except AnalysisException:
            missing.append((name,))
    return found, spark.createDataFrame(missing, "name string")
