"""Helpers shared by the corpus operators: inputs, durable cuts of the lineage, sizing."""

from __future__ import annotations

import ctypes
import gc
import math
import tempfile
import time
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder that the cluster names.

    The folder is spark.checkpoint.dir; only where that is unset (tests, one machine) a
    folder of our own is taken. Every copy there outlives the executor that wrote it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="parchment-checkpoint-"))
    return df.checkpoint(eager=True)


def unsized(df: DataFrame) -> DataFrame:
    """A checkpoint without Catalyst's estimate of its size, for loops over checkpoints.

    A checkpoint keeps the estimate of the plan that it cuts, and a join's is the product of its
    sides'. From round to round the estimate's digits double, until the driver's memory is full.
    """
    spark, kept = df.sparkSession, df._jdf.queryExecution().analyzed()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.rdd(), df._jdf.schema(), False), spark)


def release(spark: SparkSession) -> None:
    """Let go of shuffle files whose result is checkpointed: Spark deletes them when the driver
    collects its garbage, which it would else do twice an hour."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone, null texts as empty; other columns, whatever their names, go."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


#: What this Python worker keeps from task to task, all of one operator; the operator; when freed memory was last given back.
_kept: dict[Any, Any] = {}
_turn = ["", 0.0]
#: Tables that an operator keeps at most; least seconds from giving memory back to doing so again.
KEEP, EVERY = 2, 1.0


def turn(operator: str) -> None:
    """To be called where an operator's Python functions begin: the worker is this operator's now.

    Workers outlive stages, and so would the tables of every operator that had one, each beside
    the next one's. Those of others go here, and what is freed goes back to the machine, which
    the allocators would else keep.
    """
    now = time.monotonic()
    if _turn[0] == operator and now - _turn[1] < EVERY:
        return
    if _turn[0] != operator:
        _kept.clear()
    _turn[:] = [operator, now]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # other C libraries
        pass


def kept(operator: str, key: Any, make: Callable[[], Any]) -> Any:
    """A table of the operator that has its turn, made once and kept until another operator's turn."""
    turn(operator)
    if key not in _kept:
        while len(_kept) >= KEEP:
            del _kept[next(iter(_kept))]
        _kept[key] = make()
    return _kept[key]


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """Rows and UTF-8 bytes of text."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return n, size


def groups_for(size: int, each: int = 8 << 20) -> int:
    """How many hash groups of about `each` bytes hold `size` bytes."""
    return max(1, math.ceil(size / each))


#: Bytes, by a generous count of each row's, that may be broadcast; beyond it both sides of a join are shuffled.
FEW = 32 << 20


def _width(name: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        each = 8 * (1 + len(kind.elementType.fields)) if isinstance(kind.elementType, T.StructType) else 8
        return F.coalesce(F.size(name), F.lit(0)) * each + 24
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 16
    return F.lit(8)


def few(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it is measured to have at most FEW bytes."""
    width = F.lit(24)
    for f in df.schema.fields:
        width = width + _width(f.name, f.dataType)
    size = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= FEW else df
