"""Run registered queries on Spark and their SQL on DuckDB, and compare them as multisets."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd
from pyspark.sql import SparkSession


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con.execute(sql).df()


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime()
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float) and v.is_integer():
        return int(v)
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted((tuple(_plain(v) for v in r) for r in df[cols].itertuples(index=False, name=None)), key=repr)


def differs(spark_df, sql: str, sf_dir: str) -> str:
    """Empty if both agree, else what differs first."""
    got, want = pd.DataFrame([r.asDict() for r in spark_df.collect()], columns=spark_df.columns, dtype=object), oracle(sql, sf_dir)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    want = want.astype(object)
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}"
    for x, y in zip(a, b, strict=True):
        if x != y:
            return f"{x!r:.400} and {y!r:.400}"
    return ""
