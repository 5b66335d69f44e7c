"""Exact deduplication by 128-bit content hash, with a byte comparison inside groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import documents, durable

WHITE = r"[\x20\x09-\x0D]+"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are equal after all ASCII white space is deleted. The row
    with the most code points in the original text, then the smallest doc_id, stays.

    One pass over the texts writes a row of digests for each document. Groups form on the
    128-bit hash with a partial aggregate, so that a group with a third of all rows costs one
    row per task. Texts that share a hash are then read again and compared byte by byte (the
    least and the greatest of a group must be the same); a group in which two texts differ is
    split by SHA-256.

    Null text counts as empty; empty texts form one group. A null doc_id loses against any
    other. Of rows that are alike in doc_id and text exactly one is kept. An empty table gives
    an empty result. Further columns of any name are ignored.
    """
    d = documents(docs, id_col, text_col)
    norm = F.regexp_replace("text", WHITE, "")
    digests = durable(
        d.select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            F.length("text").cast("long").alias("points"),
            F.unhex(F.md5(norm)).alias("hash"),
            F.sha2(norm, 256).alias("text_sha256"),
        )
    )
    shared = durable(digests.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"))
    members = digests.join(shared, "hash", "left_semi").select(F.col("doc_id").alias("member"), F.col("hash").alias("claimed")).distinct()
    split = durable(
        d.join(members, F.col("doc_id").eqNullSafe(F.col("member")))
        .select("claimed", norm.alias("norm"))
        .where(F.unhex(F.md5("norm")) == F.col("claimed"))
        .groupBy("claimed")
        .agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
        .where("low <> high")
        .select(F.col("claimed").alias("hash"), F.lit(True).alias("collides"))
    )
    keyed = digests.join(split, "hash", "left").withColumn("part", F.when(F.col("collides"), F.col("text_sha256")).otherwise(""))
    best = keyed.groupBy("hash", "part").agg(
        F.min(F.struct((-F.col("points")).alias("shortness"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    )
    # written out, so that the join's sides are plain shuffles, of which a hot group's can be split
    best = durable(best.select("hash", "part", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"))
    return keyed.join(best, ["hash", "part"]).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""
