"""Line deduplication: lines that many documents share stay in one of them only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import documents, durable

EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _ascii_lower(c: Column) -> Column:
    """A-Z only; lower() does the same, and faster, where all characters are ASCII."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def _stripped(line: Column) -> Column:
    return F.trim(line, F.lit(" \t\n\x0b\x0c\r"))


def _hash(key: Column) -> Column:
    return F.unhex(F.md5(key))


def _lost(d: DataFrame, min_points: int, min_docs: int) -> DataFrame:
    """(__loser, __lost): the hashes of keys whose lines a doc_id loses."""
    keys = F.filter(F.transform(F.split(_ascii_lower(F.col("text")), "\n", -1), _stripped), lambda k: F.length(k) >= min_points)
    lines = d.select("doc_id", F.explode(F.array_distinct(F.transform(keys, _hash))).alias("key"))
    over = lines.groupBy("key").agg(F.count_distinct("doc_id").alias("held_by"), F.max("doc_id").alias("home")).where(F.col("held_by") >= min_docs).select("key", "home")
    # written out, so that the join's sides are plain shuffles, of which a hot line's can be split
    gone = lines.join(durable(over), "key").where(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("home")))
    return gone.groupBy(F.col("doc_id").alias("__loser")).agg(F.collect_set("key").alias("__lost"))


def _staying(text: Column) -> Column:
    whole = F.split(text, "\n", -1)
    stays = F.filter(whole, lambda line: ~F.array_contains("__lost", _hash(_stripped(_ascii_lower(line)))))
    return F.when(F.col("__lost").isNull(), whole).otherwise(stays)


def line_dedup(docs: DataFrame, min_points: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, kept_text.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys of
    at least `min_points` code points in at least `min_docs` documents lose their lines
    everywhere but in the largest doc_id that holds them (all its lines of that key stay).

    Lines are exploded as 128-bit hashes of their keys. The distinct documents of a hash are
    counted with the document in the first exchange's key, so that a line found in a third of
    all documents is counted by every task. What comes back to a document is the set of hashes
    that it loses, and the lines that stay are joined in their order. Shared keys are checkpointed.

    Null or empty text is one empty line. Rows that repeat a doc_id count as one document and
    lose the same lines. Rows without doc_id count for no threshold and lose every line over
    it. An empty table gives an empty result; further columns of any name are ignored.
    """
    d = documents(docs, id_col, text_col)
    lost = _lost(d, min_points, min_docs)
    return (
        d.join(lost, F.col("doc_id").eqNullSafe(F.col("__loser")), "left")
        .select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), _staying(F.col("text")).alias("stays"))
        .select("doc_id", "n_lines", (F.col("n_lines") - F.size("stays")).alias("n_dropped"), F.array_join("stays", "\n").alias("kept_text"))
    )


def without_shared_lines(docs: DataFrame, min_points: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """All rows and columns of docs with the text that line_dedup() keeps, and its length in size_col, where docs has that."""
    lost = _lost(documents(docs, id_col, text_col), min_points, min_docs)
    out = docs.join(lost, docs[id_col].eqNullSafe(F.col("__loser")), "left")
    out = out.withColumn(text_col, F.when(F.col("__lost").isNull(), F.col(text_col)).otherwise(F.array_join(_staying(F.col(text_col)), "\n")))
    if size_col in docs.columns:
        out = out.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType))
    return out.select(*docs.columns)


def digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def kept_lines_sql(source: str, columns: str = "") -> str:
    """DuckDB: doc_id, n_lines, n_dropped, kept_text of a relation with doc_id and text."""
    key = r"translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {source}),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT doc_id, pos, line, {key} AS key FROM e),
o AS (SELECT key, max(doc_id) AS home FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.home AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept_text
FROM f GROUP BY doc_id
"""


ORACLE_SQL = f"SELECT doc_id, n_lines, n_dropped, sha256(kept_text) AS kept_sha256 FROM ({kept_lines_sql('documents')})"
