"""Reproducible sharding: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 6


def _radix(n: int) -> tuple[int, int]:
    """a, b with a * b >= n and less than a numbers too many."""
    a = max(1, math.isqrt(n) + (math.isqrt(n) ** 2 < n))
    return a, max(1, -(-n // a))


def permuted(number: Column | str, n: int, seed: int) -> Column:
    """Where row `number` of 0..n-1 goes under the permutation that n and seed name.

    Six rounds on the two digits of the number in the mixed radix (a, b), each adding an MD5
    value of one digit to the other, are a bijection of 0..a*b-1. Fewer than a of these lie
    beyond n; from such a value the bijection is walked on until it is below n. A walk of `a`
    steps always ends; 64 steps fail with odds below 64**-64 where a is larger, and then raise.
    """
    a, b = _radix(n)
    mix = f"cast(conv(substring(md5(concat('{seed}:', j, ':', %s)), 1, 12), 16, 10) as bigint)"
    once = (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', x % {a}L, 'r', x div {a}L), (s, j) -> if(j % 2 = 1,"
        f" named_struct('l', (s.l + {mix % 's.r'}) % {a}L, 'r', s.r), named_struct('l', s.l, 'r', (s.r + {mix % 's.l'}) % {b}L)), s -> s.l + {a}L * s.r)"
    )
    walk = f"aggregate(sequence(1, {min(max(a, 2), 64)}), __at, (x, w) -> if(w > 1 and x < {n}L, x, {once}), x -> if(x < {n}L, x, cast(raise_error('cycle walk did not end') as bigint)))"
    source = number if isinstance(number, str) else None
    if source is None:
        raise TypeError("permuted() takes the name of a column")
    return F.expr(walk.replace("__at", f"cast({source} as bigint)"))


def bucket_of(id_col: str, buckets: int) -> Column:
    return F.expr(f"cast(conv(substring(md5(coalesce(cast({id_col} as string), 'null')), 1, 8), 16, 10) as bigint) % {buckets}L")


def shard(docs: DataFrame, shards: int = 24, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, row, place, shard, slot.

    Row numbers are global and gapless: rows fall by a hash of doc_id into about sqrt(n)
    buckets, are numbered in each by doc_id, and follow the rows of the buckets before. So
    neither a bucket nor the list of buckets outgrows a task. The permutation sends row number
    to place; shard is place mod shards and slot is place div shards: shards differ by one row
    at most, slots are gapless from 0, and both are computable for any row number alone.

    Size is the UTF-8 bytes of the text plus 8; null text has none and the checksum of an empty
    one. Rows with the same doc_id take their order from size and checksum; rows that are alike
    in these too are interchangeable. A null doc_id is numbered first in its bucket. An empty
    table gives an empty result; further columns of any name are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"))
    n = docs.count()
    d = d.withColumn("bucket", bucket_of("doc_id", _radix(n)[0]))
    starts = d.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    starts = starts.select("bucket", F.coalesce(F.sum("rows").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("bucket").orderBy("doc_id", "size", "text_crc32"))
    rows = d.withColumn("within", within).join(starts, "bucket").withColumn("row", F.col("start") + F.col("within") - 1)
    placed = rows.withColumn("place", permuted("row", n, seed))
    return placed.select("doc_id", "size", "text_crc32", "row", "place", (F.col("place") % shards).cast("int").alias("shard"), F.expr(f"place div {shards}").alias("slot"))


def contract(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def oracle_sql(shards: int = 24, seed: int = 7) -> str:
    """The same, from the same permutation in DuckDB; CRC-32 is reduced over the bytes."""

    def mix(j: int, v: str) -> str:
        return f"CAST(concat('0x', substr(md5(concat('{seed}:{j}:', CAST({v} AS BIGINT))), 1, 12)) AS BIGINT)"

    left, right = "(x % a)", "(x // a)"
    for j in range(1, ROUNDS + 1):
        if j % 2:
            left = f"(({left} + {mix(j, right)}) % a)"
        else:
            right = f"(({right} + {mix(j, left)}) % b)"
    step = f"({left} + a * {right})"
    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    rows = "list_transform(range(0, 256), lambda i: CAST(list_reduce(list_prepend(CAST(i AS BIGINT), CAST(range(0, 8) AS BIGINT[])), lambda c, k: " + bit + ") AS BIGINT))"
    return f"""
WITH RECURSIVE z AS (SELECT count(*) AS n, CAST(greatest(1, ceil(sqrt(count(*)))) AS BIGINT) AS a FROM documents),
s AS (SELECT n, a, greatest(1, CAST(ceil(n / a) AS BIGINT)) AS b, {rows} AS t FROM z),
d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 8 AS BIGINT) AS size, hex(coalesce(text, '')) AS h, n, a, b, t,
      CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) % a AS bucket FROM documents, s),
c AS (SELECT doc_id, size, n, a, b, bucket, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(regexp_extract_all(h, '..'), lambda v: CAST(concat('0x', v) AS BIGINT))),
      lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]))) AS text_crc32 FROM d),
r AS (SELECT *, row_number() OVER (ORDER BY bucket, doc_id, size, text_crc32) - 1 AS x, 0 AS k FROM c),
w AS (SELECT doc_id, size, text_crc32, n, a, b, x, k FROM r UNION ALL
      SELECT doc_id, size, text_crc32, n, a, b, CAST({step} AS BIGINT), k + 1 FROM w WHERE k = 0 OR x >= n)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % {shards} AS INTEGER) AS shard, x // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM w WHERE k > 0 AND x < n
"""
