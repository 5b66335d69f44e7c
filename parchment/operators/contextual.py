"""Context blurbs: requests by document, cost before spending, blurbs applied to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Chunks of a request, blurb length, price multipliers, characters of a token, tokens of a blurb.
GROUP, MAX_BLURB, DISCOUNT, CACHE_WRITE, CACHE_READ, CHARS, BLURB_TOKENS = 40, 400, 0.5, 1.25, 0.1, 4.0, 80


def requests(chunks: DataFrame, docs: DataFrame, size: int = GROUP) -> DataFrame:
    """custom_id, doc_id, part, chunk_ids, n_chunks, excerpt_chars, doc_chars: a document's chunks in order, `size` to a request."""
    if size < 1:
        raise ValueError(f"group size {size} must be positive")
    rn = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    c = chunks.withColumn("rn", rn).withColumn("part", F.floor(F.col("rn") / size))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rn", "chunk_id"))), lambda x: x["chunk_id"])
    g = c.groupBy("doc_id", "part").agg(ids.alias("chunk_ids"), F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("excerpt_chars"))
    d = docs.select("doc_id", F.length("text").alias("doc_chars"))
    return g.join(d, "doc_id").withColumn("custom_id", F.concat(F.col("doc_id").cast("string"), F.lit("::"), F.lpad(F.col("part").cast("string"), 4, "0")))


def estimated_cost(requests_: DataFrame, price_in: float, price_out: float, cache_min: int, system_chars: int = 0, hits: bool = True) -> DataFrame:
    """One row: requests, blurbs, cacheable, effective input tokens, output tokens, cost, batched cost.

    Of a document whose prefix can be cached the first request writes and later ones read; without
    assumed hits every one writes. A shorter prefix costs its plain tokens.
    """
    doc = F.col("doc_chars") / CHARS
    can = (system_chars / CHARS + doc) >= cache_min
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("part")) == 1
    r = requests_.withColumn("can", can).withColumn("first", first)
    tokens = F.when(~F.col("can"), doc).when(F.col("first") | F.lit(not hits), doc * CACHE_WRITE).otherwise(doc * CACHE_READ) + F.col("excerpt_chars") / CHARS
    out = F.sum("n_chunks") * BLURB_TOKENS
    cost = F.sum(tokens) / 1e6 * price_in + out / 1e6 * price_out
    return r.agg(
        F.count(F.lit(1)).alias("requests"), F.sum("n_chunks").alias("blurbs"), F.count_if("can").alias("cacheable"), F.sum(tokens).alias("input_tokens"), out.alias("output_tokens"),
        cost.alias("cost"), (cost * DISCOUNT).alias("batched"),
    )


def blurb_schema(n: int) -> dict:
    """JSON schema of a response with one blurb for each of n excerpts, none left out and none invented."""
    names = [f"{i}" for i in range(1, n + 1)]
    one = {"type": "string", "maxLength": MAX_BLURB}
    return {"type": "object", "properties": dict.fromkeys(names, one), "required": names, "additionalProperties": False}


def parsed_blurbs(raw: DataFrame) -> DataFrame:
    """chunk_id, blurb from model JSON, cut to length; empty ones and repeats after the first are left out."""
    r = raw.select("custom_id", F.posexplode(F.from_json("response", "struct<blurbs:array<struct<chunk_id:string,blurb:string>>>")["blurbs"]).alias("n", "b"))
    r = r.select("custom_id", "n", "b.chunk_id", F.substring(F.trim("b.blurb"), 1, MAX_BLURB).alias("blurb")).where("blurb <> ''")
    return r.groupBy("chunk_id").agg(F.min_by("blurb", F.struct("custom_id", "n")).alias("blurb"))


def apply_blurbs(chunks: DataFrame, blurbs: DataFrame) -> DataFrame:
    """chunks with blurb and embed_text: the old blurb goes first, so that applying twice is applying once."""
    b = blurbs.select(F.col("chunk_id").alias("__c"), F.col("blurb").alias("__b"))
    old = F.concat(F.col("blurb"), F.lit("\n\n"))
    c = chunks if "blurb" in chunks.columns else chunks.withColumn("blurb", F.lit(None).cast("string"))
    bare = F.when(F.col("blurb").isNotNull() & F.startswith("embed_text", old), F.expr("substring(embed_text, length(blurb) + 3)")).otherwise(F.col("embed_text"))
    j = c.withColumn("__bare", bare).join(b, F.col("chunk_id") == F.col("__c"), "left")
    text = F.when(F.col("__b").isNotNull(), F.concat("__b", F.lit("\n\n"), "__bare")).otherwise(F.col("__bare"))
    return j.withColumn("embed_text", text).withColumn("blurb", F.col("__b")).drop("__c", "__b", "__bare")
