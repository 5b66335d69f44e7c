"""Model interfaces with offline, deterministic implementations. A provider takes and gives DataFrames."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.functions.text import for_embedding, tokens
from parchment.operators.retrieval import hashed_embedding

# Embedding models by name with dimension, window and query prefix.
MODELS = {
    "bge-small": {"dim": 384, "window": 512, "query_prefix": "Represent this sentence for searching relevant passages: "},
    "bge-base": {"dim": 768, "window": 512, "query_prefix": "Represent this sentence for searching relevant passages: "},
    "bge-m3": {"dim": 1024, "window": 8192, "query_prefix": ""},
    "hashed": {"dim": 64, "window": 8192, "query_prefix": ""},
}


class Embedder(Protocol):
    dim: int

    def documents(self, rows: DataFrame) -> DataFrame: ...
    def queries(self, rows: DataFrame) -> DataFrame: ...


class HashedEmbedder:
    """Signed token hashing; unit vectors, NULL for texts without tokens."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def documents(self, rows: DataFrame) -> DataFrame:
        """(key, embedding) of (key, text)."""
        return rows.select("key", hashed_embedding(for_embedding("text"), self.dim).alias("embedding"))

    def queries(self, rows: DataFrame) -> DataFrame:
        return rows.select("key", hashed_embedding(F.concat(F.lit(MODELS["hashed"]["query_prefix"]), "text"), self.dim).alias("embedding"))


class OverlapScorer:
    """Cross scorer: share of the query's distinct tokens that a chunk has."""

    def __init__(self, queries: DataFrame, chunks: DataFrame):
        self.q = queries.select("query_id", F.array_distinct(tokens("text")).alias("qt"))
        self.c = chunks.select("chunk_id", F.array_distinct(tokens("text")).alias("ct"))

    def __call__(self, pairs: DataFrame) -> DataFrame:
        j = pairs.join(self.q, "query_id").join(self.c, "chunk_id")
        return j.select("query_id", "chunk_id", F.when(F.size("qt") > 0, F.size(F.array_intersect("qt", "ct")) / F.size("qt")).otherwise(0.0).alias("score"))


class ReplayGenerator:
    """Answers from a table (query_id, answer, refused, citations); a query without one is an error row."""

    def __init__(self, stored: DataFrame):
        self.stored = stored

    def __call__(self, prompts: DataFrame) -> DataFrame:
        s = self.stored.select(F.col("query_id").alias("__s"), "answer", "refused", "citations")
        j = prompts.join(s, F.col("query_id") == F.col("__s"), "left")
        return j.select("query_id", "answer", F.coalesce("refused", F.lit(False)).alias("refused"), "citations", F.when(F.col("__s").isNull(), F.lit("no stored answer")).alias("error"))


class QuotingGenerator:
    """Answers with the first sentence of the first excerpt and cites it."""

    def __call__(self, prompts: DataFrame) -> DataFrame:
        chunk = F.regexp_extract("prompt", r"(?s)\n\n\[([^\]]+)\]\n", 1)
        quote = F.trim(F.regexp_extract("prompt", r"(?s)\n\n\[[^\]]+\]\n(.*?[.!?])(\s|$)", 1))
        cited = F.array(F.struct(chunk.alias("chunk_id"), quote.alias("quote")))
        return prompts.select("query_id", quote.alias("answer"), (quote == "").alias("refused"), F.when(quote != "", cited).alias("citations"), F.lit(None).cast("string").alias("error"))


class CoverageJudge:
    """Verdicts by lexical coverage of the claim by its quote."""

    def __call__(self, items: DataFrame) -> DataFrame:
        from parchment.functions.text import coverage

        c = coverage("claim", "quote")
        return items.select("item_id", F.when(c >= 0.6, "supported").when(c >= 0.3, "partial").otherwise("unsupported").alias("verdict"))


RERANKERS = {"overlap": OverlapScorer}
GENERATORS = {"replay": ReplayGenerator, "quoting": QuotingGenerator}
JUDGES = {"coverage": CoverageJudge}
