"""From raw documents to token ids: five stages, each written and read again by whoever runs them.

All stages take null and empty texts (as empty), texts of any length, repeated rows and ids, extra
columns of any name (kept by all but the last) and empty tables (which stay empty). Rows without
doc_id pass the stages that leave documents out, as nothing is decided on them. Of rows that repeat
a doc_id all go or all stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.llm import decontamination, line_dedup, near_dedup, pieces, toxicity
from parchment.llm.common import durable, table
from parchment.llm.queries import tokenizer_file


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id isn't in ids; rows without doc_id stay."""
    return docs.join(ids.select(F.col("doc_id").alias("__decided")), F.col("doc_id") == F.col("__decided"), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects (score 0.5 or more) go; a doc_id goes if one of its rows is rejected."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return _without(docs, scored.where("predicted = 1").select("doc_id").distinct())


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in three documents or more stay in one of them; the columns follow the new text."""
    return line_dedup.without_shared_lines(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the least doc_id. Texts without words are one class."""
    return _without(docs, near_dedup.near_duplicates(docs).where("NOT kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Without items all stay."""
    hits = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, durable(hits.select("doc_id").distinct()))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, for every row."""
    out = pieces.roundtrip(docs, tokenizer_file("piece_bpe_32k.model"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_shared_lines),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]

#: The trained model and the sampled signatures are not expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; between two stages the rows are checkpointed."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs)
    return docs
