"""Grounded answers: context, prompt, refusal gates, generation by a provider, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.operators import citations


def context(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, context: the known chunks of a ranking in rank order, each under its id; unknown ids are left out."""
    h = hits.join(chunks.select("chunk_id", "text"), "chunk_id")
    block = F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit("]\n"), F.col("text"))
    order = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    return h.groupBy("query_id").agg(F.array_join(F.transform(order, lambda x: x["b"]), "\n\n").alias("context"), F.max("score").alias("top_score"), F.count(F.lit(1)).alias("n_chunks"))


def prompts(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """query_id, prompt, top_score, n_chunks for every query."""
    body = F.concat(F.lit("Excerpts:\n\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.col("text"))
    return queries.join(contexts, "query_id", "left").select("query_id", body.alias("prompt"), "top_score", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def gated(prompts_: DataFrame, threshold: float | None) -> DataFrame:
    """prompts with refusal_source: no_context, score_gate under the threshold, or NULL (ask the generator)."""
    gate = F.lit(threshold is not None) & (F.coalesce("top_score", F.lit(0.0)) < F.lit(threshold if threshold is not None else 0.0))
    return prompts_.withColumn("refusal_source", F.when(F.col("n_chunks") == 0, "no_context").when(gate, "score_gate"))


def answered(gated_: DataFrame, generator) -> DataFrame:
    """Rows for every query: answer, citations, refusal_source, error. Only rows that no gate refused reach the generator.

    generator(DataFrame(query_id, prompt)) -> query_id, answer, refused, citations array<struct<chunk_id, quote>>, error;
    a failure is a row with an error.
    """
    g = generator(gated_.where("refusal_source IS NULL").select("query_id", "prompt"))
    g = g.select(F.col("query_id").alias("__q"), "answer", F.col("refused").alias("__r"), "citations", "error")
    out = gated_.join(g, F.col("query_id") == F.col("__q"), "left")
    source = F.coalesce("refusal_source", F.when(F.col("__r"), "model"))
    return out.select("query_id", "top_score", "answer", "citations", source.alias("refusal_source"), source.isNotNull().alias("refused"), "error")


def checked(answers_: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """answer_id, pos, claim checks of every citation, against the chunks that its query was shown."""
    c = answers_.select(F.col("query_id").alias("answer_id"), F.posexplode("citations").alias("pos", "c"))
    c = c.select("answer_id", "pos", F.concat_ws("::", F.col("answer_id").cast("string"), F.col("pos").cast("string")).alias("claim_id"), F.concat_ws("@", F.col("c.chunk_id").cast("string"), F.col("answer_id").cast("string")).alias("chunk_id"), F.col("c.quote").alias("quote"))
    # a query sees its own copy of a chunk, so that siblings come from its context alone
    shown = hits.join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id")
    shown = shown.select(F.concat_ws("@", F.col("chunk_id").cast("string"), F.col("query_id").cast("string")).alias("chunk_id"), F.concat_ws("@", F.col("doc_id").cast("string"), F.col("query_id").cast("string")).alias("doc_id"), F.col("rank").alias("pos"), "text")
    v = citations.verify(c.select("claim_id", "chunk_id", "quote"), shown).select(F.col("claim_id").alias("__c"), "method", "start", "stop", "matched_text", F.split_part("found_in", F.lit("@"), F.lit(1)).alias("found_in"))
    return c.join(v, F.col("claim_id") == F.col("__c")).select("answer_id", "pos", F.split_part("chunk_id", F.lit("@"), F.lit(1)).alias("chunk_id"), "quote", "method", "start", "stop", "matched_text", "found_in")


def parsed_pairs(raw: DataFrame) -> DataFrame:
    """doc_id, n, question, answer, evidence from model JSON; rows that don't parse give none."""
    shape = "struct<pairs:array<struct<question:string,answer:string,evidence:array<struct<chunk_id:string,quote:string>>>>>"
    r = raw.select("doc_id", F.posexplode(F.from_json("response", shape)["pairs"]).alias("n", "p"))
    return r.select("doc_id", "n", F.trim("p.question").alias("question"), F.trim("p.answer").alias("answer"), F.filter("p.evidence", lambda e: F.trim(F.coalesce(e["quote"], F.lit(""))) != "").alias("evidence"))


def parsed_judgments(raw: DataFrame) -> DataFrame:
    """item_id, verdict from model JSON; unknown verdicts and repeats of an id after the first are left out."""
    shape = "struct<judgments:array<struct<item_id:string,verdict:string>>>"
    r = raw.select("batch", F.posexplode(F.from_json("response", shape)["judgments"]).alias("n", "j")).select("batch", "n", "j.item_id", F.lower("j.verdict").alias("verdict"))
    r = r.where(F.col("verdict").isin("supported", "partial", "unsupported"))
    return r.groupBy("item_id").agg(F.min_by("verdict", F.struct("batch", "n")).alias("verdict"))
