"""Reference question-answer pairs: validation, redundancy, selection, yield."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.text import coverage, line_number_density
from parchment.operators.citations import MIN_QUOTE, VERIFIED, evidence_spread
from parchment.sources.files import durable

# Shortest answer, widest spread, overlap of redundant answers, line density, coverage, draft budget.
MIN_ANSWER, MAX_SPREAD, MAX_OVERLAP, MAX_DENSITY, MIN_COVERAGE, BUDGET = 40, 2, 0.7, 0.35, 0.45, 40_000


def validated(pairs: DataFrame, checks: DataFrame, docs: DataFrame) -> DataFrame:
    """pair_id, status, reason of pairs (pair_id, question, answer, evidence: array<struct<chunk_id, quote>>).

    checks: pair_id, method (one row for each piece of evidence). The first rule that fails
    names the reason; cheaper rules come first.
    """
    quotes = pairs.select("pair_id", F.posexplode("evidence").alias("pos", "e")).select("pair_id", F.concat_ws("::", "pair_id", "pos").alias("quote_id"), F.col("e.quote").alias("quote"))
    spread = evidence_spread(quotes.select("quote_id", "quote"), docs).join(quotes.select("quote_id", "pair_id"), "quote_id").groupBy("pair_id").agg(F.max("documents").alias("spread"))
    c = checks.groupBy("pair_id").agg(F.count("method").alias("claimed"), F.count_if(F.col("method").isin(*VERIFIED)).alias("verified"))
    p = pairs.join(c, "pair_id", "left").join(spread, "pair_id", "left").withColumn("joined", F.array_join(F.transform(F.coalesce("evidence", F.array()), lambda e: e["quote"]), " "))
    answer, question = F.coalesce("answer", F.lit("")), F.coalesce("question", F.lit(""))
    verified, claimed = F.coalesce("verified", F.lit(0)), F.coalesce("claimed", F.lit(0))
    reason = (
        F.when(question == "", "empty question")
        .when(answer == "", "empty answer")
        .when(F.length(answer) < MIN_ANSWER, "answer too short")
        .when(F.lower(F.trim(question)) == F.lower(F.trim(answer)), "answer restates the question")
        .when(F.coalesce(F.size("evidence"), F.lit(0)) == 0, "no evidence supplied")
        .when(verified == 0, "no evidence verified")
        .when(coverage(answer, "joined") < MIN_COVERAGE, "answer outruns its evidence")
        .when(verified < claimed, "evidence partly verified")
        .when(F.coalesce("spread", F.lit(0)) > MAX_SPREAD, "boilerplate evidence")
    )
    return p.select("pair_id", F.when(reason.isNull(), "accepted").otherwise("rejected").alias("status"), reason.alias("reason"))


def overlap_words(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_distinct(F.filter(F.split(F.trim(F.lower(c)), r"\s+"), lambda w: F.length(w) > 2))


def redundant(pairs: DataFrame, most: float = MAX_OVERLAP) -> DataFrame:
    """pair_id, duplicate_of: accepted pairs whose answer repeats an earlier kept one (NULL: kept).

    A pair's fate depends on its earlier neighbours alone. Neighbours come from a join on rare
    shared words: two sets over the threshold share one of each set's rarest words. Then, round
    by round, pairs whose earlier neighbours are all settled are settled: with a kept one among
    them they go, else they stay.
    """
    p = pairs.where("status = 'accepted'").select("pair_id", overlap_words("answer").alias("w"))
    df = p.select(F.explode("w").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    e = p.select("pair_id", "w", F.explode("w").alias("t")).join(df, "t")
    rank = F.row_number().over(Window.partitionBy("pair_id").orderBy("df", "t"))
    e = e.withColumn("r", rank).where(F.col("r") <= F.floor(F.size("w") * (1 - most)) + 1)
    x, y = e.select("t", F.col("pair_id").alias("a"), F.col("w").alias("wa")), e.select("t", F.col("pair_id").alias("b"), F.col("w").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    near = x.join(y, "t").where("a < b").dropDuplicates(["a", "b"]).where(both / (F.size("wa") + F.size("wb") - both) > most).select("a", "b")
    near = durable(near)
    state = p.select("pair_id", F.lit(None).cast("boolean").alias("kept"), F.lit(None).cast(p.schema["pair_id"].dataType).alias("duplicate_of"))
    while True:
        earlier = near.join(state.select(F.col("pair_id").alias("a"), "kept"), "a").groupBy(F.col("b").alias("pair_id"))
        seen = earlier.agg(F.min(F.when(F.col("kept"), F.col("a"))).alias("by"), F.count_if(F.col("kept").isNull()).alias("open"))
        # the first kept neighbour names the reason; it is known once all before it are settled
        first_open = near.join(state.where("kept IS NULL").select(F.col("pair_id").alias("a")), "a").groupBy(F.col("b").alias("pair_id")).agg(F.min("a").alias("first_open"))
        j = state.join(seen, "pair_id", "left").join(first_open, "pair_id", "left")
        gone = F.col("by").isNotNull() & (F.col("first_open").isNull() | (F.col("by") < F.col("first_open")))
        kept = F.when(F.col("kept").isNotNull(), F.col("kept")).when(gone, False).when(F.coalesce("open", F.lit(0)) == 0, F.col("by").isNull())
        new = durable(j.select("pair_id", kept.alias("kept"), F.coalesce("duplicate_of", F.when(gone, F.col("by"))).alias("duplicate_of")))
        if new.where("kept IS NULL").isEmpty():
            return new.select("pair_id", "duplicate_of")
        state = new


def yield_report(pairs: DataFrame) -> DataFrame:
    """reason (up to " ("), n; accepted pairs under "accepted"."""
    key = F.when(F.col("status") == "accepted", "accepted").otherwise(F.split_part(F.coalesce("reason", F.lit("")), F.lit(" ("), F.lit(1)))
    return pairs.groupBy(key.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def review_sample(pairs: DataFrame, n: int) -> DataFrame:
    """The first n accepted pairs taking documents in turn."""
    depth = F.row_number().over(Window.partitionBy("doc_id").orderBy("pair_id"))
    return pairs.where("status = 'accepted'").withColumn("depth", depth).orderBy("depth", "doc_id").limit(n).drop("depth")


def stride_selected(chunks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Per document all chunks within the budget, else every stride-th, cut from the tail, at least one."""
    all_ = Window.partitionBy("doc_id")
    order = all_.orderBy("pos")
    c = chunks.withColumn("total", F.sum(F.length("text")).over(all_)).withColumn("rn", F.row_number().over(order) - 1)
    stride = F.when(F.col("total") <= budget, 1).otherwise(F.greatest(F.lit(2), F.ceil(F.col("total") / budget)))
    c = c.where(F.col("rn") % stride == 0).withColumn("running", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return c.where((F.col("total") <= budget) | (F.col("running") <= budget) | (F.col("rn") == 0)).drop("total", "rn", "running")


def drafting_sources(docs: DataFrame) -> DataFrame:
    """Documents that aren't typeset with line numbers."""
    return docs.where(line_number_density("text") <= MAX_DENSITY)


def draft_prompts(chunks: DataFrame, n: int, budget: int = BUDGET, least_quote: int = MIN_QUOTE) -> DataFrame:
    """doc_id, system, prompt: what a drafter is asked for each document. It sees the texts that quotes
    are located in, and the floors that answers and quotes are held to."""
    total = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    block = F.concat(F.lit("["), F.col("chunk_id").cast("string"), F.lit("]\n"), F.col("text"))
    shown = stride_selected(chunks, budget).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))).alias("bs"))
    part = F.when(F.size("bs") < F.col("total"), F.format_string(" (%d of %d excerpts, spread evenly)", F.size("bs"), F.col("total"))).otherwise("")
    prompt = F.concat(F.lit("Document "), F.col("doc_id").cast("string"), part, F.lit(f".\n\nWrite {n} pairs.\n\n"), F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n"))
    system = (
        f"Write question and answer pairs from the excerpts alone. Answers have at least {MIN_ANSWER} characters. Each piece of evidence names"
        f" its excerpt and quotes at least {least_quote} characters of it word for word. Reply with JSON: pairs of question, answer and evidence."
    )
    return shown.join(total, "doc_id").select("doc_id", F.lit(system).alias("system"), prompt.alias("prompt"))


def document_index(chunks: DataFrame) -> DataFrame:
    """doc_id and the text of its chunks in order, white space collapsed, for containment tests."""
    from parchment.functions.text import collapsed

    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return chunks.groupBy("doc_id").agg(collapsed(F.array_join(parts, " ")).alias("text"))


def diff(pairs: DataFrame) -> DataFrame:
    """id, ops: array<struct<op, token>> of a longest common subsequence of quote and source tokens
    (white space runs are tokens), and clean: equal but for white space."""
    kind = pairs.schema["id"].dataType.simpleString()

    def ops(a: list[str], b: list[str]) -> list[dict]:
        known = {t: k for k, t in enumerate(dict.fromkeys(a + b))}
        x, y = (np.array([known[t] for t in side], np.int64) for side in (a, b))
        best = np.zeros((len(a) + 1, len(b) + 1), np.uint16 if min(len(a), len(b)) < 1 << 16 else np.uint32)
        for i in reversed(range(len(a))):
            # a row at once: what a token adds where it matches, then the best of all places behind
            row = np.where(y == x[i], best[i + 1, 1:] + 1, best[i + 1, :-1])
            best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
        out, i, j = [], 0, 0
        while i < len(a) or j < len(b):
            if i < len(a) and j < len(b) and a[i] == b[j]:
                out.append({"op": "same", "token": a[i]})
                i, j = i + 1, j + 1
            elif j == len(b) or (i < len(a) and best[i + 1, j] >= best[i, j + 1]):
                out.append({"op": "del", "token": a[i]})
                i += 1
            else:
                out.append({"op": "ins", "token": b[j]})
                j += 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        for b in batches:
            rows = b.to_pylist()
            cut = [[[t for t in re.split(r"(\s+)", r[c] or "") if t] for c in ("quote", "source")] for r in rows]
            shape = pa.list_(pa.struct([("op", pa.string()), ("token", pa.string())]))
            clean = [" ".join((r["quote"] or "").split()) == " ".join((r["source"] or "").split()) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ops(*x) for x in cut], shape), pa.array(clean)], ["id", "ops", "clean"])

    return pairs.select("id", "quote", "source").mapInArrow(run, f"id {kind}, ops array<struct<op:string,token:string>>, clean boolean")
