"""Quoted evidence located in its source, with offsets into the untouched text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.text import LINE_NUMBERS, WHITE, collapsed, without_line_numbers
from parchment.operators.needles import spread

# Outcomes, the two that verify, and the shortest quote that is evidence.
METHODS = ("exact", "normalized", "line_number_ambiguous", "wrong_chunk", "unverified", "too_short")
VERIFIED = ("exact", "normalized")
MIN_QUOTE = 24


def located(quote: Column | str, source: Column | str) -> tuple[Column, Column, Column]:
    """(method, start, stop) of a quote in a source: as it stands, else but for white space, else
    but for integers beside line ends (a diagnosis, no verification). Offsets are into the source
    as it stands: the quote's words are looked for with any white space, in the last tier also with
    such integers, between them."""
    quote, source = (F.col(x) if isinstance(x, str) else x for x in (quote, source))
    exact = F.instr(source, quote)
    loose = F.contains(collapsed(source), collapsed(quote)) & (collapsed(quote) != "")
    bare = F.contains(without_line_numbers(source), without_line_numbers(quote)) & (without_line_numbers(quote) != "")
    gap, beside = f"{WHITE}+", rf"(?:{WHITE}|{LINE_NUMBERS})+"
    loosely, barely = _anywhere(collapsed(quote), gap), _anywhere(without_line_numbers(quote), beside)
    method = F.when((quote == "") | (source == ""), None).when(exact > 0, "exact").when(loose, "normalized").when(bare, "line_number_ambiguous")

    def by_method(of_exact: Column, of_pattern) -> Column:
        return F.when(method == "exact", of_exact).when(method == "normalized", of_pattern(loosely)).when(method == "line_number_ambiguous", of_pattern(barely))

    start = by_method(exact - 1, lambda p: F.regexp_instr(source, p) - 1)
    return method, start, start + by_method(F.length(quote), lambda p: F.length(F.call_function("regexp_extract", source, p, F.lit(0))))


def _anywhere(words: Column, gap: str) -> Column:
    """The pattern of single-spaced words with `gap` for each space."""
    quoted = F.replace(words, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("(?m)\\Q"), F.replace(quoted, F.lit(" "), F.lit(f"\\E{gap}\\Q")), F.lit("\\E"))


def spans(matches: DataFrame) -> DataFrame:
    """matches (source, start, stop) with matched_text, what the source says there."""
    return matches.withColumn("matched_text", F.when(F.col("start").isNotNull(), F.substring(F.col("source"), F.col("start") + 1, F.col("stop") - F.col("start"))))


def verify(claims: DataFrame, chunks: DataFrame, least: int = MIN_QUOTE) -> DataFrame:
    """claim_id, chunk_id, method, start, stop, matched_text, found_in of claims (claim_id, chunk_id, quote)
    against the chunks that were shown (chunk_id, doc_id, pos, text).

    A short quote ends it. The cited chunk is tried first and any match there decides, also a
    diagnostic one; then the other chunks of its document in order, where any match is a wrong
    chunk. A claim on an unknown chunk is unverified.
    """
    c = claims.withColumn("bare", F.regexp_replace(F.col("quote"), rf"\A{WHITE}+|{WHITE}+\z", ""))
    short = F.length("bare") < least
    cited = chunks.select(F.col("chunk_id").alias("__c"), F.col("doc_id").alias("__d"))
    every = chunks.select(F.col("chunk_id").alias("tried"), F.col("doc_id").alias("__e"), F.col("pos"), F.col("text").alias("source"))
    x = c.where(~short).join(cited, F.col("chunk_id") == F.col("__c")).join(every, F.col("__d") == F.col("__e"))
    method, start, stop = located("bare", "source")
    x = x.withColumns({"method": method, "start": start, "stop": stop}).where("method IS NOT NULL").withColumn("own", F.col("tried") == F.col("chunk_id"))
    w = Window.partitionBy("claim_id").orderBy(F.desc("own"), "pos", "tried")
    x = spans(x.withColumn("n", F.row_number().over(w)).where("n = 1").withColumn("quote", F.col("bare")))
    x = x.select(F.col("claim_id").alias("__id"), F.when(F.col("own"), F.col("method")).otherwise("wrong_chunk").alias("m"), "start", "stop", "matched_text", F.when(~F.col("own"), F.col("tried")).alias("found_in"))
    out = c.join(x, F.col("claim_id") == F.col("__id"), "left")
    return out.select("claim_id", "chunk_id", F.when(short, "too_short").otherwise(F.coalesce("m", F.lit("unverified"))).alias("method"), "start", "stop", "matched_text", "found_in")


def buckets(checks: DataFrame) -> DataFrame:
    """method, n of all six outcomes, 0 where none."""
    names = checks.sparkSession.createDataFrame([(m,) for m in METHODS], "method string")
    return names.join(F.broadcast(checks.groupBy("method").agg(F.count(F.lit(1)).alias("n"))), "method", "left").select("method", F.coalesce("n", F.lit(0)).alias("n"))


def precision(checks: DataFrame, by: str) -> DataFrame:
    """by, claimed, verified, precision (NULL without claims), grounded."""
    good = F.count_if(F.col("method").isin(*VERIFIED))
    n = F.count("method")
    return checks.groupBy(by).agg(n.alias("claimed"), good.alias("verified"), F.try_divide(good, n).alias("precision"), ((n > 0) & (good == n)).alias("grounded"))


def mean_precision(checks: DataFrame, by: str) -> DataFrame:
    """One row: answers with citations, the mean of their precisions, and how many are grounded."""
    p = precision(checks, by)
    return p.agg(F.count("precision").alias("answers"), F.avg("precision").alias("mean_precision"), F.count_if("grounded").alias("grounded"))


def line_number_exposure(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """One row: chunks, how many lose digits when line numbers go, digits before and after."""

    def digits(c: Column) -> Column:
        return F.length(F.regexp_replace(c, "[^0-9]", ""))

    c = chunks.select(digits(F.col(text_col)).alias("b"), digits(without_line_numbers(text_col)).alias("a"))
    return c.agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("a") < F.col("b")).alias("n_affected"), F.sum("b").alias("digits_before"), F.sum("a").alias("digits_after"))


def evidence_spread(quotes: DataFrame, docs: DataFrame, least: int = MIN_QUOTE) -> DataFrame:
    """quote_id, documents: how many texts contain the quote but for white space; 0 for short ones.

    Quotes are the stated set; every document is read once against all of them.
    """
    q = quotes.select("quote_id", collapsed(F.col("quote")).alias("needle"))
    n = q.where(F.length("needle") >= least).withColumnRenamed("quote_id", "needle_id")
    counts = spread(n, docs.select("doc_id", collapsed(F.col("text")).alias("text")))
    return q.join(counts, F.col("quote_id") == F.col("needle_id"), "left").select("quote_id", F.coalesce("n", F.lit(0)).alias("documents"))
