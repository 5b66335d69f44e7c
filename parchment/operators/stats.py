"""Corpus, extraction and latency statistics; failure analyses. One row per group, never nested."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Samples kept of each stage, and the marking of non-binding text.
RING = 1024
NON_BINDING = "contains nonbinding recommendations"


def p95(c: str) -> Column:
    """The value at floor(.95 n) of the sorted ones (the last if beyond), not an interpolated percentile."""
    s = F.array_sort(F.collect_list(c))
    return F.element_at(s, F.least(F.size(s), F.floor(F.size(s) * 0.95).cast("int") + 1))


def latency(samples: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, p50 (interpolated), p95, least, most.

    The order statistic comes from row numbers, so that no group is gathered in one row.
    """
    w = Window.partitionBy(by)
    s = samples.where(F.col(value).isNotNull()).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("rn", F.row_number().over(w.orderBy(value)))
    at = F.least(F.col("n"), F.floor(F.col("n") * 95 / 100) + 1)
    return s.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.median(value).alias("p50"), F.max(F.when(F.col("rn") == at, F.col(value))).alias("p95"), F.min(value).alias("least"), F.max(value).alias("most"))


def ring(samples: DataFrame, by: str, order: list[str], keep: int = RING) -> DataFrame:
    """The last `keep` samples of each stage."""
    return samples.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*(F.desc(o) for o in order)))).where(F.col("rn") <= keep).drop("rn")


def distribution(values: DataFrame, by: str, value: str) -> DataFrame:
    """by, n, least, median, p90 (nearest rank), most, total."""
    w = Window.partitionBy(by)
    s = values.where(F.col(value).isNotNull()).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("rn", F.row_number().over(w.orderBy(value)))
    at = F.greatest(F.ceil(F.col("n") * 9 / 10), F.lit(1))
    return s.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.median(value).alias("median"), F.max(F.when(F.col("rn") == at, F.col(value))).alias("p90"), F.max(value).alias("most"), F.sum(value).alias("total")
    )


def manifest_stats(manifest: DataFrame, fetched: DataFrame) -> DataFrame:
    """source and counts: in manifest, ok, failed, missing, indexable, pinned, characters and estimated tokens of the indexable."""
    f = fetched.select(F.col("doc_id").alias("__f"), "ok", "text_layer", "text_chars")
    m = manifest.join(f, F.col("doc_id") == F.col("__f"), "left")
    known, ok = F.col("__f").isNotNull(), F.coalesce(F.col("ok"), F.lit(False))
    index = ok & F.coalesce(F.col("text_layer").isin("digital_native", "mixed"), F.lit(False))
    chars = F.coalesce(F.sum(F.when(index, F.col("text_chars"))), F.lit(0))
    return m.groupBy("source").agg(
        F.count(F.lit(1)).alias("in_manifest"), F.count_if(known & ok).alias("ok"), F.count_if(known & ~ok).alias("failed"), F.count_if(~known).alias("missing"),
        F.count_if(index).alias("indexable"), F.count("sha256").alias("pinned"), chars.alias("chars"), F.floor(chars / 4).alias("tokens"),
    )


def corpus_facts(manifest: DataFrame, fetched: DataFrame) -> DataFrame:
    """what, name, n: the counts of a corpus, from one pass of conditional aggregates and one pass of groups.

    manifest: doc_id, source, status, center, issue_date, sha256; fetched: doc_id, ok, pages,
    image_only_pages, text_chars, table_like_lines, text_layer.
    """
    m = manifest.join(fetched.select(F.col("doc_id").alias("__f"), *(c for c in fetched.columns if c != "doc_id")), F.col("doc_id") == F.col("__f"), "left")
    ok = F.coalesce(F.col("ok"), F.lit(False))
    layer, pages, chars = F.col("text_layer"), F.coalesce("pages", F.lit(0)), F.coalesce("text_chars", F.lit(0))
    index = ok & F.coalesce(layer.isin("digital_native", "mixed"), F.lit(False))
    blank = index & (F.coalesce("image_only_pages", F.lit(0)) > 0)
    m = m.withColumns({"__index": index, "__ok": ok})
    facts = {
        ("count", "in_manifest"): F.lit(True), ("count", "ok"): ok, ("count", "failed"): F.col("__f").isNotNull() & ~ok, ("count", "missing"): F.col("__f").isNull(),
        ("count", "indexable"): index, ("count", "pinned"): F.col("sha256").isNotNull(),
        ("scans", "with_blank_pages"): blank, ("scans", "mixed"): blank & (layer == "mixed"), ("scans", "digital_native"): blank & (layer == "digital_native"),
        ("slices", "with_table_like_lines"): index & (F.coalesce("table_like_lines", F.lit(0)) > 0), ("slices", "undated"): index & F.col("issue_date").isNull(),
        ("quality", "undated"): F.col("issue_date").isNull(), ("quality", "unpinned"): F.col("sha256").isNull(), ("quality", "unreadable"): ok & (layer == "unreadable"),
        ("quality", "negligible_text"): ok & (pages > 0) & (chars / F.greatest(pages, F.lit(1)) < 100),
    }
    one = m.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(f"{a}.{b}") for (a, b), c in facts.items()), F.coalesce(F.sum(F.when(index, chars)), F.lit(0)).alias("sum.chars"))
    rows = F.explode(F.array(*(F.struct(F.lit(c.split(".")[0]).alias("what"), F.lit(c.split(".")[1]).alias("name"), F.col(f"`{c}`").cast("bigint").alias("n")) for c in one.columns))).alias("r")
    era = F.when(F.col("issue_date").isNull(), "undated").otherwise(F.concat((F.floor(F.year("issue_date") / 10) * 10).cast("string"), F.lit("s")))
    groups = {
        "source": F.col("source"), "status": F.coalesce("status", F.lit("n/a")), "era": era, "layer": F.when(ok, F.coalesce(layer, F.lit("unknown"))), "center": F.when(index, F.coalesce("center", F.lit("unknown"))),
    }
    named = m.select(F.explode(F.array(*(F.struct(F.lit(k).alias("what"), v.alias("name")) for k, v in groups.items()))).alias("r")).select("r.*").where("name IS NOT NULL")
    return one.select(rows).select("r.*").unionByName(named.groupBy("what", "name").agg(F.count(F.lit(1)).alias("n")))


def most(rows: DataFrame, value: str, key: str, n: int = 10) -> DataFrame:
    """The n rows with the largest value, ties by key."""
    return rows.orderBy(F.desc(value), F.asc(key)).limit(n)


def carried(new: DataFrame, old: DataFrame, key: str = "doc_id", cols: tuple[str, ...] = ("sha256",)) -> DataFrame:
    """New rows with the old rows' values where they have none."""
    o = old.select(F.col(key).alias("__k"), *(F.col(c).alias(f"__{c}") for c in cols))
    return new.join(o, F.col(key) == F.col("__k"), "left").withColumns({c: F.coalesce(c, f"__{c}") for c in cols}).select(*new.columns)


def extraction_stats(found: DataFrame, docs: DataFrame) -> DataFrame:
    """kind, source, documents, occurrences, sections and detailed forms of identifiers."""
    d = docs.select(F.col("doc_id").alias("id"), "source")
    return found.join(d, "id").groupBy("kind", "source").agg(
        F.count_distinct("id").alias("documents"), F.count(F.lit(1)).alias("occurrences"), F.count_distinct("canonical").alias("sections"), F.count_distinct("canonical_detailed").alias("detailed")
    )


def extraction_outliers(docs: DataFrame) -> DataFrame:
    """doc_id, problem of (doc_id, n_sections, n_chars, n_pages): no sections, too many, too little text."""
    p = F.when(F.col("n_sections") == 0, "no sections").when(F.col("n_sections") * 1000 > 2 * F.col("n_chars"), "over 2 sections per 1000 characters")
    p = p.when((F.col("n_pages") > 0) & (F.col("n_chars") < 100 * F.col("n_pages")), "under 100 characters per page")
    return docs.withColumn("problem", p).where("problem IS NOT NULL").select("doc_id", "problem")


def refusals(outcomes: DataFrame) -> DataFrame:
    """slice, n, refused, rate, answered among (slice, refused, error); rows with an error aren't scored."""
    s = outcomes.where("error IS NULL")
    return s.groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.count_if("refused").alias("refused"), F.avg(F.col("refused").cast("double")).alias("rate"))


def answerable_refusal(outcomes: DataFrame, mention: tuple[str, ...] = ("exact_identifier",)) -> DataFrame:
    """One row: refusals among answerable slices, and among those whose labels don't merely mention."""
    s = outcomes.where("error IS NULL AND slice <> 'unanswerable'")
    fair = ~F.col("slice").isin(*mention)
    return s.agg(
        F.count(F.lit(1)).alias("answerable"), F.count_if("refused").alias("refused"), F.count_if(fair).alias("fair"), F.count_if(fair & F.col("refused")).alias("fair_refused"),
        F.try_divide(F.count_if("refused"), F.count(F.lit(1))).alias("rate"), F.try_divide(F.count_if(fair & F.col("refused")), F.count_if(fair)).alias("fair_rate"),
    )


def obligation_errors(verdicts: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: judged, rejected, and the document with most rejects (the first of equals) and whether its text is marked non-binding."""
    v = verdicts.withColumn("doc_id", F.split_part("pair_id", F.lit("::"), F.lit(1)))
    total = v.agg(F.count(F.lit(1)).alias("n_judged"), F.count_if(F.col("verdict") == "reject").alias("n_rejected"))
    by = v.where("verdict = 'reject'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    worst = by.agg(F.min(F.struct((-F.col("n")).alias("m"), "doc_id")).alias("w")).select(F.col("w.doc_id").alias("worst_doc"), (-F.col("w.m")).alias("worst_n"))
    marked = F.lower(F.regexp_replace("text", r"[\s\-]+", " ")).contains(NON_BINDING)
    m = chunks.where(marked).select(F.col("doc_id").alias("__d")).distinct()
    return total.crossJoin(F.broadcast(worst)).join(m, F.col("worst_doc") == F.col("__d"), "left").select("n_judged", "n_rejected", "worst_doc", "worst_n", F.col("__d").isNotNull().alias("nonbinding"))


def identifier_collapse(runs: DataFrame) -> DataFrame:
    """chunking with the recalls of (chunking, retriever, recall) side by side and how often sparse beats dense (NULL for 0)."""
    w = runs.groupBy("chunking").pivot("retriever", ["sparse", "dense", "fused"]).agg(F.first("recall"))
    return w.withColumn("ratio", F.when(F.col("dense") != 0, F.col("sparse") / F.col("dense")))


def aggregate_builds(points: DataFrame) -> DataFrame:
    """ef with median, least and most recall over builds, the worst p95 and recalls in build order."""
    order = F.transform(F.array_sort(F.collect_list(F.struct("build", "recall"))), lambda x: x["recall"])
    return points.groupBy("ef").agg(F.median("recall").alias("recall"), F.min("recall").alias("least"), F.max("recall").alias("most"), F.max("p95").alias("worst_p95"), order.alias("recalls"))


def verify_cost(checks: DataFrame) -> DataFrame:
    """kind, answers, ms: median time by the dearest verdict of an answer; (answer_id, method, ms)."""
    dear = F.max(F.when(F.col("method") == "exact", 0).when(F.col("method") == "normalized", 1).otherwise(2))
    a = checks.groupBy("answer_id").agg(dear.alias("d"), F.max("ms").alias("ms"))
    kind = F.element_at(F.array(F.lit("all_exact"), F.lit("any_normalized"), F.lit("any_failed")), F.col("d") + 1)
    return a.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("answers"), F.median("ms").alias("ms"))


def token_totals(calls: DataFrame, price_in: float | None = None, price_out: float | None = None) -> DataFrame:
    """One row: calls, tokens in and out, and cost, NULL unless both prices per million are usable numbers."""
    good = all(isinstance(p, (int, float)) and 0 <= p < float("inf") for p in (price_in, price_out))
    cost = (F.sum("tokens_in") * price_in + F.sum("tokens_out") * price_out) / 1e6 if good else F.lit(None).cast("double")
    return calls.agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), cost.alias("cost"))


def truncation(chunks: DataFrame, window: int, reserve: int = 0) -> DataFrame:
    """One row: chunks, truncated ones, tokens and dropped tokens, for (n_tokens)."""
    over = F.greatest(F.col("n_tokens") + reserve - window, F.lit(0))
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(over > 0).alias("truncated"), F.sum("n_tokens").alias("tokens"), F.sum(over).alias("dropped"),
        F.try_divide(100 * F.count_if(over > 0), F.count(F.lit(1))).alias("pct_truncated"), F.try_divide(100 * F.sum(over), F.sum("n_tokens")).alias("pct_dropped"),
    )
