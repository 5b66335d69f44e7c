"""Programmatic probes with span truth: identifiers, sections, titles, and citations that nothing holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.identifiers import PRIMARY
from parchment.functions.text import normal_heading
from parchment.operators.sampling import SEED, shuffled

# Occurrences of an identifier, characters of a heading and of a section, probes of a slice.
MIN_OCCURRENCES, MAX_OCCURRENCES, MIN_HEADING, MIN_SECTION, PER_SLICE = 1, 6, 18, 400, 60
TITLES = (7, 9, 16, 21, 40, 42, 45)


def _numbered(rows: DataFrame, prefix: str, slice_name: str, key: str, limit: int, seed: int) -> DataFrame:
    r = rows.orderBy(shuffled(seed, key), key).limit(limit)
    n = F.row_number().over(Window.orderBy(shuffled(seed, key), key)) - 1
    return r.select("*", F.concat(F.lit(f"{prefix}-"), F.lpad(n.cast("string"), 4, "0")).alias("query_id"), F.lit(slice_name).alias("slice"))


def exact_identifier(found: DataFrame, limit: int = PER_SLICE, seed: int = SEED) -> DataFrame:
    """query_id, slice, query, spans: one to six occurrences, a section number in it."""
    spans = F.array_sort(F.collect_list(F.struct(F.col("id").alias("doc_id"), "start", "stop")))
    g = found.where(F.col("kind") == PRIMARY).groupBy("canonical").agg(F.count(F.lit(1)).alias("n"), spans.alias("spans"))
    g = g.where(F.col("n").between(MIN_OCCURRENCES, MAX_OCCURRENCES) & F.contains("canonical", F.lit(".")))
    return _numbered(g, "ident", "exact_identifier", "canonical", limit, seed).select("query_id", "slice", F.concat(F.lit("What are the requirements of "), "canonical", F.lit("?")).alias("query"), "spans")


def section_lookup(sections: DataFrame, limit: int = PER_SLICE, seed: int = SEED) -> DataFrame:
    """Headings of enough characters over enough text that only one section of the corpus has."""
    s = sections.withColumn("key", normal_heading("heading"))
    one = s.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("key")
    s = s.join(one, "key", "left_semi").where((F.length(F.trim("heading")) >= MIN_HEADING) & (F.col("stop") - F.col("start") >= MIN_SECTION))
    spans = F.array(F.struct("doc_id", "start", "stop"))
    return _numbered(s.withColumn("id", F.concat_ws(":", "doc_id", "idx")), "section", "section_lookup", "id", limit, seed).select("query_id", "slice", F.trim("heading").alias("query"), spans.alias("spans"))


def title_lookup(docs: DataFrame, limit: int = PER_SLICE, seed: int = SEED) -> DataFrame:
    """Titles of enough characters; the whole document is the target."""
    d = docs.where(F.length(F.trim("title")) >= MIN_HEADING)
    spans = F.array(F.struct("doc_id", F.lit(0).cast("bigint").alias("start"), F.col("n_chars").cast("bigint").alias("stop")))
    return _numbered(d, "title", "title_lookup", "doc_id", limit, seed).select("query_id", "slice", F.trim("title").alias("query"), spans.alias("spans"))


def unanswerable(found: DataFrame, limit: int = PER_SLICE, seed: int = SEED, tries: int = 4) -> DataFrame:
    """Well-formed citations that occur nowhere: candidates named by MD5, those present taken out."""
    spark = found.sparkSession

    def part(at: int, low: int, n: int):
        return (F.conv(F.substring("h", at, 7), 16, 10).cast("bigint") % n + low).cast("string")

    titles = F.array(*(F.lit(str(t)) for t in TITLES))
    c = spark.range(limit * tries).select("id", F.md5(F.concat(F.lit(f"{seed}:unanswerable:"), F.col("id").cast("string"))).alias("h"))
    c = c.select("id", F.concat(F.element_at(titles, (F.conv(F.substring("h", 1, 7), 16, 10).cast("bigint") % len(TITLES) + 1).cast("int")), F.lit(" CFR "), part(8, 100, 1900), F.lit("."), part(15, 1, 99)).alias("canonical"))
    c = c.groupBy("canonical").agg(F.min("id").alias("id")).join(found.where(F.col("kind") == PRIMARY).select("canonical").distinct(), "canonical", "left_anti")
    n = F.row_number().over(Window.orderBy("id")) - 1
    c = c.orderBy("id").limit(limit)
    return c.select(
        F.concat(F.lit("unans-"), F.lpad(n.cast("string"), 4, "0")).alias("query_id"), F.lit("unanswerable").alias("slice"),
        F.concat(F.lit("What are the requirements of "), "canonical", F.lit("?")).alias("query"), F.array().cast("array<struct<doc_id:bigint,start:bigint,stop:bigint>>").alias("spans"),
    )


def exploded(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode("spans").alias("s")).select("query_id", "s.doc_id", "s.start", "s.stop")
