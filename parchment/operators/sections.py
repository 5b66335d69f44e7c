"""Headings and sections of page text; outlines; offsets of joined pages."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of a heading, of a page of contents, of an outline, and the running-header window.
MAX_WORDS, MAX_CHARS, CONTENTS_HITS, HEADER_PAGES = 14, 110, 4, 2
PER_PAGE, SUBSTANTIVE, ONE_PAGE, WORD_CHARS = 8.0, 0.6, 0.5, 4
# Shapes of lines.
NUMBERED = r"^\s{0,8}([0-9]{1,2}(?:\.[0-9]{1,2}){0,3})\.?\s+(\S.*)$"
ROMAN = r"^\s{0,8}((?:IX|IV|VI{0,3}|I{1,3}|X{1,2}))\.\s+(\S.*)$"
LETTERED = r"^\s{0,8}([A-Z])\.\s+(\S.*)$"
CAPITALS = r"^\s{0,8}([A-Z][A-Z0-9\s&,\-/():.']{4,70})\s*$"
LEADER, TRAILING, SENTENCE = r"\.{3,}\s*[0-9]+\s*$", r"\s{2,}[0-9]{1,3}\s*$", r"[.;:,]\s*$"
CITATION = r"(?i)^[0-9]{1,2}\s*(?:C\.?\s*F\.?\s*R\.?|U\.?\s*S\.?\s*C\.?|F\.?\s*R\.?)\b"


def _words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def heading(line: Column | str) -> tuple[Column, Column]:
    """(text, level) of a line that looks like a heading, else NULLs; shapes are tried in order and the first decides."""
    line = F.col(line) if isinstance(line, str) else line
    bare = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    out = (bare == "") | (F.length(bare) > MAX_CHARS) | line.rlike(LEADER) | line.rlike(TRAILING) | bare.rlike(CITATION)

    def rest(p: str) -> Column:
        return F.regexp_replace(F.regexp_extract(line, p, 2), r"\s+$", "")

    def prose(p: str) -> Column:
        return (_words(rest(p)) > MAX_WORDS) | rest(p).rlike(SENTENCE)

    number, caps = F.regexp_extract(line, NUMBERED, 1), F.regexp_replace(F.regexp_extract(line, CAPITALS, 1), r"^\s+|\s+$", "")
    none = F.lit(None).cast("string")
    text = (
        F.when(out, none)
        .when(line.rlike(NUMBERED), F.when(~prose(NUMBERED) & rest(NUMBERED).rlike(r"^\p{Lu}"), F.concat_ws(" ", number, rest(NUMBERED))))
        .when(line.rlike(ROMAN), F.when(~prose(ROMAN), F.concat_ws(". ", F.regexp_extract(line, ROMAN, 1), rest(ROMAN))))
        .when(line.rlike(LETTERED), F.when(~prose(LETTERED), F.concat_ws(". ", F.regexp_extract(line, LETTERED, 1), rest(LETTERED))))
        .when(line.rlike(CAPITALS), F.when((_words(caps) >= 2) & caps.rlike("[AEIOU]"), caps))
    )
    level = F.when(line.rlike(NUMBERED), F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1).when(line.rlike(ROMAN), 1).when(line.rlike(LETTERED), 2).otherwise(1)
    return text, F.when(text.isNotNull(), level)


def is_contents(page: Column | str) -> Column:
    """At least four lines of dot leaders."""
    page = F.col(page) if isinstance(page, str) else page
    return F.size(F.filter(F.split(page, r"\r?\n", -1), lambda x: x.rlike(LEADER))) >= CONTENTS_HITS


def page_offsets(pages: DataFrame, gap: int = 2) -> DataFrame:
    """pages (doc_id, page, text) with start and stop in the text joined by `gap` characters."""
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + gap).over(w), F.lit(0))
    return pages.withColumn("start", start).withColumn("stop", F.col("start") + F.length("text"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Sections by headings: doc_id, idx, heading, level, page, start, stop.

    Pages of contents are skipped. A heading that stood at most two pages before, kept or not,
    is page furniture: the page before is a lag() over all its occurrences, as the rule looks
    at the previous occurrence alone. A section ends where the next begins.
    """
    p = page_offsets(pages)
    ends = p.groupBy("doc_id").agg(F.max("stop").alias("text_end"))
    lines = p.where(~is_contents("text")).select("doc_id", "page", F.col("start").alias("page_start"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    at = F.coalesce(F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id", "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    text, level = heading("line")
    h = lines.withColumn("start", F.col("page_start") + at).withColumns({"heading": text, "level": level}).where("heading IS NOT NULL")
    before = F.lag("page").over(Window.partitionBy("doc_id", "heading").orderBy("page", "pos"))
    kept = h.withColumn("before", before).where(F.col("before").isNull() | (F.col("page") - F.col("before") > HEADER_PAGES))
    w = Window.partitionBy("doc_id").orderBy("start")
    return kept.join(ends, "doc_id").select(
        "doc_id", (F.row_number().over(w) - 1).cast("bigint").alias("idx"), "heading", F.col("level").cast("bigint").alias("level"), "page", "start", F.lead("start", 1).over(w).alias("next"), "text_end"
    ).select("doc_id", "idx", "heading", "level", "page", "start", F.coalesce("next", "text_end").alias("stop"))


def outline_verdicts(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, entries, usable, reason; outline: doc_id, title, page; pages: doc_id, n_pages."""
    by_page = outline.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length(F.regexp_replace("title", r"[^\p{L}\p{N}_]", "")) >= WORD_CHARS).alias("good"))
    t = by_page.groupBy("doc_id").agg(F.sum("n").alias("entries"), F.sum("good").alias("good"), F.max("n").alias("top")).join(pages, "doc_id")
    reason = (
        F.when(F.col("entries") < 2, "fewer than 2 entries")
        .when((F.col("n_pages") > 0) & (F.col("entries") / F.col("n_pages") > PER_PAGE), "too many entries per page")
        .when(F.col("good") / F.col("entries") < SUBSTANTIVE, "too few substantive titles")
        .when(F.col("top") / F.col("entries") > ONE_PAGE, "entries resolve to one page")
        .otherwise("ok")
    )
    return t.select("doc_id", "entries", (reason == "ok").alias("usable"), reason.alias("reason"))


def _place(title: str, page: str, at: int) -> int | None:
    """Where a title stands in a page from `at` on: whole, by its first characters, or with other
    white space; None if it doesn't."""
    bare = title.strip()
    heads = dict.fromkeys(bare[:n] for n in (len(bare), 40, 20))
    shapes = [re.escape(h) for h in heads if len(h) >= 4]
    if len(bare[:30]) >= 6:
        shapes.append(r"\s*".join(map(re.escape, "".join(bare[:30].split()))))
    found = (re.compile(s).search(page, at) for s in shapes)
    return next((m.start() for m in found if m), None)


def from_outline(outline: DataFrame, pages: DataFrame) -> DataFrame:
    """Sections by an outline (doc_id, pos, title, level, page): doc_id, idx, heading, level, page, start, stop.

    Entries are anchored where their title stands on the page, each after the one before; a title
    that isn't there takes the place after the last anchor of the page. Entries of pages that don't
    exist are left out. A section ends where the next begins.
    """
    p = page_offsets(pages)
    ends = p.groupBy("doc_id").agg(F.max("stop").alias("text_end"))
    entries = outline.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "title", "level"))).alias("entries"))
    at = entries.join(p.select("doc_id", "page", "text", "start"), ["doc_id", "page"])
    kind = at.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                cursor = 0
                for e in r["entries"]:
                    here = _place(e["title"] or "", r["text"] or "", cursor)
                    here = cursor if here is None else here
                    cursor = here + 1
                    rows.append((r["doc_id"], r["page"], e["pos"], e["title"], e["level"], r["start"] + here))
            names = ("doc_id", "page", "pos", "heading", "level", "start")
            kinds = (b.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], list(names))

    found = at.select("doc_id", "page", "text", "start", "entries").mapInArrow(run, f"doc_id {kind}, page bigint, pos bigint, heading string, level bigint, start bigint")
    w = Window.partitionBy("doc_id").orderBy("start", "page", "pos")
    s = found.join(ends, "doc_id").withColumns({"idx": (F.row_number().over(w) - 1).cast("bigint"), "stop": F.coalesce(F.lead("start").over(w), "text_end")})
    return s.select("doc_id", "idx", "heading", "level", "page", "start", "stop")


def sectioned(pages: DataFrame, outline: DataFrame | None = None) -> DataFrame:
    """Sections of every document: by its outline where that is usable, else by headings in its text."""
    if outline is None:
        return from_pages(pages)
    counts = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"))
    good = outline_verdicts(outline, counts).where("usable").select("doc_id")
    by_outline = from_outline(outline.join(good, "doc_id", "left_semi"), pages.join(good, "doc_id", "left_semi"))
    return by_outline.unionByName(from_pages(pages.join(good, "doc_id", "left_anti")))


def page_verdicts(pages: DataFrame) -> DataFrame:
    """doc_id, pages, blank, text_layer of (doc_id, chars), NULL chars for a document without pages."""
    t = pages.groupBy("doc_id").agg(F.count("chars").alias("pages"), F.count_if(F.col("chars") < 100).alias("blank"))
    share = F.col("blank") / F.col("pages")
    layer = F.when(F.col("pages") == 0, "unreadable").when(share >= 0.80, "image_only").when(share >= 0.20, "mixed").otherwise("digital_native")
    return t.withColumn("text_layer", layer)


def is_indexable(layer: Column | str) -> Column:
    return (F.col(layer) if isinstance(layer, str) else layer).isin("digital_native", "mixed")
