"""Queries over text functions, identifiers, sections and quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.functions import identifiers as ids
from parchment.functions import text as t
from parchment.operators import citations, dedup, sections, stats
from parchment.plans.literals import literal, values
from parchment.plans.registry import query, table

TOK = r"[\p{L}\p{N}_]{2,}"
STOP = "[" + ", ".join(f"'{w}'" for w in t.STOP_WORDS) + "]"


def sql_tokens(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '{TOK}'), lambda w: NOT list_contains({STOP}, w))"


@query(rf"SELECT sha256(lower(trim(regexp_replace(text, '{t.WHITE}+', ' ', 'g')))) AS hash, count(*) AS size, min(doc_id) AS canonical_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_groups(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return dedup.exact_groups(d).where("size > 1")


@query(f"SELECT doc_id, CAST(len({sql_tokens('text')}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({sql_tokens('text')})) AS BIGINT) AS n_terms FROM documents")
def token_stats(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", t.tokens("text").alias("w"))
    return d.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("w")).cast("bigint").alias("n_terms"))


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
SHINGLES = "CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) END"


@query(f"WITH a AS (SELECT doc_id, {WORDS} AS w FROM documents) SELECT doc_id, CAST(len({SHINGLES}) AS BIGINT) AS n_shingles, md5(array_to_string(list_sort({SHINGLES}), '|')) AS digest FROM a")
def shingle_sets(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", t.shingles("text").alias("s"))
    return d.select("doc_id", F.size("s").cast("bigint").alias("n_shingles"), F.md5(F.array_join(F.array_sort("s"), "|")).alias("digest"))


QUALITY = rf"""
WITH q AS (SELECT doc_id, stored, text, list_filter(string_split(trim(regexp_replace(text, '{t.WHITE}+', ' ', 'g')), ' '), lambda x: x <> '') AS t FROM {{src}}),
s AS (SELECT doc_id, stored,
 CASE WHEN length(text) < 500 THEN 0 ELSE length(regexp_replace(text, '[^\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]', '', 'g')) / length(text) END AS control_share,
 CASE WHEN len(t) < 200 THEN 0 ELSE len(list_filter(t, lambda x: length(x) = 1)) / len(t) END AS single_share,
 CASE WHEN len(t) < 200 THEN 0 ELSE len(list_filter(t, lambda x: regexp_full_match(x, '\p{{L}}{{25,}}'))) / len(t) END AS run_on_share FROM q),
l AS (SELECT *, CASE WHEN control_share >= 0.005 THEN 'broken_encoding' WHEN single_share >= 0.4 THEN 'character_spaced' WHEN run_on_share >= 0.002 THEN 'space_collapsed' ELSE 'ok' END AS label FROM s)
"""


def _quality(d):
    shares = {"control_share": t.control_share("text"), "single_share": t.single_char_share("text"), "run_on_share": t.run_on_share("text")}
    s = d.select("doc_id", *(v.alias(k) for k, v in shares.items()))
    return s.select("doc_id", *(F.round(k, 6).alias(k) for k in shares), t.label_of(*shares).alias("label"))


QUALITY_OUT = "SELECT doc_id, round(control_share, 6) AS control_share, round(single_share, 6) AS single_share, round(run_on_share, 6) AS run_on_share, label FROM l"


@query(QUALITY.replace("{src}", "(SELECT doc_id, NULL AS stored, text FROM documents)") + QUALITY_OUT)
def text_quality(spark, sf):
    return _quality(table(spark, sf, "documents"))


@query(QUALITY.replace("{src}", values("quality")) + QUALITY_OUT)
def text_quality_defects(spark, sf):
    return _quality(literal(spark, "quality"))


@query(QUALITY.replace("{src}", values("quality")) + "SELECT doc_id FROM l WHERE coalesce(stored IN ('character_spaced', 'broken_encoding'), false) OR label IN ('character_spaced', 'broken_encoding')")
def quarantine_filter(spark, sf):
    return literal(spark, "quality").where(t.quarantined("stored", "text")).select("doc_id")


@query(
    f"""WITH c AS (SELECT doc_id, count(chars) AS pages, count(*) FILTER (chars < 100) AS blank FROM {values("page_chars")} GROUP BY doc_id),
v AS (SELECT *, CASE WHEN pages = 0 THEN 'unreadable' WHEN blank / pages >= 0.8 THEN 'image_only' WHEN blank / pages >= 0.2 THEN 'mixed' ELSE 'digital_native' END AS text_layer FROM c)
SELECT *, text_layer IN ('digital_native', 'mixed') AS indexable FROM v"""
)
def page_verdicts(spark, sf):
    return sections.page_verdicts(literal(spark, "page_chars")).withColumn("indexable", sections.is_indexable("text_layer"))


@query()
def identifier_extract(spark, sf):
    return ids.extract(literal(spark, "identifier_text"))


@query(
    f"""WITH m AS (SELECT id, regexp_extract_all(text, '\\bNCT[ \\t\\r\\n]*[0-9]{{8}}\\b') AS r, regexp_extract_all(text, '(?i)\\bICH[ ]*[EQSM][0-9]{{1,2}}[A-Z]?') AS i,
 regexp_extract_all(text, '\\b[0-9]{{2,3}}[ ]*F\\.?[ ]*R\\.?[ ]*[0-9]{{3,6}}\\b') AS f FROM {values("identifier_text")}),
k AS (SELECT 'registry' AS kind, unnest(list_transform(r, lambda x: regexp_replace(x, '\\s', '', 'g'))) AS v FROM m
 UNION ALL SELECT 'ich', unnest(list_transform(i, lambda x: upper(x))) FROM m UNION ALL SELECT 'fed_register', unnest(f) FROM m)
SELECT kind, count(*) AS occurrences, count(DISTINCT v) AS distinct_sections, count(DISTINCT v) AS distinct_detailed FROM k GROUP BY kind"""
)
def identifier_density(spark, sf):
    return ids.density(ids.extract(literal(spark, "identifier_text"))).where(F.col("kind").isin("registry", "ich", "fed_register"))


@query()
def identifier_counts(spark, sf):
    return ids.density(ids.extract(literal(spark, "identifier_text")))


@query()
def identifier_atoms(spark, sf):
    text = literal(spark, "identifier_text")
    a = ids.atoms(ids.extract(text))
    return text.join(a, "id", "left").select("id", "atoms", ids.augmented(F.col("text"), F.col("atoms")).alias("augmented"))


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


@query(
    f"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '{EMAIL}') AS m, string_split_regex(text, '{EMAIL}') AS g FROM documents),
e AS (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM p WHERE len(m) > 0)
SELECT doc_id, m[i] AS raw, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start FROM e"""
)
def pattern_offsets(spark, sf):
    d = table(spark, sf, "documents").where(F.contains("text", F.lit("@")))
    return d.select("doc_id", F.explode(t.offsets("text", EMAIL)).alias("m")).select("doc_id", "m.raw", F.col("m.start").cast("bigint").alias("start"))


NUMBERS = ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])') THEN '{d}' END" for w, d in t.NUMBER_WORDS.items())


@query(
    rf"""WITH x AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '[0-9][0-9,.]*'), lambda d: regexp_replace(regexp_replace(d, ',', '', 'g'), '\.+$', '')) AS d, [{NUMBERS}] AS w,
 CASE WHEN regexp_matches(lower(text), '(^|[^\p{{L}}\p{{N}}_])((a|an|each|every|per)\s+(year|month|week|day|hour|decade)s?|annually)($|[^\p{{L}}\p{{N}}_])') THEN ['1'] ELSE [] END AS u
 FROM (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT -id, 0, text FROM (VALUES (1, 'kept for a year, 5,630 of them. Sixty days.'), (2, 'ten or 3.5. Never')) AS v(id, text)))
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(d || list_filter(w, lambda y: y IS NOT NULL) || u, lambda y: y <> ''))), '|') AS claims FROM x"""
)
def numeric_claims(spark, sf):
    d = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    more = spark.createDataFrame([(-1, 0, "kept for a year, 5,630 of them. Sixty days."), (-2, 0, "ten or 3.5. Never")], "conv_id bigint, turn bigint, text string")
    return d.unionByName(more).select("conv_id", "turn", F.array_join(t.numeric_claims("text"), "|").alias("claims"))


@query(
    r"""WITH l AS (SELECT doc_id, page, text, CAST(len(list_filter(string_split_regex(text, '\r?\n'), lambda x: regexp_matches(x, '\.{3,}\s*[0-9]+\s*$'))) >= 4 AS BOOLEAN) AS contents FROM """
    + values("pages")
    + ") SELECT doc_id, page, contents FROM l"
)
def contents_pages(spark, sf):
    return literal(spark, "pages").select("doc_id", "page", sections.is_contents("text").alias("contents"))


@query(
    f"""SELECT doc_id, page, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS stop FROM (SELECT doc_id, page, length(text) AS n,
 coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM {values("pages")})"""
)
def page_offsets(spark, sf):
    return sections.page_offsets(literal(spark, "pages")).select("doc_id", "page", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"))


@query()
def heading_sections(spark, sf):
    return sections.from_pages(literal(spark, "pages"))


@query(
    """WITH p AS (SELECT page_id, regexp_extract_all(html, '<h1[^>]*>(.*?)</h1>', 1) AS h, len(regexp_extract_all(html, '<p[ >]')) AS n_p FROM pages)
SELECT page_id, list_aggregate(list_transform(h, lambda x: trim(replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'))), 'min') AS title, CAST(n_p AS BIGINT) AS paragraphs FROM p"""
)
def html_fields(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", t.strip_tags(F.element_at(t.all_matches("html", r"<h1[^>]*>(.*?)</h1>", 1), 1)).alias("title"), F.size(t.all_matches("html", r"<p[ >]")).cast("bigint").alias("paragraphs"))


@query()
def catalogue_fields(spark, sf):
    c = literal(spark, "catalogue")
    href, title = t.first_link("title")
    media, _ = t.first_link("media")
    c = c.withColumn("media_href", media).where("media_href IS NOT NULL")
    return c.select(
        "id", title.alias("title"), t.absolute(href, "https://h.example").alias("landing"), F.regexp_extract("media_href", "/media/([0-9]+)/", 1).alias("media_id"),
        t.us_date("issued").alias("issued"), t.era(t.us_date("issued")).alias("era"), t.decade(t.us_date("issued")).alias("decade"), t.offices("office").alias("offices"), t.normal_title(title).alias("title_key"),
    )


@query(
    f"""WITH c AS (SELECT doc_id, sum(n) AS entries, sum(good) AS good, max(n) AS top FROM (SELECT doc_id, page, count(*) AS n,
 count(*) FILTER (length(regexp_replace(title, '[^\\p{{L}}\\p{{N}}_]', '', 'g')) >= 4) AS good FROM {values("outline")} GROUP BY doc_id, page) GROUP BY doc_id),
r AS (SELECT c.doc_id, CAST(entries AS BIGINT) AS entries, CASE WHEN entries < 2 THEN 'fewer than 2 entries' WHEN n_pages > 0 AND entries / n_pages > 8 THEN 'too many entries per page'
 WHEN good / entries < 0.6 THEN 'too few substantive titles' WHEN top / entries > 0.5 THEN 'entries resolve to one page' ELSE 'ok' END AS reason FROM c JOIN {values("outline_pages")} p USING (doc_id))
SELECT doc_id, entries, reason = 'ok' AS usable, reason FROM r"""
)
def outline_verdicts(spark, sf):
    return sections.outline_verdicts(literal(spark, "outline"), literal(spark, "outline_pages"))


@query(
    rf"""WITH c AS (SELECT chunk_id, length(regexp_replace(text, '[^0-9]', '', 'g')) AS b FROM {values("chunks")})
SELECT chunk_id, CAST(b AS BIGINT) AS digits FROM c"""
)
def chunk_digits(spark, sf):
    return literal(spark, "chunks").select("chunk_id", F.length(F.regexp_replace("text", "[^0-9]", "")).cast("bigint").alias("digits"))


@query()
def line_number_exposure(spark, sf):
    return citations.line_number_exposure(literal(spark, "chunks"))


@query("SELECT doc_id, lang, source, n_chars, CAST(length(text) AS BIGINT) AS chars, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM documents")
def document_summary(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", "lang", "source", "n_chars", F.length("text").cast("bigint").alias("chars"), F.size(F.split("text", "\n", -1)).cast("bigint").alias("n_lines"))


@query()
def embedding_input(spark, sf):
    return literal(spark, "pages").select("doc_id", "page", t.for_embedding("text").alias("text"))


@query(
    """WITH d AS (SELECT doc_id, len(string_split(text, chr(10))) AS s, length(text) AS n FROM documents)
SELECT doc_id, CASE WHEN s = 0 THEN 'no sections' WHEN s * 1000 > 2 * n THEN 'over 2 sections per 1000 characters' ELSE 'under 100 characters per page' END AS problem FROM d WHERE s = 0 OR s * 1000 > 2 * n OR n < 300"""
)
def extraction_outliers(spark, sf):
    d = table(spark, sf, "documents")
    return stats.extraction_outliers(d.select("doc_id", F.size(F.split("text", "\n")).alias("n_sections"), F.length("text").alias("n_chars"), F.lit(3).alias("n_pages")))
