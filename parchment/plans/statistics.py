"""Queries over statistics, sampling, percentiles and incremental loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.functions.identifiers import extract
from parchment.operators import sampling, stats
from parchment.operators.citations import METHODS  # noqa: F401
from parchment.plans.literals import literal, values
from parchment.plans.registry import query, table
from parchment.sources import files
from parchment.streaming import events as stream


def _manifest(spark, sf):
    d = table(spark, sf, "documents")
    m = d.select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, F.md5("text")).alias("sha256"))
    layer = F.when(F.length("text") < 100, "image_only").when(F.length("text") < 400, "mixed").otherwise("digital_native")
    f = d.join(table(spark, sf, "labels"), "doc_id").select("doc_id", (F.col("quality") == 1).alias("ok"), layer.alias("text_layer"), F.length("text").cast("bigint").alias("text_chars"))
    return m, f


@query(
    """WITH m AS (SELECT d.doc_id, source, CASE WHEN d.doc_id % 3 = 0 THEN 1 END AS pin, l.doc_id AS f, coalesce(quality = 1, false) AS ok, length(text) AS n FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT source, count(*) AS in_manifest, count(*) FILTER (f IS NOT NULL AND ok) AS ok, count(*) FILTER (f IS NOT NULL AND NOT ok) AS failed, count(*) FILTER (f IS NULL) AS missing, count(*) FILTER (ok AND n >= 100) AS indexable,
 count(pin) AS pinned, CAST(coalesce(sum(n) FILTER (ok AND n >= 100), 0) AS BIGINT) AS chars, CAST(coalesce(sum(n) FILTER (ok AND n >= 100), 0) // 4 AS BIGINT) AS tokens FROM m GROUP BY source"""
)
def manifest_stats(spark, sf):
    return stats.manifest_stats(*_manifest(spark, sf))


def _corpus(spark, sf):
    """A manifest and a fetch log made from documents and labels."""
    d = table(spark, sf, "documents")
    m = d.select(
        "doc_id", "source", F.when(F.col("doc_id") % 4 > 0, F.col("lang")).alias("status"), F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("c"), F.col("doc_id") % 7)).alias("center"),
        F.when(F.col("doc_id") % 6 > 0, F.date_add(F.lit("1990-01-01").cast("date"), (F.col("doc_id") % 12000).cast("int"))).alias("issue_date"), F.when(F.col("doc_id") % 3 == 0, F.md5("text")).alias("sha256"),
    )
    _, f = _manifest(spark, sf)
    return m, f.select("*", (F.col("doc_id") % 9).alias("pages"), (F.col("doc_id") % 3).alias("image_only_pages"), (F.col("doc_id") % 11).alias("table_like_lines"))


@query(
    """WITH m AS (SELECT d.doc_id, source, CASE WHEN d.doc_id % 4 > 0 THEN lang END AS status, CASE WHEN d.doc_id % 5 > 0 THEN 'c' || (d.doc_id % 7) END AS center,
 CASE WHEN d.doc_id % 6 > 0 THEN DATE '1990-01-01' + CAST(d.doc_id % 12000 AS INTEGER) END AS dt, d.doc_id % 3 = 0 AS pin, l.doc_id IS NOT NULL AS f, coalesce(quality = 1, false) AS ok, length(text) AS n,
 CASE WHEN length(text) < 100 THEN 'image_only' WHEN length(text) < 400 THEN 'mixed' ELSE 'digital_native' END AS layer, d.doc_id % 9 AS p, d.doc_id % 3 AS b, d.doc_id % 11 AS t FROM documents d LEFT JOIN labels l USING (doc_id)),
x AS (SELECT *, ok AND n >= 100 AS i, ok AND n >= 100 AND b > 0 AS k FROM m)
SELECT 'count' AS what, 'in_manifest' AS name, count(*) AS n FROM x UNION ALL SELECT 'count', 'ok', count(*) FILTER (ok) FROM x UNION ALL SELECT 'count', 'failed', count(*) FILTER (f AND NOT ok) FROM x
UNION ALL SELECT 'count', 'missing', count(*) FILTER (NOT f) FROM x UNION ALL SELECT 'count', 'indexable', count(*) FILTER (i) FROM x UNION ALL SELECT 'count', 'pinned', count(*) FILTER (pin) FROM x
UNION ALL SELECT 'scans', 'with_blank_pages', count(*) FILTER (k) FROM x UNION ALL SELECT 'scans', 'mixed', count(*) FILTER (k AND layer = 'mixed') FROM x UNION ALL SELECT 'scans', 'digital_native', count(*) FILTER (k AND layer = 'digital_native') FROM x
UNION ALL SELECT 'slices', 'with_table_like_lines', count(*) FILTER (i AND t > 0) FROM x UNION ALL SELECT 'slices', 'undated', count(*) FILTER (i AND dt IS NULL) FROM x
UNION ALL SELECT 'quality', 'undated', count(*) FILTER (dt IS NULL) FROM x UNION ALL SELECT 'quality', 'unpinned', count(*) FILTER (NOT pin) FROM x UNION ALL SELECT 'quality', 'unreadable', 0
UNION ALL SELECT 'quality', 'negligible_text', count(*) FILTER (ok AND p > 0 AND n / p < 100) FROM x UNION ALL SELECT 'sum', 'chars', CAST(coalesce(sum(n) FILTER (i), 0) AS BIGINT) FROM x
UNION ALL SELECT 'source', source, count(*) FROM x GROUP BY source UNION ALL SELECT 'status', coalesce(status, 'n/a'), count(*) FROM x GROUP BY 2
UNION ALL SELECT 'era', CASE WHEN dt IS NULL THEN 'undated' ELSE (year(dt) // 10 * 10) || 's' END, count(*) FROM x GROUP BY 2 UNION ALL SELECT 'layer', layer, count(*) FROM x WHERE ok GROUP BY 2
UNION ALL SELECT 'center', coalesce(center, 'unknown'), count(*) FROM x WHERE i GROUP BY 2"""
)
def corpus_facts(spark, sf):
    return stats.corpus_facts(*_corpus(spark, sf))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def longest_documents(spark, sf):
    return stats.most(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN md5(text) END, CASE WHEN doc_id % 2 = 0 THEN 'old' END) AS sha256 FROM documents")
def carry_forward(spark, sf):
    m, _ = _manifest(spark, sf)
    old = m.where("doc_id % 2 = 0").select("doc_id", F.lit("old").alias("sha256"))
    return stats.carried(m, old).select("doc_id", "sha256")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_yet_fetched(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id, md5(text) AS sha256 FROM documents WHERE doc_id % 2 = 1 OR doc_id % 10 = 0")
def incremental_diff(spark, sf):
    now = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("sha256"))
    done = now.where("doc_id % 2 = 0").withColumn("sha256", F.when(F.col("doc_id") % 10 == 0, "stale").otherwise(F.col("sha256")))
    return files.to_process(now, done)


@query(
    """WITH r AS (SELECT md5(text) AS key, count(*) AS n, bool_or(doc_id % 4 = 0) AS hit FROM documents GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS requested, CAST(coalesce(sum(n) FILTER (hit), 0) AS BIGINT) AS hits,
 count(*) FILTER (NOT hit) AS misses, CAST(coalesce(sum(n - 1) FILTER (NOT hit), 0) AS BIGINT) AS deduped FROM r"""
)
def vector_cache_counts(spark, sf):
    r = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("key"))
    return files.cache_counts(r, r.where("doc_id % 4 = 0").select("key").distinct())


@query(
    """WITH o AS (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn FROM events)
SELECT event_type, count(*) AS n, round(median(value), 6) AS p50, max(value) FILTER (rn = least(n, n * 95 // 100 + 1)) AS p95, min(value) AS least, max(value) AS most FROM o GROUP BY event_type"""
)
def latency_percentiles(spark, sf):
    return stats.latency(table(spark, sf, "events"), "event_type", "value").withColumn("p50", F.round("p50", 6))


@query(
    """WITH k AS (SELECT event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 1024),
o AS (SELECT event_type, value, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn FROM k)
SELECT event_type, count(*) AS n, round(median(value), 6) AS p50, max(value) FILTER (rn = least(n, n * 95 // 100 + 1)) AS p95, min(value) AS least, max(value) AS most FROM o GROUP BY event_type"""
)
def ring_percentiles(spark, sf):
    k = stats.ring(table(spark, sf, "events"), "event_type", ["ts", "event_id"])
    return stats.latency(k, "event_type", "value").withColumn("p50", F.round("p50", 6))


@query(
    """WITH o AS (SELECT lang, n_chars AS v, count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (PARTITION BY lang ORDER BY n_chars) AS rn FROM documents)
SELECT lang, count(*) AS n, min(v) AS least, median(v) AS median, max(v) FILTER (rn = greatest(1, (n * 9 + 9) // 10)) AS p90, max(v) AS most, CAST(sum(v) AS BIGINT) AS total FROM o GROUP BY lang"""
)
def size_distribution(spark, sf):
    return stats.distribution(table(spark, sf, "documents"), "lang", "n_chars")


@query()
def extraction_stats(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("s"), (F.col("doc_id") % 2).cast("string")).alias("source"))
    return stats.extraction_stats(extract(literal(spark, "identifier_text")), d)


O = values("outcomes")  # noqa: E741


@query(f"SELECT slice, count(*) AS n, count(*) FILTER (refused) AS refused, avg(CAST(refused AS DOUBLE)) AS rate FROM {O} WHERE error IS NULL GROUP BY slice")
def refusal_breakdown(spark, sf):
    return stats.refusals(literal(spark, "outcomes"))


@query(
    f"""SELECT count(*) AS answerable, count(*) FILTER (refused) AS refused, count(*) FILTER (slice <> 'exact_identifier') AS fair, count(*) FILTER (refused AND slice <> 'exact_identifier') AS fair_refused,
 count(*) FILTER (refused) / count(*) AS rate, count(*) FILTER (refused AND slice <> 'exact_identifier') / count(*) FILTER (slice <> 'exact_identifier') AS fair_rate FROM {O} WHERE error IS NULL AND slice <> 'unanswerable'"""
)
def answerable_refusal(spark, sf):
    return stats.answerable_refusal(literal(spark, "outcomes"))


@query(f"SELECT count(*) AS calls, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round((sum(tokens_in) * 0.5 + sum(tokens_out) * 2.0) / 1e6, 9) AS cost FROM {O}")
def token_totals(spark, sf):
    return stats.token_totals(literal(spark, "outcomes"), 0.5, 2.0).withColumn("cost", F.round("cost", 9))


@query("SELECT count(*) AS chunks, count(*) FILTER (n > 512) AS truncated, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(greatest(n - 512, 0)) AS BIGINT) AS dropped, round(100 * count(*) FILTER (n > 512) / count(*), 6) AS pct_truncated, round(100 * sum(greatest(n - 512, 0)) / sum(n), 6) AS pct_dropped FROM (SELECT length(text) // 4 AS n FROM documents)")
def truncation(spark, sf):
    t = stats.truncation(table(spark, sf, "documents").select(F.floor(F.length("text") / 4).alias("n_tokens")), 512)
    return t.withColumns({c: F.round(c, 6) for c in ("pct_truncated", "pct_dropped")})


@query(f"SELECT ef, round(median(recall), 9) AS recall, min(recall) AS least, max(recall) AS most, max(p95) AS worst_p95, array_to_string(list(CAST(round(recall * 1000) AS BIGINT) ORDER BY build), ',') AS recalls FROM {values('builds')} GROUP BY ef")
def ann_builds(spark, sf):
    b = stats.aggregate_builds(literal(spark, "builds"))
    return b.withColumns({"recall": F.round("recall", 9), "recalls": F.array_join(F.transform("recalls", lambda x: F.round(x * 1000).cast("bigint").cast("string")), ",")})


@query(f"SELECT CASE d WHEN 0 THEN 'all_exact' WHEN 1 THEN 'any_normalized' ELSE 'any_failed' END AS kind, count(*) AS answers, median(ms) AS ms FROM (SELECT answer_id, max(CASE method WHEN 'exact' THEN 0 WHEN 'normalized' THEN 1 ELSE 2 END) AS d, max(ms) AS ms FROM {values('timed')} GROUP BY 1) GROUP BY 1")
def verify_cost(spark, sf):
    return stats.verify_cost(literal(spark, "timed"))


@query(f"SELECT chunking, max(recall) FILTER (retriever = 'sparse') AS sparse, max(recall) FILTER (retriever = 'dense') AS dense, max(recall) FILTER (retriever = 'fused') AS fused, max(recall) FILTER (retriever = 'sparse') / nullif(max(recall) FILTER (retriever = 'dense'), 0) AS ratio FROM {values('runs')} GROUP BY 1")
def identifier_collapse(spark, sf):
    return stats.identifier_collapse(literal(spark, "runs"))


@query(
    f"""WITH v AS (SELECT *, split_part(pair_id, '::', 1) AS doc_id FROM {values("verdicts")}), w AS (SELECT doc_id, count(*) AS n FROM v WHERE verdict = 'reject' GROUP BY 1 ORDER BY n DESC, doc_id LIMIT 1)
SELECT (SELECT count(*) FROM v) AS n_judged, (SELECT count(*) FROM v WHERE verdict = 'reject') AS n_rejected, w.doc_id AS worst_doc, w.n AS worst_n,
 EXISTS (SELECT 1 FROM {values("chunks")} c WHERE CAST(c.doc_id AS VARCHAR) = w.doc_id AND contains(lower(regexp_replace(c.text, '[\\s\\-]+', ' ', 'g')), 'contains nonbinding recommendations')) AS nonbinding FROM w"""
)
def obligation_errors(spark, sf):
    c = literal(spark, "chunks").withColumn("doc_id", F.col("doc_id").cast("string"))
    return stats.obligation_errors(literal(spark, "verdicts"), c)


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) WHERE n <= 7")
def first_per_slice(spark, sf):
    return sampling.first_per_slice(table(spark, sf, "documents").select("doc_id", "lang"), 7, "lang", "doc_id")


@query(
    """WITH d AS (SELECT doc_id, lang || '|' || source AS s FROM documents), r AS (SELECT doc_id, s, row_number() OVER (PARTITION BY s ORDER BY md5('20260813:' || doc_id), doc_id) - 1 AS depth FROM d),
o AS (SELECT s, row_number() OVER (ORDER BY md5('20260813:' || s), s) - 1 AS ord, count(*) OVER () AS n FROM (SELECT DISTINCT s FROM d)),
t AS (SELECT doc_id, s, depth, ((ord - depth) % n + n) % n AS turn FROM r JOIN o USING (s)) SELECT doc_id, s AS stratum FROM t ORDER BY depth, turn LIMIT 100"""
)
def stratified_sample(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws("|", "lang", "source").alias("stratum"))
    return sampling.rotating(d, "stratum", 100)


@query()
def guidance_sample(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("Guidance "), (F.col("doc_id") % 40).cast("string")).alias("title"), F.when(F.col("doc_id") % 2 == 0, "Draft").otherwise("Final").alias("status"),
        F.col("source").alias("center"), F.make_date(F.lit(1995) + F.col("doc_id").cast("int") % 30, F.lit(1), F.lit(1)).alias("issue_date"),
    )
    return sampling.sample_guidance(d, 60)


@query()
def protocol_sample(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("declared_bytes"), F.col("lang").alias("sponsor_class"))
    return sampling.sample_protocols(d, 40)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    w = stream.windowed_counts(table(spark, sf, "events"))
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM s GROUP BY user_id, s"""
)
def event_sessions(spark, sf):
    s = stream.sessions(table(spark, sf, "events"))
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")
