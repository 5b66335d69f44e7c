"""Queries over answers: citations, reference pairs, triage, judging, generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.functions import text as t
from parchment.operators import answers, citations, contextual, curate, golden, judge, needles, providers, retrieval
from parchment.plans.corpus import CHUNKS, chunks, questions
from parchment.plans.literals import literal, values
from parchment.plans.registry import query, table

C, Q = values("chunks"), values("claims")
WS = t.WHITE + "+"


def flat(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}', ' ', 'g'))"


def bare(c: str) -> str:
    # without look-behind the three kinds of numbers beside line ends are cut one after the other, each from a text with marked line ends
    one = rf"regexp_replace({c}, '(?m)^[ \t]*[0-9]+[ \t]*$', ' ', 'g')"
    two = rf"regexp_replace({one}, '(\s)[0-9]+[ \t]*(\n)', '\1 \2', 'g')"
    three = rf"regexp_replace({two}, '(\n)[ \t]*[0-9]+(\s)', '\1 \2', 'g')"
    return flat(three)


VERIFY = f"""t AS (SELECT q.claim_id, q.answer_id, q.chunk_id, trim(q.quote) AS quote, c.doc_id FROM {Q} q LEFT JOIN {C} c ON c.chunk_id = q.chunk_id),
m AS (SELECT t.claim_id, s.chunk_id AS tried, s.chunk_id = t.chunk_id AS own, s.pos, CASE WHEN strpos(s.text, t.quote) > 0 THEN 'exact' WHEN strpos({flat("s.text")}, {flat("t.quote")}) > 0 THEN 'normalized'
 WHEN strpos({bare("s.text")}, {bare("t.quote")}) > 0 THEN 'line_number_ambiguous' END AS method, CASE WHEN strpos(s.text, t.quote) > 0 THEN strpos(s.text, t.quote) - 1 END AS start
 FROM t JOIN {C} s ON s.doc_id = t.doc_id WHERE length(t.quote) >= 24),
b AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY own DESC, pos) AS n FROM m WHERE method IS NOT NULL),
v AS (SELECT t.claim_id, t.answer_id, t.chunk_id, CASE WHEN length(t.quote) < 24 THEN 'too_short' WHEN b.method IS NULL THEN 'unverified' WHEN own THEN b.method ELSE 'wrong_chunk' END AS method,
 CASE WHEN NOT own THEN tried END AS found_in FROM t LEFT JOIN (SELECT * FROM b WHERE n = 1) b USING (claim_id))"""


def _checks(spark):
    q = literal(spark, "claims")
    return citations.verify(q.select("claim_id", "chunk_id", "quote"), literal(spark, "chunks")).join(q.select("claim_id", "answer_id"), "claim_id")


@query(f"WITH {VERIFY} SELECT claim_id, chunk_id, method, found_in FROM v")
def citation_verify(spark, sf):
    return _checks(spark).select("claim_id", "chunk_id", "method", "found_in")


#: The words of a quote with any white space between them; in the last tier also with integers beside line ends.
SPACED = f"replace(regexp_escape({flat('t.quote')}), '\\ ', '{WS}')"
NUMBERED = f"replace(regexp_escape({bare('t.quote')}), '\\ ', '(?:{t.WHITE}|{t.WHITE}[0-9]+[ \t]*\n|\n[ \t]*[0-9]+{t.WHITE})+')"


@query(
    f"""WITH {VERIFY}, f AS (SELECT t.claim_id, b.method AS tier, s.text, t.quote, b.own, b.tried, CASE b.method WHEN 'exact' THEN t.quote WHEN 'normalized' THEN regexp_extract(s.text, {SPACED}) ELSE regexp_extract(s.text, {NUMBERED}) END AS matched
 FROM t JOIN b USING (claim_id) JOIN {C} s ON s.chunk_id = b.tried WHERE b.n = 1)
SELECT v.claim_id, v.method, CAST(strpos(f.text, f.matched) - 1 AS BIGINT) AS start, CAST(strpos(f.text, f.matched) - 1 + length(f.matched) AS BIGINT) AS stop, f.matched AS matched_text, v.found_in FROM v LEFT JOIN f USING (claim_id)"""
)
def citation_spans(spark, sf):
    c = _checks(spark)
    return c.select("claim_id", "method", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"), "matched_text", "found_in")


METHODS = ", ".join(f"('{m}')" for m in citations.METHODS)


@query(f"WITH {VERIFY} SELECT method, count(claim_id) AS n FROM (VALUES {METHODS}) AS k(method) LEFT JOIN v USING (method) GROUP BY method")
def citation_buckets(spark, sf):
    return citations.buckets(_checks(spark))


@query(
    f"""WITH {VERIFY} SELECT answer_id, count(method) AS claimed, count(*) FILTER (method IN ('exact', 'normalized')) AS verified, count(*) FILTER (method IN ('exact', 'normalized')) / nullif(count(method), 0) AS precision,
 count(method) > 0 AND count(*) FILTER (method IN ('exact', 'normalized')) = count(method) AS grounded FROM v GROUP BY answer_id"""
)
def citation_precision(spark, sf):
    return citations.precision(_checks(spark), "answer_id")


@query("SELECT item_id AS claim_id, doc_id, CAST(strpos(d.text, b.text) - 1 AS BIGINT) AS start, CAST(strpos(d.text, b.text) - 1 + length(b.text) AS BIGINT) AS stop FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def quotes_in_documents(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))
    d = table(spark, sf, "documents").select("doc_id", "text")
    at = needles.containing(b, d).select("needle_id", "doc_id").join(b, "needle_id").join(d, "doc_id")
    m, start, stop = citations.located("needle", "text")
    j = at.select(F.col("needle_id").alias("claim_id"), "doc_id", m.alias("m"), start.cast("bigint").alias("start"), stop.cast("bigint").alias("stop"))
    return j.where("m = 'exact'").drop("m")


@query(
    rf"""WITH d AS (SELECT doc_id, {flat("text")} AS hay FROM documents), q AS (SELECT item_id, {flat("text")} AS needle FROM benchmark)
SELECT item_id AS quote_id, count(DISTINCT doc_id) AS documents FROM q LEFT JOIN d ON length(needle) >= 24 AND contains(hay, needle) GROUP BY item_id"""
)
def evidence_spread(spark, sf):
    return citations.evidence_spread(table(spark, sf, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), table(spark, sf, "documents"))


def _golden(spark):
    g = literal(spark, "golden")
    return g.select("pair_id", "doc_id", "question", "answer", F.array(F.struct("chunk_id", "quote")).alias("evidence"))


def _validated(spark):
    g = literal(spark, "golden")
    checks = citations.verify(g.select(F.col("pair_id").alias("claim_id"), "chunk_id", "quote"), literal(spark, "chunks")).select(F.col("claim_id").alias("pair_id"), "method")
    docs = golden.document_index(literal(spark, "chunks"))
    return golden.validated(_golden(spark), checks, docs).join(g.select("pair_id", "doc_id", "answer", "quote"), "pair_id")


COVER = "[" + ", ".join(f"'{w}'" for w in t.COVERAGE_STOP_WORDS) + "]"


def content(c: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: regexp_matches(w, '[0-9]') OR (length(w) > 2 AND NOT list_contains({COVER}, w))))"


GOLDEN = f"""g AS (SELECT g.*, c.text AS source, strpos(c.text, g.quote) > 0 OR strpos({flat("c.text")}, {flat("g.quote")}) > 0 AS ok,
 (SELECT count(*) FROM (SELECT {flat("string_agg(text, ' ' ORDER BY pos)")} AS hay FROM {C} GROUP BY doc_id) h WHERE contains(hay, {flat("g.quote")})) AS spread,
 len(list_intersect({content("g.answer")}, {content("g.quote")})) / len({content("g.answer")}) AS cov FROM {values("golden")} g JOIN {C} c USING (chunk_id)),
r AS (SELECT pair_id, answer, CASE WHEN question = '' THEN 'empty question' WHEN answer = '' THEN 'empty answer' WHEN length(answer) < 40 THEN 'answer too short' WHEN lower(trim(question)) = lower(trim(answer)) THEN 'answer restates the question'
 WHEN NOT ok THEN 'no evidence verified' WHEN cov < 0.45 THEN 'answer outruns its evidence' WHEN spread > 2 THEN 'boilerplate evidence' END AS reason FROM g)"""


@query(f"WITH {GOLDEN} SELECT pair_id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason FROM r")
def golden_validate(spark, sf):
    return _validated(spark).select("pair_id", "status", "reason")


@query(f"WITH {GOLDEN} SELECT coalesce(split_part(reason, ' (', 1), 'accepted') AS reason, count(*) AS n FROM r GROUP BY 1")
def yield_report(spark, sf):
    return golden.yield_report(_validated(spark))


@query(
    f"""WITH RECURSIVE {GOLDEN}, p AS (SELECT pair_id, list_distinct(list_filter(string_split_regex(lower(answer), '\\s+'), lambda w: length(w) > 2)) AS w, row_number() OVER (ORDER BY pair_id) AS n FROM r WHERE reason IS NULL),
k(n, kept, dup, id) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) UNION ALL
 SELECT p.n, CASE WHEN x.d IS NULL THEN list_append(k.kept, p.n) ELSE k.kept END, x.d, p.pair_id FROM k JOIN p ON p.n = k.n + 1
 LEFT JOIN LATERAL (SELECT min(o.pair_id) AS d FROM p o WHERE list_contains(k.kept, o.n) AND len(list_intersect(o.w, p.w)) / len(list_distinct(o.w || p.w)) > 0.7) x ON true)
SELECT id AS pair_id, dup AS duplicate_of FROM k WHERE n > 0"""
)
def golden_redundant(spark, sf):
    return golden.redundant(_validated(spark))


@query(f"WITH {GOLDEN}, d AS (SELECT r.pair_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY r.pair_id) AS depth FROM r JOIN {values('golden')} USING (pair_id) WHERE reason IS NULL) SELECT pair_id FROM d ORDER BY depth, doc_id LIMIT 3")
def review_sample(spark, sf):
    return golden.review_sample(_validated(spark), 3).select("pair_id")


@query(
    f"""WITH g AS (SELECT pair_id, regexp_extract_all(answer, '[0-9][0-9,.]*') AS a, regexp_extract_all(text, '[0-9][0-9,.]*') AS s, regexp_matches(lower(text), '\\b(a|an|each|every|per)\\s+(year|month|week|day|hour|decade)s?\\b|\\bannually\\b') AS u FROM {values("golden")} JOIN {C} USING (chunk_id))
SELECT pair_id, array_to_string(list_sort(list_filter(list_transform(a, lambda x: regexp_replace(replace(x, ',', ''), '\\.+$', '')), lambda x: NOT list_contains(list_transform(s, lambda y: regexp_replace(replace(y, ',', ''), '\\.+$', '')), x) AND NOT (u AND x = '1'))), ',') AS missing FROM g"""
)
def unsupported_numbers(spark, sf):
    g = literal(spark, "golden").select("pair_id", "answer", "chunk_id").join(literal(spark, "chunks").select("chunk_id", "text"), "chunk_id")
    return g.select("pair_id", F.array_join(t.unsupported_numbers("answer", "text"), ",").alias("missing"))


def _flags(spark):
    g = _golden(spark)
    return curate.flags(g.join(curate.cited_source(g, literal(spark, "chunks")), "pair_id").select("pair_id", "answer", "source"))


@query()
def curate_flags(spark, sf):
    return _flags(spark)


@query()
def curate_summary(spark, sf):
    return curate.summary(_flags(spark), _golden(spark))


ACTOR = ", ".join(f"CASE WHEN regexp_matches(text, '(?i)\\b{a}\\b') THEN '{a}' END" for a in sorted(curate.ACTORS))


@query(f"SELECT chunk_id, array_to_string(list_filter([{ACTOR}], lambda x: x IS NOT NULL), ',') AS actors, CAST(len(regexp_extract_all(lower(text), '\\b(?:not|no|never|cannot|neither|nor|except|unless|without|prohibited)\\b')) AS BIGINT) AS negations FROM {C}")
def actors_and_negations(spark, sf):
    return literal(spark, "chunks").select("chunk_id", F.array_join(curate.actors("text"), ",").alias("actors"), curate.negations("text").cast("bigint").alias("negations"))


@query()
def relevant_sentences(spark, sf):
    g = literal(spark, "golden").join(literal(spark, "chunks").select("chunk_id", "text"), "chunk_id")
    return g.select("pair_id", curate.relevant_sentence("answer", "text").alias("sentence"), curate.excerpt(F.col("text"), F.lit("agency")).alias("excerpt"))


@query(
    f"""WITH {GOLDEN} SELECT r.pair_id, CASE WHEN v.verdict = 'reject' AND r.reason IS NULL THEN 'rejected' WHEN r.reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status,
 CASE WHEN v.verdict = 'reject' AND r.reason IS NULL THEN 'human: ' || coalesce(v.reason, '') ELSE r.reason END AS reason FROM r LEFT JOIN {values("verdicts")} v USING (pair_id)"""
)
def status_rewrite(spark, sf):
    return curate.with_verdicts(_validated(spark), literal(spark, "verdicts"))


@query(f"SELECT pair_id, verdict FROM {values('verdicts')} WHERE pair_id NOT IN (SELECT pair_id FROM {values('golden')})")
def orphan_verdicts(spark, sf):
    return curate.orphans(literal(spark, "verdicts"), _golden(spark)).select("pair_id", "verdict")


def _pool(spark, sf):
    """Question-answer pairs of the conversations: the document is the conversation, the quote the question."""
    c = table(spark, sf, "conversations").where("turn >= 0")
    a, u = c.where("role = 'assistant'").alias("a"), c.where("role = 'user'").alias("u")
    j = a.join(u, (F.col("a.conv_id") == F.col("u.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1))
    return j.select(F.format_string("%06d::%03d", "a.conv_id", "a.turn").alias("pair_id"), F.col("a.conv_id").alias("doc_id"), F.col("a.text").alias("answer"), F.col("u.text").alias("quote"))


@query()
def control_set(spark, sf):
    return judge.control_set(_pool(spark, sf), 20, 20).select("item_id", "control", "source_id")


@query(
    """WITH p AS (SELECT printf('%06d::%03d', a.conv_id, a.turn) AS pair_id, a.conv_id AS doc_id FROM conversations a JOIN conversations u ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE a.role = 'assistant' AND u.role = 'user'),
d AS (SELECT pair_id, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pair_id) AS depth FROM p) SELECT pair_id, row_number() OVER (ORDER BY depth, doc_id) - 1 AS turn FROM d"""
)
def round_robin(spark, sf):
    return judge.round_robin(_pool(spark, sf), "doc_id", "pair_id").select("pair_id", F.col("turn").cast("bigint").alias("turn"))


J = values("judged")


@query(f"SELECT item_id, (row_number() OVER (ORDER BY depth, k) - 1) // 8 AS batch FROM (SELECT item_id, k, row_number() OVER (PARTITION BY k ORDER BY item_id) AS depth FROM (SELECT item_id, CASE control WHEN 'positive' THEN 0 WHEN 'negative' THEN 1 ELSE 2 END AS k FROM {J}))")
def judge_batches(spark, sf):
    return judge.batches(literal(spark, "judged").select("item_id", "control")).select("item_id", F.col("batch").cast("bigint").alias("batch"))


@query(
    f"""WITH a AS (SELECT count(*) FILTER (control = 'positive' AND verdict IS NOT NULL) AS n_positive, count(*) FILTER (control = 'positive' AND verdict = 'supported') AS positive_supported,
 count(*) FILTER (control = 'negative' AND verdict IS NOT NULL) AS n_negative, count(*) FILTER (control = 'negative' AND verdict <> 'supported') AS negative_rejected, count(*) FILTER (verdict IS NULL) AS unjudged FROM {J} WHERE control IS NOT NULL)
SELECT *, positive_supported / nullif(n_positive, 0) AS positive_rate, negative_rejected / nullif(n_negative, 0) AS negative_rate, least(n_positive, n_negative) >= 4 AND (n_positive + n_negative) / (n_positive + n_negative + unjudged) >= 0.8
 AND negative_rejected / nullif(n_negative, 0) >= 0.8 AND positive_supported / nullif(n_positive, 0) >= 0.4 AS usable FROM a"""
)
def judge_agreement(spark, sf):
    j = literal(spark, "judged")
    return judge.agreement(j.select("item_id", "control"), j.where("verdict IS NOT NULL").select("item_id", "verdict"))


def _claims(spark):
    return _checks(spark).withColumnRenamed("claim_id", "pos").join(literal(spark, "claims").select(F.col("claim_id").alias("pos"), "quote"), "pos").withColumn("claim", F.col("quote"))


def _judgments(spark):
    return spark.createDataFrame([("1::0", "supported"), ("1::1", "partial"), ("2::1", "supported"), ("4::0", "unsupported")], "item_id string, verdict string")


JUDGED = f"""{VERIFY}, x AS (SELECT answer_id, method, answer_id || '::' || (row_number() OVER (PARTITION BY answer_id ORDER BY claim_id) - 1) AS item_id FROM v),
y AS (SELECT x.*, z.verdict, method IN ('exact', 'normalized') AS there FROM x LEFT JOIN (VALUES ('1::0', 'supported'), ('1::1', 'partial'), ('2::1', 'supported'), ('4::0', 'unsupported')) AS z(item_id, verdict) USING (item_id))"""


@query(
    f"""WITH {JUDGED}, a AS (SELECT count(*) AS claimed, count(*) FILTER (there) AS located, count(*) FILTER (there AND verdict = 'supported') AS supported, count(*) FILTER (there AND verdict = 'partial') AS partial,
 count(*) FILTER (there AND verdict = 'unsupported') AS unsupported, count(*) FILTER (there AND verdict IS NULL) AS unjudged FROM y) SELECT *, supported / nullif(located, 0) AS of_located, supported / nullif(claimed, 0) AS of_claimed FROM a"""
)
def faithfulness(spark, sf):
    return judge.faithfulness(_claims(spark), _judgments(spark))


@query(f"WITH {JUDGED} SELECT answer_id, bool_and(there AND coalesce(verdict = 'supported', false)) AS fully_supported FROM y GROUP BY answer_id")
def answer_faithfulness(spark, sf):
    return judge.answer_faithfulness(_claims(spark), _judgments(spark))


@query(f"WITH {JUDGED} SELECT item_id FROM y WHERE there AND (SELECT 5 >= 4)")
def gated_judge_items(spark, sf):
    j = literal(spark, "judged")
    a = judge.agreement(j.select("item_id", "control"), j.where("verdict IS NOT NULL").select("item_id", "verdict"))
    return judge.gated(judge.citation_items(_claims(spark)), a).select("item_id")


def _answers(spark, sf):
    c, q = chunks(spark, sf), questions(spark, sf)
    hits = retrieval.LexicalIndex(c).search(q, 5)
    p = answers.gated(answers.prompts(q, answers.context(hits, c)), 8.0)
    return answers.answered(p, providers.QuotingGenerator()), hits, c


@query()
def grounded_answers(spark, sf):
    a, _, _ = _answers(spark, sf)
    return a.select("query_id", F.round("top_score", 6).alias("top_score"), "answer", "refusal_source", "refused", "error")


@query()
def answer_citations(spark, sf):
    a, hits, c = _answers(spark, sf)
    return answers.checked(a, hits, c).select("answer_id", "chunk_id", "method", "start", "stop")


@query()
def diff_tokens(spark, sf):
    g = literal(spark, "claims").select(F.col("claim_id").alias("id"), "chunk_id", "quote").join(literal(spark, "chunks").select("chunk_id", F.col("text").alias("source")), "chunk_id")
    return golden.diff(g).select("id", F.array_join(F.transform("ops", lambda o: F.concat(o["op"], F.lit(":"), o["token"])), "|").alias("ops"), "clean")


@query(
    f"""WITH c AS (SELECT doc_id, chunk_id, text, (row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1) // 4 AS part FROM {CHUNKS})
SELECT doc_id || '::' || lpad(CAST(part AS VARCHAR), 4, '0') AS custom_id, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS excerpt_chars FROM c GROUP BY doc_id, part"""
)
def request_groups(spark, sf):
    r = contextual.requests(chunks(spark, sf).withColumnRenamed("idx", "pos"), table(spark, sf, "documents"), 4)
    return r.select("custom_id", "n_chunks", "excerpt_chars")


@query(
    f"""WITH c AS (SELECT doc_id, chunk_id, text, (row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1) // 4 AS part FROM {CHUNKS}),
r AS (SELECT doc_id, part, count(*) AS n, sum(length(text)) AS ex, any_value(dl) / 4 AS dt FROM c JOIN (SELECT doc_id, length(text) AS dl FROM documents) USING (doc_id) GROUP BY doc_id, part),
e AS (SELECT *, 25 + dt >= 512 AS can FROM r)
SELECT count(*) AS requests, CAST(sum(n) AS BIGINT) AS blurbs, count(*) FILTER (can) AS cacheable, round(sum(CASE WHEN NOT can THEN dt WHEN part = 0 THEN dt * 1.25 ELSE dt * 0.1 END + ex / 4), 3) AS input_tokens, CAST(sum(n) * 80 AS BIGINT) AS output_tokens FROM e"""
)
def context_cost(spark, sf):
    r = contextual.requests(chunks(spark, sf).withColumnRenamed("idx", "pos"), table(spark, sf, "documents"), 4)
    c = contextual.estimated_cost(r, 1.0, 5.0, 512, 100)
    return c.select("requests", "blurbs", "cacheable", F.round("input_tokens", 3).alias("input_tokens"), "output_tokens")


@query(
    f"""WITH c AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS rn FROM {CHUNKS}),
s AS (SELECT *, CASE WHEN total <= 4000 THEN 1 ELSE greatest(2, CAST(ceil(total / 4000) AS BIGINT)) END AS stride FROM c),
k AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY idx) AS running FROM s WHERE rn % stride = 0) SELECT chunk_id FROM k WHERE total <= 4000 OR running <= 4000 OR rn = 0"""
)
def stride_select(spark, sf):
    return golden.stride_selected(chunks(spark, sf).withColumnRenamed("idx", "pos"), 4000).select("chunk_id")


@query(
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)
SELECT doc_id, CASE WHEN len(ls) < 10 THEN 0 ELSE round(len(list_filter(ls, lambda x: regexp_matches(x, '^\s*[0-9]+\s*$|\s[0-9]+\s*$|^\s*[0-9]+\s'))) / len(ls), 6) END AS density FROM l"""
)
def line_number_density(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(t.line_number_density("text"), 6).alias("density"))
