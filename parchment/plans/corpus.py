"""Queries over chunks: chunking, duplicates, retrieval, fusion, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.functions.identifiers import extract
from parchment.functions.text import WHITE
from parchment.operators import chunking, dedup, evalset, fusion, metrics, needles, providers, retrieval
from parchment.operators import sections as sec
from parchment.plans.literals import literal, values
from parchment.plans.registry import query, table
from parchment.plans.text import SHINGLES, WORDS, sql_tokens
from parchment.sources.files import durable, few

CHUNKS = """(SELECT printf('%d::fixed::%05d', doc_id, i) AS chunk_id, doc_id, CAST(i AS INTEGER) AS idx, i * 871 AS start,
 i * 871 + length(substring(text, i * 871 + 1, 1024)) AS stop, substring(text, i * 871 + 1, 1024) AS text
 FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(ceil((length(text) - 1024) / 871), 0) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0))"""
TERMS = f"(SELECT chunk_id, unnest({sql_tokens('text')}) AS term FROM {CHUNKS})"
BM25 = f"""WITH tok AS MATERIALIZED {TERMS}, dl AS (SELECT c.chunk_id, count(t.term) AS dl FROM {CHUNKS} c LEFT JOIN tok t USING (chunk_id) GROUP BY 1),
sz AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl), tf AS (SELECT term, chunk_id, count(*) AS tf FROM tok GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
post AS (SELECT term, chunk_id, tf, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / mean)) AS weight FROM tf JOIN df USING (term) JOIN dl USING (chunk_id), sz),
q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({sql_tokens('text')}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT query_id, chunk_id, round(sum(qtf * weight), 9) AS score FROM q JOIN post USING (term) GROUP BY 1, 2),
bm AS (SELECT query_id, 'bm25' AS retriever, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0)"""
SHOW = "query_id, retriever, chunk_id, round(score, 6) AS score, rank"


def chunks(spark, sf):
    return chunking.fixed_width(table(spark, sf, "documents"))


def questions(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def shown(hits):
    return hits.withColumn("score", F.round("score", 6))


@query(f"SELECT chunk_id, doc_id, CAST(idx AS BIGINT) AS idx, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, md5(text) AS digest FROM {CHUNKS}")
def chunk_fixed_width(spark, sf):
    return chunks(spark, sf).select("chunk_id", "doc_id", *(F.col(c).cast("bigint").alias(c) for c in ("idx", "start", "stop")), F.md5("text").alias("digest"))


#: One step of the window rule, in SQL: from c the cut, then the next start.
CUT = r"""CASE WHEN c + 1024 >= n THEN n ELSE least(n, c + 1024 + CASE WHEN regexp_matches(w, '\n\s*\n') THEN strpos(w, regexp_extract(w, '\n\s*\n')) + length(regexp_extract(w, '\n\s*\n')) - 1
 WHEN regexp_matches(w, '[.!?][''")\]]?\s') THEN strpos(w, regexp_extract(w, '[.!?][''")\]]?\s')) + length(regexp_extract(w, '[.!?][''")\]]?\s')) - 1 ELSE strpos(w, ' ') END) END"""


@query(
    rf"""WITH RECURSIVE s AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, CAST(0 AS BIGINT) AS c, substring(text, 1025, 250) AS w FROM documents WHERE length(text) > 0),
r AS (SELECT doc_id, text, n, c, {CUT} AS e FROM s UNION ALL
 SELECT doc_id, text, n, c, {CUT} AS e FROM (SELECT doc_id, text, n, greatest(c + 1, e - 153) AS c, substring(text, CAST(greatest(c + 1, e - 153) + 1025 AS BIGINT), 250) AS w FROM r WHERE e < n)),
g AS (SELECT doc_id, c, e, sum(CASE WHEN c > 0 AND e - c >= 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY c) AS g FROM r)
SELECT doc_id, CAST(min(c) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS stop FROM g GROUP BY doc_id, g"""
)
def chunk_fixed(spark, sf):
    return chunking.chunk_fixed(table(spark, sf, "documents")).select("doc_id", "start", "stop")


@query()
def chunk_structural(spark, sf):
    d = table(spark, sf, "documents")
    s = chunking.line_sections(d)
    c = chunking.assembled(chunking.chunk_structural(d, s), d, "structural", s)
    return c.drop("text", "embed_text")


SENTENCES = r"""(WITH p AS (SELECT doc_id, text, string_split_regex(text, '[.!?][''")\]]?\s+') AS g, regexp_extract_all(text, '[.!?][''")\]]?\s+') AS m FROM documents WHERE length(text) > 0),
e AS (SELECT doc_id, text, unnest(range(0, len(g))) AS i, g, m FROM p),
c AS (SELECT doc_id, i, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS s,
 list_sum(list_transform(g[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i + 1], lambda x: length(x))), 0) AS t FROM e),
n AS (SELECT doc_id, s, t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM c WHERE t > s),
h AS (SELECT doc_id, s, t, sum(CASE WHEN rn > 1 AND t - s >= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY rn) AS h FROM n),
k AS (SELECT doc_id, h, min(s) AS s, max(t) AS t FROM h GROUP BY doc_id, h),
j AS (SELECT doc_id, s, t, CASE WHEN h = 0 AND t - s < 40 THEN 1 ELSE h END AS h FROM k),
f AS (SELECT doc_id, h, min(s) AS s, max(t) AS t FROM j GROUP BY doc_id, h)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS pos, CAST(s AS BIGINT) AS start, CAST(t AS BIGINT) AS stop FROM f)"""


@query(f"SELECT * FROM {SENTENCES}")
def sentence_spans(spark, sf):
    return chunking.sentence_spans(table(spark, sf, "documents"))


def _breaks(spark, sf):
    v = chunking.sentences(table(spark, sf, "documents")).select("doc_id", "pos", F.coalesce(retrieval.hashed_embedding("sentence", 16), F.array_repeat(F.lit(0.0), 16)).alias("vec"))
    return chunking.breakpoints(chunking.distances(v))


@query()
def sentence_breakpoints(spark, sf):
    return _breaks(spark, sf).select("doc_id", "pos", F.round("distance", 6).alias("distance"))


@query()
def chunk_semantic(spark, sf):
    d = table(spark, sf, "documents")
    return chunking.chunk_semantic(d, _breaks(spark, sf), chunking.sentence_spans(d)).select("doc_id", "start", "stop")


@query(
    f"""WITH o AS (SELECT id, start, stop, row_number() OVER (PARTITION BY id ORDER BY start, stop) AS rn FROM {values("spans")}),
g AS (SELECT id, start, stop, sum(CASE WHEN rn > 1 AND stop - start >= 200 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY rn) AS g FROM o),
m AS (SELECT id, g, min(start) AS start, max(stop) AS stop, max(g) OVER (PARTITION BY id) AS top FROM (SELECT id, g, start, stop FROM g) GROUP BY id, g),
k AS (SELECT id, CASE WHEN g = 0 AND stop - start < 200 AND top > 0 THEN 1 ELSE g END AS g, start, stop FROM m)
SELECT id, min(start) AS start, max(stop) AS stop FROM k GROUP BY id, g"""
)
def runts_absorbed(spark, sf):
    return chunking.absorbed(literal(spark, "spans"))


STATS = f"""SELECT 'fixed' AS strategy, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_documents, CAST(min(stop - start) AS BIGINT) AS min_chars, CAST(max(stop - start) AS BIGINT) AS max_chars,
 CAST(sum(stop - start) AS BIGINT) AS total_chars, CAST(sum(greatest(0, stop - greatest(start, coalesce(prev, 0)))) AS BIGINT) AS unique_chars, CAST(sum(length(text) // 4) AS BIGINT) AS index_tokens
 FROM (SELECT *, max(stop) OVER (PARTITION BY doc_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM {CHUNKS})"""


@query(STATS)
def chunk_stats(spark, sf):
    c = chunks(spark, sf).withColumns({"strategy": F.lit("fixed"), "section": F.lit(None).cast("bigint"), "fallback": F.lit(False), "embed_text": F.col("text")})
    s = chunking.strategy_stats(c)
    return s.select("strategy", "n_chunks", "n_documents", *(F.col(x).cast("bigint").alias(x) for x in ("min_chars", "max_chars", "total_chars", "unique_chars", "index_tokens")))


@query()
def chunk_section_alignment(spark, sf):
    d = table(spark, sf, "documents")
    s = chunking.line_sections(d)
    c = chunking.assembled(chunking.chunk_structural(d, s), d, "structural", s)
    return chunking.strategy_stats(c, s)


@query(
    f"""WITH p AS (SELECT doc_id, page, start, start + n AS stop FROM (SELECT doc_id, page, length(text) AS n,
 coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM {values("pages")})),
s AS (SELECT doc_id, i * 60 AS start, i * 60 + 90 AS stop FROM (SELECT DISTINCT doc_id FROM p), range(0, 5) AS r(i)),
f AS (SELECT doc_id, min(page) AS first FROM p GROUP BY doc_id)
SELECT s.doc_id, CAST(s.start AS BIGINT) AS start, CAST(s.stop AS BIGINT) AS stop, coalesce(min(p.page), any_value(first)) AS page_start, coalesce(max(p.page), any_value(first)) AS page_end
FROM s JOIN f USING (doc_id) LEFT JOIN p ON p.doc_id = s.doc_id AND p.start < s.stop AND p.stop > s.start GROUP BY s.doc_id, s.start, s.stop"""
)
def pages_touched(spark, sf):
    p = sec.page_offsets(literal(spark, "pages")).select("doc_id", "page", F.col("start").alias("page_start"), F.col("stop").alias("page_stop"))
    spans = p.select("doc_id").distinct().crossJoin(spark.range(5)).select("doc_id", (F.col("id") * 60).alias("start"), (F.col("id") * 60 + 90).alias("stop"))
    return chunking.pages_touched(spans, p)


@query()
def identifiers_inside(spark, sf):
    text = literal(spark, "identifier_text").select(F.col("id").alias("doc_id"), "text")
    c = chunking.fixed_width(text, 201, 100)
    return chunking.identifiers_inside(c, extract(text.select(F.col("doc_id").alias("id"), "text")))


@query()
def index_text_modes(spark, sf):
    d = table(spark, sf, "documents")
    s = chunking.line_sections(d)
    c = chunking.assembled(chunking.chunk_structural(d, s), d, "structural", s)
    out = [chunking.index_text(c, m).select(F.lit(m).alias("mode"), "chunk_id", F.length("index_text").alias("n")) for m in ("prepend", "source", "strip")]
    return out[0].unionByName(out[1]).unionByName(out[2]).groupBy("mode").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n").alias("chars"))


JACCARD = f"""w AS (SELECT doc_id, md5(array_to_string(w, ' ')) AS key, length(text) AS n, {SHINGLES} AS s FROM (SELECT doc_id, text, {WORDS} AS w FROM documents)),
r AS (SELECT min(doc_id) AS id, key, any_value(s) AS s FROM w GROUP BY key), e AS (SELECT id, unnest(s) AS t FROM r), z AS (SELECT id, len(s) AS n FROM r),
j AS (SELECT a, b, c / (x.n + y.n - c) AS similarity FROM (SELECT p.id AS a, q.id AS b, count(*) AS c FROM e p JOIN e q ON p.t = q.t AND p.id < q.id GROUP BY 1, 2) JOIN z x ON x.id = a JOIN z y ON y.id = b)"""


def _items(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


@query(f"WITH {JACCARD} SELECT a, b, round(similarity, 6) AS similarity FROM j WHERE similarity >= 0.85")
def dedup_pairs(spark, sf):
    return dedup.pairs(_items(spark, sf)).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH RECURSIVE {JACCARD}, l AS (SELECT a, b FROM j WHERE similarity >= 0.85 UNION SELECT b, a FROM j WHERE similarity >= 0.85),
c(id, m) AS (SELECT id, id FROM r UNION SELECT l.b, c.m FROM c JOIN l ON l.a = c.id), k AS (SELECT id, min(m) AS comp FROM c GROUP BY id),
g AS (SELECT w.doc_id, w.n, w.key, k.comp FROM w JOIN r USING (key) JOIN k ON k.id = r.id),
s AS (SELECT comp, count(*) AS size, arg_max(doc_id, n * 1000000000 - doc_id) AS canonical_id, array_to_string(list_sort(list(doc_id)), ',') AS members FROM g GROUP BY comp HAVING count(*) > 1),
f AS (SELECT x.comp, min(coalesce(similarity, 0)) AS floor FROM (SELECT r.id, k.comp FROM r JOIN k USING (id)) x JOIN (SELECT r.id, k.comp FROM r JOIN k USING (id)) y ON x.comp = y.comp AND x.id < y.id LEFT JOIN j ON j.a = x.id AND j.b = y.id GROUP BY x.comp)
SELECT canonical_id, size, members, round(coalesce(floor, 1), 6) AS similarity_floor FROM s LEFT JOIN f USING (comp)"""
)
def dedup_clusters(spark, sf):
    c = dedup.clusters(_items(spark, sf))
    return c.select("canonical_id", "size", F.array_join("members", ",").alias("members"), F.round("similarity_floor", 6).alias("similarity_floor"))


@query()
def minhash_estimates(spark, sf):
    d = _items(spark, sf)
    p = durable(dedup.pairs(d))
    # only what has a partner is signed
    s = durable(dedup.signature(dedup.profiles(d.join(few(p.select(F.col("a").alias("id")).union(p.select("b")).distinct()), "id", "left_semi"))))
    j = p.join(s.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
    return j.select("a", "b", "similarity", dedup.estimated_jaccard("sa", "sb").alias("estimate"))


@query(
    f"""WITH {JACCARD}, x AS (SELECT doc_id AS a, len(s) AS na, s FROM w WHERE doc_id % 50 = 0), xe AS (SELECT a, na, unnest(s) AS t FROM x)
SELECT a, id AS b, round(count(*) / (any_value(na) + any_value(z.n) - count(*)), 6) AS similarity FROM xe JOIN e USING (t) JOIN z USING (id) WHERE a <> id GROUP BY a, id HAVING count(*) / (any_value(na) + any_value(z.n) - count(*)) >= 0.1"""
)
def overlap_scores(spark, sf):
    d = _items(spark, sf)
    return dedup.overlaps(d.where("id % 50 = 0"), d).withColumn("similarity", F.round("similarity", 6))


@query(f"{BM25} SELECT {SHOW} FROM bm WHERE rank <= 10")
def bm25_topk(spark, sf):
    return shown(retrieval.LexicalIndex(chunks(spark, sf)).search(questions(spark, sf), 10))


@query(f"{BM25} SELECT chunk_id, term, round(weight, 6) AS weight FROM post")
def sparse_vectors(spark, sf):
    return retrieval.LexicalIndex(chunks(spark, sf)).postings.select("chunk_id", "term", F.round("weight", 6).alias("weight"))


VECTORS = "(SELECT vec_id AS chunk_id, embedding AS vec, label FROM embeddings)"
DENSE = f"""qv AS (SELECT vec_id AS query_id, embedding AS qvec, label AS ql FROM embeddings WHERE vec_id % 50 = 0),
ds AS (SELECT query_id, ql, chunk_id, label, round(list_sum(list_transform(range(1, 65), lambda i: CAST(qvec[i] AS DOUBLE) * CAST(vec[i] AS DOUBLE))), 9) AS score FROM qv, {VECTORS}),
dn AS (SELECT query_id, 'dense' AS retriever, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds)"""


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"), "label")
    return e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"), "label"), q


@query(f"WITH {DENSE} SELECT {SHOW} FROM dn WHERE rank <= 10")
def dense_topk(spark, sf):
    v, q = _vectors(spark, sf)
    return shown(retrieval.dense_search(q, v, 10))


@query()
def ann_topk(spark, sf):
    v, q = _vectors(spark, sf)
    return shown(retrieval.InvertedFile(v).search(q, 10))


@query()
def ann_recall_sweep(spark, sf):
    """Recall of three numbers of probes, the last of them the one that the index chose for itself."""
    v, q = _vectors(spark, sf)
    retrieval.check_same_keys(v, table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id")))
    exact, index, out = durable(retrieval.dense_search(q, v, 10)), retrieval.InvertedFile(v), None
    for probes in sorted({max(1, index.probes // 4), max(1, index.probes // 2), index.probes}):
        r = retrieval.index_recall(index.search(q, 10, probes), exact, 10)
        r = r.agg(F.count(F.lit(1)).alias("n_queries"), F.avg("recall").alias("recall"), F.avg(F.col("identical").cast("double")).alias("identical"))
        r = r.withColumns({"probes": F.lit(probes), "cells": F.lit(index.cells)})
        out = r if out is None else out.unionByName(r)
    return out


def _lists(spark, sf):
    h = literal(spark, "hits")
    return [h.where(F.col("retriever") == r) for r in ("sparse", "dense")]


HITS = values("hits")


@query(f"SELECT query_id, 'rrf' AS retriever, chunk_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS s FROM {HITS} GROUP BY 1, 2)")
def fusion_rrf(spark, sf):
    return shown(fusion.rrf(_lists(spark, sf), 10))


@query(f"SELECT query_id, 'wrrf' AS retriever, chunk_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(sum(CASE WHEN retriever = 'sparse' THEN 0.75 ELSE 0.25 END / (60 + rank)), 9) AS s FROM {HITS} GROUP BY 1, 2)")
def fusion_weighted(spark, sf):
    return shown(fusion.weighted_rrf(_lists(spark, sf), {"sparse": 3.0, "dense": 1.0}, 10))


@query(
    f"""WITH n AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM {HITS} WINDOW w AS (PARTITION BY query_id, retriever)),
s AS (SELECT query_id, chunk_id, round(sum(0.5 * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.5 END), 9) AS s FROM n GROUP BY 1, 2)
SELECT query_id, 'minmax' AS retriever, chunk_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM s"""
)
def fusion_minmax(spark, sf):
    return shown(fusion.minmax(_lists(spark, sf), {"sparse": 1.0, "dense": 1.0}, 10))


#: The offline embedder: each token adds 1 or -1 at a place, both named by its MD5; unit length.
HASHED = """SELECT {id}, list(v / norm ORDER BY i) AS vec FROM (SELECT {id}, i, v, sqrt(sum(v * v) OVER (PARTITION BY {id})) AS norm FROM (
 SELECT g.{id}, g.i, coalesce(sum(t.v), 0) AS v FROM (SELECT DISTINCT {id}, unnest(range(0, 64)) AS i FROM {t}) g LEFT JOIN (SELECT {id}, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64 AS i,
 CASE WHEN substr(md5(term), 9, 1) < '8' THEN 1.0 ELSE -1.0 END::DOUBLE AS v FROM {t}) t ON t.{id} = g.{id} AND t.i = g.i GROUP BY 1, 2)) WHERE norm > 0 GROUP BY {id}"""
QTERMS = f"(SELECT item_id AS query_id, unnest({sql_tokens('text')}) AS term FROM benchmark)"


@query(
    f"""{BM25}, cv AS MATERIALIZED ({HASHED.format(id="chunk_id", t="tok")}), qv AS MATERIALIZED ({HASHED.format(id="query_id", t=QTERMS)}),
hd AS (SELECT query_id, chunk_id, round(list_sum(list_transform(range(1, 65), lambda i: qv.vec[i] * cv.vec[i])), 9) AS score FROM qv, cv),
hr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hd),
hs AS (SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 9) AS s FROM (SELECT query_id, chunk_id, rank FROM hr WHERE rank <= 100 UNION ALL SELECT query_id, chunk_id, rank FROM bm WHERE rank <= 100) GROUP BY 1, 2)
SELECT query_id, 'hybrid' AS retriever, chunk_id, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM hs) WHERE rank <= 10"""
)
def hybrid_topk(spark, sf):
    c, q = chunks(spark, sf), questions(spark, sf)
    index = retrieval.LexicalIndex(c)
    vec = c.select("chunk_id", retrieval.hashed_embedding("text").alias("vec")).where("vec IS NOT NULL")
    qv = q.select("query_id", retrieval.hashed_embedding("text").alias("qvec")).where("qvec IS NOT NULL")
    return shown(fusion.hybrid([lambda x, k: index.search(x, k), lambda x, k: retrieval.dense_search(qv, vec, k)], q, 10))


@query(
    f"""{BM25}, qt AS (SELECT item_id AS query_id, list_distinct({sql_tokens("text")}) AS t FROM benchmark), ct AS (SELECT chunk_id, list_distinct({sql_tokens("text")}) AS t FROM {CHUNKS}),
o AS (SELECT bm.query_id, bm.chunk_id, round(len(list_intersect(qt.t, ct.t)) / len(qt.t), 9) AS score FROM bm JOIN qt USING (query_id) JOIN ct USING (chunk_id) WHERE rank <= 50),
k AS (SELECT query_id, 'rerank' AS retriever, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM o) SELECT {SHOW} FROM k WHERE rank <= 10"""
)
def rerank_topk(spark, sf):
    c, q = chunks(spark, sf), questions(spark, sf)
    return shown(retrieval.rerank(retrieval.LexicalIndex(c).search(q, 50), providers.OverlapScorer(q, c), 10))


TRUTH = f"(SELECT item_id AS query_id, chunk_id FROM benchmark JOIN documents d ON contains(d.text, benchmark.text) JOIN {CHUNKS} c ON c.doc_id = d.doc_id AND c.start < strpos(d.text, benchmark.text) - 1 + length(benchmark.text) AND c.stop > strpos(d.text, benchmark.text) - 1)"


def _truth(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("needle_id"), F.col("text").alias("needle"))
    found = needles.containing(b, table(spark, sf, "documents"))
    spans = found.join(F.broadcast(b.select("needle_id", F.length("needle").alias("n"))), "needle_id").select(F.col("needle_id").alias("query_id"), "doc_id", "start", (F.col("start") + F.col("n")).alias("stop"))
    return metrics.relevant_chunks(spans, chunks(spark, sf))


@query(f"SELECT DISTINCT query_id, chunk_id FROM {TRUTH}")
def relevant_chunks(spark, sf):
    return _truth(spark, sf)


@query(
    f"""{BM25}, tr AS (SELECT DISTINCT query_id, chunk_id FROM {TRUTH}), n AS (SELECT query_id, count(*) AS n FROM tr GROUP BY 1),
h AS (SELECT bm.query_id, min(rank) FILTER (tr.chunk_id IS NOT NULL) AS first, count(*) FILTER (tr.chunk_id IS NOT NULL AND rank <= 10) AS c10, count(*) FILTER (tr.chunk_id IS NOT NULL AND rank <= 5) AS c5 FROM bm LEFT JOIN tr USING (query_id, chunk_id) WHERE rank <= 20 GROUP BY 1)
SELECT count(n.n) AS n_queries, count(*) - count(n.n) AS n_unscorable, round(avg(CASE WHEN n.n > 0 THEN CASE WHEN first <= 1 THEN 1.0 ELSE 0 END END), 6) AS hit_1, round(avg(coalesce(c10, 0) / n.n), 6) AS recall_10,
 round(avg(CASE WHEN n.n > 0 THEN coalesce(c5, 0) / 5 END), 6) AS precision_5, round(avg(CASE WHEN n.n > 0 THEN CASE WHEN first <= 10 THEN 1.0 / first ELSE 0 END END), 6) AS mrr_10
FROM benchmark LEFT JOIN n ON n.query_id = item_id LEFT JOIN h ON h.query_id = item_id"""
)
def retrieval_eval(spark, sf):
    q = questions(spark, sf)
    hits = retrieval.LexicalIndex(chunks(spark, sf)).search(q, 20)
    s = metrics.by_slice(metrics.per_query(hits, _truth(spark, sf), q.select("query_id", F.lit("passages").alias("slice"))))
    return s.select("n_queries", "n_unscorable", "hit_1", "recall_10", "precision_5", "mrr_10")


@query(
    f"""WITH h AS (SELECT h.*, t.chunk_id IS NOT NULL AS rel FROM {HITS} h LEFT JOIN {values("truth")} t USING (query_id, chunk_id)), n AS (SELECT query_id, count(*) AS n FROM {values("truth")} GROUP BY 1),
a AS (SELECT query_id, retriever, min(rank) FILTER (rel) AS f, count(*) FILTER (rel AND rank <= 5) AS c5, sum(CASE WHEN rel THEN 1 / log2(rank + 1) END) AS dcg FROM h GROUP BY 1, 2),
p AS (SELECT p.query_id, p.slice, r.retriever, coalesce(n.n, 0) AS n, a.f, coalesce(a.c5, 0) AS c5, coalesce(a.dcg, 0) AS dcg FROM {values("probes")} p CROSS JOIN (SELECT DISTINCT retriever FROM h) r LEFT JOIN n USING (query_id) LEFT JOIN a ON a.query_id = p.query_id AND a.retriever = r.retriever)
SELECT retriever, slice, count(*) FILTER (n > 0) AS n_queries, count(*) FILTER (n = 0) AS n_unscorable, round(avg(CASE WHEN n > 0 THEN CASE WHEN f = 1 THEN 1.0 ELSE 0 END END), 6) AS hit_1,
 round(avg(CASE WHEN n > 0 THEN c5 / n END), 6) AS recall_5, round(avg(CASE WHEN n > 0 THEN c5 / 5 END), 6) AS precision_5, round(avg(CASE WHEN n > 0 THEN coalesce(1.0 / f, 0) END), 6) AS mrr_10,
 round(avg(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, CAST(n AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) END), 6) AS ndcg_10 FROM p GROUP BY 1, 2"""
)
def metrics_by_slice(spark, sf):
    s = metrics.by_slice(metrics.per_query(literal(spark, "hits"), literal(spark, "truth"), literal(spark, "probes")))
    return s.select("retriever", "slice", "n_queries", "n_unscorable", "hit_1", "recall_5", "precision_5", "mrr_10", "ndcg_10")


SC = values("scored")


@query(
    f"""WITH t AS (SELECT DISTINCT score AS t FROM {SC} UNION SELECT max(score) + 1 FROM {SC}), a AS (SELECT t, avg(CASE WHEN (score >= t) = answerable THEN 1.0 ELSE 0 END) AS acc FROM t, {SC} GROUP BY t),
b AS (SELECT t, acc FROM a ORDER BY acc DESC, t LIMIT 1), c AS (SELECT count(*) FILTER (answerable) AS p, count(*) FILTER (NOT answerable) AS n, avg(score) FILTER (answerable) AS mp, avg(score) FILTER (NOT answerable) AS mn FROM {SC})
SELECT p AS n_pos, n AS n_neg, t AS threshold, round(acc, 9) AS accuracy, round(greatest(p, n) / (p + n), 9) AS baseline, round(acc - greatest(p, n) / (p + n), 9) AS gain, mp AS mean_pos, mn AS mean_neg FROM b, c"""
)
def separability(spark, sf):
    s = metrics.separability(literal(spark, "scored"))
    return s.withColumns({c: F.round(c, 9) for c in ("accuracy", "baseline", "gain")})


@query(f"SELECT avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc, count(*) AS n_pairs FROM {SC} a, {SC} b WHERE a.answerable AND NOT b.answerable")
def separability_auc(spark, sf):
    return metrics.auc(literal(spark, "scored"))


@query(
    f"""WITH e AS (SELECT min(score) AS lo, max(score) AS hi FROM {SC}), t AS (SELECT CAST(i AS INTEGER) AS step, lo + (hi - lo) * i / 12 AS threshold FROM e, range(0, 13) AS r(i))
SELECT step, round(threshold, 9) AS threshold, count(*) FILTER (answerable AND score < t.threshold) AS answerable_refused, count(*) FILTER (NOT answerable AND score < t.threshold) AS unanswerable_refused FROM t, {SC} GROUP BY step, t.threshold"""
)
def threshold_sweep(spark, sf):
    return metrics.threshold_sweep(literal(spark, "scored")).withColumn("threshold", F.round("threshold", 9))


@query(f"SELECT t.query_id, round(count(DISTINCT h.chunk_id) / count(DISTINCT t.chunk_id), 6) AS ceiling FROM {values('truth')} t LEFT JOIN (SELECT * FROM {HITS} WHERE rank <= 2) h USING (query_id, chunk_id) GROUP BY 1")
def recall_ceiling(spark, sf):
    return metrics.recall_ceiling(literal(spark, "hits"), literal(spark, "truth"), 2).withColumn("ceiling", F.round("ceiling", 6))


@query(f"SELECT retriever, count(*) < 2 OR max(n) / sum(n) > 0.9 AS saturated FROM (SELECT retriever, round(recall, 4) AS v, count(*) AS n FROM {values('runs')} GROUP BY 1, 2) GROUP BY 1")
def saturation(spark, sf):
    return metrics.saturated(literal(spark, "runs"), "retriever", "recall")


def _sections(spark, sf):
    return chunking.line_sections(table(spark, sf, "documents"))


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS idx, len(string_split(text, chr(10))) AS n FROM documents WHERE length(text) > 0),
s AS (SELECT doc_id, idx, array_to_string(string_split(line, ' ')[1:4], ' ') AS heading, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
 length(line) + CASE WHEN idx = n - 1 THEN 0 ELSE 1 END AS size FROM l),
k AS (SELECT *, count(*) OVER (PARTITION BY lower(trim(regexp_replace(heading, '{WHITE}+', ' ', 'g')))) AS held, doc_id || ':' || idx AS id FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY md5('20260813:' || id), id) - 1 AS n FROM k WHERE held = 1 AND length(trim(heading)) >= 18 AND size >= 400)
SELECT 'section-' || lpad(CAST(n AS VARCHAR), 4, '0') AS query_id, 'section_lookup' AS slice, trim(heading) AS query, doc_id, CAST(start AS BIGINT) AS start, CAST(start + size AS BIGINT) AS stop FROM o WHERE n < 60"""
)
def evalset_sections(spark, sf):
    s = evalset.section_lookup(_sections(spark, sf))
    return s.select("query_id", "slice", "query", F.col("spans")[0].alias("s")).select("query_id", "slice", "query", "s.doc_id", "s.start", "s.stop")


@query()
def evalset_identifiers(spark, sf):
    return evalset.exploded(evalset.exact_identifier(extract(literal(spark, "identifier_text"))))


@query(
    """WITH t AS (SELECT doc_id, substring(text, 1, 40) AS title, n_chars FROM documents WHERE length(trim(substring(text, 1, 40))) >= 18),
o AS (SELECT *, row_number() OVER (ORDER BY md5(concat('20260813:', doc_id)), doc_id) - 1 AS n FROM t)
SELECT 'title-' || lpad(CAST(n AS VARCHAR), 4, '0') AS query_id, doc_id, n_chars AS stop FROM o WHERE n < 60"""
)
def evalset_titles(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 40).alias("title"), "n_chars")
    return evalset.exploded(evalset.title_lookup(d)).select("query_id", "doc_id", "stop")


@query(
    f"""WITH c AS (SELECT i AS id, md5('20260813:unanswerable:' || i) AS h FROM range(0, 240) AS r(i)),
k AS (SELECT ([7, 9, 16, 21, 40, 42, 45])[CAST('0x' || substr(h, 1, 7) AS BIGINT) % 7 + 1] || ' CFR ' || (CAST('0x' || substr(h, 8, 7) AS BIGINT) % 1900 + 100) || '.' || (CAST('0x' || substr(h, 15, 7) AS BIGINT) % 99 + 1) AS canonical, id FROM c),
p AS (SELECT unnest(regexp_extract_all(regexp_replace(text, '[Cc][Ff][Rr]', 'CFR', 'g'), '[0-9]+ CFR [0-9]+[.][0-9]+')) AS canonical FROM {values("identifier_text")}),
u AS (SELECT canonical, min(id) AS id FROM k WHERE canonical NOT IN (SELECT canonical FROM p) GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS n FROM u)
SELECT 'unans-' || lpad(CAST(n AS VARCHAR), 4, '0') AS query_id, 'unanswerable' AS slice, 'What are the requirements of ' || canonical || '?' AS query FROM o WHERE n < 60"""
)
def evalset_unanswerable(spark, sf):
    return evalset.unanswerable(extract(literal(spark, "identifier_text"))).select("query_id", "slice", "query")
