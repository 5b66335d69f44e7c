"""The operators composed into the jobs that a user runs: extract, chunk, probes, evaluation, sweep,
answers, reference pairs, judging, index measurement, triage. Tables in, tables out; what is read
and written lies with sources/."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.identifiers import PRIMARY, extract
from parchment.functions.text import control_share, label_of, quarantined, run_on_share, single_char_share, unsupported_numbers
from parchment.operators import answers, chunking, citations, curate, dedup, evalset, fusion, golden, judge, metrics, providers, retrieval, sampling, sections, stats
from parchment.sources.files import durable

SHARES = {"control_share": control_share, "single_share": single_char_share, "run_on_share": run_on_share}


def extracted(pages: DataFrame, outline: DataFrame | None = None, gap: int = 2) -> dict[str, DataFrame]:
    """documents (doc_id, text, n_chars, n_pages, n_sections, n_identifiers, shares, label), sections and
    identifiers of pages (doc_id, page, text)."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    docs = pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n" * gap).alias("text"), F.count(F.lit(1)).alias("n_pages"))
    docs = docs.select("doc_id", "text", "n_pages", F.length("text").cast("bigint").alias("n_chars"), *(f("text").alias(n) for n, f in SHARES.items()))
    docs = durable(docs.withColumn("label", label_of(*SHARES)))
    found = extract(docs, "doc_id")
    parts = sections.sectioned(pages, outline)
    counts = [t.groupBy(F.col("doc_id").alias(f"d_{n}")).agg(F.count(F.lit(1)).alias(n)) for t, n in ((parts, "n_sections"), (found, "n_identifiers"))]
    for t, n in zip(counts, ("n_sections", "n_identifiers"), strict=True):
        docs = docs.join(t, F.col("doc_id") == F.col(f"d_{n}"), "left").drop(f"d_{n}").withColumn(n, F.coalesce(n, F.lit(0)))
    return {"documents": docs, "sections": parts, "identifiers": found}


def readable(docs: DataFrame) -> DataFrame:
    """Documents (text, label) that aren't quarantined."""
    return docs.where(~quarantined("label", "text"))


def chunked(docs: DataFrame, parts: DataFrame, strategy: str, breaks: DataFrame | None = None, target: int = chunking.TARGET, overlap: int = chunking.OVERLAP) -> DataFrame:
    """Chunks of one strategy, each with duplicate_of: the canonical chunk of its cluster, NULL for the others."""
    if strategy == "semantic":
        sentences = chunking.sentence_spans(docs)
        spans = chunking.chunk_semantic(docs, breaks if breaks is not None else semantic_breaks(docs), sentences, target)
    elif strategy == "structural":
        spans = chunking.chunk_structural(docs, parts, target, overlap)
    else:
        spans = chunking.chunk_fixed(docs, target, overlap)
    chunks = durable(chunking.assembled(spans, docs, strategy, parts if strategy == "structural" else None))
    copies = dedup.copies(chunks.select(F.col("chunk_id").alias("id"), "text"))
    copies = copies.select(F.col("id").alias("__c"), F.col("canonical_id").alias("duplicate_of"))
    return chunks.join(copies, F.col("chunk_id") == F.col("__c"), "left").drop("__c")


def semantic_breaks(docs: DataFrame, dim: int = 64) -> DataFrame:
    """Sentences that a break follows, by the distance of neighbours under the offline embedder."""
    v = chunking.sentences(docs).select("doc_id", "pos", F.coalesce(retrieval.hashed_embedding("sentence", dim), F.array_repeat(F.lit(0.0), dim)).alias("vec"))
    return chunking.breakpoints(chunking.distances(v))


def chunk_report(chunks: DataFrame, parts: DataFrame, found: DataFrame) -> DataFrame:
    """strategy_stats() with chunks that hold identifiers, distinct citations within reach of one chunk,
    and clusters of duplicates across and within documents."""
    inside = chunking.identifiers_inside(chunks, found.withColumnRenamed("doc_id", "id")).join(chunks.select("chunk_id", "strategy"), "chunk_id")
    primary = F.col("kind") == PRIMARY
    ids = inside.groupBy("strategy").agg(
        F.count_distinct("chunk_id").alias("with_identifier"), F.count_distinct(F.when(primary, F.col("chunk_id"))).alias("with_primary"), F.count_distinct(F.when(primary, F.col("canonical"))).alias("primary_reachable")
    )
    of = chunks.select("strategy", "doc_id", F.coalesce("duplicate_of", "chunk_id").alias("cluster")).groupBy("strategy", "cluster").agg(F.count(F.lit(1)).alias("size"), F.count_distinct("doc_id").alias("docs"))
    copies = of.where("size > 1").groupBy("strategy").agg(
        F.sum(F.col("size") - 1).alias("marked_duplicate"), F.count_if(F.col("docs") > 1).alias("cross_document"), F.count_if(F.col("docs") == 1).alias("within_document")
    )
    out = chunking.strategy_stats(chunks, parts).join(ids, "strategy", "left").join(copies, "strategy", "left")
    return out.fillna(0, ["with_identifier", "with_primary", "primary_reachable", "marked_duplicate", "cross_document", "within_document"])


def largest_clusters(chunks: DataFrame, n: int = 8) -> DataFrame:
    """The n largest clusters of duplicates: canonical_id, size, documents; ties by id."""
    of = chunks.groupBy(F.coalesce("duplicate_of", "chunk_id").alias("canonical_id")).agg(F.count(F.lit(1)).alias("size"), F.count_distinct("doc_id").alias("documents"))
    return of.where("size > 1").orderBy(F.desc("size"), "canonical_id").limit(n)


def probes(docs: DataFrame, parts: DataFrame, found: DataFrame, titles: DataFrame, limit: int = evalset.PER_SLICE, seed: int = sampling.SEED) -> DataFrame:
    """The four slices of probes over readable documents: query_id, slice, query, spans."""
    good = durable(readable(docs).select("doc_id"))
    keep = lambda t, c="doc_id": t.join(good, t[c] == good["doc_id"], "left_semi")
    ids = durable(keep(found).withColumnRenamed("doc_id", "id"))
    made = [
        evalset.exact_identifier(ids, limit, seed), evalset.section_lookup(keep(parts), limit, seed),
        evalset.title_lookup(keep(titles), limit, seed), evalset.unanswerable(ids, limit, seed),
    ]
    return reduce(DataFrame.unionByName, made)


def retrievers(chunks: DataFrame, queries: DataFrame, ablations: bool = True, weights: tuple[float, ...] = (0.3, 0.5, 0.7), candidates: int = 50) -> dict:
    """Name -> function (queries, k) -> hits, over assembled chunks: lexical (with its ablations), dense,
    the fusions of both, and reranked ones."""
    q = queries.select("query_id", "text")
    sparse = retrieval.LexicalIndex(chunks, mode="prepend")
    embedder = providers.HashedEmbedder()
    vec = embedder.documents(chunks.select(F.col("chunk_id").alias("key"), F.col("embed_text").alias("text"))).select(F.col("key").alias("chunk_id"), F.col("embedding").alias("vec")).where("vec IS NOT NULL")
    vec = durable(vec)
    qvec = embedder.queries(q.select(F.col("query_id").alias("key"), "text")).select(F.col("key").alias("query_id"), F.col("embedding").alias("qvec")).where("qvec IS NOT NULL")
    deep, lists = max(fusion.FETCH, candidates), {}

    def once(name: str, search):
        """Each list is made once, to the depth that fusion and reranking fetch; a shorter one is its beginning."""

        def cut(k: int) -> DataFrame:
            if name not in lists:
                lists[name] = durable(search(deep))
            return lists[name].where(F.col("rank") <= k) if k <= deep else search(k)

        return cut

    out = {"bm25": once("bm25", lambda k: sparse.search(q, k)), "dense": once("dense", lambda k: retrieval.dense_search(qvec, vec, k))}
    if ablations:
        for name, index in (
            ("bm25 -atoms", {"atoms": False, "mode": "prepend"}), ("bm25 heading=source", {"mode": "source"}), ("bm25 heading=strip", {"mode": "strip"}),
        ):
            out[name] = lambda k, kw=index: retrieval.LexicalIndex(chunks, **kw).search(q, k)
    pair = lambda: [out["bm25"](fusion.FETCH), out["dense"](fusion.FETCH)]
    out["hybrid rrf"] = once("hybrid rrf", lambda k: fusion.rrf(pair(), k))
    for w in weights:
        share = {"bm25": 1 - w, "dense": w}
        out[f"hybrid wrrf {w:g}"] = lambda k, s=share: fusion.weighted_rrf(pair(), s, k)
        out[f"hybrid minmax {w:g}"] = lambda k, s=share: fusion.minmax(pair(), s, k)
    scorer = providers.OverlapScorer(q, chunks)
    for base in ("bm25", "hybrid rrf"):
        out[f"rerank {base}"] = lambda k, b=base: retrieval.rerank(out[b](max(candidates, k)), scorer, k, candidates)
    return out


def grid(chunks: DataFrame, queries: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """strategy, retriever, slice with their metrics: every strategy of `chunks` under every retriever.

    queries: query_id, slice, query, spans. Truth is spans of characters, resolved against each
    strategy's own chunks.
    """
    q = queries.select("query_id", "slice", F.col("query").alias("text"))
    spans = evalset.exploded(queries)
    out = []
    for strategy in sorted(r["strategy"] for r in chunks.select("strategy").distinct().collect()):
        c = chunks.where(F.col("strategy") == strategy)
        all_ = retrievers(c, q)
        hits = [f(max(metrics.CUTS)).withColumn("retriever", F.lit(n)) for n, f in all_.items() if names is None or n in names]
        scored = metrics.per_query(durable(reduce(DataFrame.unionByName, hits)), durable(metrics.relevant_chunks(spans, c)), q)
        out.append(metrics.by_slice(scored).withColumn("strategy", F.lit(strategy)))
    return reduce(DataFrame.unionByName, out)


def sweep(docs: DataFrame, parts: DataFrame, queries: DataFrame, targets: tuple[int, ...] = (512, 1024, 2048, 4096), names: tuple[str, ...] = ("bm25", "dense", "hybrid rrf", "rerank bm25")) -> DataFrame:
    """target, retriever, slice with their metrics: structural chunks of several sizes under four retrievers.

    The sizes go through one grid, as strategies of one table of chunks.
    """
    sized = []
    for t in targets:
        spans = chunking.chunk_structural(docs, parts, t, min(chunking.OVERLAP, t // 2))
        c = chunking.assembled(spans, docs, "structural", parts)
        sized.append(c.withColumns({"strategy": F.lpad(F.lit(str(t)), 5, "0"), "chunk_id": F.concat(F.lit(f"{t}::"), "chunk_id")}))
    g = grid(durable(reduce(DataFrame.unionByName, sized)), queries, names)
    return g.withColumn("target", F.col("strategy").cast("int")).drop("strategy")


def answer_run(queries: DataFrame, chunks: DataFrame, generator, judgments: DataFrame | None = None, agreement: DataFrame | None = None, per_slice: int = 4, k: int = 5, threshold: float | None = None) -> dict[str, DataFrame]:
    """outcomes, checks, buckets, precision, refusals and, where the judge is usable, faithfulness of
    answers to the first `per_slice` queries of each slice."""
    q = sampling.first_per_slice(queries, per_slice, order="query_id").select("query_id", "slice", F.col("query").alias("text"))
    hits = durable(retrieval.LexicalIndex(chunks, mode="prepend").search(q, k))
    prompts = answers.gated(answers.prompts(q, answers.context(hits, chunks)), threshold)
    outcomes = durable(answers.answered(prompts, generator).join(q.select("query_id", "slice"), "query_id"))
    checks = durable(answers.checked(outcomes, hits, chunks))
    out = {
        "outcomes": outcomes, "checks": checks, "buckets": citations.buckets(checks), "precision": citations.precision(checks, "answer_id"), "mean": citations.mean_precision(checks, "answer_id"), "refusals": stats.refusals(outcomes),
        "answerable": stats.answerable_refusal(outcomes),
    }
    if judgments is not None and agreement is not None:
        usable = checks.crossJoin(F.broadcast(agreement.select("usable"))).where("usable").drop("usable")
        out["faithfulness"] = judge.faithfulness(usable, judgments)
    return out


def golden_run(pairs: DataFrame, checks: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """pairs with status and reason after validation and redundancy, numeric risks of the accepted, yield.

    pairs: pair_id, doc_id, question, answer, evidence; checks: pair_id, method; chunks: chunk_id, doc_id, pos, text.
    """
    v = golden.validated(pairs, checks, golden.document_index(chunks))
    v = durable(v.join(pairs.select("pair_id", "doc_id", "question", "answer", "evidence"), "pair_id"))
    copies = golden.redundant(v).where("duplicate_of IS NOT NULL")
    v = v.join(copies.select(F.col("pair_id").alias("__p"), "duplicate_of"), F.col("pair_id") == F.col("__p"), "left").drop("__p")
    again = F.col("duplicate_of").isNotNull()
    v = durable(
        v.withColumn("reason", F.when(again, F.concat(F.lit("redundant (of "), F.col("duplicate_of").cast("string"), F.lit(")"))).otherwise(F.col("reason")))
        .withColumn("status", F.when(again, "rejected").otherwise(F.col("status")))
    )
    kept = v.where("status = 'accepted'")
    risks = kept.join(curate.cited_source(kept, chunks), "pair_id").select("pair_id", unsupported_numbers("answer", "source").alias("numbers")).where(F.size("numbers") > 0)
    return {"pairs": v, "risks": risks, "yield": golden.yield_report(v)}


def judge_run(pairs: DataFrame, judge_items, positives: int = 8, negatives: int = 8) -> dict[str, DataFrame]:
    """controls in batches, the judgments of judge_items(DataFrame) -> (item_id, verdict), and their agreement."""
    controls = durable(judge.batches(judge.control_set(pairs, positives, negatives)))
    judged = durable(judge_items(controls))
    return {"controls": controls, "judgments": judged, "agreement": judge.agreement(controls, judged)}


def index_run(queries: DataFrame, vectors: DataFrame, k: int = 10, builds: int = 3) -> dict[str, DataFrame]:
    """points (build, probes, recall, identical) of several builds, their aggregate by probes, and
    same: whether two searches of one build agree."""
    retrieval.check_same_keys(vectors, vectors)
    exact, points, same = durable(retrieval.dense_search(queries, vectors, k)), [], None
    for build in range(builds):
        # a build differs in what its centroids are fitted on
        index = retrieval.InvertedFile(vectors, k=k, seed=build)
        for probes in sorted({1, max(1, index.probes // 2), index.probes}):
            found = durable(index.search(queries, k, probes))
            if same is None:
                again = index.search(queries, k, probes)
                same = found.exceptAll(again).unionAll(again.exceptAll(found)).agg((F.count(F.lit(1)) == 0).alias("same"))
            r = retrieval.index_recall(found, exact, k).agg(F.avg("recall").alias("recall"), F.avg(F.col("identical").cast("double")).alias("identical"))
            points.append(r.select(F.lit(build).alias("build"), F.lit(probes).alias("probes"), "recall", "identical"))
    p = durable(reduce(DataFrame.unionByName, points))
    total = p.groupBy("probes").agg(F.count(F.lit(1)).alias("builds"), F.median("recall").alias("recall"), F.min("recall").alias("least"), F.max("recall").alias("most"))
    return {"points": p, "by_probes": total, "same": same}


def triage(pairs: DataFrame, flags: DataFrame, verdicts: DataFrame) -> dict[str, DataFrame]:
    """The summary of the flags, pairs after human verdicts, and verdicts on pairs that aren't there."""
    return {"summary": curate.summary(flags, pairs), "pairs": curate.with_verdicts(pairs, verdicts), "orphans": curate.orphans(verdicts, pairs)}
