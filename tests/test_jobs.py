"""Composed jobs, the stored collection, vector search and rules that fixtures don't hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment import jobs, reports
from parchment.functions import identifiers, text
from parchment.operators import chunking, citations, contextual, dedup, golden, judge, retrieval, sections, stats, store
from parchment.plans.literals import LOREM, literal
from parchment.sources import files


def column(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i")
    return [r[0] for r in rows.select(fn(F.col("v"))).collect()]


# -- text rules -------------------------------------------------------------------------------

# written out by hand: words whose sharing says nothing about evidence
EMPTY_WORDS = "some each every under over into upon within without both either neither only same including include includes included provided provide provides using used use uses".split()


def test_coverage_looks_past_empty_words(spark):
    got = column(spark, [" ".join(EMPTY_WORDS) + " records"], lambda c: F.array_join(text.content_words(c), " "))
    assert got == ["records"]
    assert column(spark, ["each sponsor uses records within sites"], lambda c: text.coverage(c, F.lit("each uses within without"))) == [0.0]


def test_white_space_is_that_of_unicode(spark):
    odd = ["a b", "a  b", " a　\u0085b ", "a\x1c\x0bb"]
    assert column(spark, odd, text.collapsed) == ["a b"] * 4
    assert len(set(column(spark, odd, text.content_hash))) == 1


def test_quotes_are_located_with_offsets_into_the_source(spark):
    source = "Start. The sponsor must\nreport 28 \nevery event 12\nwithout   delay (see a.b). End"
    quotes = ["The sponsor must report 28 every", "report every event without delay (see a.b)", "see a.b", "see axb", "\\E event", ""]
    rows = spark.createDataFrame([(i, q, source) for i, q in enumerate(quotes)], "i int, quote string, source string")
    m, a, b = citations.located("quote", "source")
    got = {r.i: (r.m, r.a, r.b) for r in rows.select("i", m.alias("m"), a.alias("a"), b.alias("b")).collect()}
    assert got[0] == ("normalized", 7, source.index("every") + 5)
    assert got[1] == ("line_number_ambiguous", source.index("report"), source.index("). End") + 1)
    assert got[2] == ("exact", source.index("see"), source.index("see") + 7)
    assert got[3] == got[4] == got[5] == (None, None, None)


def test_quality_shares_count_tokens_between_spaces(spark):
    rows = ["x " * 100 + "word " * 100, "  " + "a bb\n" * 150, "short", "", None]
    assert column(spark, rows, text.single_char_share) == [0.5, 0.5, 0.0, 0.0, None]


def test_atoms_of_a_text_are_those_of_its_identifiers(spark):
    t = literal(spark, "identifier_text")
    want = {r.id: set(r.atoms) for r in identifiers.atoms(identifiers.extract(t)).collect()}
    got = {r.id: set(r.a) for r in t.select("id", identifiers.atoms_of("text").alias("a")).collect()}
    assert got == {**{r.id: set() for r in t.collect()}, **want}


# -- retrieval --------------------------------------------------------------------------------


def _chunks(spark, rows):
    return spark.createDataFrame([(i, h, t, f"{h}\n\n{t}" if h else t) for i, h, t in rows], "chunk_id string, heading string, text string, embed_text string")


def test_atoms_find_the_citation_and_no_other(spark):
    c = _chunks(spark, [("a", "", "Rules of 21 CFR 314.50(a) apply here today"), ("b", "", "Rules of 21 CFR 314.81 and part 50 apply"), ("c", "", "21 CFR 50 and again 314 here")])
    q = spark.createDataFrame([(1, "21 CFR 314.50"), (2, "21 CFR 314.50(a)")], "query_id bigint, text string")
    hits = retrieval.LexicalIndex(c, mode="source").search(q, 3).collect()
    assert {r.query_id: r.chunk_id for r in hits if r["rank"] == 1} == {1: "a", 2: "a"}
    plain = {(r.query_id, r.chunk_id): r.score for r in retrieval.LexicalIndex(c, mode="source", atoms=False).search(q, 3).collect()}
    top = {(r.query_id, r.chunk_id): r.score for r in hits}
    assert top[1, "a"] - top[1, "c"] > plain[1, "a"] - plain.get((1, "c"), 0.0)


def test_heading_modes(spark):
    c = _chunks(spark, [("a", "Storage", "Storage of samples in the site"), ("b", "Storage", "nothing alike"), ("c", None, "no heading at all")])
    q = spark.createDataFrame([(1, "storage")], "query_id bigint, text string")
    found = {m: {r.chunk_id for r in retrieval.LexicalIndex(c, mode=m).search(q, 5).collect()} for m in ("prepend", "source", "strip")}
    assert found == {"prepend": {"a", "b"}, "source": {"a"}, "strip": set()}


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_the_index_finds_nine_of_ten_neighbours(spark, sf):
    e = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    v = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    exact = retrieval.dense_search(q, v, 10)
    rows = {r.vec_id: np.array(r.embedding, float) for r in e.collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    for r in exact.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("l")).collect():
        best = ids[np.lexsort((ids, -np.round(x @ rows[r.query_id], 9)))[:10]]
        assert [h.chunk_id for h in r.l] == best.tolist()
    recall = retrieval.index_recall(retrieval.InvertedFile(v).search(q, 10), exact, 10).agg(F.avg("recall"), F.count(F.lit(1))).first()
    assert recall[0] >= 0.9 and recall[1] == q.count()


def test_a_large_cell_and_many_queries_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PART", 16)
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    r = np.random.default_rng(2)
    rows = [(int(i), r.normal(size=4).round(3).tolist()) for i in range(100)]
    v = spark.createDataFrame(rows, "chunk_id bigint, vec array<float>")
    got = {(x.query_id, x.chunk_id) for x in retrieval.dense_search(v.toDF("query_id", "qvec"), v, 3).collect()}
    m = np.array([x for _, x in rows], np.float32).astype(float)
    want = {(i, int(j)) for i in range(100) for j in np.lexsort((np.arange(100), -np.round(m @ m[i], 9)))[:3]}
    assert got == want


def test_a_stored_collection(spark, tmp_path):
    c = spark.createDataFrame([(f"c{i}", f"{LOREM} word{i} {'alpha' if i % 2 else 'beta'}") for i in range(30)], "chunk_id string, text string")
    v = c.select("chunk_id", retrieval.hashed_embedding("text").alias("vec"))
    q = spark.createDataFrame([(1, "word7 alpha"), (2, "nothingknown")], "query_id bigint, text string").withColumn("qvec", retrieval.hashed_embedding("text"))
    lexical = retrieval.LexicalIndex(c)
    store.write(str(tmp_path / "full"), c, v, lexical)
    full = store.Collection(spark, str(tmp_path / "full"))
    rows = lambda d: {(r.query_id, r.chunk_id, round(r.score, 6), r["rank"]) for r in d.collect()}
    assert rows(full.search(q, 5, "sparse")) == rows(lexical.search(q, 5))
    assert full.search(q, 5, "dense", probes=full.meta["cells"]).count() == 10
    assert [r.chunk_id for r in full.search(q.where("query_id = 1"), 1, "hybrid").collect()] == ["c7"]
    store.write(str(tmp_path / "dense"), c, v)
    dense = store.Collection(spark, str(tmp_path / "dense"))
    for bad in ({"mode": "sparse"}, {"mode": "other"}):
        with pytest.raises(ValueError):
            dense.search(q, 5, **bad)
    with pytest.raises(ValueError):
        dense.search(q.drop("qvec"), 5)
    with pytest.raises(ValueError):
        dense.search(q.withColumn("qvec", F.array(F.lit(1.0))), 5)
    with pytest.raises(ValueError):
        store.write(str(tmp_path / "odd"), c, v.where("chunk_id <> 'c3'"))


def test_overlaps_answer_every_query(spark):
    rows = [(1, "a b c d e f g h"), (50, "a b c d e f g h"), (60, "a b c d e f g x"), (100, "z y x w v u"), (150, "")]
    d = spark.createDataFrame(rows, "id bigint, text string")
    got = {(r.a, r.b): round(r.similarity, 6) for r in dedup.overlaps(d.where("id % 50 = 0"), d).collect()}
    assert got == {(50, 1): 1.0, (50, 60): 0.6}


# -- jobs -------------------------------------------------------------------------------------


def test_extraction(spark):
    pages, outline = literal(spark, "pages"), literal(spark, "toc")
    out = jobs.extracted(pages, outline)
    d = {r.doc_id: r for r in out["documents"].collect()}
    assert d[1].n_pages == 4 and d[2].text == "no headings at all\njust text" and d[2].n_sections == 0 and d[1].label == "ok"
    assert d[1].n_identifiers == 1 and [r.canonical for r in out["identifiers"].collect()] == ["21 CFR 820.30"]
    s = sorted(((r.doc_id, r.idx, r.heading, r.start, r.stop) for r in out["sections"].collect()))
    # document 1 has a usable outline; its titles are cut out of the joined text
    assert [x[2] for x in s if x[0] == 1][:2] == ["Scope of the Study", "Primary Aim"]
    for doc, _, heading, start, _ in s:
        assert doc != 1 or d[1].text[start : start + len(heading)] == heading
    assert all(a[4] == b[3] for a, b in zip(s, s[1:]) if a[0] == b[0])


def test_chunks_know_their_canonical_copies(spark):
    body = LOREM * 12
    d = spark.createDataFrame([(1, body, "ok"), (2, body, "ok"), (3, "a b c d e " * 60, None)], "doc_id bigint, text string, label string")
    assert {r.doc_id for r in jobs.readable(d).collect()} == {1, 2}
    d = jobs.readable(d)
    parts = chunking.line_sections(d)
    c = jobs.chunked(d, parts, "fixed")
    rows = {r.chunk_id: r for r in c.collect()}
    copies = {k for k, r in rows.items() if r.duplicate_of}
    assert copies and all(rows[k].duplicate_of in rows and rows[k].duplicate_of not in copies for k in copies)
    r = jobs.chunk_report(c, parts, identifiers.extract(d, "doc_id")).first()
    assert r.n_chunks == len(rows) and r.marked_duplicate == len(copies) and r.cross_document >= 1
    assert jobs.largest_clusters(c).first()["documents"] == 2
    assert {s for s in jobs.chunked(d, parts, "semantic").select("strategy").distinct().toPandas()["strategy"]} == {"semantic"}


def test_the_grid_scores_every_strategy_under_every_retriever(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").limit(40).select("doc_id", "text", F.lit("ok").alias("label"))
    parts = chunking.line_sections(d)
    spans = chunking.chunk_structural(d, parts)
    c = chunking.assembled(spans, d, "structural", parts)
    q = spark.createDataFrame([("t1", "titles", d.first().text[:50], [(d.first().doc_id, 0, 100)]), ("u1", "unanswerable", "zzzz qqqq", [])], "query_id string, slice string, query string, spans array<struct<doc_id:bigint,start:bigint,stop:bigint>>")
    rows = jobs.grid(c, q, ("bm25", "dense", "hybrid rrf", "rerank bm25")).collect()
    assert {(r.retriever, r.slice) for r in rows} == {(n, s) for n in ("bm25", "dense", "hybrid rrf", "rerank bm25") for s in ("titles", "unanswerable")}
    best = next(r for r in rows if r.retriever == "bm25" and r.slice == "titles")
    assert best.n_queries == 1 and best.hit_10 == 1.0
    assert all(r.n_queries == 0 and r.n_unscorable == 1 for r in rows if r.slice == "unanswerable")


def test_reference_pairs_are_judged_in_one_run(spark):
    g = literal(spark, "golden")
    pairs = g.select("pair_id", "doc_id", "question", "answer", F.array(F.struct("chunk_id", "quote")).alias("evidence"))
    chunks = literal(spark, "chunks")
    checks = citations.verify(g.select(F.col("pair_id").alias("claim_id"), "chunk_id", "quote"), chunks).select(F.col("claim_id").alias("pair_id"), "method")
    out = jobs.golden_run(pairs, checks, chunks)
    rows = {r.pair_id: r for r in out["pairs"].collect()}
    # "30 days" and "60 days": the second answer repeats the first
    assert rows["1::001"].status == "accepted" and rows["1::002"].duplicate_of == "1::001" and rows["1::002"].status == "rejected"
    assert {r.reason: r.n for r in out["yield"].collect()}["redundant"] >= 1
    run = jobs.judge_run(g.select("pair_id", "doc_id", "answer", "quote"), lambda items: items.select("item_id", F.when(F.col("control") == "positive", "supported").otherwise("unsupported").alias("verdict")), 4, 4)
    a = run["agreement"].first()
    assert a.unjudged == 0 and a.positive_rate == 1.0


def test_two_searches_of_a_build_agree(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    v = e.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    out = jobs.index_run(q, v, builds=2)
    assert out["same"].first().same and out["points"].count() >= 4
    assert max(r.recall for r in out["by_probes"].collect()) >= 0.9


def test_diffs_are_subsequences(spark):
    rows = spark.createDataFrame([(1, "a  b c", "a b d c"), (2, "x " * 400, "x " * 399 + "y"), (3, "", None)], "id bigint, quote string, source string")
    got = {r.id: r for r in golden.diff(rows).collect()}
    for i, q, s in [(1, "a  b c", "a b d c"), (2, "x " * 400, "x " * 399 + "y")]:
        assert "".join(o.token for o in got[i].ops if o.op != "ins") == q and "".join(o.token for o in got[i].ops if o.op != "del") == s
    assert got[1].clean is False and got[3].clean is True and got[3].ops == []


# -- sources and reports ----------------------------------------------------------------------


def test_loads_and_cache(spark, tmp_path):
    m = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, True)], "doc_id string, seq int, ok boolean")
    assert {(r.doc_id, r.ok) for r in files.last_wins(m, "doc_id", "seq").collect()} == {("a", False), ("b", True)}
    c = spark.createDataFrame([("x", "fixed"), ("y", "structural")], "chunk_id string, strategy string")
    files.write_chunks(c, str(tmp_path / "chunks"))
    assert [r.chunk_id for r in files.read_chunks(spark, str(tmp_path / "chunks"), "fixed").collect()] == ["x"]
    assert files.read_chunks(spark, str(tmp_path / "chunks")).count() == 2
    keys = spark.range(1).select(files.cache_key(F.lit("t"), "m", 512, True).alias("a"), files.cache_key(F.lit("t"), "m", 512, False).alias("b"), files.cache_key(F.lit("t"), "m", 512, True).alias("c")).first()
    assert keys.a == keys.c != keys.b
    cache = spark.createDataFrame([("k", [1.0, 2.0])], "key string, embedding array<double>")
    assert files.one_dimension(cache, 2).count() == 1 and files.one_dimension(cache, 3).count() == 0
    cache.write.parquet(str(tmp_path / "t"))
    found, missing = files.tables_present(spark, {"t": str(tmp_path / "t"), "gone": str(tmp_path / "gone")})
    assert list(found) == ["t"] and [r.name for r in missing.collect()] == ["gone"]


def test_duplicates_point_to_their_canonical_chunk(spark):
    items = spark.createDataFrame([(1, "One  text of many words here"), (2, "one text OF many words here"), (3, "another")], "id bigint, text string")
    assert [tuple(r)[1:] for r in dedup.exact_groups(items).where("size > 1").collect()] == [(2, 1)]
    assert [tuple(r) for r in dedup.duplicate_of(dedup.clusters(items)).collect()] in ([(2, 1)], [(1, 2)])


def test_reports_show_what_the_payload_holds(spark):
    data = reports.payload({"counts": spark.createDataFrame([("b", 2000, None), ("a", 1, 0.5)], "name string, n int, share double"), "none": spark.createDataFrame([], "x int")})
    out = reports.markdown("Corpus", data, {"counts": "By name."})
    assert "| a | 1 | 0.5000 |\n| b | 2,000 | - |" in out and "No rows." in out and "By name." in out
    assert reports.as_json(data) == reports.as_json(reports.payload({"none": spark.createDataFrame([], "x int"), "counts": spark.createDataFrame([("a", 1, 0.5), ("b", 2000, None)], "name string, n int, share double")}))
    with pytest.raises(ValueError):
        reports.payload({"rows": spark.range(10)}, most=5)


def test_controls_and_layers(spark):
    assert judge.round_robin(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, i int"), "g", "i").count() == 3
    assert stats.most(spark.createDataFrame([(1, 5), (2, 5), (3, 9)], "k int, v int"), "v", "k", 2).collect()[1].k == 1
    assert sections.sectioned(literal(spark, "pages")).count() == sections.from_pages(literal(spark, "pages")).count()


def test_labels_and_clips(spark):
    assert column(spark, ["a  bb ccc dddd", "short", ""], lambda c: text.clipped(c, 7)) == ["a bb…", "short", ""]
    assert column(spark, ["x-NCT02942264-Prot_000::g::016", "fda-75426::g::085"], text.document_label) == ["NCT02942264", "fda-75426"]


def test_golden_files(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"pair_id":"b","question":"q","answer":"a","evidence":[{"chunk_id":"c","quote":"x"}],"doc_id":"d","shape":"fact","status":"rejected","reason":"no"}\n{"pair_id":"a"}\n')
    g = files.read_golden(spark, str(tmp_path / "g.jsonl"))
    files.write_golden(g, str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert len(list((tmp_path / "out").glob("part-*"))) == 1 and ['"pair_id":"a"' in lines[0], '"status":"draft"' in lines[0], '"status":"rejected"' in lines[1]] == [True] * 3
    assert files.read_golden(spark, str(tmp_path / "none")).count() == 0


def test_drafts_are_asked_for_what_is_checked(spark):
    c = spark.createDataFrame([(f"c{i}", 1, i, "word " * 10) for i in range(6)], "chunk_id string, doc_id bigint, pos bigint, text string")
    r = golden.draft_prompts(c, 3, budget=120).first()
    assert str(golden.MIN_ANSWER) in r.system and str(citations.MIN_QUOTE) in r.system
    assert "excerpts, spread evenly" in r.prompt and "[c0]" in r.prompt and "Write 3 pairs" in r.prompt
    checks = spark.createDataFrame([("x", "exact"), ("x", "unverified"), ("y", "exact"), ("z", None)], "answer_id string, method string")
    m = citations.mean_precision(checks, "answer_id").first()
    assert (m.answers, m.mean_precision, m.grounded) == (2, 0.75, 1)
    schema = contextual.blurb_schema(2)
    assert schema["required"] == ["1", "2"] and schema["additionalProperties"] is False
