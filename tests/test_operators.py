"""Rules of single operators on rows made by hand."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchment.functions import identifiers, text
from parchment.operators import answers, chunking, citations, contextual, curate, dedup, fusion, golden, judge, metrics, providers, retrieval, sampling, sections, stats
from parchment.functions import text as t_
from parchment.plans.literals import LOREM, literal
from parchment.sources import feeds, files
from parchment.streaming import events


def column(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i")
    return [r[0] for r in rows.select(fn(F.col("v"))).collect()]


# -- chunking ---------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=4000), st.integers(201, 600), st.integers(0, 200))
def test_windows_cover_the_text(t, target, overlap):
    spans = chunking.windows(t, 0, len(t), target, min(overlap, target - 1))
    assert [s for s, _ in spans] == sorted(s for s, _ in spans)
    seen = set()
    for s, e in spans:
        assert 0 <= s < e <= len(t)
        seen.update(range(s, e))
    assert len(seen) == len(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 900), min_size=1, max_size=8), st.integers(0, 300))
def test_sections_cover_the_text(sizes, lead):
    t = ("word " * 2000)[: lead + sum(sizes) + 37]
    edges = [lead]
    for n in sizes:
        edges.append(edges[-1] + n)
    spans = chunking.section_spans(t, [(a, b, i) for i, (a, b) in enumerate(zip(edges, edges[1:]))], 400, 50)
    seen = {i for s, e, _ in spans for i in range(s, e)}
    assert {i for i, c in enumerate(t) if c.strip()} <= seen


def test_oversize_spans_are_cut_without_fragments():
    spans = chunking.split_oversize("x" * 1026, [(0, 1026)], 1024)
    assert spans == [(0, 1026)]
    assert all(e - s <= 1024 + chunking.LOOK_AHEAD + chunking.MIN_CHUNK for s, e in chunking.split_oversize("ab. " * 2000, [(0, 8000)], 1024))


def test_degenerate_parameters_are_refused(spark):
    d = spark.createDataFrame([(1, "x")], "doc_id bigint, text string")
    for target, overlap in ((200, 10), (500, 500), (500, -1)):
        with pytest.raises(ValueError):
            chunking.chunk_fixed(d, target, overlap)


def test_chunks_are_exact_slices_and_dense(spark):
    d = spark.createDataFrame([(1, "Ein Satz mit ß. " * 200), (2, ""), (3, " \n "), (4, None)], "doc_id bigint, text string")
    c = chunking.assembled(chunking.chunk_fixed(d), d, "fixed").collect()
    t = "Ein Satz mit ß. " * 200
    assert {r.doc_id for r in c} == {1}
    assert [r.idx for r in sorted(c, key=lambda r: r.start)] == list(range(len(c)))
    assert all(r.text == t[r.start : r.stop] for r in c)


# -- sections ---------------------------------------------------------------------------------


def test_headings(spark):
    lines = ["1.1 Primary Aim", "2. lower", "IV. Results", "B. Remarks", "TWO WORDS", "XYZ", "21 CFR 820.30 Design", "3 Ends here.", "Scope ..... 4", "", "3. " + "w " * 20]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, v string").orderBy("i")
    got = [tuple(r) for r in rows.select(*sections.heading("v")).collect()]
    assert got[:5] == [("1.1 Primary Aim", 2), (None, None), ("IV. Results", 1), ("B. Remarks", 2), ("TWO WORDS", 1)]
    assert all(h is None for h, _ in got[5:])


def test_running_headers_are_furniture(spark):
    found = {(r.heading, r.page) for r in sections.from_pages(literal(spark, "pages")).where("doc_id = 1").collect()}
    assert ("STUDY PROTOCOL HEADER", 2) in found and ("STUDY PROTOCOL HEADER", 3) not in found
    # three pages later it is a heading again
    assert ("STUDY PROTOCOL HEADER", 6) in found


def test_outline_is_anchored(spark):
    p = spark.createDataFrame([(1, 1, "Title\nScope of Work"), (1, 2, "x METHODS y")], "doc_id bigint, page bigint, text string")
    o = [(1, 1, "Scope of Work", 1, 1), (1, 2, "METHODS", 1, 2), (1, 3, "absent", 2, 2), (1, 4, "gone", 1, 9)]
    got = sections.from_outline(spark.createDataFrame(o, "doc_id bigint, pos bigint, title string, level bigint, page bigint"), p).orderBy("idx").collect()
    assert [(r.heading, r.start, r.stop) for r in got] == [("Scope of Work", 6, 23), ("METHODS", 23, 24), ("absent", 24, 32)]


def test_titles_are_found_by_their_beginning_and_with_other_white_space():
    page = "x A long title about records\nand sites of a study, then   text. Scope\n of   Work"
    whole = "A long title about records and sites of a study, which goes on in the outline alone"
    assert sections._place(whole, page, 0) == 2 and sections._place("Scope of Work", page, 0) == page.index("Scope")
    assert sections._place("abc", page, 0) is None and sections._place("A long title about records", page, 3) is None


# -- identifiers and text ---------------------------------------------------------------------


def test_identifiers(spark):
    got = {(r.id, r.kind, r.canonical_detailed, r.repaired) for r in identifiers.extract(literal(spark, "identifier_text")).collect()}
    assert (1, "cfr", "21 CFR 314.50(a)(2)", False) in got and (1, "usc", "42 USC 262a(b)", False) in got
    assert (2, "cfr", "21 CFR 312.32", False) in got and (2, "cfr", "21 CFR 211.42(d)", False) in got
    assert not any(c.startswith("71 ") for _, _, c, _ in got)
    assert {(3, "cfr", "50 CFR 17.3(C)", False), (3, "cfr", "50 CFR 17.3(c)", False)} <= got
    assert (4, "cfr", "21 CFR 812.2", True) in got
    assert {c for i, k, c, _ in got if k == "docket"} == {"FDA-2022-D-0814", "FDA-1996-D-0012"}
    assert {c for i, k, c, _ in got if k == "ich"} == {"ICH E6(R2)", "ICH Q10"}


def test_atoms_tell_case_apart(spark):
    assert column(spark, ["50 CFR 17.3(C)", "50 CFR 17.3(c)"], identifiers.atom) == ["idz50zqcqfqrz17z3zqcz", "idz50zqcqfqrz17z3zcz"]


def test_offsets_are_code_points(spark):
    got = column(spark, ["é😀 ab x ab", "", None], lambda c: F.transform(text.offsets(c, "ab"), lambda m: m["start"]))
    assert got == [[3, 8], [], None] or got == [[3, 8], [], []]


def test_numeric_claims(spark):
    got = column(spark, ["within 5,630. days", "kept for a year", "annually, thirty times", "a supplier"], text.numeric_claims)
    assert got == [["5630"], ["1"], ["1", "30"], []]


def test_quality_labels(spark):
    got = {r.doc_id: r.label for r in literal(spark, "quality").select("doc_id", text.quality_label("text").alias("label")).collect()}
    assert got == {1: "ok", 2: "character_spaced", 3: "broken_encoding", 4: "space_collapsed", 5: "ok", 6: "ok", 7: "ok"}


def test_catalogue_fields(spark):
    c = literal(spark, "catalogue")
    r = {x.id: x for x in c.select("id", text.offices("office").alias("o"), text.us_date("issued").cast("string").alias("d")).collect()}
    assert r[1].o == ["Center A", "Office of B, C and D", "Office of E"] and r[1].d == "1999-03-15"
    assert r[2].d is None and r[3].d is None and r[3].o == ["Office <X>"]


# -- duplicates -------------------------------------------------------------------------------


def test_clusters(spark):
    a = " ".join(f"w{i}" for i in range(60))
    b = a.replace("w59", "other")
    rows = [(1, a), (2, a.upper()), (3, b + " tail"), (4, "something else entirely that is not alike"), (5, "..."), (6, "!!")]
    got = dedup.clusters(spark.createDataFrame(rows, "id bigint, text string")).orderBy("size", ascending=False).collect()
    assert [(r.canonical_id, r.size, r.members) for r in got][0] == (3, 3, [1, 2, 3])
    assert got[0].similarity_floor < 1


def test_sentences_and_their_distances_shuffle_nothing(spark):
    d = spark.createDataFrame([(1, "Short. " + "a longer sentence that stands on its own here. " * 3), (2, "one"), (3, None), (4, "")], "doc_id bigint, text string")
    s = chunking.sentences(d)
    assert _exchanges(s) == 0
    got = {(r.doc_id, r.pos): r.sentence for r in s.collect()}
    assert len(got) == 4 and got[1, 0].startswith("Short. a longer") and got[2, 0] == "one"
    v = s.select("doc_id", "pos", F.when(F.col("pos") == 1, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))).alias("vec")).coalesce(1)
    x = chunking.distances(v)
    assert _exchanges(x) == 0 and sorted(tuple(r) for r in x.collect()) == [(1, 0, 1.0), (1, 1, 1.0)]


def test_odd_characters_are_counted_not_all_others_replaced(spark):
    d = spark.createDataFrame([("x" * 498 + "\x01\x9f",), ("\t\n\r" * 200,), (None,)], "text string").select(t_.control_share("text").alias("s"))
    assert "regexp_replace" not in d._jdf.queryExecution().executedPlan().toString()
    assert [r.s for r in d.collect()] == [2 / 500, 0.0, None]


def test_overlaps_form_no_joined_rows(spark):
    line = "a line that stands in every one of the texts here"
    d = spark.createDataFrame([(i, f"{line} and own{i} words{i} of{i} it{i}") for i in range(40)], "id bigint, text string")
    x = dedup.overlaps(d.where("id < 4"), d)
    assert _exchanges(x) == 0
    assert {(r.a, r.b) for r in x.collect()} == {(a, b) for a in range(4) for b in range(40) if a != b}


def test_all_pairs_of_a_cluster(spark):
    # the least id is similar to both others, which are similar to each other too
    body = [f"word{i}" for i in range(200)]
    texts = [" ".join(body), " ".join([*body[:-1], "changed"]), " ".join(["changed", *body[1:]]), " ".join(body[:20])]
    d = spark.createDataFrame(list(enumerate(texts, 1)), "id bigint, text string")
    assert {(r.a, r.b) for r in dedup.pairs(d).collect()} == {(1, 2), (1, 3), (2, 3)}


@pytest.mark.parametrize("t", [0.5, 0.85, 1.0])
def test_no_similar_pair_lacks_a_shared_key(spark, t):
    import random

    rng, rows = random.Random(7), []
    for i in range(0, 1200, 2):
        n = rng.choice([1, 2, 3, 5, 6, 7, 8, 12, 13, 20, 40, 47, 333])
        x = [rng.getrandbits(63) for _ in range(n)]
        # as unlike as the threshold allows: some left out, some put in
        out = next(k for k in range(n, -1, -1) if (n - k) / (n + k) >= t)
        rows += [(i, x), (i + 1, x[: n - out] + [rng.getrandbits(63) for _ in range(out)])]
    s = spark.createDataFrame(rows, "id bigint, set array<bigint>")
    got = {(r.a, r.b) for r in dedup.candidates(dedup.shared_keys(s, t), t).collect()}
    assert got >= {(i, i + 1) for i in range(0, 1200, 2)}


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    assert {r.component for r in dedup.components(e).collect()} == {0}


# -- retrieval --------------------------------------------------------------------------------


def test_sparse_dot_is_the_score(spark):
    c = spark.createDataFrame([("a", "alpha beta beta gamma"), ("b", "beta delta"), ("c", "")], "chunk_id string, text string")
    q = spark.createDataFrame([(1, "beta beta gamma"), (2, "unknown words")], "query_id bigint, text string")
    index = retrieval.LexicalIndex(c)
    dot = index.postings.join(index.query_vectors(q), "term").groupBy("query_id", "chunk_id").agg(F.sum(F.col("qtf") * F.col("weight")).alias("s"))
    want = {(r.query_id, r.chunk_id): round(r.s, 9) for r in dot.collect()}
    got = {(r.query_id, r.chunk_id): r.score for r in index.search(q, 5).collect()}
    assert got == pytest.approx(want) and set(got) == {(1, "a"), (1, "b")}


def _exchanges(df) -> int:
    return df._jdf.queryExecution().sparkPlan().toString().count("Join") + df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_postings_stay_where_their_chunks_are(spark):
    c = spark.createDataFrame([("a", "alpha beta beta gamma"), ("b", "beta delta"), ("c", "")], "chunk_id string, text string")
    assert _exchanges(retrieval.postings(retrieval.LexicalIndex(c).terms)) == 0
    got = {(r.chunk_id, r.term): (r.tf, r.df) for r in retrieval.LexicalIndex(c).postings.collect()}
    assert got == {("a", "alpha"): (1, 1), ("a", "beta"): (2, 2), ("a", "gamma"): (1, 1), ("b", "beta"): (1, 2), ("b", "delta"): (1, 1)}


def test_an_embedding_is_formed_once_though_filtered(spark):
    d = spark.createDataFrame([("alpha beta alpha",), ("",), (None,)], "text string")
    v = d.select(retrieval.hashed_embedding("text", 16).alias("vec")).where("vec IS NOT NULL")
    assert v._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [round(sum(x * x for x in r.vec), 9) for r in v.collect()] == [1.0]


def test_ties_break_before_the_cut(spark):
    s = spark.createDataFrame([(1, c, 1.0) for c in "dcba"], "query_id bigint, chunk_id string, score double")
    assert [r.chunk_id for r in retrieval.ranked(s, 2, "x").orderBy("rank").collect()] == ["a", "b"]


def test_mismatched_keys_are_refused(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "chunk_id bigint") for xs in ((1, 2), (1, 3)))
    with pytest.raises(ValueError):
        retrieval.check_same_keys(a, b)
    retrieval.check_same_keys(a, a)


def test_fusion(spark):
    h = [literal(spark, "hits").where(F.col("retriever") == r) for r in ("sparse", "dense")]
    top = fusion.rrf(h, 1).where("query_id = 1").first()
    assert top.chunk_id == 11 and top.score == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)
    one = fusion.minmax(h, {"sparse": 1, "dense": 1}, 5).where("query_id = 3").first()
    assert one.score == 0.25
    for bad in ({}, {"sparse": 0, "dense": 0}, {"sparse": -1, "dense": 2}):
        with pytest.raises(ValueError):
            fusion.weighted_rrf(h, bad, 5)


def test_embeddings_have_unit_length(spark):
    got = column(spark, ["alpha beta gamma", "", "of the and"], retrieval.hashed_embedding)
    assert sum(x * x for x in got[0]) == pytest.approx(1) and got[1] is None and got[2] is None


# -- metrics ----------------------------------------------------------------------------------


def test_precision_divides_by_the_cut_and_recall_by_the_relevant(spark):
    p = metrics.per_query(literal(spark, "hits"), literal(spark, "truth"), literal(spark, "probes")).where("query_id = 1 AND retriever = 'sparse'").first()
    assert (p.hit_1, p.recall_5, p.precision_5, p.mrr_10) == (0.0, pytest.approx(1 / 3), 0.2, 0.5)


def test_one_class_alone_has_no_separability(spark):
    s = spark.createDataFrame([(1, True, 1.0)], "query_id bigint, answerable boolean, score double")
    r = metrics.separability(s).first()
    assert (r.n_pos, r.n_neg, r.threshold, r.accuracy) == (1, 0, None, None)
    assert metrics.auc(s).first().auc is None


# -- citations --------------------------------------------------------------------------------


def test_citation_cascade(spark):
    q = literal(spark, "claims")
    got = {r.claim_id: r for r in citations.verify(q.select("claim_id", "chunk_id", "quote"), literal(spark, "chunks")).collect()}
    assert {i: r.method for i, r in got.items()} == {
        1: "exact", 2: "normalized", 3: "too_short", 4: "wrong_chunk", 5: "line_number_ambiguous", 6: "unverified", 7: "unverified", 8: "unverified", 9: "exact",
    }
    source = {r.chunk_id: r.text for r in literal(spark, "chunks").collect()}
    two = got[2]
    assert two.matched_text == source["a1"][two.start : two.stop] and " ".join(two.matched_text.split()) == "days of the event, and the record is kept"
    assert got[4].found_in == "a2"


def test_no_claims_have_no_precision(spark):
    c = spark.createDataFrame([(1, "exact"), (2, None)], "answer_id bigint, method string")
    got = {r.answer_id: (r.precision, r.grounded) for r in citations.precision(c, "answer_id").collect()}
    assert got == {1: (1.0, True), 2: (None, False)}


# -- triage -----------------------------------------------------------------------------------


def pair_flags(spark, answer, source):
    p = spark.createDataFrame([("p", answer, source)], "pair_id string, answer string, source string")
    return {(r.kind, r.severity) for r in curate.flags(p).collect()}


def test_flags(spark):
    assert ("modal_strengthened", "high") in pair_flags(spark, "You must file.", "You should file it within the month, they say.")
    assert ("modal_added_to_unmodalised_source", "medium") in pair_flags(spark, "You must file.", "File it.")
    assert ("polarity_inverted", "high") in pair_flags(spark, "They shall submit it.", "They shall not submit it.")
    assert ("polarity_inverted", "high") not in pair_flags(spark, "They shall submit it.", "They shall not submit it. Later all others shall submit it.")
    assert ("actor_not_in_source", "medium") in pair_flags(spark, "The sponsor must file.", "One must file.")
    assert ("unsupported_number", "high") in pair_flags(spark, "Within 60 days.", "Within 30 days.")
    assert pair_flags(spark, "Within 60 days.", "  ") == {("no_source", "high")}
    assert not pair_flags(spark, "Bookmarks are not required.", "Bookmarks are not needed.")
    assert not pair_flags(spark, "The FDA must be notified.", "The FDA must be notified at once.")


def test_split_words_are_still_modals(spark):
    assert column(spark, ["the requir ed form", "annotation"], lambda c: curate.strength(curate.modals(c))) == [4, 0]


def test_verdict_files_are_checked(spark):
    v = spark.createDataFrame([("a", "keep"), ("b", "reject")], "pair_id string, verdict string")
    no = spark.createDataFrame([], "pair_id string, seq int, verdict string")
    files.checked_verdicts(v, no)
    with pytest.raises(ValueError):
        files.checked_verdicts(v.withColumn("verdict", F.lit("perhaps")), no)
    with pytest.raises(ValueError):
        files.checked_verdicts(v, spark.createDataFrame([("a", 1, "reject")], no.schema))


def test_redundant_pairs_depend_on_kept_ones_only(spark):
    def words(lo, hi):
        return " ".join(f"word{i}" for i in range(lo, hi))

    rows = [("a", "accepted", words(0, 10)), ("b", "accepted", words(1, 11)), ("c", "accepted", words(2, 12)), ("d", "rejected", words(0, 10))]
    got = {r.pair_id: r.duplicate_of for r in golden.redundant(spark.createDataFrame(rows, "pair_id string, status string, answer string")).collect()}
    assert got == {"a": None, "b": "a", "c": None}


def test_diff(spark):
    r = golden.diff(spark.createDataFrame([(1, "a b  c", "a x c"), (2, "a  b", "a b")], "id bigint, quote string, source string")).orderBy("id").collect()
    assert [(o.op, o.token) for o in r[0].ops if o.token.strip()] == [("same", "a"), ("del", "b"), ("ins", "x"), ("same", "c")]
    assert [x.clean for x in r] == [False, True]


# -- judging ----------------------------------------------------------------------------------


def test_negatives_come_from_other_documents(spark):
    p = spark.createDataFrame([(f"{d}::{i}", d, f"answer number {d} {i}", f"quote of {d} {i}") for d in "ab" for i in range(3)], "pair_id string, doc_id string, answer string, quote string")
    c = judge.control_set(p, 2, 6)
    assert c.where("control = 'positive'").count() == 2
    neg = [r.source_id.split("|") for r in c.where("control = 'negative'").collect()]
    assert len(neg) == 6 and all(a[0] != b[0] for a, b in neg)
    alone = p.where("doc_id = 'a'")
    assert judge.control_set(alone, 2, 2).where("control = 'negative'").count() == 0


def test_an_unusable_judge_gates_everything(spark):
    items = spark.createDataFrame([(f"pos::{i}", "positive") for i in range(4)], "item_id string, control string")
    v = spark.createDataFrame([(f"pos::{i}", "supported") for i in range(4)], "item_id string, verdict string")
    a = judge.agreement(items, v)
    r = a.first()
    assert r.negative_rate is None and r.usable is False
    assert judge.gated(items, a).count() == 0


# -- answers, context, sampling, statistics ---------------------------------------------------


def test_refusal_cascade(spark):
    p = spark.createDataFrame([(1, "x", 9.0, 2), (2, "x", 1.0, 2), (3, "x", None, 0)], "query_id bigint, prompt string, top_score double, n_chunks bigint")
    g = answers.gated(p, 5.0)
    assert {r.query_id: r.refusal_source for r in g.collect()} == {1: None, 2: "score_gate", 3: "no_context"}
    stored = spark.createDataFrame([], "query_id bigint, answer string, refused boolean, citations array<struct<chunk_id:string,quote:string>>")
    a = {r.query_id: r for r in answers.answered(g, providers.ReplayGenerator(stored)).collect()}
    assert a[1].error and not a[1].refused and a[2].refused and a[2].error is None


def test_model_json(spark):
    raw = spark.createDataFrame([(1, '{"pairs":[{"question":" q ","answer":"a","evidence":[{"chunk_id":"c","quote":"x"},{"chunk_id":"d","quote":" "}]}]}'), (2, "not json")], "doc_id bigint, response string")
    r = answers.parsed_pairs(raw).collect()
    assert len(r) == 1 and r[0].question == "q" and len(r[0].evidence) == 1
    j = spark.createDataFrame([(0, '{"judgments":[{"item_id":"i","verdict":"Supported"},{"item_id":"i","verdict":"partial"},{"item_id":"k","verdict":"?"}]}')], "batch int, response string")
    assert [tuple(x) for x in answers.parsed_judgments(j).collect()] == [("i", "supported")]


def test_blurbs_apply_once(spark):
    c = spark.createDataFrame([("a", "body"), ("b", "other")], "chunk_id string, embed_text string")
    b = spark.createDataFrame([("a", "About a.")], "chunk_id string, blurb string")
    once = contextual.apply_blurbs(c, b)
    twice = contextual.apply_blurbs(once, b)
    want = {"a": "About a.\n\nbody", "b": "other"}
    assert {r.chunk_id: r.embed_text for r in once.collect()} == {r.chunk_id: r.embed_text for r in twice.collect()} == want
    with pytest.raises(ValueError):
        contextual.requests(c, c, 0)


def test_no_hits_cost_at_least_as_much(spark):
    d = spark.createDataFrame([(1, LOREM * 60), (2, "short")], "doc_id bigint, text string")
    c = spark.createDataFrame([(f"c{i}", 1 + i // 9, i, "x" * 100) for i in range(12)], "chunk_id string, doc_id bigint, pos bigint, text string")
    r = contextual.requests(c, d, 3)
    low, high = (contextual.estimated_cost(r, 1.0, 5.0, 512, hits=h).first().cost for h in (True, False))
    assert low <= high


def test_strata_take_turns(spark):
    d = spark.createDataFrame([(i, "big" if i < 90 else f"s{i}") for i in range(100)], "doc_id bigint, stratum string")
    got = sampling.rotating(d, "stratum", 11).collect()
    assert len({r.stratum for r in got}) == 11
    assert sampling.rotating(d, "stratum", 5).count() == 5


def test_percentiles_of_few(spark):
    s = spark.createDataFrame([("a", 1.0), ("a", 9.0), ("b", None)], "k string, v double")
    assert [tuple(r) for r in stats.latency(s, "k", "v").collect()] == [("a", 2, 5.0, 9.0, 1.0, 9.0)]


def test_costs_need_usable_prices(spark):
    c = spark.createDataFrame([(10, 5)], "tokens_in bigint, tokens_out bigint")
    assert stats.token_totals(c, 1.0, 1.0).first().cost == pytest.approx(15e-6)
    for bad in (None, -1.0, float("nan"), float("inf")):
        assert stats.token_totals(c, bad, 1.0).first().cost is None


# -- sources and streams ----------------------------------------------------------------------


def test_jsonl(spark, tmp_path):
    empty = files.read_jsonl(spark, str(tmp_path / "none.jsonl"), files.FETCHED)
    assert empty.count() == 0
    (tmp_path / "in.jsonl").write_text('{"doc_id":"b","ok":true,"new":1}\n\n{"doc_id":"a"}\n')
    rows = files.read_jsonl(spark, str(tmp_path / "in.jsonl"), files.FETCHED)
    assert {r.doc_id: r.ok for r in rows.collect()} == {"a": None, "b": True}
    files.write_jsonl(rows, str(tmp_path / "out"), "doc_id")
    back = files.read_jsonl(spark, str(tmp_path / "out"), files.FETCHED)
    assert sorted(r.doc_id for r in back.collect()) == ["a", "b"]


def test_hashes_and_cache(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(b"abc")
    f = files.file_hashes(spark, str(tmp_path / "f.bin"))
    pins = f.select("path", F.lit("0").alias("pin"))
    assert files.hash_mismatches(f, pins).count() == 1
    req = spark.createDataFrame([("k1", "alpha"), ("k1", "alpha"), ("k2", "beta")], "key string, text string")
    cache = files.encode_missing(req, spark.createDataFrame([("k2", [1.0])], "key string, embedding array<double>"), providers.HashedEmbedder().documents)
    assert [r.key for r in cache.collect()] == ["k1"]


def test_feeds(spark):
    raw = spark.createDataFrame([('<a href="/t">T</a>', '<a href="/media/5/x">m</a>', "01/02/2003", "Final", "C", "O", '<a href="/d">None found</a>'), ("x", None, "", "", "", "", "")], "title string, media string, issued string, status string, center string, offices string, docket string")
    r = feeds.guidance(raw, "https://h.example").collect()
    assert len(r) == 1 and r[0].doc_id == "guidance-5" and r[0].docket is None and r[0].url == "https://h.example/media/5/x"
    study = '{"protocolSection":{"identificationModule":{"nctId":"NCT00000012","briefTitle":"B"}},"documentSection":{"largeDocumentModule":{"largeDocs":[{"typeAbbrev":"Prot","filename":"Prot_000.pdf","size":7},{"typeAbbrev":"ICF","filename":"x.pdf"}]}}}'
    r = feeds.registry(spark.createDataFrame([(study,)], "response string"), "https://h.example").collect()
    assert [(x.doc_id, x.sponsor_class, x.declared_bytes) for x in r] == [("registry-NCT00000012-Prot_000", "UNKNOWN", 7)]
    assert feeds.retry_after("7") == 7 and feeds.retry_after("900") == 60 and feeds.retry_after("soon") is None and feeds.backoff(2) == 4


def test_stream_counts_like_the_batch(spark, sf, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf}/events.parquet", tmp_path / "in" / "events.parquet")
    batch = spark.read.parquet(f"{sf}/events.parquet")
    q = events.windowed_counts(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), late="1 day")
    run = q.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.windowed_counts(batch).agg(F.sum("n")).first()[0] == batch.count()
