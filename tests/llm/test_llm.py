"""The corpus operators: against brute force, libraries and planted cases; odd inputs."""

import gc
import hashlib
import math
import random
import re
import weakref
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from harness import differs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from parchment.llm import components, decontamination, exact_dedup, line_dedup, near_dedup, pieces, pii, queries, sharding, substring_dedup, token_counts, toxicity
from parchment.llm.queries import tokenizer_file

MODEL, BYTES = tokenizer_file("piece_bpe_32k.model"), tokenizer_file("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, text_sha256 string, size string, score string, key string"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "x", "x", "x") for i, t in rows], SCHEMA)


def words(n, seed, low=3, high=9):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(low, high))) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (None, "no id"), (5, "x" * 70_000), (6, words(12_000, 1)), (7, "é😀 ﬁ\x00 ▁<s>"), (8, "one"), (8, "one"), (9, "\n\n\n")]


# -- SQL and shape ----------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, sf, name):
    assert not differs(queries.QUERIES[name](spark, sf), queries.ORACLES[name], sf)


def everything(spark, d):
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, toxic int")
    items = spark.createDataFrame([(1, words(30, 77)), (2, None), (3, "")], "item_id bigint, text string")
    return {
        "near": near_dedup.near_duplicates(d),
        "pieces": pieces.roundtrip(d, MODEL),
        "passages": substring_dedup.repeated_passages(d),
        "leaks": decontamination.contaminated(d, items),
        "shard": sharding.shard(d),
        "tokens": token_counts.token_counts(d, BYTES),
        "exact": exact_dedup.exact_dedup(d),
        "lines": line_dedup.line_dedup(d),
        "toxic": toxicity.toxicity(d, labels),
        "pii": pii.digest(pii.find_pii(d)),
    }


def test_odd_rows(spark):
    out = {k: v.collect() for k, v in everything(spark, docs(spark, ODD)).items()}
    for k in ("pieces", "shard", "tokens", "exact", "lines", "toxic", "pii"):
        assert len(out[k]) == len(ODD), k
    assert len(out["near"]) == 9 and {r.class_id for r in out["near"] if r.doc_id in (1, 2, 3, 9)} == {1}
    assert not out["passages"] and not out["leaks"]
    assert sum(r.kept for r in out["exact"] if r.doc_id == 8) == 0 and sum(r.kept for r in out["exact"]) == 6


def test_empty_tables(spark):
    for k, v in everything(spark, docs(spark, [])).items():
        assert v.count() == 0, k


# -- near duplicates --------------------------------------------------------------------------


def test_near_duplicates_are_those_of_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, _ = brute.near_classes([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()])
    got = near_dedup.near_duplicates(d).collect()
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = {c: sum(x == c for x in want.values()) for c in set(want.values())}
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_a_large_group_of_near_copies(spark):
    base = words(200, 5).split()
    r = random.Random(9)
    rows = []
    for i in range(150):
        w = list(base)
        w[r.randrange(200)] = f"edit{i}x{r.randrange(99)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, words(200, 100 + i)) for i in range(20)]
    want, _ = brute.near_classes(rows)
    assert {x.doc_id: x.class_id for x in near_dedup.near_duplicates(docs(spark, rows)).collect()} == want


def test_near_copies_in_a_family_of_variants_below_the_threshold(spark):
    base, r, rows = words(200, 15).split(), random.Random(21), []

    def edited(w, n, tag):
        w = list(w)
        for k in r.sample(range(len(w)), n):
            w[k] = f"{tag}x{k}"
        return w

    for i in range(400):
        v = edited(base, 3, f"v{i}")
        rows.append((i, " ".join(v)))
        if i % 4 == 0:
            rows.append((10_000 - i, " ".join(edited(v, 2, f"c{i}"))))
    want, sims = brute.near_classes(rows)
    got = {x.doc_id: x.class_id for x in near_dedup.near_duplicates(docs(spark, rows)).collect()}
    planted = [(i, 10_000 - i) for i in range(0, 400, 4) if sims[i, 10_000 - i] >= 0.8]
    assert len(planted) > 50 and [p for p in planted if got[p[0]] != got[p[1]]] == []
    assert got == want


def test_samples_draw_weighted_jaccard():
    r = np.random.default_rng(4)
    h = r.integers(1, 2**63, 400, dtype=np.uint64)
    a, b = (np.sort(h[:300]), np.sort(h[60:]))
    wa, wb = 1 + (a % np.uint64(7)).astype(float) / 7, 1 + (b % np.uint64(5)).astype(float) / 5
    exact = near_dedup.similarity((a, wa), (b, wb))
    x = near_dedup.samples(a, wa, np.array([0]), 1024)[:, 0]
    y = near_dedup.samples(b, wb, np.array([0]), 1024)[:, 0]
    assert abs((x == y).mean() - exact) < 0.05


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 9), (9, 8), (5, 5)], "a bigint, b bigint")
    assert {tuple(r) for r in components.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7), (9, 7)}


def test_rounds_of_components_leave_plans_small(spark):
    path = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    got = components.components(path)
    assert {tuple(r) for r in got.collect()} == {(i, 0) for i in range(301)}
    # the estimate that the driver keeps for the next plan, which doubled its digits with each round
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2**64


# -- SentencePiece ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


ALPHABET = list("aabcdeehilnorstu  ▁\n.,-'é😀ß\x00\t012<s>/=") + ["the", "ing", " a", "   ", "tion", "=="]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join))
def test_pieces_are_the_librarys(sp, text):
    table = pieces.prefix_table(MODEL)
    ids = table.encode(text)
    want = sp.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(ids, np.uint32).tolist() == want
    assert table.decode(ids) == sp.decode(want)


def test_whole_documents_round_trip(spark, sf, sp):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in d.collect()}
    for r in queries.op2_sentencepiece(spark, sf).collect():
        ids = sp.encode(text[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_long_units_take_linear_time(sp):
    text = words(1, 3, 60_000, 60_000) + "a" * 40_000
    assert np.frombuffer(pieces.prefix_table(MODEL).encode(text), np.uint32).tolist() == sp.encode(text, add_bos=True, add_eos=True)


# -- token counts -----------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word ", "a", "  ", "\n", "12", "'s", "é", "<|endoftext|>", "<|endo", "!?", "xyz" * 9]), max_size=300).map("".join))
def test_spliced_counts_are_the_librarys(text):
    t = token_counts.tokenizer(BYTES)
    want = len(t.encode(text, add_special_tokens=False))
    assert token_counts.count_tokens(t, text, 80, 8) == token_counts.count_tokens(t, text, 300, 40) == want


@pytest.mark.parametrize("text", ["a" * 90_000, " " * 90_000 + "x", "1" * 70_000 + "b c" * 9_000, "\n" * 70_000])
def test_without_a_common_boundary_the_overlap_widens(text):
    t = token_counts.tokenizer(BYTES)
    assert token_counts.count_tokens(t, text) == len(t.encode(text, add_special_tokens=False))


def test_token_counts(spark, sf):
    t = token_counts.tokenizer(BYTES)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op6_token_counts(spark, sf).collect():
        n = len(t.encode(text[r.doc_id], add_special_tokens=False))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text[r.doc_id].encode()), n > 1024)


# -- passages ---------------------------------------------------------------------------------


def test_passages_are_those_of_brute_force(spark, sf):
    d = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    passage, near = words(60, 42), words(60, 42).split()
    near[30] = "changed"
    d += [(9001, words(80, 1) + "\n" + passage), (9002, passage + "\n" + words(50, 2)), (9003, words(30, 3) + "\n" + " ".join(near)), (9004, words(90, 4))]
    got = substring_dedup.repeated_passages(docs(spark, d))
    rows = {(r.doc_id, r.paragraph, r.keep_doc_id) for r in got.where("kind = 'line'").collect()}
    assert rows == {(a, b, c) for a, b, c, _ in brute.passage_classes(d)}
    assert {i for i, _, _ in rows if i > 9000} == {9001, 9002, 9003}
    rest = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs(spark, d), got).collect()}
    assert passage in rest[9001] and passage not in rest[9002] and rest[9004] == d[-1][1]


def test_passages_in_a_family_of_variants_below_the_threshold(spark):
    r = random.Random(3)
    base, rows = words(100, 11).split(), []

    def edited(w, n, tag):
        w = list(w)
        for k in r.sample(range(len(w)), n):
            w[k] = f"{tag}x{k}"
        return w

    for i in range(400):
        v = edited(base, 2, f"v{i}")
        rows.append((i, " ".join(v)))
        if i % 10 == 0:
            rows.append((10_000 - i, " ".join(edited(v, 1, f"c{i}"))))
    got = substring_dedup.repeated_passages(docs(spark, rows)).where("kind = 'line'")
    assert {(x.doc_id, x.paragraph, x.keep_doc_id) for x in got.collect()} == {(a, b, c) for a, b, c, _ in brute.passage_classes(rows)}


def test_every_repeated_run_holds_a_reported_one(spark, sf):
    d = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    w = words(51, 43).split()
    wrapped = "\n".join(" ".join(w[k : k + 9]) for k in range(0, 51, 9))
    d += [(9001, words(70, 5) + " " + " ".join(w) + " " + words(40, 6)), (9002, words(30, 7) + "\n" + wrapped + "\n" + words(8, 8)), (9003, words(5, 44) + " " + " ".join(w[:50]) + " " + words(9, 45))]
    d += [(9004, words(20, 9) + "\n" + wrapped.upper() + " " + words(40, 6))]
    got = substring_dedup.repeated_passages(docs(spark, d)).where("kind = 'run'")
    found = {(r.doc_id, k) for r in got.collect() for k in range(r.first_word, r.first_word + r.n_words)}
    for i, k in brute.run_starts(d):
        assert sum((i, x) in found for x in range(k, k + 51)) >= substring_dedup.WINDOW, (i, k)
    for r in got.collect():
        assert brute.alike_elsewhere(d, r.doc_id, r.first_word, substring_dedup.WINDOW), r
    # 50 equal words are not a run of over 50
    assert {i for i, _ in found if i > 9000} == {9001, 9002, 9004}
    rest = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs(spark, d), got).collect()}
    assert rest[9001] == d[-4][1] and len(rest[9002].split()) <= 38 + 25 and w[25] not in rest[9002].split() and rest[9003] == d[-2][1]


def test_a_passage_of_very_many_documents_and_a_doc_id_of_text(spark):
    passage = words(55, 51)
    rows = [(f"d{i:04}", words(30 + i % 7, 5000 + i) + " " + passage + " " + words(12, 9000 + i)) for i in range(600)]
    d = spark.createDataFrame([("x", *r) for r in rows], "key string, doc_id string, text string").repartition(7)
    got = substring_dedup.repeated_passages(d).collect()
    whole = [r for r in got if r.class_docs == 600]
    assert {r.doc_id for r in whole} == {i for i, _ in rows} and {r.keep_doc_id for r in whole} == {"d0000"}
    assert {r.doc_id for r in whole if r.kept} == {"d0000"}


def test_bands_find_what_is_asked_for():
    bands, rows = substring_dedup.tuned(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999


# -- decontamination --------------------------------------------------------------------------


def test_leaks_are_found_and_clean_documents_left(spark):
    items = [(i, ". ".join(words(12, 500 + 10 * i + k).capitalize() for k in range(3)) + ".") for i in range(40)]
    r = random.Random(2)
    rows, planted = [], set()
    for i in range(120):
        body = [words(r.randint(5, 300), 3000 + i)]
        if i % 4 == 0:
            at = r.randrange(40)
            body.insert(r.randint(0, 1), items[at][1].upper() if i % 8 else items[at][1])
            planted.add((i, at))
        rows.append((i, " ".join(body)))
    half = items[7][1].split(". ")[0]
    rows.append((999, words(50, 1) + " " + half))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.contaminated(docs(spark, rows), bench)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == planted
    brute_hits = {(i, k) for i, t in rows for k, item in items if " ".join(brute.words(item)) in " ".join(brute.words(t))}
    assert brute_hits == planted


def test_wand_finds_what_scoring_everything_finds():
    items = [(i, words(20, 900 + i % 7, 2, 3) + " " + words(10, 950 + i, 2, 3)) for i in range(60)]
    index, longest = decontamination.build_index(items, 5)
    text = " ".join(words(40, 900 + i % 9, 2, 3) for i in range(30)) + " " + items[3][1]
    w = decontamination.Words(pa.array([text]))
    found = {(i, first) for _, i, _, first, _ in decontamination.search(index[0], w, longest, 0.3)}
    p, want = index[0], set()
    for at in range(0, len(w.hash), longest):
        have = set(w.hash[at : at + 2 * longest].tolist())
        for i in range(60):
            score = sum(x for k, it, x in zip(p.key, p.item, p.impact, strict=True) if it == i and int(p.terms[k // p.maxima.shape[1]]) in have)
            if score >= 0.3:
                want.add((i, at))
    assert found == want and found


def test_short_items_and_items_without_spaces(spark):
    items = [(1, "Short Item"), (2, "一二三四五六七八九十百千万上下左右中大小月日"), (3, "yes"), (4, None), (5, "?!")]
    rows = [(1, "a short, item here"), (2, "short of an item"), (3, "前文" + items[1][1] + "后文"), (4, "Yes. " + words(30, 8)), (5, "yesterday"), (6, "一二三")]
    got = decontamination.contaminated(docs(spark, rows), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (3, 2), (4, 3)}
    assert {(r.first_word, r.past_word) for r in got if r.item_id == 1} == {(1, 3)}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", "漢", "字", "かな", "ไทย", "é", "、", ".", "x1", "𠀀", "가나", "\n"]), max_size=12).map("".join), st.text(max_size=10))
def test_words_of_scripts_without_spaces(a, b):
    w = decontamination.Words(pa.array([a, b, "", a]))
    for i, t in enumerate((a, b, "", a)):
        low, high = w.text_at[i], w.text_at[i + 1]
        found = [bytes(w.data[f:p]).decode() for f, p in zip(w.first[low:high], w.past[low:high], strict=True)]
        assert found == brute.words(t)


# -- sharding ---------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 24, 25, 1000])
def test_the_permutation_is_one(spark, n):
    got = [r[0] for r in spark.range(n).select(sharding.permuted("id", n, 7)).collect()]
    assert sorted(got) == list(range(n)) and (n < 24 or got != list(range(n)))


def test_shards(spark, sf):
    rows = queries.op5_sharding(spark, sf).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    by = [sorted(r.slot for r in rows if r.shard == s) for s in range(24)]
    assert all(x == list(range(len(x))) for x in by) and max(map(len, by)) - min(map(len, by)) <= 1
    assert all(r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r["size"] == len(text[r.doc_id].encode()) + 8 for r in rows)
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard(spark.read.parquet(f"{sf}/documents.parquet").repartition(5, "lang")).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}


# -- exact copies and lines -------------------------------------------------------------------


def test_the_longest_original_stays(spark):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs(spark, [(1, "ab"), (2, "a b"), (3, " ab"), (4, None), (5, "\n\n"), (6, "a b")])).collect()}
    assert got == {1: (2, 3, False), 2: (2, 3, True), 3: (2, 3, False), 4: (5, 2, False), 5: (5, 2, True), 6: (6, 1, True)}


def test_lines(spark):
    line = "A line that is Shared by many"
    rows = [(1, line + "\nown\n" + line), (2, "  " + line.lower() + "\t\nx"), (3, line), (4, line[:-1] + "Y"), (5, None), (6, "short\nÉ" * 3), (7, "short"), (8, "short")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.line_dedup(docs(spark, rows)).collect()}
    # A-Z alone fold: the last letter of 4 is a y then, which makes it the line's largest holder
    assert got[1] == (3, 2, "own") and got[2] == (2, 1, "x") and got[3] == (1, 1, "") and got[4] == (1, 0, rows[3][1])
    assert got[5] == (1, 0, "") and got[7][1] == 0
    whole = line_dedup.without_shared_lines(docs(spark, rows))
    assert whole.columns == docs(spark, rows).columns and {r.doc_id: r.n_chars for r in whole.collect()}[1] == 3


# -- toxicity ---------------------------------------------------------------------------------


def test_toxicity_is_learnt_from_the_other_rows(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(d, labels).join(labels, "doc_id").where("held_out").select("doc_id", "score", "predicted", "toxic").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id)
    rank = out.score.rank()
    pos = out.toxic == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.95 and (out.predicted == out.toxic).mean() > 0.97
    assert out[(out.predicted == 1)].toxic.mean() > 0.95


def test_a_pair_of_terms_says_what_no_weights_can():
    r = np.random.default_rng(0)
    x = r.integers(0, 2, (20_000, 2))
    rows = [(np.flatnonzero(v), np.ones(v.sum(), np.float32)) for v in x]
    # one term or the other, not both: no bias and weights tell these apart
    m = toxicity.fit(np.array([10, 20]), rows, (x[:, 0] ^ x[:, 1]).astype(np.float32), epochs=20)

    def logits(pair):
        return [m.bias, m.bias + m.weight[0], m.bias + m.weight[1], m.bias + m.weight.sum() + pair]

    def right(z):
        return [v > 0 for v in z] == [False, True, True, False]

    assert right(logits(float(m.factor[0] @ m.factor[1]))) and not right(logits(0.0))


def test_scores_are_the_plain_sum_over_pairs():
    r = np.random.default_rng(5)
    texts = pa.array([words(40, 600 + i, 2, 6) for i in range(20)] + ["", None, "x"])
    _, bucket, _ = toxicity.terms(texts)
    buckets = np.unique(bucket)[::3]
    column = np.full(1 << toxicity.BITS, -1, np.int32)
    column[buckets] = np.arange(len(buckets))
    m = toxicity.Machine(column, -0.3, r.normal(size=len(buckets)) * 0.1, r.normal(size=(len(buckets), 4)) * 0.1)
    got = m.score(texts)
    text, bucket, count = toxicity.terms(texts)
    for i in range(len(texts)):
        x = {int(column[b]): 1 + math.log(c) for t, b, c in zip(text, bucket, count, strict=True) if t == i and column[b] >= 0}
        z = m.bias + sum(m.weight[k] * v for k, v in x.items())
        z += sum(float(m.factor[a] @ m.factor[b]) * x[a] * x[b] for a in x for b in x if a < b)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)


# -- personal data ----------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()  # noqa: B023
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


PARTS = ["a@b.c", "x.y@d-e.org", "@", ".", "+", "_", "1.2.3.4", "256.1.1.1", "001.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+12", "é", "😀", " ", "-", "12", "4111111111111111", "\n"]


def test_base_spans_are_those_of_brute_force(spark):
    r = random.Random(6)
    rows = [(i, "".join(r.choice(PARTS) for _ in range(r.randint(0, 14)))) for i in range(1500)]
    rows += [(5000, "1" * 60_000), (5001, "a" * 60_000 + "@b.c"), (5002, "1 " * 30_000), (5003, ("9" * 12 + "  ") * 2000)]
    got = {x.doc_id: x for x in pii.digest(pii.find_pii(docs(spark, rows))).collect()}
    for i, t in rows:
        want = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, t[:80], want)
        assert set(want) <= set(got[i].spans.split(",")) | {""}
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(w.startswith(k + ":") for w in want) for k in pii.KINDS]


def sound(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == "email":
        plain = re.sub(r"[(\[]dot[)\]]", ".", re.sub(r"[(\[]at[)\]]", "@", span.replace(" ", "").lower()))
        return bool(re.fullmatch(r"[a-z0-9_%+-]+(\.[a-z0-9_%+-]+)*@([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z]{2,24}", plain))
    if kind == "ip":
        return all(len(x) <= 3 and int(x) <= 255 and (x == "0" or x[0] != "0") for x in span.replace(" ", "").replace(",", ".").split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and digits[0] in "3456" and luhn(digits)
    return bool(re.fullmatch(r"00[1-9][0-9]{8,12}|[2-9][0-9]{2}[2-9][0-9]{6}", digits))


def test_added_spans_are_sound_and_spelt_out_addresses_among_them(spark):
    r, rows = random.Random(12), []
    for i in range(900):
        body = words(6, i).split()
        name, host = words(1, 7000 + i), words(1, 8000 + i)
        card = f"4{r.randrange(10**14):014}"
        card += str(next(d for d in range(10) if luhn(card + str(d))))
        put = [f"{name}@{host}.org", f"mail {name} (at) {host} (dot) com", f"{name} (at) {host} (dot) 7", "card " + ".".join(card[k : k + 4] for k in range(0, 16, 4)), f"no {r.randrange(10**15, 10**16)}", f"call {r.randrange(200, 999)} {r.randrange(200, 999)}-{r.randrange(1000, 9999)}"]
        rows.append((i, " ".join([*body[:3], put[i % 6], *body[3:]])))
    out = pii.find_pii(docs(spark, rows)).collect()
    text, more = dict(rows), [(x.doc_id, pii.KINDS[s.kind], s.start, s.stop) for x in out for s in x.more]
    good = [sound(k, text[i][a:b]) for i, k, a, b in more]
    assert sum(good) >= 0.9 * len(good)
    spelt = {i for i, k, _, _ in more if k == "email"}
    assert len(spelt & set(range(1, 900, 6))) >= 140 and not spelt & set(range(2, 900, 6))
    assert len({i for i, k, _, _ in more if k == "card"} & set(range(3, 900, 6))) >= 140
    # labels as the operator takes them
    for x in pii.spans(docs(spark, rows[:60])).collect():
        for o in x.others:
            if o.span.wide:
                assert o.span.sound == sound(pii.KINDS[o.span.kind], text[x.doc_id][o.span.start : o.span.stop])


def test_trees_rate_like_their_sql(spark):
    r = random.Random(1)
    table = [{**{k: r.randrange(v) for k, v in pii.LEVELS.items()}, "held_out": i % 4 == 0, "base": i % 3 == 0, "n": 5, "positives": 0} for i in range(300)]
    for row in table:
        row["positives"] = 5 if row["digits"] > 4 and row["cue"] else r.randrange(2)
    m = pii.fit(table)
    names = list(pii.LEVELS)
    d = spark.createDataFrame([tuple(row[k] for k in names) for row in table[:50]], ", ".join(f"{k} int" for k in names))
    got = [x[0] for x in d.select(F.expr(m.sql("x").replace("x.", ""))).collect()]
    assert got == pytest.approx([m.score(row) for row in table[:50]], abs=1e-6)


# -- the pipeline -----------------------------------------------------------------------------


def test_pipeline(spark, sf, tmp_path):
    d = spark.read.parquet(f"{sf}/documents.parquet").withColumn("note", F.lit("x"))
    ids = {r[0] for r in d.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, d, sf)
        out.write.parquet(str(tmp_path / str(k)))
        new = spark.read.parquet(str(tmp_path / str(k)))
        if k + 1 < len(corpus_pipeline.STAGES):
            assert new.columns == d.columns, name
        rows = {r[0] for r in new.select("doc_id").collect()}
        before = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
        if name == "toxicity":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            gone = {r.doc_id for r in toxicity.toxicity(d, labels).where("predicted = 1").collect()}
            assert rows == ids - gone
        elif name == "minhash near-dedup":
            want, _ = brute.near_classes(before)
            assert rows == set(want.values())
        elif name == "benchmark decontamination":
            items = [brute.words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            clean = {i for i, t in before if not any(" ".join(x) in " ".join(brute.words(t)) for x in items)}
            assert rows == clean
        else:
            assert rows == {i for i, _ in before}, name
        ids, d = rows, new
    got = {tuple(r) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {tuple(r) for r in d.collect()}


def test_pipeline_of_an_empty_table(spark, sf):
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs(spark, []), sf)
        assert out.count() == 0 and (k == 4 or out.columns == docs(spark, []).columns), name


def test_pipeline_keeps_odd_rows(spark, sf):
    assert corpus_pipeline.tokenize(spark, docs(spark, ODD), sf).count() == len(ODD)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs(spark, ODD), sf)
        assert out.columns == docs(spark, ODD).columns
        assert out.where("doc_id IS NULL").count() == 1


def test_a_worker_keeps_the_tables_of_one_operator():
    table = weakref.ref(pieces.prefix_table(MODEL))
    assert pieces.prefix_table(MODEL) is table()
    near_dedup.samples(np.arange(9, dtype=np.uint64), np.ones(9), np.array([0]), 64)
    gc.collect()
    assert table() is None
