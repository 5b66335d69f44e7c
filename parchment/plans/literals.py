"""Small literal tables, the same rows in Spark and in SQL, for patterns that no fixture holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOREM = "Sponsors of a study keep records of every subject. Each record names the site and the visit. "

#: name -> (schema, rows)
TABLES: dict[str, tuple[str, list[tuple]]] = {
    "identifier_text": (
        "id bigint, text string",
        [
            (1, "See 21 CFR 314.50(a)(2) and 21 CFR 314.50 again, then 42 U.S.C. 262a(b)."),
            (2, "As required by 21\nCFR Part 312.32, and 21 C.F.R. §§ 211.42(d)."),
            (3, "An impossible 71 CFR 10.1 and a valid 50 cfr 17.3(C) or 50 CFR 17.3(c)."),
            (4, "subject to 21 CFR 28 \n 812.2 of this chapter"),
            (5, "Docket FDA–2022–D–0814 and FDA-1996-\nD-0012; 85 FR 12345."),
            (6, "Registered as NCT 01234567 and NCT01234567, see ICH E6(R2) and ich q10."),
            (7, "Nothing to see here."),
        ],
    ),
    "pages": (
        "doc_id bigint, page bigint, text string",
        [
            (1, 1, "TABLE OF CONTENTS\n1. Scope ....... 2\n2. Aim ....... 3\n3. Plan ....... 4\n4. End ....... 5"),
            (1, 2, "STUDY PROTOCOL HEADER\n1. Scope of the Study\nText of the scope goes here.\n1.1 Primary Aim\nMore text."),
            (1, 3, "STUDY PROTOCOL HEADER\nII. Methods and Materials\nA. Selection of Sites\nplain text\n21 CFR 820.30 Design Controls"),
            (1, 6, "STUDY PROTOCOL HEADER\n2.1 lower case stays prose\n3 Ends like a sentence.\nB. Final Remarks"),
            (2, 1, "no headings at all\njust text"),
            (3, 1, "IV. Results\n" + LOREM),
        ],
    ),
    "quality": (
        "doc_id bigint, stored string, text string",
        [
            (1, "ok", LOREM * 20),
            (2, None, "a b c d e " * 60),
            (3, None, (LOREM + "\x03\x03\x03") * 10),
            (4, None, (LOREM + "Informedconsentforeachpatientwillbeobtained ") * 20),
            (5, "broken_encoding", LOREM * 20),
            (6, None, "a b c short"),
            (7, None, "x " * 79 + "word " * 121),
        ],
    ),
    "chunks": (
        "chunk_id string, doc_id bigint, pos bigint, text string",
        [
            ("a1", 1, 0, "The sponsor must report within 30 \ndays of the event, and the  record\nis kept for a year."),
            ("a2", 1, 1, "A second part of the first document says that Treponema 28 \npallidum was found at the site."),
            ("b1", 2, 0, "Investigators should not submit the form; the agency may require it. Subjects will be told."),
            ("b2", 2, 1, "Contains nonbinding\nrecommendations. The agency recommends that you provide the following."),
        ],
    ),
    "claims": (
        "claim_id bigint, answer_id bigint, chunk_id string, quote string",
        [
            (1, 1, "a1", "The sponsor must report within 30"),
            (2, 1, "a1", "days of the event, and the record is kept"),
            (3, 1, "a1", "too short"),
            (4, 2, "a1", "Treponema 28 \npallidum was found at the site"),
            (5, 2, "a2", "Treponema pallidum was found at the site"),
            (6, 2, "zz", "The sponsor must report within 30"),
            (7, 3, "b1", "The sponsor must report within 30 days"),
            (8, 3, "b1", "INVESTIGATORS SHOULD NOT SUBMIT THE FORM"),
            (9, 4, "b1", "  the agency may require it. Subjects will  "),
            (10, 4, "b2", "recommendations. The\u00a0agency recommends that"),
        ],
    ),
    "hits": (
        "retriever string, query_id bigint, chunk_id bigint, score double, rank bigint",
        [
            ("sparse", 1, 10, 9.0, 1), ("sparse", 1, 11, 7.0, 2), ("sparse", 1, 12, 1.0, 3), ("dense", 1, 11, 0.9, 1), ("dense", 1, 13, 0.4, 2),
            ("sparse", 2, 20, 3.0, 1), ("dense", 2, 21, 0.5, 1), ("dense", 2, 22, 0.5, 2), ("dense", 3, 30, 0.7, 1), ("sparse", 4, 41, 2.0, 1), ("sparse", 4, 40, 2.0, 2),
        ],
    ),
    "truth": ("query_id bigint, chunk_id bigint", [(1, 11), (1, 13), (1, 99), (2, 22), (4, 40), (4, 41)]),
    "probes": ("query_id bigint, slice string", [(1, "sections"), (2, "sections"), (3, "unanswerable"), (4, "titles"), (5, "titles")]),
    "scored": (
        "query_id bigint, answerable boolean, score double",
        [(1, True, 9.0), (2, True, 7.5), (3, True, 4.0), (4, True, 3.0), (5, False, 4.0), (6, False, 2.0), (7, False, 1.0), (8, False, 3.5), (9, True, 8.0)],
    ),
    "outcomes": (
        "query_id bigint, slice string, refused boolean, error string, tokens_in bigint, tokens_out bigint",
        [
            (1, "exact_identifier", True, None, 900, 40), (2, "exact_identifier", False, None, 800, 200), (3, "section_lookup", False, None, 700, 150), (4, "section_lookup", True, None, 650, 30),
            (5, "unanswerable", True, None, 600, 25), (6, "unanswerable", True, None, 610, 22), (7, "section_lookup", False, "timeout", 0, 0), (8, "title_lookup", False, None, 500, 90),
        ],
    ),
    "golden": (
        "pair_id string, doc_id bigint, question string, answer string, chunk_id string, quote string",
        [
            ("1::001", 1, "When must the sponsor report?", "The sponsor must report the event within 30 days of the event.", "a1", "The sponsor must report within 30"),
            ("1::002", 1, "When must the sponsor report?", "The sponsor must report the event within 60 days of the event.", "a1", "The sponsor must report within 30"),
            ("1::003", 1, "", "An answer without any question that is long enough.", "a1", "The sponsor must report within 30"),
            ("1::004", 1, "What was found at the site by whom?", "Short answer.", "a2", "pallidum was found at the site."),
            ("2::001", 2, "Should investigators submit the form?", "Investigators should submit the form when the agency asks.", "b1", "Investigators should not submit the form"),
            ("2::002", 2, "What does the agency recommend to you?", "The sponsor shall provide the following to the agency at once.", "b2", "The agency recommends that you provide the following."),
            ("2::003", 2, "Is it quoted from thin air anywhere?", "A fabricated statement that nobody can find anywhere at all.", "b1", "This sentence is nowhere in the source."),
            ("2::004", 2, "Should investigators submit a form?", "Investigators should submit the form when the agency asks it.", "b1", "Investigators should not submit the form"),
        ],
    ),
    "verdicts": ("pair_id string, verdict string, reason string", [("1::002", "reject", "wrong number"), ("2::001", "reject", "polarity"), ("1::001", "keep", None), ("9::009", "reject", "gone")]),
    "judged": (
        "item_id string, control string, verdict string",
        [(f"pos::{i}", "positive", "supported" if i < 4 else "partial") for i in range(5)]
        + [(f"neg::{i}", "negative", "unsupported" if i < 4 else "supported") for i in range(5)]
        + [("neg::9", "negative", None), ("item::1", None, "supported")],
    ),
    "spans": (
        "id bigint, start bigint, stop bigint",
        [(1, 0, 150), (1, 150, 600), (1, 600, 700), (1, 700, 1200), (2, 0, 50), (3, 0, 300), (3, 300, 350), (3, 350, 380), (3, 380, 900), (4, 0, 100), (4, 100, 180)],
    ),
    "page_chars": ("doc_id bigint, chars bigint", [(1, 2000), (1, 1500), (1, 20), (2, 10), (2, 0), (3, 500), (3, 600), (3, 700), (3, 800), (3, 900), (3, 40), (4, None), (5, 99), (5, 100)]),
    "outline": (
        "doc_id bigint, pos bigint, title string, page bigint",
        [(1, 1, "Scope of Work", 1), (1, 2, "Methods", 2), (1, 3, "Results", 3), (2, 1, "One", 1), (3, 1, "a", 1), (3, 2, "", 2), (3, 3, "Intro", 3), (4, 1, "Alpha", 1), (4, 2, "Beta", 1), (4, 3, "Gamma", 2)]
        + [(5, i, f"Entry {i}", i % 2 + 1) for i in range(20)],
    ),
    "toc": (
        "doc_id bigint, pos bigint, title string, level bigint, page bigint",
        [(1, 1, "Scope of the Study", 1, 2), (1, 2, "Primary Aim", 2, 2), (1, 3, "Methods and Materials", 1, 3), (1, 4, "Selection of Sites", 2, 3), (1, 5, "Final Remarks", 1, 6), (3, 1, "Results", 1, 1), (3, 2, "Sponsors of a study", 2, 1)],
    ),
    "outline_pages": ("doc_id bigint, n_pages bigint", [(i, 9 if i < 5 else 2) for i in range(1, 6)]),
    "catalogue": (
        "id bigint, title string, media string, issued string, office string",
        [
            (1, '<a href="/x/1">Draft &amp; Final Guidance</a>', '<a class="m" href="/media/77/download">PDF</a>', "03/15/1999", "Center A<br>Office of B, C and D,Office of E<br/>Center A"),
            (2, '<a href="https://h.example/x">Guidance for Industry: Rev. 2</a>', None, "13/45/2001", ""),
            (3, "Plain title", '<a href="/media/9/download">x</a>', "01/02/1900", "Office &lt;X&gt;"),
            (4, '<a href="/y">Final Guidance, Revision 3</a>', '<a href="/media/10/download">x</a>', "12/31/2015", None),
        ],
    ),
    "builds": ("build bigint, ef bigint, recall double, p95 double", [(b, ef, round(0.5 + ef / 100 + b / 1000, 6), 2.0 + b + ef / 10) for b in range(3) for ef in (4, 8, 16)]),
    "timed": ("answer_id bigint, method string, ms double", [(1, "exact", 0.004), (1, "exact", 0.004), (2, "exact", 0.1), (2, "normalized", 0.1), (3, "exact", 0.006), (4, "unverified", 0.3), (5, "normalized", 0.2)]),
    "runs": ("chunking string, retriever string, recall double", [("fixed", "sparse", 0.955), ("fixed", "dense", 0.013), ("fixed", "fused", 0.163), ("semantic", "sparse", 0.972), ("semantic", "dense", 0.0), ("semantic", "fused", 0.239)]),
}


def literal(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def values(name: str) -> str:
    """The table as a DuckDB relation."""
    schema, rows = TABLES[name]
    cols = [c.split(" ") for c in schema.split(", ")]
    types = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}

    def show(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v).upper() if isinstance(v, bool) else repr(v)

    body = ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)
    return f"(SELECT {', '.join(f'CAST({c} AS {types[t]}) AS {c}' for c, t in cols)} FROM (VALUES {body}) AS t({', '.join(c for c, _ in cols)}))"
