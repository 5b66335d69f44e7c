"""Personal data: generators propose spans, boosted trees rate them, calibrated thresholds choose."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import documents

KINDS = ("email", "ip", "card", "phone")
#: The base of each kind. Possessive runs and the look-behinds change no match; they keep the
#: search linear in runs of letters or digits of any length.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What else may be one: addresses spelt out, numbers with other separators or without a plus.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?: ?[.,] ?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ ._/-]?[0-9]{4}){2}[ ._/-]?[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9])(?:00 ?[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
CUE = r"(?i)mail|contact|@|\bip\b|host|server|addr|card|visa|credit|konto|tarjeta|carte|tel|phone|call|fax|mobil"
#: Names and numbers of levels of a span's features.
LEVELS = {"kind": 4, "wide": 2, "digits": 8, "marks": 6, "before": 6, "after": 6, "cue": 2, "round": 2}
ROUNDS, RATE, PRECISION = 40, 0.3, 0.9

_DIGITS = "regexp_replace(h, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": "forall(split(h, '[.]'), x -> length(ltrim('0', x)) <= 3 and coalesce(cast(ltrim('0', x) as int), 0) <= 255)",
    "card": f"length({_DIGITS}) between 13 and 19 and luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) between 9 and 15",
}
_SPELT = r"regexp_replace(regexp_replace(lower(replace(x.h, ' ', '')), '[(\\[]at[)\\]]', '@'), '[(\\[]dot[)\\]]', '.')"
_QUADS = "regexp_replace(replace(x.h, ' ', ''), ',', '.')"
#: What makes a wider candidate sound: its normal form passes a strict check. That labels it; no feature sees it.
_SOUND = {
    "email": rf"{_SPELT} rlike '^[a-z0-9_%+-]+([.][a-z0-9_%+-]+)*@([a-z0-9]([a-z0-9-]*[a-z0-9])?[.])+[a-z]{{2,24}}$'",
    "ip": f"forall(split({_QUADS}, '[.]'), x -> length(x) <= 3 and cast(x as int) <= 255 and (x = '0' or left(x, 1) <> '0'))",
    "card": f"length({_DIGITS}) between 13 and 19 and {_DIGITS} rlike '^[3-6]' and luhn_check({_DIGITS})",
    "phone": f"{_DIGITS} rlike '^(00[1-9][0-9]{{8,12}}|[2-9][0-9]{{2}}[2-9][0-9]{{6}})$'",
}
_SPAN = "struct<kind:int,wide:int,start:int,stop:int,valid:boolean,sound:boolean,digits:int,marks:int,before:int,after:int,cue:int,round:int>"


def _class(c: str) -> str:
    return f"case when {c} = '' then 0 when {c} rlike '[0-9]' then 1 when {c} rlike '\\\\p{{L}}' then 2 when {c} rlike '\\\\s' then 3 when {c} rlike '[.,;:!?]' then 4 else 5 end"


def _spans(hits: str, gaps: str, kind: str, wide: int) -> str:
    """SQL: the hits as spans. Offsets are running sums of the lengths of gaps and hits."""
    valid = _VALID[kind].replace("(h,", "(x.h,") if not wide else "false"
    sound = _SOUND[kind].replace("(h,", "(x.h,") if wide else "false"
    digits = _DIGITS.replace("(h,", "(x.h,")
    return f"""case when coalesce(size({hits}), 0) = 0 then cast(array() as array<{_SPAN}>) else aggregate(
 arrays_zip({hits} as h, slice({gaps}, 1, size({hits})) as g, slice({gaps}, 2, size({hits})) as n),
 named_struct('at', 0, 'out', cast(array() as array<{_SPAN}>)),
 (s, x) -> named_struct('at', s.at + length(x.g) + length(x.h), 'out', concat(s.out, array(named_struct(
  'kind', {KINDS.index(kind)}, 'wide', {wide}, 'start', s.at + length(x.g), 'stop', s.at + length(x.g) + length(x.h), 'valid', {valid}, 'sound', {sound},
  'digits', case when length({digits}) = 0 then 0 when length({digits}) < 7 then 1 when length({digits}) < 10 then 2 when length({digits}) = 10 then 3
   when length({digits}) < 13 then 4 when length({digits}) < 16 then 5 when length({digits}) < 20 then 6 else 7 end,
  'marks', least(length(regexp_replace(x.h, '[\\\\p{{L}}0-9]', '')), 5),
  'before', {_class("right(x.g, 1)")}, 'after', {_class("left(x.n, 1)")},
  'cue', cast(right(x.g, 24) rlike '{CUE.replace(chr(92), chr(92) * 2)}' as int),
  'round', cast(x.h rlike '[()]' as int))))),
 s -> s.out) end""".replace(" as h,", ",").replace(" as g,", ",").replace(" as n)", ")").replace("x.h", "x['0']").replace("x.g", "x['1']").replace("x.n", "x['2']")


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its candidate spans, valid ones of the base first by kind and start, then the others.

    Offsets are code points, ends exclusive. A text without a digit or an at sign is not searched further.
    """
    d = documents(docs, id_col, text_col)
    generators = [(k, w, (WIDE if w else BASE)[k]) for w in (0, 1) for k in KINDS]
    none = F.array().cast("array<string>")
    at, digit = F.col("text").contains("@") | F.col("text").rlike(r"[(\[]at[)\]]"), F.col("text").rlike("[0-9]")
    d = d.withColumn("has_at", at).withColumn("has_digit", digit)
    names = [(f"h{i}", f"g{i}", k, w, p, F.col("has_at" if k == "email" else "has_digit")) for i, (k, w, p) in enumerate(generators)]
    d = d.select("doc_id", "text", *(F.when(can, F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(h) for h, _, _, _, p, can in names))
    d = d.select("*", *(F.when(F.size(h) > 0, F.split("text", p, -1)).otherwise(none).alias(g) for h, g, _, _, p, _ in names))
    d = d.select("doc_id", F.concat(*(_arrays(h, g, k, w) for h, g, k, w, _, _ in names)).alias("all"))
    d = d.select("doc_id", F.expr("filter(all, x -> x.valid)").alias("base"), F.expr("filter(all, x -> not x.valid)").alias("others"))
    over = "exists(base, b -> b.kind = x.kind and b.start < x.stop and x.start < b.stop)"
    return d.select("doc_id", "base", F.expr(f"transform(others, x -> named_struct('span', x, 'known', {over}))").alias("others"))


def _arrays(hits: str, gaps: str, kind: str, wide: int) -> Column:
    # a plain zip of three arrays has fields named by position
    return F.expr(_spans(hits, gaps, kind, wide).replace(f"arrays_zip({hits},", f"arrays_zip(slice({hits}, 1, size({hits})),"))


@dataclass
class Trees:
    """Boosted trees of depth two: (weight, first test, tests and values of its two sides)."""

    start: float
    trees: list[tuple]
    thresholds: dict[int, float]

    def sql(self, x: str) -> str:
        def leaf(side: tuple) -> str:
            test, low, high = side
            return f"{low:.9f}D" if test is None else f"if({x}.{test[0]} <= {test[1]}, {low:.9f}D, {high:.9f}D)"

        total = " + ".join([f"{self.start:.9f}D", *(f"if({x}.{t[0]} <= {t[1]}, {leaf(low)}, {leaf(high)})" for t, low, high in self.trees)])
        return f"(1D / (1D + exp(-({total}))))"

    def score(self, row: dict) -> float:
        total = self.start
        for test, low, high in self.trees:
            inner, a, b = low if row[test[0]] <= test[1] else high
            total += a if inner is None or row[inner[0]] <= inner[1] else b
        return 1 / (1 + math.exp(-total))


def _best(rows: list[tuple[dict, float, float]]) -> tuple:
    """Test and leaf values with the largest gain in squared gradients."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best, found = 1e-6, (None, RATE * g / (h + 1), RATE * g / (h + 1))
    for name, levels in LEVELS.items():
        by = [[0.0, 0.0] for _ in range(levels)]
        for row, a, b in rows:
            by[row[name]][0] += a
            by[row[name]][1] += b
        low_g = low_h = 0.0
        for level in range(levels - 1):
            low_g, low_h = low_g + by[level][0], low_h + by[level][1]
            gain = low_g**2 / (low_h + 1) + (g - low_g) ** 2 / (h - low_h + 1) - g**2 / (h + 1)
            if gain > best:
                best, found = gain, ((name, level), RATE * low_g / (low_h + 1), RATE * (g - low_g) / (h - low_h + 1))
    return found


def fit(table: list[dict]) -> Trees:
    """Boost on counts: a row for each combination of features and part (held out or not, base or
    not) with n and positives. Thresholds are per kind the least score from which on the held-out
    spans beside the base have the precision; a kind that never gets there adds nothing."""
    train = [r for r in table if not r["held_out"]]
    n, yes = sum(r["n"] for r in train), sum(r["positives"] for r in train)
    model = Trees(math.log((yes + 1) / (n - yes + 1)), [], {})
    scores = {id(r): model.start for r in train}
    for _ in range(ROUNDS if n else 0):
        rows = []
        for r in train:
            p = 1 / (1 + math.exp(-scores[id(r)]))
            rows.append((r, r["positives"] - r["n"] * p, r["n"] * p * (1 - p)))
        test = _best(rows)[0]
        if test is None:
            break
        sides = [[x for x in rows if (x[0][test[0]] <= test[1]) == low] for low in (True, False)]
        tree = (test, _best(sides[0]), _best(sides[1]))
        model.trees.append(tree)
        for r in train:
            inner, a, b = tree[1] if r[test[0]] <= test[1] else tree[2]
            scores[id(r)] += a if inner is None or r[inner[0]] <= inner[1] else b
    for kind in range(len(KINDS)):
        held = sorted(((model.score(r), r["n"], r["positives"]) for r in table if r["held_out"] and not r["base"] and r["kind"] == kind), reverse=True)
        seen = good = 0
        for i, (p, m, y) in enumerate(held):
            seen, good = seen + m, good + y
            if good >= PRECISION * seen and (i + 1 == len(held) or held[i + 1][0] < p):
                model.thresholds[kind] = p - 1e-9
    return model


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, base and more: arrays of (kind, start, stop) spans.

    Base spans are the leftmost matches of each kind that pass its check (parts up to 255,
    Luhn, numbers of digits). Wider generators propose overlapping spans. Trees are boosted on
    base spans, as positives, and on all other candidates that overlap none of their kind: these
    are positives if their normal form (spelt-out signs written, separators out) passes a strict
    check, which format and context features, never the checks, have to foretell. Features have few
    levels, so that the whole corpus is summed into a table of at most their product before it
    reaches the driver. The trees become a SQL expression. Thresholds are calibrated, kind by kind,
    on the held-out candidates that could be added. Spans over their threshold are `more`.

    Null text counts as empty; a text of any length is searched whole. Every row stands for itself:
    repeated rows, null ids and extra columns need no rule. Without any span nothing is fitted and
    nothing added. An empty table gives an empty result.
    """
    found = spans(docs, id_col, text_col)
    held = F.expr("crc32(cast(doc_id as string)) % 5 = 0").alias("held_out")
    pool = F.expr("concat(transform(base, b -> named_struct('span', b, 'base', true)), transform(filter(others, x -> not x.known), x -> named_struct('span', x.span, 'base', false)))")
    rows = found.select(held, F.explode(pool).alias("c"))
    rows = rows.select(F.coalesce("held_out", F.lit(False)).alias("held_out"), "c.base", (F.col("c.base") | F.col("c.span.sound")).alias("good"), *(f"c.span.{x}" for x in LEVELS))
    table = rows.groupBy("held_out", "base", *LEVELS).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("positives"))
    model = fit([r.asDict() for r in table.orderBy("held_out", "base", *LEVELS).collect()])
    brief = "named_struct('kind', {0}.kind, 'start', {0}.start, 'stop', {0}.stop)"
    over = " or ".join(f"(x.span.kind = {k} and {model.sql('x.span')} >= {t!r}D)" for k, t in model.thresholds.items()) or "false"
    more = f"array_distinct(transform(filter(others, x -> not x.known and ({over})), x -> {brief.format('x.span')}))"
    return found.select("doc_id", F.expr(f"array_sort(transform(base, x -> {brief.format('x')}))").alias("base"), F.expr(f"array_sort({more})").alias("more"))


def digest(out: DataFrame) -> DataFrame:
    def joined(c: str) -> str:
        names = ", ".join(f"'{k}'" for k in KINDS)
        return f"array_join(transform({c}, x -> concat(element_at(array({names}), x.kind + 1), ':', x.start, ':', x.stop)), ',')"

    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(F.expr(joined("base")), 256).alias("base_sha256"), F.expr(joined("array_sort(array_union(base, more))")).alias("spans"))
