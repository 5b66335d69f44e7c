"""Identifiers in text: found with offsets, canonical at two granularities, as index atoms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions.text import offsets

# Dashes and white space that extraction leaves inside identifiers.
DASH = "[-‐‑‒–—]"
WS = "[ \\t\\r\\n ]*"
SUB = r"(?:\([A-Za-z0-9]{1,4}\))*"
PART = f"(?:[Pp]arts?{WS})?§{{0,2}}{WS}"


@dataclass(frozen=True)
class Kind:
    """pattern finds; parts (on the flattened match) has title, section and subsection or a code."""

    pattern: str
    parts: str
    label: str = ""
    titles: int = 0  # so many titles exist; 0: not a titled kind


# The identifier classes of the corpus, in order.
KINDS: dict[str, Kind] = {
    "cfr": Kind(rf"(?i)\b[0-9]{{1,2}}{WS}C\.?{WS}F\.?{WS}R\.?{WS}{PART}[0-9]+(?:\.[0-9]+)?{SUB}", rf"(?i)([0-9]{{1,2}}){WS}C\.?{WS}F\.?{WS}R\.?{WS}{PART}([0-9]+(?:\.[0-9]+)?)({SUB})", "CFR", 50),
    "usc": Kind(rf"(?i)\b[0-9]{{1,2}}{WS}U\.?{WS}S\.?{WS}C\.?{WS}§{{0,2}}{WS}[0-9]+[a-z]?{SUB}", rf"(?i)([0-9]{{1,2}}){WS}U\.?{WS}S\.?{WS}C\.?{WS}§{{0,2}}{WS}([0-9]+[a-z]?)({SUB})", "USC", 54),
    "fed_register": Kind(rf"\b[0-9]{{2,3}}{WS}F\.?{WS}R\.?{WS}[0-9]{{3,6}}\b", rf"([0-9]{{2,3}}){WS}F\.?{WS}R\.?{WS}([0-9]{{3,6}})"),
    "docket": Kind(rf"\b[A-Z]{{2,4}}{DASH}{WS}[0-9]{{4}}{DASH}{WS}[A-Z]{DASH}{WS}[0-9]{{3,5}}\b", ""),
    "registry": Kind(rf"\bNCT{WS}[0-9]{{8}}\b", rf"(?i)NCT{WS}([0-9]{{8}})"),
    "ich": Kind(rf"(?i)\bICH{WS}[EQSM][0-9]{{1,2}}[A-Z]?(?:{WS}\(R[0-9]\))?", rf"(?i)ICH{WS}([EQSM][0-9]{{1,2}}[A-Z]?)(?:{WS}\((R[0-9])\))?"),
}
PRIMARY = "cfr"
#: What each identifier holds somewhere.
MAYBE = r"(?i)[0-9][ \t\r\n\x{a0}]*[CUF]\.?[ \t\r\n\x{a0}]*[FSR]|[A-Z][-‐‑‒–—][ \t\r\n\x{a0}]*[0-9]|NCT[ \t\r\n\x{a0}]*[0-9]|ICH[ \t\r\n\x{a0}]*[EQSM][0-9]"


def flattened(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(raw, DASH, "-"), r"[\s ]+", " "))


def _forms(name: str, raw: Column, tail: Column) -> tuple[Column, Column, Column]:
    """canonical, canonical_detailed, repaired; NULL canonical for what is no identifier."""
    kind, flat = KINDS[name], flattened(raw)

    def part(i: int) -> Column:
        return F.regexp_extract(flat, kind.parts, i)

    if kind.titles:
        title, section = part(1).cast("int"), part(2)
        valid = title.between(1, kind.titles)
        # a line number was taken for the section if the next line starts with a real one
        after = F.regexp_extract(tail, r"\A\s*\n\s*([0-9]+\.[0-9]+)", 1)
        repaired = (after != "") & ~F.contains(section, F.lit("."))
        shown = F.lower(section) if name == "usc" else section
        base = F.concat_ws(" ", title.cast("string"), F.lit(kind.label), F.when(repaired, after).otherwise(shown))
        return F.when(valid, base), F.when(valid, F.when(repaired, base).otherwise(F.concat(base, part(3)))), F.coalesce(repaired, F.lit(False))
    if name == "fed_register":
        one = F.concat_ws(" FR ", part(1), part(2))
    elif name == "registry":
        one = F.concat(F.lit("NCT"), part(1))
    elif name == "ich":
        one = F.concat(F.lit("ICH "), F.upper(part(1)), F.when(part(2) != "", F.concat(F.lit("("), F.upper(part(2)), F.lit(")"))).otherwise(""))
    else:
        one = F.upper(F.regexp_replace(flat, r"\s*-\s*", "-"))
    return one, one, F.lit(False)


def extract(docs: DataFrame, id_col: str = "id", text_col: str = "text", kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """id, kind, raw, canonical, canonical_detailed, start, stop, repaired of every identifier."""
    out = None
    for name in kinds:
        found = docs.select(F.col(id_col), F.col(text_col), F.explode(offsets(text_col, KINDS[name].pattern)).alias("m"))
        canonical, detailed, repaired = _forms(name, F.col("m.raw"), F.substring(F.col(text_col), F.col("m.stop") + 1, F.lit(24)))
        one = found.select(
            F.col(id_col), F.lit(name).alias("kind"), F.col("m.raw").alias("raw"), canonical.alias("canonical"), detailed.alias("canonical_detailed"),
            F.col("m.start").cast("bigint").alias("start"), F.col("m.stop").cast("bigint").alias("stop"), repaired.alias("repaired"),
        ).where("canonical IS NOT NULL")
        out = one if out is None else out.unionByName(one)
    return out


def density(found: DataFrame, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """kind, occurrences, distinct_sections, distinct_detailed; kinds that don't occur have 0."""
    counts = found.groupBy("kind").agg(
        F.count(F.lit(1)).alias("o"), F.count_distinct("canonical").alias("s"), F.count_distinct("canonical_detailed").alias("d")
    )
    names = found.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return names.join(F.broadcast(counts), "kind", "left").select(
        "kind", *(F.coalesce(c, F.lit(0)).alias(a) for c, a in (("o", "occurrences"), ("s", "distinct_sections"), ("d", "distinct_detailed")))
    )


def atom(canonical: Column) -> Column:
    """One indivisible token; an upper-case letter is marked, as (C) and (c) differ."""
    marked = F.lower(F.regexp_replace(canonical, "([A-Z])", "q$1"))
    return F.concat(F.lit("idz"), F.regexp_replace(marked, "[^a-z0-9]+", "z"))


def atoms(found: DataFrame, id_col: str = "id") -> DataFrame:
    """id and its distinct atoms of both granularities, in order of first occurrence."""
    order = F.array_sort(F.collect_list(F.struct("start", "kind", "canonical", "canonical_detailed")))
    both = F.flatten(F.transform(order, lambda x: F.array(atom(x["canonical"]), atom(x["canonical_detailed"]))))
    return found.groupBy(id_col).agg(F.array_distinct(both).alias("atoms"))


def atoms_of(text: Column | str) -> Column:
    """The distinct atoms of the identifiers in a text, of both granularities; kinds in their order."""
    text = F.col(text) if isinstance(text, str) else text

    def of(name: str) -> Column:
        def forms(m: Column) -> Column:
            canonical, detailed, _ = _forms(name, m["raw"], F.substring(text, m["stop"] + 1, F.lit(24)))
            return F.array(atom(canonical), atom(detailed))

        return F.flatten(F.transform(offsets(text, KINDS[name].pattern), forms))

    found = F.filter(F.array_distinct(F.concat(*(of(name) for name in KINDS))), lambda x: x.isNotNull())
    # every kind has a digit behind a letter or a letter behind a digit; most texts don't pass
    return F.when(text.rlike(MAYBE), found).otherwise(F.array().cast("array<string>"))


def augmented(text: Column, atoms_: Column) -> Column:
    """Text with its atoms on a line of their own."""
    return F.when(F.coalesce(F.size(atoms_), F.lit(0)) > 0, F.concat(text, F.lit("\n"), F.array_join(atoms_, " "))).otherwise(text)
