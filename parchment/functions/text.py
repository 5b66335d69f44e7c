"""Text functions as Column expressions. Offsets are code points, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The English stop list of the lexical index.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with"
).split()
#: Words that say nothing about whether evidence covers an answer.
COVERAGE_STOP_WORDS = (
    "a an and are as at be by do for i if in is it its no of on or so the to up us we he she him her his my me you your they them their this that"
    " these those all any can had has have was were will with from but out per via non pre re co ex vs am pm which who whom whose what when where"
    " why how than then there here also such would could been being other more most some each every under over into upon within without both"
    " either neither only same including include includes included provided provide provides using used use uses"
).split()
#: Words that a review doesn't compare.
REVIEW_STOP_WORDS = "the a an of and or to in for be is are was were with that this on by as at from will shall must may should not no".split()
#: Written numbers that count as digits.
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "ten": "10", "eleven": "11", "twelve": "12", "fifteen": "15", "twenty": "20", "thirty": "30", "sixty": "60", "ninety": "90",
}
#: White space of Unicode as a class that Java and RE2 read alike; their \\s is ASCII only.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOKEN = r"[\p{L}\p{N}_]{2,}"
WORD = r"[\p{L}\p{N}_]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: a lambda over it would compute it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def all_matches(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group))


def strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def collapsed(c: Column | str) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(c), f"{WHITE}+", " "))


def content_hash(c: Column | str) -> Column:
    """SHA-256 of the collapsed lower-case text (lower, not case folding: ß stays)."""
    return F.sha2(F.lower(collapsed(c)), 256)


def tokens(c: Column | str, stop: bool = True) -> Column:
    """Lower-case words of two or more characters, with repeats, stop words left out."""
    t = all_matches(F.lower(col(c)), TOKEN)
    return F.filter(t, lambda w: ~w.isin(STOP_WORDS)) if stop else t


def words(c: Column | str) -> Column:
    return all_matches(F.lower(col(c)), WORD)


def shingles(c: Column | str, size: int = 5) -> Column:
    """Distinct runs of `size` words as text; a shorter text is one run, one without words has none."""
    def runs(w: Column) -> Column:
        whole = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, size), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(whole))

    return let(words(c), runs)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two arrays without repeats; NULL if both are empty."""
    both = F.size(F.array_intersect(col(a), col(b)))
    return F.try_divide(both.cast("double"), (F.size(col(a)) + F.size(col(b)) - both).cast("double"))


def white_tokens(c: Column | str) -> Column:
    return F.filter(F.split(collapsed(c), " "), lambda w: w != "")


def _share(c: Column | str, floor: int, pattern: str) -> Column:
    """Share of white-space tokens that match, 0 under `floor` tokens. Between single spaces a
    token is counted by its pattern, so that no array is built and the text is collapsed once."""

    def of(flat: Column) -> Column:
        n = F.when(flat == "", 0).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1)
        return F.when(n < floor, F.lit(0.0)).otherwise(F.regexp_count(flat, F.lit(f"(?<![^ ]){pattern}(?![^ ])")) / n)

    return let(collapsed(c), of)


def single_char_share(c: Column | str, floor: int = 200) -> Column:
    return _share(c, floor, "[^ ]")


def control_share(c: Column | str, floor: int = 500) -> Column:
    # the odd characters are counted: to cut out all others is a replacement for each of them
    odd = F.regexp_count(col(c), F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"))
    return F.when(F.length(col(c)) < floor, F.lit(0.0)).otherwise(odd / F.length(col(c)))


def run_on_share(c: Column | str, floor: int = 200, long: int = 25) -> Column:
    return _share(c, floor, rf"\p{{L}}{{{long},}}")


def quality_label(c: Column | str, floor: int = 200, control_floor: int = 500) -> Column:
    """Worst first: broken_encoding, character_spaced, space_collapsed, ok."""
    return label_of(control_share(c, control_floor), single_char_share(c, floor), run_on_share(c, floor))


def label_of(control: Column | str, single: Column | str, run_on: Column | str) -> Column:
    """quality_label() of shares that are there already."""
    return F.when(col(control) >= 0.005, "broken_encoding").when(col(single) >= 0.40, "character_spaced").when(col(run_on) >= 0.002, "space_collapsed").otherwise("ok")


def quarantined(label: Column | str, c: Column | str, floor: int = 200, control_floor: int = 500) -> Column:
    """Stored label or live thresholds say that the text can't be read."""
    bad = ("character_spaced", "broken_encoding")
    live = (control_share(c, control_floor) >= 0.005) | (single_char_share(c, floor) >= 0.40)
    return F.coalesce(col(label).isin(*bad), F.lit(False)) | F.coalesce(live, F.lit(False))


def numeric_claims(c: Column | str) -> Column:
    """Sorted distinct digit strings, written numbers and "a year" as 1."""
    digits = F.transform(all_matches(c, r"[0-9][0-9,.]*"), lambda d: F.regexp_replace(F.regexp_replace(d, ",", ""), r"\.+$", ""))
    lower = F.lower(col(c))
    written = F.filter(
        F.array(*(F.when(lower.rlike(rf"(^|[^\p{{L}}\p{{N}}_]){w}($|[^\p{{L}}\p{{N}}_])"), F.lit(d)) for w, d in NUMBER_WORDS.items())), lambda x: x.isNotNull()
    )
    unit = lower.rlike(r"(^|[^\p{L}\p{N}_])((a|an|each|every|per)\s+(year|month|week|day|hour|decade)s?|annually)($|[^\p{L}\p{N}_])")
    once = F.when(unit, F.array(F.lit("1"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.filter(F.array_distinct(F.concat(digits, written, once)), lambda x: x != ""))


def unsupported_numbers(answer: Column | str, source: Column | str) -> Column:
    return F.array_except(numeric_claims(answer), numeric_claims(source))


def content_words(c: Column | str) -> Column:
    """Distinct words that carry meaning: any with a digit, or longer than two letters and no stop word."""
    w = F.array_distinct(all_matches(F.lower(col(c)), "[a-z0-9]+"))
    return F.filter(w, lambda x: x.rlike("[0-9]") | ((F.length(x) > 2) & ~x.isin(COVERAGE_STOP_WORDS)))


def coverage(answer: Column | str, evidence: Column | str) -> Column:
    wanted = content_words(answer)
    return F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(wanted, content_words(evidence))) / F.size(wanted))


def line_number_density(c: Column | str) -> Column:
    lines = F.split(col(c), "\n", -1)
    hits = F.filter(lines, lambda x: x.rlike(r"^\s*[0-9]+\s*$|\s[0-9]+\s*$|^\s*[0-9]+\s"))
    return F.when(F.size(lines) < 10, F.lit(0.0)).otherwise(F.size(hits) / F.size(lines))


#: Integers alone on a line, before a line's end and at its start.
LINE_NUMBERS = r"^[ \t]*[0-9]+[ \t]*$|(?<=\s)[0-9]+[ \t]*(?=\n)|(?<=\n)[ \t]*[0-9]+(?=\s)"


def without_line_numbers(c: Column | str) -> Column:
    """Integers beside line ends dropped (all three kinds judged on the original text), white space collapsed."""
    lone = F.regexp_replace(col(c), f"(?m){LINE_NUMBERS}", " ")
    return collapsed(lone)


def for_embedding(c: Column | str) -> Column:
    """Leader runs, wide gaps and blank lines shortened; only ever for what is embedded."""
    short = F.regexp_replace(col(c), r"([.·•_\-=~*])\s*(?:\1\s*){3,}", "$1 ")
    return F.trim(F.regexp_replace(F.regexp_replace(short, r"[ \t]{3,}", " "), r"(?:\r?\n\s*){3,}", "\n\n"))


def offsets(c: Column | str, pattern: str) -> Column:
    """array<struct<raw, start, stop>> of all matches, from the lengths of what lies between them."""
    hits, gaps = all_matches(c, pattern), F.split(col(c), pattern, -1)
    empty = F.array().cast("array<struct<raw:string,start:int,stop:int>>")
    zipped = F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap"))
    return F.aggregate(
        F.when(F.size(hits) > 0, zipped).otherwise(F.array().cast("array<struct<hit:string,gap:string>>")),
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x.getField("gap")) + F.length(x.getField("hit"))).alias("at"),
            F.concat(
                s["out"],
                F.array(
                    F.struct(
                        x.getField("hit").alias("raw"),
                        (s["at"] + F.length(x.getField("gap"))).alias("start"),
                        (s["at"] + F.length(x.getField("gap")) + F.length(x.getField("hit"))).alias("stop"),
                    )
                ),
            ).alias("out"),
        ),
        lambda s: s["out"],
    )


def strip_tags(c: Column | str) -> Column:
    """Markup out, the common entities in."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(text)


def clipped(c: Column | str, limit: int) -> Column:
    """Collapsed text of at most `limit` characters, cut between words and marked where it is cut."""
    return let(collapsed(c), lambda flat: F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, limit), " [^ ]*$", ""), F.lit("…"))))


def document_label(pair_id: Column | str) -> Column:
    """What names a pair's document to a reader: its registry id if it has one, else the id of the document."""
    doc = F.split_part(col(pair_id), F.lit("::"), F.lit(1))
    registry = F.regexp_extract(doc, "(?:^|-)(NCT[^-]*)", 1)
    return F.when(registry != "", registry).otherwise(doc)


def normal_title(c: Column | str) -> Column:
    t = F.regexp_replace(F.lower(col(c)), r"\b(draft|final|revision\s*[0-9]*|rev\.?\s*[0-9]*|guidance for industry)\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[^a-z0-9 ]+", " "), " +", " "))


def normal_heading(c: Column | str) -> Column:
    return F.lower(collapsed(c))


def us_date(c: Column | str, latest: int = 2027) -> Column:
    """MM/DD/YYYY as a date, NULL outside 1938..latest."""
    d = F.try_to_timestamp(F.trim(col(c)), F.lit("MM/dd/yyyy")).cast("date")
    return F.when(F.year(d).between(1938, latest), d)


def era(c: Column | str) -> Column:
    y = F.year(col(c))
    return F.when(y.isNull(), "undated").when(y < 2000, "pre-2000").when(y < 2010, "2000s").when(y < 2020, "2010s").otherwise("2020s")


def decade(c: Column | str) -> Column:
    return F.coalesce(F.concat((F.floor(F.year(col(c)) / 10) * 10).cast("string"), F.lit("s")), F.lit("undated"))


def offices(c: Column | str) -> Column:
    """<br>-delimited names, cut also at commas without a space behind, in order and once each."""
    parts = F.flatten(F.transform(F.split(col(c), r"(?i)<br\s*/?>", -1), lambda x: F.split(strip_tags(x), r",(?!\s)", -1)))
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.regexp_replace(F.trim(x), ",+$", "")), lambda x: x != ""))


def first_link(c: Column | str) -> tuple[Column, Column]:
    p = r'(?is)<a\s[^>]*href="([^"]+)"[^>]*>(.*?)</a>'
    href = F.regexp_extract(col(c), p, 1)
    return F.when(href != "", href), F.when(href != "", strip_tags(F.regexp_extract(col(c), p, 2))).otherwise(strip_tags(c))


def absolute(url: Column | str, base: str) -> Column:
    return F.when(col(url) == "", None).when(F.startswith(col(url), F.lit("http")), col(url)).otherwise(F.concat(F.lit(base), col(url)))
