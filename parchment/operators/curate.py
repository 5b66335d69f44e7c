"""Triage of reference pairs: obligation, polarity, attribution and numbers against the cited source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.functions.text import REVIEW_STOP_WORDS, unsupported_numbers

# Modal forms and their strength.
STRENGTH = {
    "may": 1, "might": 1, "can": 1, "could": 1, "optional": 1, "permitted": 1,
    "should": 2, "recommend": 2, "recommends": 2, "recommendation": 2, "recommendations": 2, "recommended": 2, "encouraged": 2, "expected": 2,
    "will": 3,
    "shall": 4, "must": 4, "require": 4, "required": 4, "requires": 4, "mandatory": 4, "prohibited": 4,
}
LABEL = {1: "permissive", 2: "recommended", 3: "descriptive", 4: "mandatory"}
# Markers of negation, and parties that an obligation can fall on.
NEGATIONS = ("not", "no", "never", "cannot", "neither", "nor", "except", "unless", "without", "prohibited", "may not")
ACTORS = ("sponsor", "applicant", "agency", "fda", "investigator", "irb", "manufacturer", "secretary", "institution", "submitter", "subject", "patient", "physician")
NEGATED = r"(?i)\b(?:not|never|cannot|no\s+longer)\b"
REACH = 2  # words either side of a modal


def _spaced(word: str) -> str:
    """The word, also with one space between letters, as extraction leaves it."""
    return r"\b" + r"\s?".join(word) + r"\b"


def _named(around: Column, modal: str) -> Column:
    return F.transform(around, lambda w: F.struct(F.lit(modal).alias("modal"), F.rlike(w, F.lit(NEGATED)).alias("negated")))


def modals(c: Column | str) -> Column:
    """Sorted distinct array<struct<modal, negated>> of the ranked modals in a text."""
    c = F.col(c) if isinstance(c, str) else c
    per = []
    for m in STRENGTH:
        p = rf"(?i)((?:\w+\s+){{0,{REACH}}}){_spaced(m)}((?:\s+\w+){{0,{REACH}}})"
        around = F.zip_with(F.regexp_extract_all(c, F.lit(p), F.lit(1)), F.regexp_extract_all(c, F.lit(p), F.lit(2)), lambda a, b: F.concat_ws(" ", a, b))
        per.append(_named(around, m))
    return F.array_sort(F.array_distinct(F.concat(*per)))


def _rank(m: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in STRENGTH.items() for x in kv)), m)


def strength(polarities: Column | str) -> Column:
    """The strongest unnegated modal's rank, 0 without one."""
    p = F.col(polarities) if isinstance(polarities, str) else polarities
    return F.coalesce(F.array_max(F.transform(F.filter(p, lambda x: ~x["negated"]), lambda x: _rank(x["modal"]))), F.lit(0))


def strongest(polarities: Column | str) -> Column:
    """Its spelling: the longest, then alphabetically first, of that rank."""
    p = F.col(polarities) if isinstance(polarities, str) else polarities
    at = strength(p)
    names = F.transform(F.filter(p, lambda x: ~x["negated"] & (_rank(x["modal"]) == at)), lambda x: F.struct((-F.length(x["modal"])).alias("n"), x["modal"].alias("m")))
    return F.array_min(names)["m"]


def negations(c: Column | str) -> Column:
    """Markers with repeats; the two-word one is counted once, before the single words."""
    c = F.lower(F.col(c) if isinstance(c, str) else c)
    pairs = F.regexp_count(c, F.lit(r"\bmay not\b"))
    rest = F.regexp_replace(c, r"\bmay not\b", " ")
    return pairs + F.regexp_count(rest, F.lit(rf"\b(?:{'|'.join(n for n in NEGATIONS if ' ' not in n)})\b"))


def actors(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_sort(F.filter(F.array(*(F.when(F.rlike(c, F.lit(rf"(?i)\b{a}\b")), F.lit(a)) for a in ACTORS)), lambda x: x.isNotNull()))


def review_words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) > 3) & ~w.isin(REVIEW_STOP_WORDS)))


def relevant_sentence(answer: Column | str, source: Column | str) -> Column:
    """The source sentence (30 characters or more) whose words are most like the answer's, the first of equals, up to 400 characters; '' without any."""
    answer, source = (F.col(x) if isinstance(x, str) else x for x in (answer, source))
    want = review_words(answer)
    tidy = F.transform(F.split(source, r"(?<=[.;:])\s+", -1), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))

    def score(s: Column) -> Column:
        both = F.size(F.array_intersect(want, review_words(s)))
        return F.try_divide(both.cast("double"), (F.size(want) + F.size(review_words(s)) - both).cast("double"))

    scored = F.transform(tidy, lambda s, i: F.struct(F.when(F.length(s) >= 30, score(s)).alias("score"), (-i).alias("at"), s.alias("s")))
    best = F.array_max(F.filter(scored, lambda x: F.coalesce(x["score"], F.lit(0.0)) > 0))
    return F.coalesce(F.substring(best["s"], 1, 400), F.lit(""))


def excerpt(c: Column, needle: Column, around: int = 80) -> Column:
    at = F.instr(F.lower(c), F.lower(needle))
    return F.when(at > 0, F.trim(F.substring(c, F.greatest(at - around, F.lit(1)), F.lit(2 * around) + F.length(needle))))


def flags(pairs: DataFrame) -> DataFrame:
    """pair_id, kind, severity, detail of every check that a pair (pair_id, answer, source) trips.

    One projection computes what the checks share; each check is an array of no, one or more flags.
    """
    p = pairs.withColumns({"am": modals("answer"), "sm": modals("source"), "sentence": relevant_sentence("answer", "source")}).withColumn("cm", modals("sentence"))
    p = p.withColumns({"a": strength("am"), "s": strength("sm"), "c": strength("cm"), "missing": unsupported_numbers("answer", "source"), "novel": F.array_except(actors("answer"), actors("source"))})

    def flag(kind, severity, detail) -> Column:
        return F.struct(*((x if isinstance(x, Column) else F.lit(x)).alias(n) for x, n in ((kind, "kind"), (severity, "severity"), (detail, "detail"))))

    none = F.array().cast("array<struct<kind:string,severity:string,detail:string>>")

    def when(cond: Column, one: Column) -> Column:
        return F.when(cond, F.array(one)).otherwise(none)

    stronger = when(
        F.col("a") > F.col("s"),
        flag(F.when(F.col("s") > 0, "modal_strengthened").otherwise("modal_added_to_unmodalised_source"), F.when(F.col("s") > 0, "high").otherwise("medium"), F.concat_ws(" > ", strongest("am"), strongest("sm"))),
    )
    context = when((F.col("c") > 0) & (F.col("a") > F.col("c")), flag("modal_strengthened_in_context", "high", F.concat_ws(" > ", strongest("am"), strongest("cm"))))
    opposite = F.filter("am", lambda x: F.exists("sm", lambda y: (y["modal"] == x["modal"]) & (y["negated"] != x["negated"])) & ~F.exists("sm", lambda y: y == x))
    inverted = F.transform(opposite, lambda x: flag("polarity_inverted", "high", x["modal"]))
    party = when((F.col("a") >= 3) & (F.size("novel") > 0), flag("actor_not_in_source", "medium", F.element_at("novel", 1)))
    number = when(F.size("missing") > 0, flag("unsupported_number", "high", F.array_join("missing", ", ")))
    lost = F.array(flag("no_source", "high", "no cited chunk resolved"))
    every = F.when(F.trim(F.coalesce("source", F.lit(""))) == "", lost).otherwise(F.concat(stronger, context, inverted, party, number))
    return p.select("pair_id", F.explode(every).alias("f")).select("pair_id", "f.kind", "f.severity", "f.detail")


def cited_source(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """pair_id and the text of the chunks that its evidence cites, in order; '' if none resolves."""
    e = pairs.select("pair_id", F.posexplode("evidence").alias("pos", "e")).select("pair_id", "pos", F.col("e.chunk_id").alias("__c"))
    e = e.join(chunks.select("chunk_id", "text"), F.col("__c") == F.col("chunk_id"), "left")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"])
    return e.groupBy("pair_id").agg(F.array_join(parts, " ").alias("source"))


def summary(flags_: DataFrame, pairs: DataFrame) -> DataFrame:
    """what, name, n: flags by kind, pairs by their worst severity, and all and flagged pairs."""
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    worst = flags_.groupBy("pair_id").agg(F.max(rank).alias("r")).groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    kinds = flags_.groupBy(F.col("kind").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("kind").alias("what"), "name", "n")
    levels = flags_.sparkSession.createDataFrame([("high", 3), ("medium", 2), ("low", 1)], "name string, r int").join(worst, "r", "left")
    levels = levels.select(F.lit("severity").alias("what"), "name", F.coalesce("n", F.lit(0)).alias("n"))
    total = pairs.agg(F.count(F.lit(1)).alias("n")).select(F.lit("pairs").alias("what"), F.lit("all").alias("name"), "n")
    flagged = flags_.agg(F.count_distinct("pair_id").alias("n")).select(F.lit("pairs").alias("what"), F.lit("flagged").alias("name"), "n")
    return kinds.unionByName(levels).unionByName(total).unionByName(flagged)


def with_verdicts(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """pair_id, status, reason after human verdicts: a reject overrules what a machine accepted; edits are refused."""
    if not verdicts.where("verdict = 'edit'").isEmpty():
        raise ValueError("edit verdicts can't be applied")
    bad = verdicts.where(~F.col("verdict").isin("keep", "reject")).limit(1).collect()
    if bad:
        raise ValueError(f"unknown verdict: {bad[0]}")
    v = verdicts.select(F.col("pair_id").alias("__p"), F.col("verdict"), F.col("reason").alias("__r"))
    no = F.coalesce(F.col("verdict") == "reject", F.lit(False)) & (F.col("status") == "accepted")
    return pairs.join(v, F.col("pair_id") == F.col("__p"), "left").select(
        "pair_id", F.when(no, "rejected").otherwise(F.col("status")).alias("status"), F.when(no, F.concat(F.lit("human: "), F.coalesce("__r", F.lit("")))).otherwise(F.col("reason")).alias("reason")
    )


def orphans(verdicts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Verdicts on pairs that aren't there."""
    return verdicts.join(pairs.select("pair_id"), "pair_id", "left_anti")
