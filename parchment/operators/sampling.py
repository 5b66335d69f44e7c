"""Seeded, engine-portable sampling: order by the MD5 of seed, slice and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchment.functions.text import era, normal_title

# Seed, share of draft/final pairs, largest documents that are always taken.
SEED, PAIR_SHARE, LARGEST = 20260813, 0.15, 2


def shuffled(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)))


def first_per_slice(rows: DataFrame, n: int, slice_col: str = "slice", order: str = "pos") -> DataFrame:
    w = Window.partitionBy(slice_col).orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def rotating(rows: DataFrame, stratum: str, target: int, seed: int = SEED, id_col: str = "doc_id") -> DataFrame:
    """`target` rows taking strata in turn; strata and rows in seeded order, each round starting one stratum later."""
    depth = F.row_number().over(Window.partitionBy(stratum).orderBy(shuffled(seed, id_col), id_col)) - 1
    strata = rows.select(stratum).distinct()
    order = strata.select(F.col(stratum).alias("__s"), (F.row_number().over(Window.orderBy(shuffled(seed, stratum), stratum)) - 1).alias("ord"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    r = rows.withColumn("depth", depth).where(F.col("depth") < target).join(F.broadcast(order), F.col(stratum).eqNullSafe(F.col("__s")))
    turn = F.pmod(F.col("ord") - F.col("depth"), F.col("n"))
    return r.withColumn("turn", turn).orderBy("depth", "turn").limit(target).drop("__s", "ord", "n", "depth", "turn")


def paired_titles(docs: DataFrame) -> DataFrame:
    """title_key of titles with a Draft and a Final, with the first document of each."""
    d = docs.where(F.col("status").isin("Draft", "Final")).withColumn("title_key", normal_title("title"))
    g = d.groupBy("title_key").agg(F.min(F.when(F.col("status") == "Draft", F.col("doc_id"))).alias("draft"), F.min(F.when(F.col("status") == "Final", F.col("doc_id"))).alias("final"))
    return g.where("draft IS NOT NULL AND final IS NOT NULL")


def sample_guidance(docs: DataFrame, target: int, seed: int = SEED) -> DataFrame:
    """doc_id, sample_reason: draft/final pairs up to their share, then strata of (center, status, era) in turn."""
    n_titles = min(target, round(target * PAIR_SHARE)) // 2
    t = paired_titles(docs).orderBy(shuffled(seed, "title_key"), "title_key").limit(n_titles)
    pairs = t.select(F.explode(F.array("draft", "final")).alias("doc_id")).distinct().withColumn("sample_reason", F.lit("draft_final_pair"))
    key = F.concat_ws("|", F.coalesce("center", F.lit("unknown")), F.coalesce("status", F.lit("unknown")), era("issue_date"))
    rest = docs.join(pairs, "doc_id", "left_anti").withColumn("stratum", key)
    more = rotating(rest, "stratum", target - pairs.count(), seed).select("doc_id", F.lit("stratified_center_status_era").alias("sample_reason"))
    return pairs.unionByName(more)


def sample_protocols(docs: DataFrame, target: int, seed: int = SEED) -> DataFrame:
    """doc_id, sample_reason: the largest documents, then sponsor classes in turn."""
    big = docs.orderBy(F.desc(F.coalesce("declared_bytes", F.lit(0))), "doc_id").limit(min(LARGEST, target)).select("doc_id", F.lit("largest_available_document").alias("sample_reason"))
    rest = docs.join(big, "doc_id", "left_anti").withColumn("stratum", F.coalesce("sponsor_class", F.lit("UNKNOWN")))
    more = rotating(rest, "stratum", max(0, target - LARGEST), seed).select("doc_id", F.lit("stratified_sponsor_class").alias("sample_reason"))
    return big.unionByName(more)
