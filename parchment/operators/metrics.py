"""Retrieval metrics over hits and truth; separation of answerable from unanswerable queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Cut-offs.
CUTS = (1, 5, 10, 20)


def relevant_chunks(spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id of chunks that overlap a relevant span (query_id, doc_id, start, stop) of the same document."""
    s = spans.select("query_id", F.col("doc_id").alias("__d"), F.col("start").alias("s0"), F.col("stop").alias("s1"))
    c = chunks.select("chunk_id", "doc_id", "start", "stop")
    return c.join(s, (F.col("doc_id") == F.col("__d")) & (F.col("start") < F.col("s1")) & (F.col("stop") > F.col("s0"))).select("query_id", "chunk_id").distinct()


def per_query(hits: DataFrame, truth: DataFrame, queries: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """query_id, slice, retriever, n_relevant and hit, recall, precision at each cut, mrr@10 and ndcg@10.

    Every query stands for every retriever, also one without hits. Recall counts distinct chunks over the
    relevant set; precision divides by the cut, not by the list.
    """
    t = truth.select("query_id", "chunk_id").distinct()
    n = t.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    h = hits.join(t.withColumn("relevant", F.lit(1)), ["query_id", "chunk_id"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    gain = F.when(F.col("relevant") == 1, 1.0 / F.log2(F.col("rank") + 1.0))
    aggs = [F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("rank") <= 10, gain)).alias("dcg"), F.max("score").alias("top_score")]
    for k in cuts:
        good = F.when((F.col("rank") <= k) & (F.col("relevant") == 1), F.col("chunk_id"))
        aggs += [F.count_distinct(good).alias(f"d{k}"), F.count(good).alias(f"c{k}")]
    a = h.groupBy("query_id", "retriever").agg(*aggs)
    every = queries.select("query_id", "slice").crossJoin(F.broadcast(hits.select("retriever").distinct()))  # a handful of names
    q = every.join(a, ["query_id", "retriever"], "left").join(n, "query_id", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    cols = []
    for k in cuts:
        d, c = F.coalesce(f"d{k}", F.lit(0)), F.coalesce(f"c{k}", F.lit(0))
        cols += [
            F.when(d > 0, 1.0).otherwise(0.0).alias(f"hit_{k}"),
            F.when(F.col("n_relevant") > 0, d / F.col("n_relevant")).otherwise(0.0).alias(f"recall_{k}"),
            (c / F.lit(float(k))).alias(f"precision_{k}"),
        ]
    mrr = F.when(F.col("first") <= 10, 1.0 / F.col("first")).otherwise(0.0)
    ndcg = F.when(F.col("n_relevant") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0)
    return q.select("query_id", "slice", "retriever", "n_relevant", "top_score", *cols, mrr.alias("mrr_10"), ndcg.alias("ndcg_10"))


def by_slice(scored: DataFrame, places: int = 6) -> DataFrame:
    """Means over answerable queries; slices without any have n_queries 0 and no means."""
    names = [c for c in scored.columns if c.split("_")[0] in ("hit", "recall", "precision", "mrr", "ndcg")]
    ok = F.col("n_relevant") > 0
    return scored.groupBy("retriever", "slice").agg(F.count_if(ok).alias("n_queries"), F.count_if(~ok).alias("n_unscorable"), *(F.round(F.avg(F.when(ok, F.col(c))), places).alias(c) for c in names))


def separability(scores: DataFrame) -> DataFrame:
    """One row from (answerable, score): best threshold and accuracy of "answerable from t on", baseline, gain, means.

    Candidates are the distinct scores and one beyond the largest; of equally good ones the
    least stays. Counts at or over a candidate are running sums over distinct scores.
    """
    s = scores.groupBy("score").agg(F.count_if("answerable").alias("pos"), F.count_if(~F.col("answerable")).alias("neg"))
    total = scores.agg(
        F.count_if("answerable").alias("n_pos"), F.count_if(~F.col("answerable")).alias("n_neg"), F.max("score").alias("top"),
        F.avg(F.when(F.col("answerable"), F.col("score"))).alias("mean_pos"), F.avg(F.when(~F.col("answerable"), F.col("score"))).alias("mean_neg"),
    )
    s = s.unionByName(total.select((F.col("top") + 1).alias("score"), F.lit(0).alias("pos"), F.lit(0).alias("neg")))
    under = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select("score", F.coalesce(F.sum("pos").over(under), F.lit(0)).alias("missed"), F.coalesce(F.sum("neg").over(under), F.lit(0)).alias("refused")).crossJoin(F.broadcast(total))
    s = s.withColumn("accuracy", (F.col("n_pos") - F.col("missed") + F.col("refused")) / (F.col("n_pos") + F.col("n_neg")))
    best = s.agg(F.max(F.struct("accuracy", (-F.col("score")).alias("low"))).alias("b")).select("b.accuracy", (-F.col("b.low")).alias("threshold"))
    base = F.greatest("n_pos", "n_neg") / (F.col("n_pos") + F.col("n_neg"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return total.crossJoin(F.broadcast(best)).select(
        "n_pos", "n_neg", *(F.when(both, c).alias(a) for c, a in ((F.col("threshold"), "threshold"), (F.col("accuracy"), "accuracy"), (base, "baseline"), (F.col("accuracy") - base, "gain"), (F.col("mean_pos"), "mean_pos"), (F.col("mean_neg"), "mean_neg")))
    )


def auc(scores: DataFrame) -> DataFrame:
    """One row: area under the curve with ties as half, and the number of pairs; NULL without pairs.

    From average ranks, so that no pair is formed: ranks come from running counts over distinct scores.
    """
    s = scores.groupBy("score").agg(F.count_if("answerable").alias("pos"), F.count(F.lit(1)).alias("n"))
    under = F.coalesce(F.sum("n").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = s.withColumn("rank", under + (F.col("n") + 1) / 2).agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("p"), F.sum("n").alias("n"))
    pairs = F.col("p") * (F.col("n") - F.col("p"))
    return t.select(F.when(pairs > 0, (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / pairs).alias("auc"), pairs.alias("n_pairs"))


def threshold_sweep(scores: DataFrame, steps: int = 12) -> DataFrame:
    """step, threshold and how many of either kind lie strictly under it, for equal steps from least to largest."""
    edge = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    t = edge.select(F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"), "lo", "hi").select("step", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("step") / steps).alias("threshold"))
    return scores.crossJoin(F.broadcast(t)).groupBy("step", "threshold").agg(
        F.count_if(F.col("answerable") & (F.col("score") < F.col("threshold"))).alias("answerable_refused"),
        F.count_if(~F.col("answerable") & (F.col("score") < F.col("threshold"))).alias("unanswerable_refused"),
    )


def recall_ceiling(hits: DataFrame, truth: DataFrame, candidates: int) -> DataFrame:
    """query_id, ceiling: share of the relevant chunks among the candidates."""
    n = truth.groupBy("query_id").agg(F.count_distinct("chunk_id").alias("n"))
    found = hits.where(F.col("rank") <= candidates).join(truth, ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.count_distinct("chunk_id").alias("f"))
    return n.join(found, "query_id", "left").select("query_id", (F.coalesce("f", F.lit(0)) / F.col("n")).alias("ceiling"))


def saturated(values: DataFrame, by: str, value: str, modal: float = 0.9) -> DataFrame:
    """by, saturated: fewer than two values at four places, or one with more than `modal` of all."""
    c = values.groupBy(by, F.round(value, 4).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(by).agg(((F.count(F.lit(1)) < 2) | (F.max("n") / F.sum("n") > modal)).alias("saturated"))
