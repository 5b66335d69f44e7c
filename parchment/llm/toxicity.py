"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import documents, durable, turn
from parchment.llm.words import Words, parts

#: Bits of a term's bucket; lengths in bytes of the beginnings of words that are terms.
BITS, PREFIXES = 20, (4, 5, 6, 7, 8)
#: Labelled rows that the model is fitted on at most; buckets with weights; factors.
SAMPLE, TERMS, FACTORS = 12_000, 1_024, 8


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of every term: words and beginnings of longer words, in lower case."""
    w = Words(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(w.text_at))
    who, what = [text], [w.hash]
    for n in PREFIXES:
        longer = np.flatnonzero(w.past - w.first > n)
        who.append(text[longer])
        what.append(w.span_hash(w.first[longer], w.first[longer] + n) * np.uint64(0xD6E8FEB86659FD93))
    key = np.concatenate(who).astype(np.int64) << BITS | (np.concatenate(what) >> np.uint64(64 - BITS)).astype(np.int64)
    key, count = np.unique(key, return_counts=True)
    return key >> BITS, key & (1 << BITS) - 1, count


@dataclass
class Machine:
    """Score = sigmoid(bias + w x + sum over pairs of <v_i, v_j> x_i x_j), x = 1 + ln(count)."""

    column: np.ndarray  # of each bucket, or -1
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, bucket, count = terms(texts)
        column = self.column[bucket]
        known = column >= 0
        return text[known], column[known], (1 + np.log(count[known])).astype(np.float32)

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        text, column, x = self.rows(texts)
        out += np.bincount(text, self.weight[column] * x, len(texts))
        for f in range(self.factor.shape[1]):
            vx = self.factor[column, f] * x
            out += 0.5 * (np.bincount(text, vx, len(texts)) ** 2 - np.bincount(text, vx * vx, len(texts)))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def chosen(counts: np.ndarray, total: np.ndarray, most: int = TERMS) -> np.ndarray:
    """Buckets with the largest chi-square of presence against label; counts: (bucket, without, with)."""
    a, b = counts[:, 2].astype(float), counts[:, 1].astype(float)
    n, yes = total.sum(), total[1]
    part = a + b
    expected = part * yes / n
    chi = (a - expected) ** 2 / np.maximum(expected, 1e-9) + (b - part + expected) ** 2 / np.maximum(part - expected, 1e-9)
    chi[part < 3] = 0
    order = np.lexsort((counts[:, 0], -chi))[:most]
    return np.sort(counts[order[chi[order] > 4], 0])


def fit(buckets: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, seed: int = 3) -> Machine:
    """Adam on the logistic loss in batches of 256, with L2 on weights and factors."""
    column = np.full(1 << BITS, -1, np.int32)
    column[buckets] = np.arange(len(buckets))
    m, rate = len(buckets), float((labels.sum() + 1) / (len(labels) + 2))
    model = Machine(column, float(np.log(rate / (1 - rate))), np.zeros(m, np.float32), np.zeros((m, FACTORS), np.float32))
    if not m or labels.min() == labels.max():
        return model
    g = np.random.default_rng(seed)
    model.factor = (g.normal(size=(m, FACTORS)) * 0.01).astype(np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.weight, model.factor)]
    step = 0
    for epoch in range(epochs):
        for batch in np.array_split(g.permutation(len(rows)), max(1, len(rows) // 256)):
            x = np.zeros((len(batch), m), np.float32)
            for i, r in enumerate(batch):
                c, v = rows[r]
                x[i, c] = v
            xv, x2 = x @ model.factor, x * x
            z = model.bias + x @ model.weight + 0.5 * ((xv**2).sum(1) - x2 @ (model.factor**2).sum(1))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]).astype(np.float32) / len(batch)
            model.bias -= 0.05 * float(error.sum())
            grads = (x.T @ error + 2e-4 * model.weight, x.T @ (error[:, None] * xv) - model.factor * (x2.T @ error)[:, None] + 2e-3 * model.factor)
            step += 1
            for p, grad, (first, second) in zip((model.weight, model.factor), grads, moments, strict=True):
                first += 0.1 * (grad - first)
                second += 0.001 * (grad * grad - second)
                p -= 0.01 * (0.5 ** (epoch / 4)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return model


def _held_out(c: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(c).cast("string")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fit on the `sample` labelled rows (at most) whose ids hash lowest, held-out ids left out.

    That bound holds for the ids that are broadcast and for what the driver collects: the
    sample's counts by bucket are summed by the cluster, and only chosen buckets come back.
    A doc_id with several labels is toxic if one says so; null labels and ids are left out.
    """
    d = documents(docs, id_col, text_col)
    rows = labels.select(F.col("doc_id").alias("of"), F.col("toxic").cast("int").alias("toxic")).where("of IS NOT NULL AND toxic IS NOT NULL")
    rows = rows.where(~_held_out("of")).groupBy("of").agg(F.max("toxic").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("of"), "of").limit(sample)
    taken = durable(d.join(F.broadcast(rows), F.col("doc_id") == F.col("of")).select("doc_id", "text", F.least("toxic", F.lit(1)).alias("toxic")))
    total = np.zeros(2)
    for r in taken.groupBy("toxic").count().collect():
        total[r["toxic"]] += r["count"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("toxicity")
        for b in batches:
            y = np.asarray(b.column(2))
            for low, high in parts(b.column(1)):
                text, bucket, _ = terms(b.column(1).slice(low, high - low))
                seen, n = np.unique(bucket * 2 + y[low + text], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seen // 2), pa.array(np.where(seen % 2 == 0, n, 0)), pa.array(np.where(seen % 2 == 1, n, 0))], ["bucket", "n0", "n1"])

    sums = taken.mapInArrow(count, "bucket bigint, n0 bigint, n1 bigint").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    rate = F.lit(float(total[1] / max(1, total.sum())))
    part, expected = F.col("n0") + F.col("n1"), (F.col("n0") + F.col("n1")) * rate
    sums = sums.withColumn("chi", F.pow(F.col("n1") - expected, 2) / F.greatest(expected, F.lit(1e-9)) + F.pow(F.col("n0") - part + expected, 2) / F.greatest(part - expected, F.lit(1e-9)))
    top = sums.where("n0 + n1 >= 3").orderBy(F.desc("chi"), "bucket").limit(TERMS).select("bucket", "n0", "n1").collect()
    buckets = chosen(np.array([[r[0], r[1], r[2]] for r in top], np.int64).reshape(-1, 3), total) if top else np.zeros(0, np.int64)
    shape = Machine(np.full(1 << BITS, -1, np.int32), 0.0, np.zeros(0), np.zeros((0, 0)))
    shape.column[buckets] = np.arange(len(buckets))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("toxicity")
        for b in batches:
            for low, high in parts(b.column(1)):
                text, column, x = shape.rows(b.column(1).slice(low, high - low))
                at = np.searchsorted(text, np.arange(high - low + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(low, high - low), b.column(2).slice(low, high - low), pa.ListArray.from_arrays(at, pa.array(column)), pa.ListArray.from_arrays(at, pa.array(x))],
                    ["doc_id", "toxic", "columns", "x"],
                )

    kind = taken.schema["doc_id"].dataType.simpleString()
    # not sorted by the cluster: the order that training needs is made here
    got = taken.mapInArrow(extract, f"doc_id {kind}, toxic int, columns array<int>, x array<float>").toArrow().sort_by("doc_id")
    each = [(np.asarray(c.values), np.asarray(v.values)) for c, v in zip(got.column("columns"), got.column("x"), strict=True)]
    y = np.asarray(got.column("toxic")).astype(np.float32)
    return fit(buckets, each, y) if len(y) else fit(np.zeros(0, np.int64), [], np.zeros(1, np.float32))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    The score is that of a factorization machine on the whole text's words and beginnings of
    words; label, language, source and id are no inputs. held_out rows (CRC-32 of the doc_id
    as text divisible by 5) are never learnt from. Null and empty texts get the score of a
    text without known terms. Repeated rows and null ids (not held out) are scored as they
    stand. Without labels of both kinds every score is the share of toxic labels, smoothed.
    Further columns of any name are ignored. Scoring shuffles nothing.
    """
    model = learn(docs, labels, sample, id_col, text_col)
    d = documents(docs, id_col, text_col)
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("toxicity")
        for b in batches:
            for low, high in parts(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), pa.array(model.score(b.column(1).slice(low, high - low)))], ["doc_id", "score"])

    out = d.mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
