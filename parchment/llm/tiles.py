"""Buckets that hold several components: which members meet in one task, so that every pair of
members of different components is compared once and no task holds a whole bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import durable

#: Members of one side of a task; columns of a block of a product.
TILE, BLOCK = 512, 4096


def meetings(members: DataFrame, linked: DataFrame, tile: int = TILE) -> DataFrame:
    """(bucket, x, y, node, component): the members (bucket, node) of buckets with several
    components of linked (node, component), dealt to the tasks (bucket, x, y) where they meet.

    The members of a bucket's largest component need not be compared with each other. All others,
    the rest, meet the rest and the largest: both fall into tiles by a hash, and each two tiles of
    the rest, and each tile of the rest and one of the largest, are one task. Of buckets with the
    same members one is taken. The rest shrinks with what the leaders have linked before.
    """
    m = members.join(linked.select(F.col("node").alias("linked"), "component"), F.col("node") == F.col("linked"), "left")
    m = m.select("bucket", "node", F.coalesce("component", "node").alias("component"))
    parts = m.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("sum"))
    several = parts.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("size").alias("n"), F.bit_xor("sum").alias("sum"), F.max("size").alias("most"), F.max_by("component", F.struct("size", "component")).alias("main")
    )
    one = several.where("parts > 1").groupBy("n", "sum", "main").agg(F.min("bucket").alias("bucket"), F.first("most").alias("most"))
    one = durable(one.select("bucket", "main", F.ceil(F.col("most") / F.lit(tile)).cast("int").alias("main_tiles"), F.ceil((F.col("n") - F.col("most")) / F.lit(tile)).cast("int").alias("rest_tiles")))
    m = m.join(one, "bucket").withColumn("rest", F.col("component") != F.col("main"))
    own = F.pmod(F.xxhash64("node"), F.when(F.col("rest"), F.col("rest_tiles")).otherwise(F.col("main_tiles"))).cast("int")
    m = m.withColumn("own", own)
    # y < 0 names a tile of the largest component
    of_rest = F.transform(
        F.sequence(F.lit(0), F.col("rest_tiles") - 1), lambda t: F.struct(F.least(F.col("own"), t).alias("x"), F.greatest(F.col("own"), t).alias("y"))
    )
    with_main = F.transform(F.sequence(F.lit(1), F.col("main_tiles")), lambda t: F.struct(F.col("own").alias("x"), (-t).alias("y")))
    of_main = F.transform(F.sequence(F.lit(0), F.col("rest_tiles") - 1), lambda t: F.struct(t.alias("x"), (-F.col("own") - 1).alias("y")))
    at = F.explode(F.when(F.col("rest"), F.concat(of_rest, with_main)).otherwise(of_main))
    return m.select("bucket", at.alias("at"), "node", "component").select("bucket", "at.x", "at.y", "node", "component")


def products(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of every two sets of (elements, weights) the sum of the products of their common elements' weights."""
    n, size = len(sets), [len(h) for h, _ in sets]
    common = np.zeros((n, n), np.float32)
    if not sum(size):
        return common
    elements, column, count = np.unique(np.concatenate([h for h, _ in sets]), return_inverse=True, return_counts=True)
    weight, row = np.concatenate([w for _, w in sets]).astype(np.float32), np.repeat(np.arange(n), size)
    shared = np.flatnonzero(count > 1)
    number = np.full(len(elements), -1)
    number[shared] = np.arange(len(shared))
    column = number[column]
    order = np.argsort(column, kind="stable")
    column, row, weight = column[order], row[order], weight[order]
    for low in range(0, len(shared), BLOCK):
        a, b = np.searchsorted(column, [low, low + BLOCK])
        v = np.zeros((n, min(BLOCK, len(shared) - low)), np.float32)
        v[row[a:b], column[a:b] - low] = weight[a:b]
        common += v @ v.T
    return common


class Forest:
    """Components of the members of a task; links() gives the pairs that join two of them."""

    def __init__(self, names: list):
        known = {c: i for i, c in enumerate(dict.fromkeys(names))}
        self.root, self.of = list(range(len(known))), [known[c] for c in names]

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def links(self, likely: np.ndarray, sure) -> list[tuple[int, int]]:
        """Pairs (j, i), j < i, with likely[i, j], in different components, for which sure(j, i)."""
        out = []
        for i in range(len(self.of)):
            for j in np.flatnonzero(likely[i, :i]).tolist():
                p, q = self.find(self.of[i]), self.find(self.of[j])
                if p != q and sure(j, i):
                    self.root[p] = q
                    out.append((j, i))
        return out
