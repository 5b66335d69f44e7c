"""Stated sets of strings looked up in all documents: one automaton for many needles, one pass over the texts."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the needles of one automaton. A larger set is several automata, each a pass of its own.
BLOCK = 16 << 20


def _blocks(needles: DataFrame) -> Iterator[dict[str, list]]:
    held: dict[str, list] = {}
    size = 0
    for r in needles.select("needle_id", "needle").where("needle <> ''").toLocalIterator():
        size += 0 if r["needle"] in held else len(r["needle"])
        held.setdefault(r["needle"], []).append(r["needle_id"])
        if size >= BLOCK:
            yield held
            held, size = {}, 0
    if held:
        yield held


def containing(needles: DataFrame, docs: DataFrame) -> DataFrame:
    """needle_id, doc_id, start: the first place of each needle (needle_id, needle) in each document
    (doc_id, text) that holds it. Null and empty needles are in no document."""
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((needles, "needle_id"), (docs, "doc_id"))]
    schema = f"needle_id {kinds[0]}, doc_id {kinds[1]}, start bigint"
    spark, d, out = docs.sparkSession, docs.select("doc_id", "text").where("text IS NOT NULL"), None
    for held in _blocks(needles):
        shared = spark.sparkContext.broadcast(held)
        part = d.mapInArrow(_search(shared), schema)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], schema) if out is None else out


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for needle, ids in shared.value.items():
            machine.add_word(needle, (len(needle), ids))
        machine.make_automaton()
        for b in batches:
            who, where, what = [], [], []
            for i, text in enumerate(b.column(1)):
                first: dict[int, int] = {}
                for end, (n, ids) in machine.iter(text.as_py()):
                    if id(ids) not in first:
                        first[id(ids)] = end
                        for needle_id in ids:
                            what.append(needle_id)
                            who.append(i)
                            where.append(end + 1 - n)
            if who:
                yield pa.RecordBatch.from_arrays([pa.array(what), b.column(0).take(pa.array(who)), pa.array(where, pa.int64())], ["needle_id", "doc_id", "start"])

    return run


def spread(needles: DataFrame, docs: DataFrame) -> DataFrame:
    """needle_id, n: how many documents hold the needle, for those that any holds."""
    return containing(needles, docs).groupBy("needle_id").agg(F.count_distinct("doc_id").alias("n"))
