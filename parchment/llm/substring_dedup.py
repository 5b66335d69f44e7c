"""Repeated passages: paragraphs that collide in a MinHash band, verified and cut by components.

Paragraphs are lines and, for passages that start and end inside lines or go over several, windows
of words that the text itself selects."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchment.llm.common import corpus_size, documents, durable, few, groups_for, release
from parchment.llm.components import components
from parchment.llm.tiles import Forest, meetings, products
from parchment.llm.words import _BASE, Words, _power, mixed, parts

SIZE, THRESHOLD, RECALL = 5, 0.8, 0.999
#: Words that a line has at least to be a paragraph; shorter lines are parts of windows.
MIN_WORDS = 20
#: Words of the shortest run that is certain to be found, and of a window: every run of RUN words holds a whole window.
RUN, WINDOW = 51, 26
#: Bands and rows of a band for windows. What they are for, equal runs, meets in any band; one edit in a window of
#: this size leaves its similarity under the threshold, so alike passages are what lines have their bands for.
WINDOW_BANDS = (1, 16)
#: Units that a task combines before it sends them; bytes sent to one range of bands; keys of one row.
FLUSH, RANGE, CHUNK = 1 << 20, 4 << 20, 4096


def tuned(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 64) -> tuple[int, int]:
    """Bands and rows of a band: of all that find a pair at the threshold with probability
    `recall` in at most `most` hashes, the one with the fewest chance meetings of less similar pairs."""
    best = None
    for rows in range(1, 9):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most:
            grid = np.linspace(0, threshold, 101)
            chance = float((1 - (1 - grid**rows) ** bands).mean())
            # a band costs a sent number for every paragraph, a chance meeting a verified pair
            cost = chance + 0.02 * bands
            best = min(best or (cost, bands, rows), (cost, bands, rows))
    return best[1], best[2]


def minima(shingles: np.ndarray, first: np.ndarray, past: np.ndarray, count: int) -> np.ndarray:
    """uint64[count, sets]: the least hash of each set shingles[first:past] under `count` hash functions."""
    seeds = np.random.default_rng(19970611).integers(1, 2**63, (count, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((count, len(first)), np.uint64)
    ends = np.stack([first, past], 1).ravel()
    padded = np.append(shingles, np.uint64(0))
    for k in range(count):
        # the product's upper half orders the shingles; a multiply-shift on mixed bits
        h = padded * seeds[k, 0]
        h ^= h >> np.uint64(32)
        h *= seeds[k, 1]
        out[k] = np.minimum.reduceat(h, ends)[::2] if len(first) else 0
    return out


class Units:
    """The paragraphs of some texts: first and past word, line of the first word, whether it is a
    line (or a window), text, key (hash of the words and the kind); and the shingle at each word."""

    def __init__(self, texts: pa.Array, min_words: int):
        w = self.words = Words(texts)
        self.total = np.zeros(len(w.hash) + 1, np.uint64)
        np.cumsum(w.hash * _power("up", _BASE, len(w.hash)), out=self.total[1:])
        text = np.repeat(np.arange(len(texts)), np.diff(w.text_at))
        newline = np.cumsum(w.data == 10)
        line = newline[w.first] if len(w.first) else np.zeros(0, np.int64)
        cut = np.flatnonzero(np.concatenate([[True], (line[1:] != line[:-1]) | (text[1:] != text[:-1])])) if len(line) else np.zeros(0, np.int64)
        ends = np.append(cut[1:], len(line))
        long = ends - cut >= max(min_words, SIZE)
        at = self._windows(text)
        self.first = np.concatenate([cut[long], at])
        self.past = np.concatenate([ends[long], at + WINDOW])
        self.is_line = np.arange(len(self.first)) < long.sum()
        self.text = text[self.first]
        before = np.concatenate([[0], newline])[w.edge[self.text]]
        self.line = line[self.first] - before
        self.key = mixed(self.hashes(self.first, self.past) + self.is_line.astype(np.uint64))
        self.shingle = self.hashes(np.arange(len(w.hash)), np.minimum(np.arange(len(w.hash)) + SIZE, len(w.hash)))

    def hashes(self, first: np.ndarray, past: np.ndarray) -> np.ndarray:
        """64-bit hashes of runs of words, equal for equal words wherever they stand."""
        down = _power("down", pow(_BASE, -1, 1 << 64), len(self.total))
        return mixed((self.total[past] - self.total[first]) * down[first] + (past - first).astype(np.uint64))

    def _windows(self, text: np.ndarray) -> np.ndarray:
        """First words of the windows whose hash is least of RUN - WINDOW + 1 neighbours', so that
        equal runs of RUN words hold equal windows."""
        n = len(text)
        left = self.words.text_at[1:][text] - np.arange(n) - WINDOW if n else np.zeros(0, np.int64)
        h = self.hashes(np.arange(n), np.minimum(np.arange(n) + WINDOW, n))
        reach, least, span = RUN - WINDOW + 1, h, 1
        while span < reach:
            step = min(span, reach - span)
            least, span = np.concatenate([np.minimum(least[:-step], least[step:]), least[len(least) - step :]]) if len(least) > step else least, span + step
        # 0 stands for a neighbourhood that doesn't fit into its text
        most, span = np.where(left >= reach - 1, least, np.uint64(0)), 1
        while span < reach:
            step = min(span, reach - span)
            most, span = np.concatenate([most[:step], np.maximum(most[step:], most[:-step])]) if len(most) > step else most, span + step
        return np.flatnonzero(most == h)

    def bands(self, which: np.ndarray, bands: int, rows: int, name: int) -> np.ndarray:
        """uint64[units, bands] of the units `which`; `name` tells schemes apart."""
        drawn = minima(self.shingle, self.first[which], self.past[which] - SIZE + 1, bands * rows)
        out = np.empty((len(which), bands), np.uint64)
        for band in range(bands):
            total = np.full(len(which), 2 * band + name, np.uint64)
            for k in range(band * rows, (band + 1) * rows):
                total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + drawn[k])
            out[:, band] = total
        return out

    def set_of(self, i: int) -> np.ndarray:
        return np.unique(self.shingle[self.first[i] : self.past[i] - SIZE + 1])


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.append(starts, len(values)).astype(np.int32), _longs(values))


def _entries(schemes: list[tuple[int, int]], ranges: int, min_words: int):
    """(part, bucket, key, several): the bands of a task's distinct paragraphs, by band and range
    of the hash space; several says that two texts of the task hold the paragraph."""

    def packed(held: list) -> Iterator[pa.RecordBatch]:
        at = 0
        for name, (bands, _) in enumerate(schemes):
            key, text, band = (np.concatenate([x[name][k] for x in held]) for k in range(3))
            order = np.lexsort((text, key))
            key, text, band = key[order], text[order], band[order]
            one = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            last = np.append(one[1:], len(key)) - 1
            several = text[one] != text[last] if len(key) else np.zeros(0, bool)
            for b in range(bands):
                bucket = band[one, b]
                part = (bucket >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                by = np.argsort(part, kind="stable")
                part = part[by]
                cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
                offsets = pa.array(np.append(cut, len(part)).astype(np.int32))
                flags = pa.ListArray.from_arrays(offsets, pa.array(several[by]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((part[cut] + np.uint64((at + b) * ranges)).astype(np.int64)), _lists(bucket[by], cut), _lists(key[one][by], cut), flags], ["part", "bucket", "key", "several"]
                )
            at += bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, 0
        for b in batches:
            for low, high in parts(b.column(0)):
                u = Units(b.column(0).slice(low, high - low), min_words)
                each = []
                for name, (bands, rows) in enumerate(schemes):
                    which = np.flatnonzero(u.is_line == (name == 1))
                    each.append((u.key[which], u.text[which] + seen, u.bands(which, bands, rows, name)))
                held.append(each)
                seen, size = seen + high - low, size + len(u.first)
                if size >= FLUSH:
                    yield from packed(held)
                    held, size = [], 0
        if held:
            yield from packed(held)

    return run


def _met(heads: set[int], ranges: int):
    """Of one range of one band: the buckets with several paragraphs, (bucket, leader, keys), and,
    for each scheme's first band, the paragraphs that several texts hold: (null, null, keys)."""

    def run(key, t):
        t = t.combine_chunks()
        bucket, keys = (np.asarray(t.column(c).combine_chunks().flatten()).view(np.uint64) for c in ("bucket", "key"))
        several = np.asarray(t.column("several").combine_chunks().flatten())
        order = np.lexsort((keys, bucket))
        bucket, keys, several = bucket[order], keys[order], several[order]
        one = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (keys[1:] != keys[:-1])]))
        count = np.diff(np.append(one, len(keys)))
        held = np.logical_or.reduceat(several, one) | (count > 1)
        bucket, keys = bucket[one], keys[one]
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        size = np.diff(np.append(start, len(bucket)))
        place = np.arange(len(bucket)) - np.repeat(start, size)
        many = np.repeat(size > 1, size)
        lead = keys[np.repeat(start, size)][many]
        rows = np.flatnonzero(place[many] % CHUNK == 0)
        found = pa.table({"bucket": _longs(bucket[many][rows]), "leader": _longs(lead[rows]), "keys": _lists(keys[many], rows)})
        if key[0].as_py() // ranges not in heads:
            return found
        again = keys[held]
        cut = np.arange(0, len(again), CHUNK)
        none = pa.nulls(len(cut), pa.int64())
        return pa.concat_tables([found, pa.table({"bucket": none, "leader": none, "keys": _lists(again, cut)})])

    return run


def _members(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high in parts(b.column(1)):
                u = Units(b.column(1).slice(low, high - low), min_words)
                w = u.words
                begin = w.text_at[u.text]
                whole = u.hashes(w.text_at[:-1], w.text_at[1:])[u.text] if len(w.hash) else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(low, high - low).take(pa.array(u.text)),
                        _longs(whole),
                        *(pa.array(x.astype(np.int32)) for x in (u.first - begin, u.past - begin, u.line)),
                        pa.array(u.is_line),
                        _longs(u.key),
                    ],
                    ["doc_id", "of", "first", "past", "line", "is_line", "key"],
                )

    return run


def repeated_passages(
    docs: DataFrame, threshold: float = THRESHOLD, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per passage that repeats in another document: doc_id, paragraph (line number from 0
    of its first word), n_words, class_id, class_paragraphs, class_docs, keep_doc_id, kept,
    first_word (from 0), kind (line or run).

    Paragraphs are the lines of a text with at least `min_words` words (lower case, letters and
    digits) and windows of WINDOW words across line breaks, selected by their own hashes so that
    every run of RUN words holds a whole window and equal runs hold equal ones. Two paragraphs of
    a kind are linked if the Jaccard similarity of their runs of five words is at least
    `threshold`; a class is a connected component of links with at least two documents. Its
    first paragraph, by doc_id and place, stays, the others are removals. class_id is its key.

    A line of a class is a row. Windows of classes that touch and share their keep_doc_id are one
    row, the run of words that they cover. Where touching windows cover less than RUN words, they
    count only if a run of RUN words around them is the same in another document.

    1. Each task sends the bands of its distinct paragraphs, packed by band and range: a passage
       of a third of all documents is one number for each task. The bands of lines follow from
       the threshold and the recall asked for.
    2. Paragraphs that meet or repeat are looked up in the documents again.
    3. Every member of a bucket meets the bucket's leader. In buckets that hold several
       components even then, all pairs across components are compared, tile by tile, so that every
       pair that shares a band is compared or already connected. Similarities are exact.

    Null and empty texts have no paragraphs. A null doc_id is left out. Rows that repeat a
    doc_id count as one document. An empty table gives an empty result. Further columns of any
    name are ignored. A very long line is one paragraph, a very long text has many. State between
    the steps is checkpointed. Keys are 64-bit hashes of the words.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schemes = [WINDOW_BANDS, tuned(threshold)]
    d = documents(docs, id_col, text_col).where("doc_id IS NOT NULL")
    _, size = corpus_size(d)
    # about 0.7 bytes are sent for a byte of text; a task's share of a range stays worth a row
    ranges = groups_for(size, max(RANGE, 8 * math.isqrt(size)))
    sent = d.select("text").mapInArrow(_entries(schemes, ranges, min_words), "part bigint, bucket array<bigint>, key array<bigint>, several array<boolean>")
    met = durable(sent.groupBy("part").applyInArrow(_met({0, schemes[0][0]}, ranges), "bucket bigint, leader bigint, keys array<bigint>"))
    release(docs.sparkSession)
    found = d.mapInArrow(_members(min_words), f"doc_id {kind}, of bigint, first int, past int, line int, is_line boolean, key bigint")
    # written out, so that the join's sides are plain shuffles, of which a hot key's can be split
    wanted = durable(met.select(F.explode("keys").alias("key")).distinct())
    members = durable(found.join(wanted, "key", "left_semi"))
    release(docs.sparkSession)

    buckets = met.where("leader IS NOT NULL").select("bucket", "leader", F.explode("keys").alias("node"))
    edges = durable(buckets.where("leader <> node").select("leader", F.col("node").alias("member")).distinct())
    sets = _sets(edges, members, d, min_words)
    links = durable(_verified(edges, sets, threshold))
    linked = components(links, "leader", "member")
    several = met.where("leader IS NOT NULL").groupBy("bucket").agg(F.sum(F.size("keys")).alias("n")).where("n > 2")
    apart = durable(meetings(buckets.join(several, "bucket", "left_semi").select("bucket", "node"), linked))
    if not apart.isEmpty():
        linked = components(links.unionAll(durable(_across(apart, sets, threshold))), "leader", "member")

    classed = members.join(linked, F.col("key") == F.col("node"), "left").withColumn("class", F.coalesce("component", "key")).drop("node", "component")
    each = classed.groupBy("class", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line", "first")).alias("at"))
    classes = each.groupBy("class").agg(
        F.sum("n").alias("class_paragraphs"), F.count(F.lit(1)).alias("class_docs"), F.min(F.struct("doc_id", "at")).alias("keep")
    )
    classes = durable(classes.where("class_docs > 1").select("class", F.col("class_paragraphs").cast("int"), F.col("class_docs").cast("int"), "keep"))
    is_first = (F.col("doc_id") == F.col("keep.doc_id")) & (~F.col("is_line") | (F.col("line") == F.col("keep.at.line")) & (F.col("first") == F.col("keep.at.first")))
    rows = classed.join(classes, "class").withColumns({"keep_doc_id": F.col("keep.doc_id"), "kept": is_first}).drop("key", "keep")
    rows = durable(_stretches(rows))
    release(docs.sparkSession)
    out = [
        "doc_id",
        F.col("line").alias("paragraph"),
        "n_words",
        F.lower(F.hex("class")).alias("class_id"),
        F.col("class_paragraphs").cast("bigint").alias("class_paragraphs"),
        F.col("class_docs").cast("bigint").alias("class_docs"),
        "keep_doc_id",
        "kept",
        F.col("first").alias("first_word"),
    ]
    lines = rows.where("is_line").withColumn("n_words", F.col("past") - F.col("first"))
    runs = _runs(rows.where("NOT is_line"), d, kind)
    return lines.select(*out, F.lit("line").alias("kind")).unionByName(runs.select(*out, F.lit("run").alias("kind")))


def _sets(edges: DataFrame, members: DataFrame, d: DataFrame, min_words: int) -> DataFrame:
    """(key, shingles) of the paragraphs that edges name, cut from one document of each."""
    ends = edges.select(F.col("leader").alias("key")).unionAll(edges.select("member")).distinct()
    # summed before it is shuffled: a passage of very many documents is one row of each task
    one = members.groupBy("key").agg(F.min("doc_id").alias("needed_id")).join(ends, "key", "left_semi")
    by_doc = durable(one.groupBy("needed_id").agg(F.collect_list("key").alias("wanted")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low, high in parts(b.column(0)):
                wanted = np.unique(np.asarray(b.column(1).slice(low, high - low).flatten()))
                u = Units(b.column(0).slice(low, high - low), min_words)
                key, at = np.unique(u.key.view(np.int64), return_index=True)
                at = at[np.isin(key, wanted)]
                sets = [u.set_of(i) for i in at.tolist()]
                starts = np.cumsum([0, *(len(s) for s in sets)])[:-1]
                yield pa.RecordBatch.from_arrays([_longs(u.key[at]), _lists(np.concatenate([*sets, np.zeros(0, np.uint64)]), starts)], ["key", "shingles"])

    near = d.join(few(by_doc), F.col("doc_id") == F.col("needed_id")).select("text", "wanted")
    return durable(near.mapInArrow(cut, "key bigint, shingles array<bigint>").dropDuplicates(["key"]))


def _verified(edges: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(leader, member) of the edges whose Jaccard similarity is at the threshold."""
    x, y = (sets.select(F.col("key").alias(name), F.col("shingles").alias(s)) for name, s in (("leader", "x"), ("member", "y")))
    common = F.size(F.array_intersect("x", "y"))
    # sizes alone rule most pairs of lines of other lengths out
    alike = (F.least(F.size("x"), F.size("y")) >= threshold * F.greatest(F.size("x"), F.size("y"))) & (common >= threshold * (F.size("x") + F.size("y") - common))
    return edges.join(x, "leader").join(y, "member").where(alike).select("leader", "member")


def _across(apart: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(leader, member): links at the threshold that connect the components of each bucket."""
    dealt = apart.join(sets, F.col("node") == F.col("key")).drop("key")

    def run(key, t):
        t = t.combine_chunks()
        x = t.column("shingles").combine_chunks()
        at, flat = np.asarray(x.offsets), np.asarray(x.values)
        own = [flat[at[i] : at[i + 1]] for i in range(len(x))]
        size = np.array([len(s) for s in own])
        common = products([(s, np.ones(len(s))) for s in own])
        likely = common >= threshold * (size[:, None] + size - common.astype(np.float64)) * (1 - 1e-6)
        found = Forest(t.column("component").to_pylist()).links(likely, lambda j, i: True)
        first, second = (pa.array([p[k] for p in found], pa.int64()) for k in (0, 1))
        return pa.table({"leader": t.column("node").take(first), "member": t.column("node").take(second)})

    return dealt.groupBy("bucket", "x", "y").applyInArrow(run, "leader bigint, member bigint")


def _stretches(rows: DataFrame) -> DataFrame:
    """rows with low and high, the words that touching paragraphs of the same kind cover."""
    order = Window.partitionBy("doc_id", "of", "is_line").orderBy("first")
    rows = rows.withColumn("new", F.when(F.col("first") <= F.lag("past").over(order), 0).otherwise(1)).withColumn("stretch", F.sum("new").over(order))
    whole = Window.partitionBy("doc_id", "of", "is_line", "stretch")
    return rows.withColumns({"low": F.min("first").over(whole), "high": F.max("past").over(whole)}).drop("new", "stretch")


def _runs(windows: DataFrame, d: DataFrame, kind: str) -> DataFrame:
    """The runs of words that touching windows with the same keep_doc_id cover."""
    short = windows.where(f"high - low < {RUN}")
    # a run that two documents share holds windows of the same class in both
    tested = windows.join(durable(short.select("class").distinct()), "class", "left_semi")
    by_doc = durable(tested.groupBy(F.col("doc_id").alias("needed_id"), F.col("of").alias("needed_of")).agg(F.collect_set("first").alias("wanted")))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ofs, firsts, hashes = [], [], [], []
            for k in range(b.num_rows):
                u = Units(b.column(1).slice(k, 1), 1 << 30)
                n = len(u.words.hash)
                of = int(u.hashes(np.array([0]), np.array([n])).view(np.int64)[0])
                for first in b.column(3)[k].as_py() if of == b.column(2)[k].as_py() else ():
                    at = np.arange(max(0, first + WINDOW - RUN), min(first, n - RUN) + 1)
                    ids += [k] * len(at)
                    ofs += [of] * len(at)
                    firsts += [first] * len(at)
                    hashes.append(u.hashes(at, at + RUN))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(ids, pa.int64())), pa.array(ofs, pa.int64()), pa.array(firsts, pa.int32()), _longs(np.concatenate([*hashes, np.zeros(0, np.uint64)]))], ["doc_id", "of", "first", "run"]
            )

    near = d.join(few(by_doc), F.col("doc_id") == F.col("needed_id")).select("doc_id", "text", "needed_of", "wanted")
    tried = durable(near.mapInArrow(around, f"doc_id {kind}, of bigint, first int, run bigint"))
    shared = tried.groupBy("run").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a <> b").select("run")
    sure = tried.join(shared, "run", "left_semi").select("doc_id", "of", "first").distinct()
    w = windows.where(f"high - low >= {RUN}").unionByName(short.join(sure, ["doc_id", "of", "first"], "left_semi"))
    order = Window.partitionBy("doc_id", "of").orderBy("first")
    goes_on = (F.col("first") <= F.lag("past").over(order)) & (F.col("keep_doc_id") == F.lag("keep_doc_id").over(order))
    w = w.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("piece", F.sum("new").over(order))
    runs = w.groupBy("doc_id", "of", "piece").agg(F.min(F.struct("first", "line", "class", "class_paragraphs", "class_docs", "keep_doc_id", "kept")).alias("f"), F.max("past").alias("past"))
    return runs.select("doc_id", "f.*", (F.col("past") - F.col("f.first")).alias("n_words"))


def without_repeats(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the text without the passages that repeated_passages() did not keep: whole lines
    go with their line break, runs from their first word to their last."""
    kind = docs.schema[id_col].dataType.simpleString()
    lost = passages.where("NOT kept").groupBy(F.col("doc_id").alias("loser")).agg(F.collect_list(F.struct("kind", "paragraph", "first_word", "n_words")).alias("lost"))
    d = documents(docs, id_col, text_col).join(lost, F.col("doc_id") == F.col("loser"), "left").select("doc_id", "text", "lost")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, lost in enumerate(b.column(2).to_pylist()):
                if lost:
                    texts[i] = _without(texts[i], lost)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return d.mapInArrow(cut, f"doc_id {kind}, text string")


_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def _without(text: str, lost: list[dict]) -> str:
    spans, words, at = [], [m.span() for m in _WORD.finditer(text)], 0
    whole = {x["paragraph"] for x in lost if x["kind"] == "line"}
    for k, line in enumerate(text.split("\n")):
        if k in whole:
            spans.append((at, min(len(text), at + len(line) + 1)))
        at += len(line) + 1
    spans += [(words[x["first_word"]][0], words[x["first_word"] + x["n_words"] - 1][1]) for x in lost if x["kind"] == "run"]
    out, at = [], 0
    for low, high in sorted(spans):
        out.append(text[at : max(at, low)])
        at = max(at, high)
    rest = "".join(out) + text[at:]
    return rest.removesuffix("\n") if len(text.split("\n")) - 1 in whole else rest
