"""Benchmark decontamination: every training passage queries a BM25 index of the test items."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from parchment.llm.common import documents, turn
from parchment.llm.words import Words, parts

K1, B = 1.2, 0.75
#: Items of a block of the index; entries of a part's table of block maxima.
BLOCK, PART = 16, 16 << 20
#: Bytes of the test items' texts, which the driver holds.
MOST = 1 << 30


@dataclass
class Part:
    """Postings of some of the items, impact-ordered by block.

    Impacts are BM25 weights over the item's own total, so that a passage with every word of an
    item scores 1. maxima[term, block] is the largest impact of a term on an item of a block.
    """

    item_id: list
    terms: np.ndarray  # sorted hashes
    maxima: np.ndarray  # float32[terms, blocks]
    key: np.ndarray  # sorted term * blocks + block of each posting
    item: np.ndarray
    impact: np.ndarray
    question: list  # sorted n-gram hashes of each item
    answer: list
    n: list  # words of these n-grams


def sentences(text: str) -> tuple[str, str]:
    """Question and answer: all but the last sentence, and that; of a single one its halves."""
    cut = [m.end() for m in re.finditer(r"[.!?]\s+", text)]
    if cut and text[cut[-1] :].strip():
        return text[: cut[-1]], text[cut[-1] :]
    if len(cut) > 1:
        return text[: cut[-2]], text[cut[-2] :]
    words = text.split()
    half = (len(words) + 1) // 2
    return " ".join(words[:half]), " ".join(words[half:])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words; no run if there are fewer words."""
    if len(h) < n or n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[k : len(h) - n + 1 + k]
    return out


class Short:
    """Items of too few words for a score, by the hash of their whole run of words."""

    def __init__(self, items: list[tuple], below: int):
        words = Words(pa.array([t for _, t in items], pa.string()))
        self.by: dict[int, dict[int, list]] = {}
        for (item_id, _), low, high in zip(items, words.text_at[:-1].tolist(), words.text_at[1:].tolist(), strict=True):
            if 0 < high - low < below:
                key = int(grams(words.hash[low:high], high - low)[0])
                self.by.setdefault(high - low, {}).setdefault(key, []).append(item_id)

    def found(self, words: Words) -> Iterator[tuple[int, object, int, int]]:
        """(text, item_id, first word, past word) of the first place of each item in each text."""
        for n, keys in self.by.items():
            h = grams(words.hash, n)
            at = np.flatnonzero(np.isin(h, np.fromiter(keys, np.uint64)))
            text = np.searchsorted(words.text_at, at, side="right") - 1
            whole = at + n <= words.text_at[text + 1]
            seen = set()
            for t, k in zip(text[whole].tolist(), at[whole].tolist(), strict=True):
                if (t, h[k]) not in seen:
                    seen.add((t, h[k]))
                    first = k - int(words.text_at[t])
                    yield from ((t, item_id, first, first + n) for item_id in keys[int(h[k])])


def build_index(items: list[tuple], min_words: int, gram: int = 3) -> tuple[list[Part], int]:
    """Parts of the index and the words of the longest item. Statistics are those of all items."""
    words = Words(pa.array([t for _, t in items], pa.string()))
    per = [words.hash[words.text_at[i] : words.text_at[i + 1]] for i in range(len(items))]
    keep = [i for i in range(len(items)) if len(per[i]) >= min_words]
    if not keep:
        return [], 0
    mean = sum(len(per[i]) for i in keep) / len(keep)
    distinct = [np.unique(per[i], return_counts=True) for i in keep]
    vocabulary, df = np.unique(np.concatenate([t for t, _ in distinct]), return_counts=True)
    idf = np.log1p((len(keep) - df + 0.5) / (df + 0.5))
    out, at = [], 0
    while at < len(keep):
        n = len(keep) - at
        while n > BLOCK and sum(len(distinct[k][0]) for k in range(at, at + n)) * (n // BLOCK + 1) > PART:
            n = (n + 1) // 2
        chosen = range(at, at + n)
        terms = np.unique(np.concatenate([distinct[k][0] for k in chosen]))
        blocks = -(-n // BLOCK)
        maxima = np.zeros((len(terms), blocks), np.float32)
        key, item, impact, question, answer, sizes = [], [], [], [], [], []
        for i, k in enumerate(chosen):
            t, tf = distinct[k]
            w = idf[np.searchsorted(vocabulary, t)] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(per[keep[k]]) / mean))
            w = w / w.sum()
            row = np.searchsorted(terms, t)
            np.maximum.at(maxima, (row, i // BLOCK), w.astype(np.float32) * np.float32(1.0001))
            key.append(row * blocks + i // BLOCK)
            item.append(np.full(len(t), i))
            impact.append(w)
            q, a = (Words(pa.array([x])).hash for x in sentences(items[keep[k]][1]))
            size = max(1, min(gram, len(q) or gram, len(a) or gram))
            question.append(np.unique(grams(q, size)))
            answer.append(np.unique(grams(a, size)))
            sizes.append(size)
        key, item, impact = np.concatenate(key), np.concatenate(item), np.concatenate(impact)
        order = np.argsort(key, kind="stable")
        out.append(Part([items[keep[k]][0] for k in chosen], terms, maxima, key[order], item[order], impact[order], question, answer, sizes))
        at += n
    return out, max(len(per[i]) for i in keep)


def search(part: Part, words: Words, stride: int, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, first word, past word) of every passage and item at the threshold.

    Passages are runs of 2 * stride words, one from every stride-th word on. Block-max WAND
    over all passages at once: a passage's distinct terms are summed with their largest
    impacts, first over all items, then block by block; only for blocks that may reach the
    threshold are postings read and items scored.
    """
    row = np.searchsorted(part.terms, words.hash)
    row[row == len(part.terms)] = 0
    at = np.flatnonzero(part.terms[row] == words.hash)
    if not len(at):
        return []
    row = row[at].astype(np.int64)
    count = np.diff(words.text_at)
    text = np.searchsorted(words.text_at, at, side="right") - 1
    before = np.concatenate([[0], np.cumsum(-(-np.maximum(count, 1) // stride))])
    nth = (at - words.text_at[text]) // stride
    window = before[text] + nth
    again = nth > 0
    size = len(part.terms)
    pairs = np.unique(np.concatenate([window * size + row, (window[again] - 1) * size + row[again]]))
    window, row = pairs // size, pairs % size
    most = part.maxima.max(axis=1)
    starts = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
    alive = np.add.reduceat(most[row], starts) >= threshold
    lengths = np.diff(np.concatenate([starts, [len(window)]]))
    keep = np.repeat(alive, lengths)
    window, row, starts = window[keep], row[keep], np.concatenate([[0], np.cumsum(lengths[alive])])[:-1]
    if not len(window):
        return []
    bound = np.add.reduceat(part.maxima[row], starts, axis=0)
    hit, block = np.nonzero(bound >= threshold)
    if not len(hit):
        return []
    # every pair of a passage and a block that is left, with the passage's terms in the block
    blocks = part.maxima.shape[1]
    terms_of = np.diff(np.concatenate([starts, [len(window)]]))[hit]
    pair = np.repeat(np.arange(len(hit)), terms_of)
    term = row[np.repeat(starts[hit], terms_of) + _within(terms_of)]
    there = part.maxima[term, block[pair]] > 0
    pair, key = pair[there], term[there] * blocks + block[pair[there]]
    low = np.searchsorted(part.key, key)
    many = np.searchsorted(part.key, key, side="right") - low
    posting = np.repeat(low, many) + _within(many)
    place = np.repeat(pair, many) * BLOCK + part.item[posting] - block[np.repeat(pair, many)] * BLOCK
    score = np.bincount(place, part.impact[posting], len(hit) * BLOCK)
    found = []
    for at in np.flatnonzero(score >= threshold).tolist():
        h, i = divmod(at, BLOCK)
        w = int(window[starts[hit[h]]])
        t = int(np.searchsorted(before, w, side="right") - 1)
        first = int(words.text_at[t]) + (w - int(before[t])) * stride
        found.append((t, i + int(block[h]) * BLOCK, float(score[at]), first, min(first + 2 * stride, int(words.text_at[t + 1]))))
    return found


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts, one behind the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.6,
    overlap: float = 0.5,
    min_words: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, score, question_overlap,
    answer_overlap, first_word, past_word (the best passage).

    Every passage of every document is a query; items are the documents of the index. A
    passage spans twice the longest item, and one starts each such length, so that every
    occurrence of an item lies in one passage. Of what scores `threshold` of the item's own
    score, those pairs stay for which `overlap` of the question's and of the answer's
    three-word runs are in the passage.

    The index is made of the test items alone. It is cut into parts of bounded size, each
    broadcast and searched by itself; document frequencies are those of all items. The driver
    holds the items and their frequencies, not anything of the corpus: a set of tests is small
    beside what it tests, and one of over MOST bytes is refused. Nothing is shuffled.

    Items with fewer than `min_words` words can't be scored and are looked up as exact runs of
    words, with score and overlaps of 1. Null items and items without words are not searched.
    Null text counts as empty; a text of any length is searched whole. Equal items are reported each,
    repeated rows as often as they stand, null ids as null. Without items or documents the
    result is empty. Further columns of any name are ignored.
    """
    d = documents(docs, id_col, text_col)
    spark = d.sparkSession
    size = items.agg(F.sum(F.octet_length(F.col(item_text).cast("string")))).first()[0] or 0
    if size > MOST:
        raise ValueError(f"test items of {size} bytes; split them into tables of at most {MOST}")
    rows = [tuple(r) for r in documents(items, item_col, item_text).orderBy("doc_id", "text").toLocalIterator()]
    index, longest = build_index(rows, min_words)
    item_kind = items.schema[item_col].dataType.simpleString()
    item_arrow = to_arrow_type(items.schema[item_col].dataType)
    kind = d.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, score double, question_overlap double, answer_overlap double, first_word bigint, past_word bigint"
    short = Short(rows, min_words)
    if not index and not short.by:
        return spark.createDataFrame([], schema)
    out = [d.mapInArrow(_search_batches(spark.sparkContext.broadcast(p), max(8, longest), threshold, overlap), schema) for p in index]
    if short.by:
        out.append(d.mapInArrow(_short_batches(spark.sparkContext.broadcast(short), item_arrow), schema))
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionAll(more)
    return whole


def _search_batches(shared, stride: int, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("decontamination")
        part: Part = shared.value
        for b in batches:
            best: dict[tuple[int, int], tuple] = {}
            for low, high in parts(b.column(1)):
                words = Words(b.column(1).slice(low, high - low))
                for t, i, score, first, past in search(part, words, stride, threshold):
                    have = np.unique(grams(words.hash[first:past], part.n[i]))
                    q, a = (len(np.intersect1d(x, have, assume_unique=True)) / len(x) if len(x) else 1.0 for x in (part.question[i], part.answer[i]))
                    if q >= overlap and a >= overlap:
                        base = int(words.text_at[t])
                        new = (round(score, 6), -first + base, q, a, first - base, past - base)
                        best[low + t, i] = max(new, best.get((low + t, i), new))
            if best:
                keys = sorted(best)
                rest = [best[k] for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array([k[0] for k in keys])),
                        pa.array([part.item_id[k[1]] for k in keys]),
                        *(pa.array([float(r[c]) for r in rest]) for c in (0, 2, 3)),
                        *(pa.array([r[c] for r in rest], pa.int64()) for c in (4, 5)),
                    ],
                    ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word", "past_word"],
                )

    return run


def _short_batches(shared, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn("decontamination")
        for b in batches:
            for low, high in parts(b.column(1)):
                hits = list(shared.value.found(Words(b.column(1).slice(low, high - low))))
                if hits:
                    one = pa.array([1.0] * len(hits))
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).take(pa.array([low + h[0] for h in hits])),
                            pa.array([h[1] for h in hits], item_type),
                            one,
                            one,
                            one,
                            *(pa.array([h[c] for h in hits], pa.int64()) for c in (2, 3)),
                        ],
                        ["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word", "past_word"],
                    )

    return run
