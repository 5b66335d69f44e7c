"""Token counts of whole texts; huge ones by chunks whose overlaps are resynchronised."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from parchment.llm.common import documents

#: Code points of a chunk and of its first overlap; texts up to a chunk are encoded at once.
CHUNK, OVERLAP = 32_768, 512
#: Code points of text in one call of the library.
SLICE = 1 << 19


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _guard(t) -> int:
    """No string of an added token that a chunk's edge cuts reaches so far from the edge."""
    return 2 + max([8, *(len(a.content) for a in t.get_added_tokens_decoder().values())])


def _starts(encoding) -> dict[int, int]:
    """Offset of each pre-token's first character -> number of tokens before it."""
    words, out = encoding.word_ids, {}
    for k, (start, _) in enumerate(encoding.offsets):
        if k == 0 or words[k] is None or words[k] != words[k - 1]:
            out.setdefault(start, k)
    return out


def count_tokens(t, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of text, as t.encode(text, add_special_tokens=False) has them.

    A chunk starts before the end of the one ahead of it. A place in the overlap where both
    scans start a pre-token, away from both edges by more than an added token's length, is
    stable: pre-tokens ahead of it are those of the whole text, since the left scan began at
    such a place, and from there on both scans read the same characters in the same state.
    Counts are spliced at the last such place. Without one the overlap is doubled; if it would
    reach back to where the left chunk began, the left chunk itself grows instead.
    """
    if len(text) <= chunk:
        return len(t.encode(text, add_special_tokens=False))
    guard, total, start, width = _guard(t), 0, 0, chunk
    left = t.encode(text[:width], add_special_tokens=False)
    skip, end = 0, width  # tokens of the left chunk that are counted already
    while end < len(text):
        ahead, by = _starts(left), max(overlap, 4 * guard)
        while True:
            if by >= end - start:  # nothing in common: a longer left chunk
                width *= 2
                end = min(len(text), start + width)
                left = t.encode(text[start:end], add_special_tokens=False)
                break
            begin = end - by
            right = t.encode(text[begin : begin + chunk + by], add_special_tokens=False)
            both = _starts(right)
            common = [x for x in both if guard <= x <= by - guard and ahead.get(x + begin - start, -1) >= skip]
            if common:
                x = max(common)
                total += ahead[x + begin - start] - skip
                skip, start, left, width = both[x], begin, right, chunk
                end = min(len(text), begin + chunk + by)
                break
            by *= 2
    return total + len(left) - skip


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (more tokens than limit).

    Counts are those of the tokenizers library for the file at `path` (on every executor),
    without special tokens added, truncation or padding. Null text counts as empty: no bytes,
    no tokens. Every row stands for itself, so repeated rows and ids, null ids and empty
    tables need no rule. Further columns of any name are ignored. Nothing is shuffled.
    """
    d = documents(docs, id_col, text_col)
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            texts = b.column(1)
            counts, sizes, small, held = [0] * len(texts), [0] * len(texts), [], 0

            def flush() -> None:
                for (k, _), e in zip(small, t.encode_batch_fast([x for _, x in small], add_special_tokens=False), strict=True):  # noqa: B023
                    counts[k] = len(e)  # noqa: B023
                small.clear()  # noqa: B023

            for k in range(len(texts)):
                text = texts[k].as_py()
                sizes[k] = len(text.encode())
                if len(text) > CHUNK:
                    counts[k] = count_tokens(t, text)
                    continue
                small.append((k, text))
                held += len(text)
                if held > SLICE:
                    flush()
                    held = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return d.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
