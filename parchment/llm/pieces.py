"""SentencePiece encoding and decoding of merge-type (BPE) models by a prefix table."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from parchment.llm.common import documents, kept

SPACE = "▁"
#: Cached units; the cache starts anew when it is full.
CACHE = 300_000
#: Characters of text that one output batch comes from, unless a single text is longer.
SLICE = 2 << 20


#: Ways to cut a text into units, the finest first: letters apart from other characters, or only
#: where a space mark or a line break follows. A model takes the first that cuts none of its pieces.
UNITS = (
    rf"\n|{SPACE}*[^\W\d_²³¹]+|{SPACE}*(?:(?![{SPACE}\n])[\W\d_²³¹])+|{SPACE}+",
    rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+",
)


class PrefixTable:
    """Encoder and decoder of one merge-type model.

    The encoding of every prefix of a string ends in exactly one token. It is found among the
    tokens that an Aho-Corasick automaton reports as ending at that position: the one that is
    compatible with the last token of the prefix before it, where two tokens are compatible if
    merging their joined characters gives the two again. The table keeps this one token for
    each prefix, and the ids are read off backwards from the end. That takes time in proportion
    to the text, whatever its length.

    A text falls into units before that, cut where no merge can cross because no piece does.
    This is checked for every piece when the model is read. Units that were seen are taken from a
    bounded cache.
    """

    def __init__(self, model: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        self.text: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.text.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i):
                self.text.append(b"")
            elif sp.is_unknown(i):
                self.text.append(" ⁇ ".encode())
            else:
                self.id[piece], self.rank[piece] = i, sp.get_score(i)
                self.text.append(piece.replace(SPACE, " ").encode())
        if any(c not in self.id for piece in self.id for c in piece):
            raise ValueError("a piece has a character that is no piece")
        for unit in UNITS:
            self.unit = re.compile(unit)
            if all(self.unit.findall(p) == [p] for p in self.id):
                break
        else:
            raise ValueError("a piece crosses a unit's edge")
        self.bytes_of = {i: b for b, i in self.byte.items()}
        self.pair: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.id:
            if len(piece) == 1 or self.merged(piece) == [piece]:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.packed = {p: i.to_bytes(4, "little") for p, i in self.id.items()}
        self.cache: dict[str, bytes] = {}

    def merged(self, s: str) -> list[str]:
        """The merges themselves, for the short strings of a compatibility test: best score first, then leftmost."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.rank.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        known = self.pair.get((left, right))
        if known is None:
            if len(self.pair) > 4 * CACHE:
                self.pair.clear()
            known = self.pair[left, right] = self.merged(left + right) == [left, right]
        return known

    def _unit(self, s: str) -> bytes:
        n = len(s)
        last: list[str | None] = [None] * n
        get = self.pair.get
        for end, piece in self.automaton.iter(s):
            if last[end] is not None:
                continue
            before = end - len(piece)
            if before < 0:
                last[end] = piece
                continue
            previous = last[before]
            if previous is None:  # a character that the model doesn't have: nothing merges with it
                last[end] = piece
                continue
            known = get((previous, piece))
            if known is None:
                known = self.compatible(previous, piece)
            if known:
                last[end] = piece
        out, at = [], n - 1
        while at >= 0:
            piece = last[at]
            if piece is None:
                out.extend(self._fallback(s[at]))
                at -= 1
            else:
                out.append(self.packed[piece])
                at -= len(piece)
        return b"".join(reversed(out))

    def _fallback(self, c: str) -> list[bytes]:
        """A character's bytes, last first."""
        if not self.byte:
            return [self.unknown.to_bytes(4, "little")]
        return [self.byte[b].to_bytes(4, "little") for b in reversed(c.encode())]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, with begin and end."""
        cache, out = self.cache, []
        if text:
            units = self.unit.findall(SPACE + text.replace(" ", SPACE))
            get = cache.get
            for u in units:
                ids = get(u)
                if ids is None:
                    ids = self._unit(u)
                    if len(u) <= 64:
                        if len(cache) >= CACHE:
                            cache.clear()
                        cache[u] = ids
                out.append(ids)
        return self.begin.to_bytes(4, "little") + b"".join(out) + self.end.to_bytes(4, "little")

    def decode(self, ids: bytes) -> str:
        """The text of packed ids: the first piece loses its space mark, control ids say nothing,
        runs of byte ids are UTF-8, and of these each byte that is part of no character is U+FFFD."""
        tokens = memoryview(ids).cast("I").tolist()
        raw = b"".join(map(self.text.__getitem__, tokens))
        first = next((t for t in tokens if t not in (self.begin, self.end)), None)
        if first is not None and first not in self.bytes_of and raw[:1] == b" ":
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            out, rest = [], raw
            while rest:
                try:
                    out.append(rest.decode())
                    break
                except UnicodeDecodeError as e:
                    out.append(rest[: e.start].decode() + "�")
                    rest = rest[e.start + 1 :]
            return "".join(out)


def prefix_table(model: str) -> PrefixTable:
    return kept("pieces", model, lambda: PrefixTable(model))


def roundtrip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (packed little-endian unsigned 32-bit), n_tokens, decoded.

    Whole texts are encoded with begin and end ids and decoded again. Null text counts as
    empty and has the begin and end ids alone. Every row stands for itself, so repeated rows
    and ids, null ids and empty tables need no rule. Further columns of any name are ignored.
    `model` is a path that every executor has. Nothing is shuffled; a lost task runs again.
    """
    d = documents(docs, id_col, text_col)
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prefix_table(model)

        def batch(part: list) -> pa.RecordBatch:
            who, ids, decoded = zip(*part, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(who, id_type), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(decoded, pa.string())],
                ["doc_id", "ids", "n_tokens", "decoded"],
            )

        for b in batches:
            id_type, part, held = b.schema.field(0).type, [], 0
            for who, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = table.encode(text := text.as_py())
                part.append((who, ids, table.decode(ids)))
                held += len(text)
                if held > SLICE:
                    yield batch(part)
                    part, held = [], 0
            if part:
                yield batch(part)

    return d.mapInArrow(run, f"doc_id {kind}, ids binary, n_tokens bigint, decoded string")
