"""Words of whole batches of texts as hashes, without a Python step for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that make words: letters and digits of ASCII, and every byte of other characters.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Scripts without spaces, whose characters are words of their own: first two bytes from and to, and bytes of a character.
ALONE = (
    (0xE0B8, 0xE0BB, 3),  # Thai, Lao
    (0xE180, 0xE182, 3),  # Myanmar
    (0xE19E, 0xE19F, 3),  # Khmer
    (0xE381, 0xE9BF, 3),  # Hiragana, Katakana, Han
    (0xEFA4, 0xEFAB, 3),  # Han, compatibility forms
    (0xF0A0, 0xF0B3, 4),  # Han beyond the basic plane
)
_BASE = 0x9E3779B97F4A7C15 | 1
_VALUE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), np.uint64(base), np.uint64)
        have[0] = 1
        have = _powers[name] = np.cumprod(have)
    return have[:n]


def parts(texts: pa.Array, most: int = 1 << 20):
    """(first, past) of runs of rows with about `most` bytes together; a longer text is its own run."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    at = 0
    while at < len(sizes):
        total = np.cumsum(sizes[at : at + 65_536])
        n = max(1, int(np.searchsorted(total, most, side="right")))
        yield at, at + n
        at += n


class Words:
    """Words of some texts, in order: first, past (bytes in the joined lower-case texts), hash,
    and text_at: the number of words before each text and at the end."""

    def __init__(self, texts: pa.Array):
        low = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
        n = len(low)
        edge = np.frombuffer(low.buffers()[1], np.int64, n + 1, low.offset * 8) if n else np.zeros(1, np.int64)
        body = low.buffers()[2] if n else None
        data = np.frombuffer(body, np.uint8)[edge[0] : edge[-1]] if body is not None and body.size else np.zeros(0, np.uint8)
        self.edge = edge = edge - edge[0]
        self.data = data
        word = WORD[data]
        first, past = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        past[:-1] &= ~word[1:]
        inner = edge[1:-1][(edge[1:-1] > 0) & (edge[1:-1] < len(data))]
        if len(data) and data.max() >= 0xE0:
            inner = np.concatenate([inner, self._alone(data)])
        first[inner] = word[inner]
        past[inner - 1] = word[inner - 1]
        self.first = np.flatnonzero(first)
        self.past = np.flatnonzero(past) + 1
        self.hash = self.span_hash(self.first, self.past)
        self.text_at = np.searchsorted(self.first, edge)

    @staticmethod
    def _alone(data: np.ndarray) -> np.ndarray:
        """Where characters of scripts without spaces begin and end, but for the edges of the texts."""
        lead = np.flatnonzero(data >= 0xE0)
        two = data[lead].astype(np.uint16) << 8 | data[np.minimum(lead + 1, len(data) - 1)]
        size = np.zeros(len(lead), np.int64)
        for low, high, n in ALONE:
            size[(two >= low) & (two <= high)] = n
        at, size = lead[size > 0], size[size > 0]
        cut = np.concatenate([at, at + size])
        return cut[(cut > 0) & (cut < len(data))]

    def span_hash(self, first: np.ndarray, past: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans; equal bytes give equal hashes, wherever they stand."""
        if not hasattr(self, "_sum"):
            total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_VALUE[self.data] * _power("up", _BASE, len(self.data)), out=total[1:])
            self._sum = total
            self._down = _power("down", pow(_BASE, -1, 1 << 64), len(self.data) + 1)
        return mixed((self._sum[past] - self._sum[first]) * self._down[first] + (past - first).astype(np.uint64))

    def shingles(self, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every run of `size` words and the number of its text; a text with fewer words
        is one shingle, one without words has none."""
        text = np.repeat(np.arange(len(self.edge) - 1), np.diff(self.text_at))
        count = np.diff(self.text_at)
        total = np.zeros(len(self.hash), np.uint64)
        factor = 1
        for k in range(size):
            factor = factor * 0xD1342543DE82EF95 + 2 * k + 1 & (1 << 64) - 1 | 1
            left = len(self.hash) - k
            if left > 0:
                same = text[k:] == text[:left]
                total[:left] += np.where(same, self.hash[k:] * np.uint64(factor), np.uint64(0))
        within = np.arange(len(self.hash)) - np.repeat(self.text_at[:-1], count)
        last = np.repeat(np.maximum(count - size, 0), count)
        keep = within <= last
        return mixed(total[keep]), text[keep]
