"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is a run of bytes that are not ASCII white space (0x20, 0x09-0x0D); in UTF-8 such bytes are never part of
a longer character, so this is the same as the run over code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from voxmend.llm.common import plain_strings

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random odd 64-bit value for each byte: the letters of the rolling hash.
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes that are laid out at once; a longer text is laid out alone.
CHUNK_BYTES = 1 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n (or more); kept between calls, but for texts of unusual length."""
    kept = _powers.get(int(base))
    if kept is not None and len(kept) >= n:
        return kept
    out = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
    out[0] = 1
    out = np.multiply.accumulate(out)
    if n <= 4 * CHUNK_BYTES:
        _powers[int(base)] = out
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of h (a bijection on 64 bits)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Layout:
    """Some texts end to end. data: their bytes; ends of texts in off; word i is data[start[i]:end[i]]; text d has words word_off[d]:word_off[d + 1]."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        n = len(data)
        solid = ~SPACE[data]
        first, last = solid.copy(), solid.copy()
        cut = np.zeros(n + 1, bool)
        cut[off] = True
        if n:
            first[1:] &= ~solid[:-1] | cut[1:n]
            last[:-1] &= ~solid[1:] | cut[1:n]
        self.solid = solid
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.word_off = np.searchsorted(self.start, off)
        self.n_words = np.diff(self.word_off)
        self.doc = np.repeat(np.arange(len(off) - 1), self.n_words)

    def prefix(self, data: np.ndarray | None = None) -> np.ndarray:
        """Prefix sums of the rolling hash; span() cuts a span's hash out of them."""
        data = self.data if data is None else data
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data))[: len(data)], out=out[1:])
        return out

    @staticmethod
    def span(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((prefix[end] - prefix[start]) * powers(BASE_INVERSE, len(prefix))[start])

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of the flagged bytes each text has."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.off])

    def per_text_words(self, values: np.ndarray) -> np.ndarray:
        """Sums of per-word values over each text."""
        total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
        np.cumsum(values, out=total[1:])
        return np.diff(total[self.word_off])


def chunks(column: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts with about chunk_bytes; a null text counts as empty."""
    column = plain_strings(column)
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    off = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and off[-1] else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + chunk_bytes, "right")) - 1)
        yield first, last, data[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


def found_again(key: np.ndarray) -> np.ndarray:
    """Which values occur twice or more, the first occurrence included."""
    out = np.zeros(len(key), bool)
    if len(key) > 1:
        order = np.argsort(key)
        ranked = key[order]
        same = ranked[1:] == ranked[:-1]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def ngrams(word_hash: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash with the text's number mixed in) of every n-word window inside one text."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rolled = word_hash[:m].copy()
    for k in range(1, n):
        rolled *= BASE
        rolled += word_hash[k : k + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return at, mixed(rolled[at]) ^ mixed((doc[at].astype(np.uint64) + np.uint64(1)) * BASE)


def covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size words lie in a window of n words that starts at one of at (which are distinct)."""
    edge = np.zeros(size + 1, np.int32)
    edge[at] += 1
    edge[at + n] -= 1
    return np.cumsum(edge[:-1]) > 0
