"""Vectorised word splitting and hashing over batches of UTF-8 texts.

A word is a maximal run of bytes other than space and ``\\t``..``\\r``
(``[^\\x20\\x09-\\x0D]+``); no UTF-8 continuation byte is one of these, so
splitting bytes splits characters.  Texts are hashed in slabs of about
``SLAB`` bytes, which bounds the temporary arrays however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLAB = 1 << 20
_BASE = U(0x9E6C63D0676A9A99)
_BASE_2 = U(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All of ASCII but digits and letters.
NOT_ALPHANUMERIC = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


class _Powers:
    """base**i and base**-i modulo 2**64, grown as needed."""

    def __init__(self, base: np.uint64):
        self.base, self.up, self.down = int(base), np.ones(1, U), np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << int(n - 1).bit_length()
            for name, b in (("up", self.base), ("down", _inverse(self.base))):
                out, have = np.empty(size, U), 1
                out[0] = 1
                while have < size:
                    step = U(pow(b, have, 1 << 64))
                    take = min(have, size - have)
                    out[have : have + take] = out[:take] * step
                    have += take
                setattr(self, name, out)
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS, _WORD_POWERS_2 = _Powers(_BASE), _Powers(_BASE_2), _Powers(U(0xA0761D6478BD642F))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts; null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slabs(offsets: np.ndarray, limit: int = SLAB) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts that hold about ``limit`` bytes, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def _hash_pieces(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + SLAB, "right")), i + 1)
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _BYTE_POWERS.get(b - a)
        total = np.empty(b - a + 1, U)
        total[0] = 0
        np.cumsum((raw[a:b].astype(U) + U(1)) * up, out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (total[e] - total[s]) * down[s]
        i = j
    return mix(out ^ _BASE)


def split(raw: np.ndarray, offsets: np.ndarray, lower: bool = False, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, their 64-bit hashes, and how many each text has; breaks: the bytes between words."""
    if lower:
        raw = _LOWER[raw]
    n = len(raw)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0, U), np.zeros(len(offsets) - 1, np.int64)
    inside = ~breaks[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a text's first byte starts a word even after a word
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, _hash_pieces(raw, starts, ends), counts


def grams(hashes: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """Hashes of the runs of k words that start at each word; len(hashes) - k + 1 of them."""
    if len(hashes) < k:
        return np.zeros(0, U)
    up, down = (_WORD_POWERS_2 if second else _WORD_POWERS).get(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[:-1], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: len(hashes) - k + 1] + U(k))


def spans(hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """Hashes of the runs of words begin to end, each of its own length; equal runs of equal length have equal ones."""
    up, down = (_WORD_POWERS_2 if second else _WORD_POWERS).get(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[:-1], out=total[1:])
    return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(U))


def without_spaces(raw: np.ndarray) -> np.ndarray:
    """The bytes of all words, one after the other."""
    return np.ascontiguousarray(raw[~_SPACE[raw]])
