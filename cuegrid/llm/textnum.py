"""Words of many texts at once as NumPy arrays, straight from Arrow's buffers.

A word is a run of bytes other than 0x20 and 0x09-0x0D; A-Z are lower-cased, other letters stay.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 4 << 20
_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
#: Bytes between words of ASCII letters and digits and of all other characters beyond ASCII.
SIGNS = np.zeros(256, bool)
SIGNS[:128] = True
SIGNS[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
#: Words hashed at once; few enough that their numbers stay in a core's cache.
_CHUNK = 1 << 12


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which near values become unrelated ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of text and at most ``rows`` rows each, so that memory follows the longest text and not the batch."""
    size = np.cumsum(_lengths(batch.column(batch.schema.get_field_index(text))))
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = min(start + rows, batch.num_rows, max(start + 1, int(np.searchsorted(size, base + limit, "right"))))
        yield batch.slice(start, end - start)
        start = end


_kept: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, or more, of the hash's factor and of its inverse; those of usual pieces are kept."""
    if _kept and len(_kept[0]) >= n:
        return _kept[0], _kept[1]
    power, inverse = np.full(n, _P), np.full(n, _PINV)
    power[0] = inverse[0] = 1
    np.cumprod(power, out=power)
    np.cumprod(inverse, out=inverse)
    if n <= 1 << 20:
        _kept[:] = [power, inverse]
    return power, inverse


def freed() -> None:
    """Gives memory that Arrow and the C library keep for later back to the system; called where a task ends, as Spark's Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's
    if trim is not None:
        trim(0)


def _lengths(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)


class Words:
    """The words of a column of texts, runs of bytes that are not ``between`` words: ``data`` the lower-cased bytes, ``starts`` and ``ends`` of each word, ``row`` of each word, ``first`` word of each row (and the end)."""

    def __init__(self, col: pa.Array, between: np.ndarray = _WS):
        n = _lengths(col)
        raw = np.zeros(0, np.uint8)
        if len(col):
            filled = col.cast(pa.large_string()).fill_null("")
            begin = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset]  # a slice shares its parent's buffer
            raw = np.frombuffer(filled.buffers()[2] or b"", np.uint8)[begin : begin + n.sum()]
        self.data = _LOWER[raw]
        begins = np.concatenate(([0], np.cumsum(n)))
        word = ~between[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[begins] = True
        prev = np.concatenate(([False], word[:-1])) if len(raw) else word
        self.starts = np.flatnonzero(word & (~prev | edge[:-1]))
        after = np.concatenate((word[1:], [False])) if len(raw) else word
        self.ends = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, begins)
        self.row = np.repeat(np.arange(len(col)), np.diff(self.first))
        self.raw = raw

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word: a polynomial over its bytes, then mixed."""
        out = np.empty(len(self), np.uint64)
        for i in range(0, len(self), _CHUNK):
            s, e = self.starts[i : i + _CHUNK], self.ends[i : i + _CHUNK]
            base, top = s[0], e[-1]
            power, back = powers(top - base + 1)
            sums = np.zeros(top - base + 1, np.uint64)
            np.cumsum((self.data[base:top].astype(np.uint64) + np.uint64(1)) * power[: top - base], out=sums[1:])
            out[i : i + _CHUNK] = mix64((sums[e - base] - sums[s - base]) * back[s - base] + (e - s).astype(np.uint64))
        return out
