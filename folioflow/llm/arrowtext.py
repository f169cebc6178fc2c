"""Words of whole Arrow batches of text as numpy arrays, without a Python object for each word."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _libc = None
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_PIECE = 1 << 18
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_CODES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and _BASE**-i modulo 2**64 for i < n."""
    if len(_powers["up"]) < n:
        size = max(n, _PIECE)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            p = np.full(size, np.uint64(base), np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; starts and ends ascend and spans don't overlap.

    A prefix hash is summed over pieces of some 256 KB (or one span, if longer)."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + _PIECE, "right")))
        b = int(ends[j - 1])
        up, down = powers(b - a + 1)
        h = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_CODES[data[a:b]] * up[: b - a], out=h[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (h[e] - h[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


class Batch:
    """Texts of one Arrow array: bytes, offsets of texts, and the words found in them.

    ``data``: the bytes; ``at``: n+1 offsets of texts (a null text is empty); ``starts``, ``ends``:
    spans of words; ``first``: n+1 offsets of texts among the words."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, self.at = text_bytes(texts)
        if lower:
            self.data = LOWER[self.data]
        blank = BLANK[self.data]
        n = len(self.data)
        begin, end = ~blank, ~blank
        if n:
            begin[1:] &= blank[:-1]
            end[:-1] &= blank[1:]
            some = self.at[1:] > self.at[:-1]
            f, l = self.at[:-1][some], self.at[1:][some] - 1
            begin[f] = ~blank[f]
            end[l] = ~blank[l]
        self.blank = blank
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.at)
        self.first[-1] = len(self.starts)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts())


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of the texts; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _trim() -> None:
    """Give freed memory back: Python workers live on between tasks, and their executor's memory is shared."""
    pa.default_memory_pool().release_unused()
    if _libc:
        _libc.malloc_trim(0)


def blocks(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Slices of the batch with some ``most`` bytes of text in each, or one longer text."""
    _, at = text_bytes(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        j = min(j, batch.num_rows)
        yield batch.slice(i, j - i)
        i = j
    _trim()


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    s = np.sort(keys)
    same = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(same):
        return np.zeros(len(keys), bool)
    p = np.searchsorted(same, keys)
    p[p == len(same)] = 0
    return same[p] == keys


class Rolling:
    """Hashes of windows of ids, of any lengths, from one pass of prefix sums: a window's hash is the difference of two
    sums of id * base**place, moved back to place 0, so it rolls on by one subtraction and one product, whatever its length."""

    def __init__(self, ids: np.ndarray, first: np.ndarray, longest: int):
        self.n, self.first, self.pieces = len(ids), first, []
        for s in range(0, len(ids), _PIECE):  # each with the ids that its last windows reach into
            part = ids[s : s + _PIECE + longest]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * powers(_PIECE + longest + 1)[0][: len(part)], out=sums[1:])
            self.pieces.append((s, sums))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of ``n`` ids that lie within one text, and where they start."""
        total = self.n - n + 1
        if total <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.empty(total, np.uint64)
        for s, sums in self.pieces:
            m = min(_PIECE, total - s)
            if m > 0:
                h[s : s + m] = (sums[n : n + m] - sums[:m]) * powers(m)[1]
        ok = np.ones(total, bool)
        for k in range(1, n):  # a text that starts at p forbids the windows p-n+1 .. p-1
            cut = self.first[1:-1] - k
            ok[cut[(cut >= 0) & (cut < total)]] = False
        at = np.flatnonzero(ok)
        return mix(h[at]), at


def windows(ids: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` ids that lie within one text, and where they start."""
    return Rolling(ids, first, n).windows(n)
