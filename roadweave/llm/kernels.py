"""Vectorised text kernels that the operators share.

Everything here works on the data buffer of an Arrow string column: words,
lines and windows are index arrays into one byte array and their hashes come
from a single prefix sum, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=U64)
_P = int(_rng.integers(2**62, 2**63)) * 2 + 1
_PINV = pow(_P, -1, 2**64)
_Q = U64(int(_rng.integers(2**62, 2**63)) * 2 + 1)

#: the six bytes of [\x20\x09-\x0D]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_pow = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i for i < n, grown by doubling and kept per worker."""
    while len(_pow[0]) < n:
        m = len(_pow[0])
        for k, base in ((0, _P), (1, _PINV)):
            _pow[k] = np.concatenate([_pow[k], _pow[k] * U64(pow(base, m, 2**64))])
    return _pow[0][:n], _pow[1][:n]


try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def trim() -> None:
    """Gives memory that is free back to the system: idle workers stay alive, and those of an executor share its limit."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What this worker keeps for tasks of one kind, such as a vocabulary: gone when a task of another kind starts in it."""
    return _kept.setdefault(owner, {})


def release(owner: str | None = None) -> None:
    """Drops what is kept for all kinds of tasks but the owner's: sessions run many kinds, and a reused worker would hold the sum."""
    held = [d for name, d in _kept.items() if name != owner and d]
    for d in held:
        d.clear()
    if held:
        trim()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word (splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Chunk:
    """Some whole documents: bytes `data`, document k is data[off[k]:off[k+1]], rows lo..lo+n of the batch."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lo: int):
        self.data, self.off, self.lo, self.n = data, off, lo, len(off) - 1
        self._sum: np.ndarray | None = None

    def lower(self) -> Chunk:
        """A-Z lower-cased; no other letter changes."""
        return Chunk(LOWER[self.data], self.off, self.lo)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends, and for each document the index of its first word (n + 1 entries)."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(self.n + 1, np.int64)
        solid = ~SPACE[self.data]
        cut = np.zeros(n + 1, bool)
        cut[self.off] = True
        first, last = solid.copy(), solid
        first[1:] &= ~solid[:-1] | cut[1:n]
        last = solid & np.concatenate([~solid[1:] | cut[1:n], [True]])
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, self.off)

    def hash_ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of data[s:e], equal for equal bytes anywhere."""
        if self._sum is None:
            p, _ = _powers(len(self.data) + 1)
            s = np.empty(len(self.data) + 1, U64)
            s[0] = 0
            t = _BYTE[self.data]
            t *= p[: len(self.data)]
            np.cumsum(t, out=s[1:])
            self._sum = s
        _, inv = _powers(len(self.data) + 1)
        h = self._sum[ends] - self._sum[starts]
        h *= inv[starts]
        h += (ends - starts).astype(U64) * _Q
        return mix64(h)

    def chars(self) -> np.ndarray:
        """Code points of each document."""
        return self.count((self.data & 0xC0) != 0x80)

    def count(self, flags: np.ndarray) -> np.ndarray:
        """How many flags (one for each byte) each document has."""
        s = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=s[1:])
        return np.diff(s[self.off])


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The column's texts (null: empty) in pieces of whole documents, about `limit` bytes each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lo)
        lo = hi


def owner(first: np.ndarray, total: int) -> np.ndarray:
    """For items dealt to documents by `first` (n + 1 entries), each item's document."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k-word windows and their bounds by document; a text of 1..k-1 words gives one hash of all of them."""
    n = len(words)
    counts = np.diff(first)
    m = max(0, n - k + 1)
    acc = np.zeros(m, U64)
    for j in range(k):
        acc *= _Q
        acc += words[j : j + m]
    whole = mix64(acc)
    room = np.maximum(counts - k + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < k))
    total = room.copy()
    total[short] = 1
    bounds = np.concatenate([[0], np.cumsum(total)])
    out = np.empty(bounds[-1], U64)
    src = np.arange(int(room.sum())) + np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(room)[:-1]]), room)
    dst = np.arange(int(room.sum())) + np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(room)[:-1]]), room)
    out[dst] = whole[src]
    for d in short:
        h = U64(counts[d])
        for w in words[first[d] : first[d + 1]]:
            h = U64((int(h) * int(_Q) + int(w)) & (2**64 - 1))
        out[bounds[d]] = mix64(np.array([h]))[0]
    return out, bounds
