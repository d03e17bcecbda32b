"""Vectorised text work on Arrow buffers: word boundaries, word hashes and hashes of word n-grams.

Texts stay UTF-8 bytes. Both word classes used here are unions of ASCII classes with all non-ASCII characters, so a
word is a run of bytes that one 256-entry table accepts, and no text is decoded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard

U64 = np.uint64
_B, _B2, _B3 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
_CHUNK = 1 << 18


def _table(accept) -> np.ndarray:
    return np.array([accept(b) for b in range(256)], dtype=bool)


#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
#: Words `[^\x20\x09-\x0D]+`.
SPACED = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)
SAME = np.arange(256, dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_B))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, _CHUNK + (1 << 16))
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if n <= 2 * _CHUNK:  # what a very long text needs is not kept
            _powers[base] = have
    return have


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of one odd number and of its inverse, for running sums over sequences that aren't words' bytes."""
    return _power(_B2, n)


@dataclass
class Words:
    """Words of a run of texts: rows lo to hi of a batch."""

    lo: int
    hi: int
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # index of each text's first word, and the end: hi - lo + 1 numbers

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Text of each word, from 0."""
        return np.repeat(np.arange(self.hi - self.lo), self.counts)

    def hashes(self) -> np.ndarray:
        n = len(self.buf)
        power, inverse = _power(_B, n + 1)
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum(_BYTE[self.buf] * power[:n], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * inverse[self.starts]
        h += (self.ends - self.starts).astype(U64) * U64(0xA0761D6478BD642F)
        return mix(h)

    def word(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.ends[i]].tobytes()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def words_of(column: pa.Array, accept: np.ndarray, fold: np.ndarray = SAME, chunk: int = _CHUNK) -> Iterator[Words]:
    """The words of each text, some texts at a time (about `chunk` bytes, one text at least)."""
    data, offsets = text_buffers(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + chunk, side="right")) - 1)
        hi = min(hi, n)
        buf = data[offsets[lo] : offsets[hi]]
        cut = offsets[lo : hi + 1] - offsets[lo]
        inside = accept[buf]
        edge = np.zeros(len(buf) + 2, dtype=bool)
        edge[1:-1] = inside
        begins = edge[1:-1] & ~edge[:-2]
        stops = edge[1:-1] & ~edge[2:]
        bounds = cut[1:-1]
        bounds = bounds[(bounds > 0) & (bounds < len(buf))]
        begins[bounds] = inside[bounds]
        stops[bounds - 1] = inside[bounds - 1]
        starts = np.flatnonzero(begins)
        yield Words(lo, hi, fold[buf] if fold is not SAME else buf, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, cut))
        lo = hi


def grams(h: np.ndarray, n: int, base: int = _B2) -> np.ndarray:
    """Hash of each n consecutive word hashes (it runs over text ends; see `whole`)."""
    if len(h) < n:
        return np.zeros(0, dtype=U64)
    power, inverse = _power(base, len(h) + 1)
    total = np.zeros(len(h) + 1, dtype=U64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    out = (total[n:] - total[:-n]) * inverse[: len(h) - n + 1]
    out += U64(n)
    return mix(out)


def checks(h: np.ndarray, n: int) -> np.ndarray:
    """24 bits more for each n-gram, of words hashed anew and of another base."""
    return (grams(mix(h + U64(0x2545F4914F6CDD1D)), n, _B3) >> U64(40)).astype(np.uint32)


def whole(w: Words, n: int) -> np.ndarray:
    """Which n-grams of words lie within one text."""
    total = len(w.starts)
    ok = np.ones(max(0, total - n + 1), dtype=bool)
    for b in w.first[1:-1]:
        ok[max(0, b - n + 1) : b] = False
    return ok


class Lookup:
    """Membership of 64-bit values in a sorted set, with a bit table before the search."""

    BITS = 22

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.seen = np.zeros(1 << self.BITS, dtype=bool)
        self.seen[self.values >> U64(64 - self.BITS)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.seen[h >> U64(64 - self.BITS)])
        if not len(at) or not len(self.values):
            return at[:0]
        where = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        return at[self.values[where] == h[at]]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as compressed bytes: byte planes apart, so that the high bytes of small numbers vanish."""
    parts = [np.uint32(len(arrays[0])).tobytes()]
    for a in arrays:
        parts.append(a.dtype.str.encode().ljust(4))
        a = np.ascontiguousarray(a)
        parts.append(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int(np.frombuffer(raw, np.uint32, 1)[0]), 4, []
    while at < len(raw):
        kind = np.dtype(raw[at : at + 4].decode().strip())
        at += 4
        size = n * kind.itemsize
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size
    return out


def pack_sorted(keys: np.ndarray, *arrays: np.ndarray) -> bytes:
    """Like pack; keys are sorted and stored as differences."""
    return pack(np.diff(keys, prepend=keys.dtype.type(0)), *arrays)


def unpack_sorted(data: bytes) -> list[np.ndarray]:
    keys, *rest = unpack(data)
    return [np.cumsum(keys, dtype=keys.dtype), *rest]
