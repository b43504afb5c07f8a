"""Vectorised scanning of UTF-8 text held in Arrow arrays.

Words are found and hashed with numpy over slices of many documents at a time, so
that the cost of Python is paid per slice and not per word. All delimiters used
here are ASCII bytes, which never occur inside a multi-byte UTF-8 character, so the
byte scan equals a scan by code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20
_HASH_CHUNK = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_P))


def delimiters(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry boolean table, true for the bytes of the inclusive ranges."""
    t = np.zeros(256, bool)
    for a, b in ranges:
        t[a : b + 1] = True
    return t


#: Words are `[^\x20\x09-\x0D]+`.
BLANKS = delimiters((0x20, 0x20), (0x09, 0x0D))
#: Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z became a-z.
NON_ALNUM = delimiters((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Words are runs of ASCII letters and non-ASCII characters.
NON_LETTER = delimiters((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def lower_latin(buf: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the capital letters U+00C0 to U+00DE."""
    out = LOWER[buf]
    if len(out) > 1:
        lead = out[:-1] == 0xC3
        second = out[1:]
        second[lead & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)] += 0x20
    return out


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about `most` bytes.

    Null texts are empty. One text longer than `most` makes a slice of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_spans(buf: np.ndarray, offs: np.ndarray, delim: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the first word of each document (one more at the end)."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    word = ~delim[buf]
    edge = np.empty(len(buf), bool)
    edge[0] = False
    edge[1:] = word[:-1]
    edge[offs[:-1][offs[:-1] < len(buf)]] = False
    starts = np.flatnonzero(word & ~edge)
    edge[-1] = False
    edge[:-1] = word[1:]
    edge[offs[1:][offs[1:] > 0] - 1] = False
    ends = np.flatnonzero(word & ~edge) + 1
    return starts, ends, np.searchsorted(starts, offs)


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        inverse = pow(_P, -1, 1 << 64)
        _powers[:] = [np.concatenate([np.ones(1, U64), np.full(n - 1, p, U64)]).cumprod(dtype=U64) for p in (_P, inverse)]
    return _powers[0], _powers[1]


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the bytes of each span; spans are in order and do not overlap."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _HASH_CHUNK, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        power, inverse = _power_tables(max(_HASH_CHUNK, b - a) + 1)
        sums = np.zeros(b - a + 1, U64)
        np.cumsum(_BYTE[buf[a:b]] * power[: b - a], out=sums[1:])
        s = starts[i:j] - a
        out[i:j] = mix((sums[ends[i:j] - a] - sums[s]) * inverse[s])
        i = j
    return out


def chain(first: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hashes of its members."""
    h = first
    for x in more:
        h = mix(h * U64(0xD1342543DE82EF95) + x)
    return h


class Index:
    """Open addressing from distinct 64-bit keys to their places in the key array."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.ascontiguousarray(keys, U64)
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask = U64(size - 1)
        self.slot = np.full(size, -1, np.int32)
        todo = np.arange(len(keys), dtype=np.int32)
        at = (self.keys & self.mask).astype(np.int64)
        while len(todo):
            free = self.slot[at] < 0
            self.slot[at[free]] = todo[free]  # of several, the last stays
            lost = self.slot[at] != todo
            todo, at = todo[lost], (at[lost] + 1) & int(self.mask)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys; -1 where absent."""
        at = (keys & self.mask).astype(np.int64)
        got = self.slot[at]
        if not len(self.keys):
            return got
        todo = np.flatnonzero((got >= 0) & (self.keys[np.maximum(got, 0)] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & int(self.mask)
            new = self.slot[at[todo]]
            got[todo] = new
            todo = todo[(new >= 0) & (self.keys[np.maximum(new, 0)] != keys[todo])]
        return got


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + c)."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = counts > 0
    starts, counts = np.asarray(starts, np.int64)[keep], counts[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    first = np.cumsum(counts)[:-1]
    step[first] = starts[1:] - (starts[:-1] + counts[:-1]) + 1
    return np.cumsum(step)


def char_offsets(text: bytes) -> np.ndarray:
    """For each byte place (and the end), the number of code points before it."""
    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    out = np.zeros(len(text) + 1, np.int64)
    np.cumsum(lead, out=out[1:])
    return out
