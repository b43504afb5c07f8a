"""Exchanges of packed k-mers as sorted lists, a few bytes a k-mer.

As rows, a k-mer with a reference and a count takes about 15 bytes of a compressed exchange, and more where it is dealt out twice. Here a task sorts two
million occurrences, adds up equal ones, and sends each bucket its part of the list: differences of mixed k-mers (`mixed`, one to one) by byte
planes, packed by zstd. A bucket has all occurrences of its k-mers; Spark deals out and sorts the buckets, and a task adds up one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.operators.kmers import LONGEST_LONG, U64

#: Occurrences that a task sorts at a time, and k-mers that a bucket shall have, about.
SLICE, BUCKET = 1 << 21, 1 << 21
_CODEC = "zstd"


def bucket_bits(occurrences: int, k: int) -> int:
    """Bits of a bucket's number for about so many occurrences."""
    return min(2 * k - 1, max(0, int(max(1, occurrences) // BUCKET).bit_length()))


def mixed(words: np.ndarray, k: int) -> np.ndarray:
    """Packed k-mers, one to one onto numbers of as many bits whose upper ones are spread evenly."""
    bits = 2 * k
    mask = U64((1 << bits) - 1)
    h = words.astype(U64)
    for odd in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
        h = (h * U64(odd)) & mask
        h ^= h >> U64(max(1, bits // 2))
    return h


def added(h: np.ndarray, ref: np.ndarray, n: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (h, ref) once, in order, with the sum of its n (1 each, if None). h: numbers of so many bits; ref: not negative."""
    if not len(h):
        return h, ref, np.zeros(0, np.int64)
    width = int(ref.max()).bit_length()
    if bits + width <= 63:
        key = (h << U64(width)) | ref.astype(U64)
        if n is not None and int(n.sum()) <= 2 * len(n):
            key, n = np.repeat(key, n), None
        if n is None:
            key.sort()
        else:
            by = np.argsort(key, kind="stable")
            key, n = key[by], n[by]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        each = key[first]
        return each >> U64(width), (each & U64((1 << width) - 1)).astype(np.int64), np.diff(np.append(first, len(key))) if n is None else np.add.reduceat(n, first)
    by = np.lexsort((ref, h))
    h, ref = h[by], ref[by]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (ref[1:] != ref[:-1])))
    return h[first], ref[first], np.diff(np.append(first, len(h))) if n is None else np.add.reduceat(n[by], first)


def _width(most: int) -> int:
    return (most.bit_length() + 7) // 8


def _planes(x: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(x).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def _from_planes(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.reshape(width, n).T
    return out.view("<u8").reshape(-1)


def _sent(h: np.ndarray, ref: np.ndarray, n: np.ndarray, bits: int, b: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(bucket, entries, widths, packed list) of each bucket that has entries."""
    low = U64(bits - b)
    bucket = (h >> low).astype(np.int64)
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    step = np.append(h[:1], h[1:] - h[:-1])
    step[cuts] = h[cuts] & U64((1 << int(low)) - 1)
    r, c = _width(int(ref.max())), _width(int(n.max()) - 1)  # counts are sent less one: mostly nothing
    w = (bits - b + 7) // 8
    all_of = np.concatenate([_planes(step, w), _planes(ref, r), _planes(n - 1, c)], 1)
    for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(h)], strict=True):
        yield int(bucket[i]), j - i, r * 16 + c, pa.compress(np.ascontiguousarray(all_of[i:j].T), codec=_CODEC, asbytes=True)


def _taken(n: int, widths: int, packed: bytes, bits: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    w, r, c = (bits - b + 7) // 8, widths >> 4, widths & 15
    raw = np.frombuffer(pa.decompress(packed, n * (w + r + c), codec=_CODEC), np.uint8)
    parts = (raw[: n * w], w), (raw[n * w : n * (w + r)], r), (raw[n * (w + r) :], c)
    step, ref, more = (_from_planes(x, n, width) for x, width in parts)
    return np.cumsum(step, dtype=U64), ref.astype(np.int64), more.astype(np.int64) + 1


def by_bucket(occurrences: DataFrame, k: int, bits: int, summed: Callable[[Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], Iterator[pa.RecordBatch]], schema: str, *, slice_: int = SLICE) -> DataFrame:
    """The rows that summed gives for each task's buckets: (k-mers mixed and without the bucket's bits, ref, n), each (k-mer, ref) once and in order.

    occurrences: kmer, a packed long, and ref, not negative; rows with a null are left out. All rows of a k-mer are in one bucket. bits:
    `bucket_bits` of their number; a wrong number makes buckets larger or smaller and changes nothing else.
    """
    if k > LONGEST_LONG:
        raise ValueError(f"k-mers of more than {LONGEST_LONG} letters are no longs")
    wide = 2 * k

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> pa.RecordBatch:
            words, refs = (np.concatenate(x) for x in zip(*held, strict=True))
            cols = list(zip(*_sent(*added(mixed(words, k), refs, None, wide), wide, bits), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "n", "widths", "packed"])

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)))
                rows += b.num_rows
            if rows >= slice_:
                yield flush()
                held, rows = [], 0
        if held:
            yield flush()

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        now, held = None, []

        def whole() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return added(*(np.concatenate(x) for x in zip(*held, strict=True)), wide - bits)

        for b in batches:
            for bucket, n, widths, packed in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if bucket != now and held:
                    yield whole()
                    held.clear()
                now = bucket
                held.append(_taken(n, widths, packed, wide, bits))
        if held:
            yield whole()

    rows = occurrences.select("kmer", F.col("ref").cast("long")).where("kmer IS NOT NULL AND ref IS NOT NULL")
    sent = rows.mapInArrow(send, "bucket int, n int, widths int, packed binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: summed(buckets(batches)), schema)


def firsts(h: np.ndarray) -> np.ndarray:
    """Where each k-mer of a sorted list begins."""
    return np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)


def spectrum(occurrences: DataFrame, k: int, bits: int) -> DataFrame:
    """`kmers.spectrum` of packed k-mers."""

    def summed(buckets: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(3, np.int64)
        for _, _, n in buckets:
            total += [int(n.sum()), len(n), int((n == 1).sum())]
        yield pa.RecordBatch.from_arrays([pa.array(total[i : i + 1]) for i in range(3)], names=["f1", "f0", "weak"])

    each = by_bucket(occurrences.select("kmer", F.lit(0).alias("ref")), k, bits, summed, "f1 long, f0 long, weak long")
    f1, f0, weak = (F.coalesce(F.sum(c), F.lit(0)) for c in ("f1", "f0", "weak"))
    return each.agg(f1.alias("f1"), f0.alias("f0"), (f0 - weak).alias("repeats"), weak.alias("weak"))


def weak_by_ref(occurrences: DataFrame, k: int, bits: int) -> DataFrame:
    """(ref, distinct, weak): the distinct k-mers of each reference, and those of them that occur once in all."""

    def summed(buckets: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        refs, held = np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
        for h, ref, n in buckets:
            first = firsts(h)
            alone = first[(np.diff(np.append(first, len(h))) == 1) & (n[first] == 1)]
            once = np.zeros(len(h), np.int64)
            once[alone] = 1
            refs, at = np.unique(np.concatenate([refs, ref]), return_inverse=True)
            both = np.concatenate([held, np.stack([np.ones(len(h), np.int64), once], 1)])
            held = np.stack([np.bincount(at, both[:, i], len(refs)).astype(np.int64) for i in range(2)], 1)
        yield pa.RecordBatch.from_arrays([pa.array(refs), pa.array(held[:, 0]), pa.array(held[:, 1])], names=["ref", "distinct", "weak"])

    return by_bucket(occurrences, k, bits, summed, "ref long, distinct long, weak long").groupBy("ref").agg(F.sum("distinct").alias("distinct"), F.sum("weak").alias("weak"))
