"""K-mers of sequences, and their spectrum.

Windows are cut by numpy from the bytes of Arrow batches, many sequences at a time: bases are
packed 32 to a 64-bit word for every start at once, so that a window and its reverse complement
are compared by a word or a few, whatever k is. Measured at sf0.01 this takes about a fifth of the time of
`transform` and `substring` in the JVM (README). Work is done in slices of `piece` starts, so
a contig of any length costs memory for one slice of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Window starts that are cut at a time.
PIECE = 1 << 16
#: Letters of which the packed form fits a non-negative long.
LONGEST_LONG = 31
U64 = np.uint64

_CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _CODE[_c + 32] = _i
_BASE = np.frombuffer(b"ACGTN", np.uint8)


def _starts(codes: np.ndarray, length: int) -> np.ndarray:
    """The word of `length` (32 at most) two-bit codes from every start at which so many follow."""
    out, have, power, span = None, 0, codes, 1
    while span <= length:
        if length & span:  # this power of two covers the next `span` codes
            part = power[have:]
            out = part if out is None else (out[: len(part)] << U64(2 * span)) | part
            have += span
        span *= 2
        if span <= length:
            power = (power[: -(span // 2)] << U64(span)) | power[span // 2 :] if len(power) > span // 2 else power[:0]
    return out[: max(0, len(codes) - length + 1)]


def words(codes: np.ndarray, k: int) -> list[np.ndarray]:
    """The window from every start, as words of 32 bases and a last one of the rest."""
    n, codes = len(codes) - k + 1, codes.astype(U64)
    full = _starts(codes, 32) if k > 32 else None
    out = [full[at : at + n] for at in range(0, k - 32, 32)] if k > 32 else []
    at = 32 * len(out)
    return [*out, _starts(codes, k - at)[at : at + n]]


def _smaller(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    less = a[-1] < b[-1]
    for x, y in zip(a[-2::-1], b[-2::-1], strict=True):
        less = (x < y) | ((x == y) & less)
    return less


def hashed(parts: list[np.ndarray]) -> np.ndarray:
    """A non-negative hash of packed windows, of 62 bits."""
    h = np.zeros(len(parts[0]), U64)
    for x in parts:
        h = (h ^ x) * U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(29)
        h *= U64(0xBF58476D1CE4E5B9)
        h ^= h >> U64(32)
    return (h >> U64(2)).astype(np.int64)


def _packed(parts: list[np.ndarray], k: int) -> pa.Array:
    if k <= LONGEST_LONG:
        return pa.array(parts[0].astype(np.int64))
    last = k - 32 * (len(parts) - 1)
    cells = [x.astype(">u8").view(np.uint8).reshape(-1, 8) for x in [*parts[:-1], parts[-1] << U64(64 - 2 * last)]]
    rows = np.concatenate([*cells[:-1], cells[-1][:, : (last + 3) // 4]], 1)
    return _fixed(rows, pa.binary())


def _fixed(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Strings of one length from the rows of a byte matrix."""
    n, width = rows.shape
    offsets = np.arange(0, (n + 1) * width, width, dtype=np.int32)[: n + 1] if width else np.zeros(n + 1, np.int32)
    return pa.Array.from_buffers(kind, n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; nulls are empty."""
    col = col.fill_null("") if col.null_count else col
    wide = pa.types.is_large_string(col.type)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[offs[0] : offs[-1]], offs - offs[0]


class Sample:
    """How often each k-mer occurs whose hash ends in `level` zeros; the level rises so that at most `most` k-mers are held."""

    def __init__(self, most: int):
        self.most, self.level, self.all = most, 0, 0
        self.hashes, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._new: list[np.ndarray] = []

    def add(self, hashes: np.ndarray) -> None:
        self.all += len(hashes)
        self._new.append(hashes[hashes & ((1 << self.level) - 1) == 0])
        if sum(map(len, self._new)) >= self.most or len(self._new) >= 1000:
            self.merge()

    def merge(self) -> None:
        """Count what was added since the last time."""
        new = np.concatenate([np.zeros(0, np.int64), *self._new])
        self._new = []
        self.hashes, at = np.unique(np.concatenate([self.hashes, new]), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, np.ones(len(new), np.int64)]), minlength=len(self.hashes)).astype(np.int64)
        while len(self.hashes) > self.most:
            self.level += 1
            kept = self.hashes & ((1 << self.level) - 1) == 0
            self.hashes, self.counts = self.hashes[kept], self.counts[kept]


class Windows:
    """Cuts the windows of string columns. among: a bitmap of hashes; windows outside it are left out, but told to the sample. hashes: instead of windows."""

    def __init__(self, k: int, canonicalise: bool, packed: bool, among: np.ndarray | None, piece: int, hashes: bool = False, sample: Sample | None = None):
        self.k, self.canonicalise, self.packed, self.among, self.piece, self.hashes, self.sample = k, canonicalise, packed, among, piece, hashes, sample

    def cut(self, col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
        """(rows, places in them, windows), some at a time."""
        raw, offs = _bytes(col)
        ends, k = offs[1:], self.k
        for at in range(0, len(raw) - k + 1, self.piece):
            code = _CODE[raw[at : at + self.piece + k - 1]]
            n = len(code) - k + 1
            bad = np.concatenate([[0], np.cumsum(code > 3)])
            start = np.arange(at, at + n)
            row = np.searchsorted(ends, start, "right")
            chosen = np.flatnonzero((bad[k:] == bad[:-k]) & (start + k <= ends[row]))
            if not len(chosen):
                continue
            ahead = words(np.minimum(code, 3), k)
            other = np.zeros(n, bool)
            if self.canonicalise:
                back = [x[::-1] for x in words(3 - np.minimum(code, 3)[::-1], k)]
                other = _smaller(back, ahead)
                ahead = [np.where(other, y, x) for x, y in zip(ahead, back, strict=True)]
            if self.among is not None:
                h = hashed([x[chosen] for x in ahead])
                if self.sample is not None:
                    self.sample.add(h)
                bit = h & (8 * len(self.among) - 1)
                chosen = chosen[(self.among[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0]
                if not len(chosen):
                    continue
            if self.hashes:
                made = pa.array(hashed([x[chosen] for x in ahead]))
            elif self.packed:
                made = _packed([x[chosen] for x in ahead], k)
            else:
                view = np.lib.stride_tricks.sliding_window_view
                text = view(_BASE[code], k)[chosen]
                turned = other[chosen]
                text[turned] = view(_BASE[3 - np.minimum(code, 3)[::-1]], k)[n - 1 - chosen[turned]]
                made = _fixed(text, pa.string())
            rows = row[chosen]
            yield rows, start[chosen] - offs[rows], made


def kmers(seqs: DataFrame, k: int, *, seq_col: str = "seq", keep: list[str] | None = None, canonicalise: bool = True, packed: bool = False, among=None, piece: int = PIECE) -> DataFrame:
    """One row for every k-mer of A, C, G and T: the kept columns, pos (from 0) and kmer.

    Lower case counts as upper case. Windows with any other letter are skipped, as are
    sequences shorter than k and nulls. keep: default, all columns but the sequence. packed:
    kmer is two bits a base (a long up to 31 bases, else binary), which makes exchanges of
    k-mers whose letters nobody asks for several times smaller. among: a broadcast bitmap
    (`membership`); most windows outside the set it was made from are left out.
    """
    if k < 1:
        raise ValueError("k must be positive")
    keep = [c for c in seqs.columns if c != seq_col] if keep is None else keep
    rows = seqs.select(*keep, F.col(seq_col).alias("_seq"))
    kind = (T.LongType() if k <= LONGEST_LONG else T.BinaryType()) if packed else T.StringType()
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("pos", T.LongType(), False), T.StructField("kmer", kind, False)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Windows(k, canonicalise, packed, None if among is None else np.frombuffer(among.value, np.uint8), piece)
        for b in batches:
            for row, pos, made in cutter.cut(b.column(len(names) - 2)):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(len(names) - 2)), pa.array(pos), made], names=names)

    return rows.mapInArrow(run, schema)


#: Bits a k-mer of the set takes in a bitmap, and the most bits of one: more k-mers let more others pass, never fewer of their own.
BITS_EACH, MOST_BITS = 64, 1 << 28


def membership(kmer_set: DataFrame, k: int, n: int):
    """A broadcast bitmap of the hashes of about n k-mers (column kmer), 32 MB at most, for `kmers(among=...)`.

    The bitmap is put together by Spark's bitmap aggregates, 4 kB a bucket; the driver only
    lays the buckets side by side.
    """
    bits = min(MOST_BITS, 1 << max(15, int(n * BITS_EACH - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = _CODE[_bytes(b.column(0))[0]].reshape(-1, k)
            code = code[(code < 4).all(1)]
            for at in range(0, len(code), 10_000):
                flat = code[at : at + 10_000]
                parts = [x[::k] for x in words(flat.ravel(), k)]
                yield pa.RecordBatch.from_arrays([pa.array((hashed(parts) & (bits - 1)) + 1)], names=["h"])

    places = kmer_set.where(F.octet_length("kmer") == k).select("kmer").mapInArrow(run, "h long")
    found = places.groupBy((F.bitmap_bucket_number("h") - 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in found:
        out[4096 * r["bucket"] : 4096 * (r["bucket"] + 1)] = np.frombuffer(r["bits"], np.uint8)
    return kmer_set.sparkSession.sparkContext.broadcast(out.tobytes())


def multiplicities(occurrences: DataFrame) -> DataFrame:
    """(kmer, n): how often each k-mer occurs."""
    return occurrences.groupBy("kmer").agg(F.count("*").alias("n"))


def spectrum(occurrences: DataFrame) -> DataFrame:
    """One row: f1 (all), f0 (distinct), repeats (distinct, more than once) and weak (distinct, once)."""
    repeats = F.count(F.when(F.col("n") > 1, 1))
    return multiplicities(occurrences).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("f1"), F.count("*").alias("f0"), repeats.alias("repeats"), (F.count("*") - repeats).alias("weak"))


def estimated_spectrum(seqs: DataFrame, k: int, *, seq_col: str = "seq", bits: int = 20) -> DataFrame:
    """One row as `spectrum`'s: f1 exact; f0, repeats and weak estimated from counters, without a shuffle of k-mers.

    Of the canonical k-mers those are sampled whose hash ends in so many zeros that there are fewer than counters even if all
    k-mers differ; a task adds their occurrences up in 2^bits counters by the hash's next bits. Counters of all tasks are
    summed, at most 2^bits rows a task. How often a counter is 0 or 1 tells how many sampled k-mers there are, and how many
    that occur once, with collisions taken into account (a counter is a sum of Poisson numbers of k-mers
    of each multiplicity): f0 = -ln p0 and weak = p1 / p0, times counters and sampling rate. The relative standard error of f0
    is about sqrt(f1 / f0) / 2^(bits / 2): 0.1 % where most k-mers occur once, 1 % at hundredfold coverage.
    """
    letters = seqs.agg(F.coalesce(F.sum(F.length(seq_col)), F.lit(0))).first()[0]
    zeros, slots = max(0, int(letters - 1).bit_length() - bits) if letters else 0, 1 << bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, held, all_of = Windows(k, True, True, None, PIECE, hashes=True), np.zeros(slots, np.int64), 0
        for b in batches:
            for _, _, made in cutter.cut(b.column(0)):
                h = made.to_numpy()
                all_of += len(h)
                held += np.bincount(h[h & ((1 << zeros) - 1) == 0] >> zeros & (slots - 1), minlength=slots)
        full = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(full, -1)), pa.array(np.append(held[full], all_of))], names=["slot", "n"])

    summed = seqs.select(seq_col).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    seen = F.count(F.when(F.col("slot") >= 0, 1))
    once = F.count(F.when((F.col("slot") >= 0) & (F.col("n") == 1), 1))
    counts = summed.agg(F.coalesce(F.sum(F.when(F.col("slot") < 0, F.col("n"))), F.lit(0)).alias("f1"), seen.alias("seen"), once.alias("once"))
    empty = F.greatest(F.lit(slots) - F.col("seen"), F.lit(1))
    scaled = counts.select("f1", F.round(-F.log(empty / slots) * slots * (1 << zeros)).cast("long").alias("f0"), F.round(F.col("once") / empty * slots * (1 << zeros)).cast("long").alias("weak"))
    weak = F.least("weak", "f0")
    return scaled.select("f1", "f0", (F.col("f0") - weak).alias("repeats"), weak.alias("weak"))


#: K-mers of a task's sample at most: 24 bytes each in the table that `kmers_and_sample` gives, 3 MB a task.
SAMPLE = 1 << 17


def kmers_and_sample(seqs: DataFrame, k: int, *, keep: list[str], among, seq_col: str = "seq", most: int = SAMPLE) -> DataFrame:
    """The rows of `kmers(among=...)`, and in the same pass a sample of all k-mers for `sampled_spectrum`.

    Columns: keep, pos, kmer, hash, n, level. Rows with a kmer are k-mers; in those without one a task gives its sample, n
    occurrences of the k-mer with this hash, and in one with hash -1 the number of all its k-mers. Those have no kept columns.
    """
    rows = seqs.select(*keep, F.col(seq_col).alias("_seq"))
    told = [T.StructField("hash", T.LongType()), T.StructField("n", T.LongType()), T.StructField("level", T.IntegerType())]
    fields = [*(T.StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]), T.StructField("pos", T.LongType()), T.StructField("kmer", T.StringType())]
    schema = T.StructType([*fields, *told])
    kinds, width = to_arrow_schema(schema), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = Sample(most)
        cutter = Windows(k, True, False, np.frombuffer(among.value, np.uint8), PIECE, sample=sample)
        for b in batches:
            for row, pos, made in cutter.cut(b.column(width)):
                at = pa.array(row)
                kept = [b.column(i).take(at).cast(kinds.field(i).type) for i in range(width)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(pos), made, *(pa.nulls(len(row), f.type) for f in list(kinds)[width + 2 :])], schema=kinds)
        sample.merge()
        held = [np.append(sample.hashes, -1), np.append(sample.counts, sample.all), np.full(len(sample.hashes) + 1, sample.level, np.int32)]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(held[0]), f.type) for f in list(kinds)[: width + 2]), *map(pa.array, held)], schema=kinds)

    return rows.mapInArrow(run, schema)


def sampled_spectrum(sample: DataFrame) -> DataFrame:
    """One row as `spectrum`'s from tasks' samples (hash, n, level): f1 exact; f0, repeats and weak estimated.

    The highest level of any task is the sample's: the k-mers whose hash ends in so many zeros are known with all their occurrences, and stand for
    2^level times as many. The relative standard error of f0 is about 1 / sqrt(sampled k-mers): at most 0.4 % with 2^17 a task, exact at level 0.
    """
    head = sample.agg(F.coalesce(F.max("level"), F.lit(0)).alias("_level"), F.coalesce(F.sum(F.when(F.col("hash") < 0, F.col("n"))), F.lit(0)).alias("f1"))
    each = sample.where("hash >= 0").select("hash", "n").join(F.broadcast(head), F.expr("hash & (shiftleft(1L, _level) - 1) = 0")).groupBy("hash").agg(F.sum("n").alias("n"))
    seen = each.agg(F.count("*").alias("_f0"), F.count(F.when(F.col("n") == 1, 1)).alias("_weak"))
    rate = F.expr("shiftleft(1L, _level)")
    return head.join(seen, F.lit(True)).select("f1", (F.col("_f0") * rate).alias("f0"), ((F.col("_f0") - F.col("_weak")) * rate).alias("repeats"), (F.col("_weak") * rate).alias("weak"))


def register(spark: SparkSession, name: str = "kmers") -> None:
    """Make the k-mers a table function of SQL: `SELECT ... FROM reads, LATERAL kmers(seq, 21)` gives pos and kmer.

    As `kmers`, but a sequence at a time: for ad-hoc SQL, where the DataFrame form cuts whole batches.
    """

    class Kmers:
        def eval(self, seq: str, k: int) -> Iterator[tuple]:
            if seq is not None and k is not None:
                for _, pos, made in Windows(k, True, False, None, PIECE).cut(pa.array([seq], pa.string())):
                    yield from zip(pos.tolist(), made.to_pylist(), strict=True)

    spark.udtf.register(name, F.udtf(Kmers, returnType="pos long, kmer string", useArrow=True))


def approx_spectrum(occurrences: DataFrame, rsd: float = 0.02) -> DataFrame:
    """One row: f1 and an estimate of f0 by HyperLogLog, in one pass and without a shuffle of k-mers."""
    return occurrences.agg(F.count("*").alias("f1"), F.approx_count_distinct("kmer", rsd).alias("f0"))


def histogram(occurrences: DataFrame) -> DataFrame:
    """(n, kmers): how many k-mers occur n times."""
    return multiplicities(occurrences).groupBy("n").agg(F.count("*").alias("kmers"))
