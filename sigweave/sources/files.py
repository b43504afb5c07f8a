"""Sequence files, lists and index tables as DataFrames.

All files are opened by Spark, so any file system that Spark reads will do. Text is cut into
records by Spark's reader (before `>` or `@`), and a task numbers the records of its splits in
order; sequences are never gathered by file, and shuffled only to spread a few packed files over all tasks.
"""

from __future__ import annotations

import bz2
import io
import lzma
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave import schemas
from sigweave.functions.seq import base_id
from sigweave.sources.shared import stored

#: Rows of (file, number) up to which they are broadcast to the records; above, Spark joins as it sees fit.
BROADCAST_FILES = 200_000
#: Rows and letters of an Arrow batch, about.
BATCH_ROWS, BATCH_LETTERS = 10_000, 1 << 23

#: Bits of a read's number within its file; those above number the files of a folder.
NUMBER_BITS = 40

_OPEN_COST = "spark.sql.files.openCostInBytes"
_FASTA = re.compile(r"\.(fa|fasta|fas|fna|ffn|frn|faa|mpfa)(\.\w+)?$", re.I)
_WHOLE = re.compile(r"\.(xz|zip|bz)$", re.I)
#: Bytes of reads in a packed byte, about: four letters, as quality packs well.
PACKED = 4
_PACKED = re.compile(r"\.(gz|bz2|xz|zip|bz)$", re.I)
#: Names of files that are not split.
_ONE_TASK = re.compile(r"\.(gz|xz|zip|bz)$", re.I)


def _line() -> Column:
    """What orders the lines of text files as reading the files one after the other by name does.

    Spark hands out splits by size; within one, ids grow with the lines.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))


def path_list(spark: SparkSession, path: str) -> list[str]:
    """The lines of a list file, in order; blank lines are left out."""
    lines = spark.read.text(path).select("value", _line().alias("at")).orderBy("at").collect()
    return [r["value"].strip() for r in lines if r["value"].strip()]


def expand(spark: SparkSession, args: list[str]) -> list[str]:
    """Paths, where `@file` stands for the paths that the file lists."""
    return [p for a in args for p in (path_list(spark, a[1:]) if a.startswith("@") else [a])]


def references(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(ref_id, ref_name, path): one reference a path, numbered in order. A folder is one reference of all its files."""
    rows = spark.createDataFrame(list(enumerate(paths)), "ref_id int, path string")
    return rows.select("ref_id", base_id("path").alias("ref_name"), "path")


def _plain(path: Column | str) -> Column:
    """A file's path as users write it: not percent-encoded, local ones without a scheme."""
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def _placed(spark: SparkSession, files: DataFrame, column: str = "path") -> tuple[DataFrame, list[str], dict[str, int]]:
    """files with _file, the path that Spark gives each file, and _nth, its place among those of its row by name; all paths; and the size of each file.

    files: rows with a path of a file, or of a folder with files. Sizes come from listing; contents are not read. The
    driver holds a row for each file, as it does for any listing.
    """
    rows = files.collect()
    paths = sorted({r[column] for r in rows})
    if not paths:
        return files.withColumns({"_file": F.lit(""), "_nth": F.lit(0).cast("long")}), paths, {}
    cost = spark.conf.get(_OPEN_COST)
    spark.conf.set(_OPEN_COST, "0")  # only sizes are read: many small files need not be a task each
    try:
        listed = spark.read.format("binaryFile").load(paths).select(_plain("path").alias("file"), "length").collect()
    finally:
        spark.conf.set(_OPEN_COST, cost)
    by_name: dict[str, set[str]] = {}
    for r in listed:
        for full in {r["file"], re.sub(r"^[A-Za-z0-9+.-]+://[^/]*", "", r["file"])}:
            for name in (full, full.rpartition("/")[0]):
                by_name.setdefault(name, set()).add(r["file"])
    asked = lambda path: re.sub(r"^file:/+", "/", path).rstrip("/") or "/"
    found = [(*r, f, i) for r in rows for i, f in enumerate(sorted(by_name.get(asked(r[column]), ())))]
    schema = T.StructType([*files.schema.fields, T.StructField("_file", T.StringType()), T.StructField("_nth", T.LongType())])
    placed = spark.createDataFrame(found, schema)
    return F.broadcast(placed) if len(found) <= BROADCAST_FILES else placed, paths, {r["file"]: r["length"] for r in listed}


def _split_bytes(spark: SparkSession) -> int:
    """Bytes from which on a file may have several splits."""
    n, unit = re.fullmatch(r"(\d+)\s*([a-z]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return int(n) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit] >> 3  # splits shrink where there are more cores than splits


def _pieces(spark: SparkSession, paths: list[str], mark: str) -> DataFrame:
    """(value, _file, _start): text before each line that begins with mark, in the order of a split's bytes."""
    raw = spark.read.option("lineSep", f"\n{mark}").text(paths)
    return raw.select(F.col("value").cast("binary"), _plain(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.file_block_start").alias("_start"))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, str]]:
    """File, split, place within the split and text of each piece."""
    now, at = None, 0
    for b in batches:
        for value, file, start in zip(b.column(0), b.column(1), b.column(2), strict=True):
            key = file.as_py(), start.as_py()
            at, now = (at + 1 if key == now else 0), key
            yield *key, at, value.as_py().decode("utf-8", "replace")


def _batched(rows: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1] or "")
        if len(held) >= BATCH_ROWS or size > BATCH_LETTERS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def total_bytes(spark: SparkSession, paths: list[str]) -> int:
    """About how many bytes of text the files of paths have: their sizes, packed ones times PACKED."""
    _, _, sizes = _placed(spark, spark.createDataFrame(list(enumerate(paths)), "file_idx int, path string"))
    return sum(n * (PACKED if _PACKED.search(f) else 1) for f, n in sizes.items())


class Listed:
    """References whose files are listed, once for several reads of them."""

    def __init__(self, spark: SparkSession, refs: DataFrame):
        self.placed, self.paths, sizes = _placed(spark, refs.select("ref_id", "ref_name", "path"))
        self.largest = max(sizes.values(), default=0)


def read_fasta(spark: SparkSession, refs: DataFrame | Listed, *, sequences: bool = True) -> DataFrame:
    """(ref_id, ref_name, record_idx, contig, seq) of FASTA files.

    The first line of a file is a header whatever it begins with. A record ends at a line that
    begins with `>`; its lines are joined without trimming. A label is the header without its
    first character, spaces as underscores; an empty label is that of the record before.
    Files are split by records, so one large file is read by many tasks; such a file is read once
    before, for what its splits hold. refs: ref_id, ref_name, path (a file or a folder), or these listed. sequences:
    without them seq is null, for when labels are asked for.
    """
    refs = refs if isinstance(refs, Listed) else Listed(spark, refs)
    placed, paths, largest = refs.placed, refs.paths, refs.largest
    pieces = _pieces(spark, paths, ">")
    names, kinds = ["_file", "_start", "record_idx", "contig", "seq"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        label = None
        for file, start, at, text in _in_order(batches):
            header, _, body = text.partition("\n")
            if not at:
                label = None
                header = header if start else header[1:]
            label = header.replace(" ", "_") or label
            yield file, start, start + at, label, body.replace("\n", "").upper() if sequences else None

    records = pieces.mapInArrow(lambda b: _batched(parsed(b), names, kinds), "_file string, _start long, record_idx long, contig string, seq string")
    if largest > _split_bytes(spark):  # records before a split give its first number, and the label if it begins without one
        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            key, n, label = None, 0, None
            for file, start, _, contig, _ in parsed(batches):
                if (file, start) != key and key:
                    yield *key, n, label or ""
                    n = 0
                key, n, label = (file, start), n + 1, contig
            if key:
                yield *key, n, label or ""

        fields, kinds_of = ["_file", "_start", "_n", "_label"], [pa.string(), pa.int64(), pa.int64(), pa.string()]
        splits = pieces.mapInArrow(lambda b: _batched(summed(b), fields, kinds_of), "_file string, _start long, _n long, _label string")
        earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
        splits = splits.select("_file", "_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.last(F.nullif("_label", F.lit("")), ignorenulls=True).over(earlier).alias("_label"))
        splits = stored(splits, "splits")
        splits = F.broadcast(splits) if splits.count() <= BROADCAST_FILES else splits
        records = records.join(splits, ["_file", "_start"]).select("_file", (F.col("record_idx") - F.col("_start") + F.col("_before")).alias("record_idx"), F.coalesce("contig", "_label").alias("contig"), "seq")
    return records.join(placed, "_file").select("ref_id", "ref_name", "record_idx", F.coalesce("contig", F.lit("")).alias("contig"), "seq")


def records(lines: Iterator[str]) -> Iterator[tuple[str, str, int]]:
    """Name, sequence and missing quality of FASTA or FASTQ records, mixed or not; a name ends at the first white space.

    Quality is missing if the lines end within it.
    """
    line = next(lines, None)
    while line is not None:
        line = line.rstrip("\r\n")
        if line[:1] not in (">", "@"):
            line = next(lines, None)
            continue
        name, parts, missing = (line[1:].split(None, 1) or [""])[0], [], 0
        line = next(lines, None)
        while line is not None and line[:1] not in (">", "@", "+"):
            parts.append(line.rstrip("\r\n"))
            line = next(lines, None)
        seq = "".join(parts)
        if line is not None and line[:1] == "+":  # quality has as many characters as the sequence, and may begin with @
            missing = len(seq)
            while missing > 0 and (line := next(lines, None)) is not None:
                missing -= len(line.rstrip("\r\n"))
            line = next(lines, None)
        yield name, seq, max(0, missing)


_READS = "_file string, read_idx long, read_name string, seq string"
_READ_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string()]


def _split_reads(pieces: DataFrame, mark: str) -> DataFrame:
    """Reads from pieces of text that begin after mark."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        missing = idx = 0
        for file, start, at, text in _in_order(batches):
            if not at:
                missing, idx = 0, start
            lines = text.split("\n")
            if missing > 0:  # quality that begins with the mark
                missing -= 1 + sum(len(x.rstrip("\r")) for x in lines)
                continue
            if mark == "@" and start and not at and not any(x.startswith("+") for x in lines[1:]):
                continue  # the quality of the last record of the split before
            if start or at:
                lines[0] = mark + lines[0]
            for name, seq, missing in records(iter(lines)):
                yield file, idx, name, seq
                idx += 1

    return pieces.mapInArrow(lambda b: _batched(parsed(b), ["_file", "read_idx", "read_name", "seq"], _READ_KINDS), _READS)


def _whole_reads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Reads of packed files that only Python opens, each by one task; at most 2 GB packed."""

    def text(path: str, content: bytes) -> Iterator[str]:
        low, raw = path.lower(), io.BytesIO(content)
        if low.endswith(".zip"):
            z = zipfile.ZipFile(raw)
            opened = [z.open(n) for n in sorted(z.namelist())]
        else:
            opened = [(lzma if low.endswith(".xz") else bz2).open(raw)]
        for f in opened:
            yield from io.TextIOWrapper(f, encoding="utf-8", errors="replace", newline="\n")

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for file, content in zip(b.column(0), b.column(1), strict=True):
                for idx, (name, seq, _) in enumerate(records(text(file.as_py(), content.as_py()))):
                    yield file.as_py(), idx, name, seq

    files = spark.read.format("binaryFile").load(paths).select(_plain("path").alias("_file"), "content")
    return files.mapInArrow(lambda b: _batched(parsed(b), ["_file", "read_idx", "read_name", "seq"], _READ_KINDS), _READS)


def read_reads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_idx, read_idx, read_name, seq) of FASTA or FASTQ files; for r1 and r2 give both.

    Plain and bz2 files are split among tasks; gz files are not. A name that ends in .fa, .fasta or the like,
    packed or not, means FASTA, all others FASTQ. Quality may begin with `@`; where it is also
    wrapped into lines within a file of several splits, a split must not begin inside it.
    xz and zip files (all their entries) are read as a whole. read_idx grows within a file, and from file to file of a folder by name. Where there are fewer files than
    cores and some are packed so that one task reads one, reads are dealt to all tasks, as k-mers take many times the work of reading.
    """
    files = spark.createDataFrame(list(enumerate(paths)), "file_idx int, path string")
    placed, _, sizes = _placed(spark, files)
    kinds: dict[str, set[str]] = {}
    for p in paths:
        kinds.setdefault("whole" if _WHOLE.search(p) else ">" if _FASTA.search(p) else "@", set()).add(p)
    parts = [_whole_reads(spark, sorted(some)) if kind == "whole" else _split_reads(_pieces(spark, sorted(some), kind), kind) for kind, some in sorted(kinds.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.join(placed, "_file").select("file_idx", (F.shiftleft("_nth", NUMBER_BITS) + F.col("read_idx")).alias("read_idx"), "read_name", "seq")
    tasks = spark.sparkContext.defaultParallelism
    return out.repartition(tasks, "file_idx", "read_idx") if len(sizes) < tasks and any(map(_ONE_TASK.search, sizes)) else out


def read_sketch(spark: SparkSession, path: str) -> DataFrame:
    """A sketch table with line_no, which orders its lines: by file name, then as they stand. A malformed row is an error.

    Of lines with the same k-mer the first counts, of names with the same id the last (`query.signatures`, `query.reference_names`).
    """
    rows = spark.read.csv(path, sep="\t", schema=schemas.SKETCH, mode="FAILFAST", quote="")
    return rows.select("*", _line().alias("line_no"))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(path, uniq_count, ref_id) of a stat table; a malformed row is an error."""
    return spark.read.csv(path, sep="\t", schema=schemas.COUNTS, mode="FAILFAST", quote="")


def read_candidates(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """(ref_id, ref_name, kmer, pos, contig) of the candidates that a stat table (path, uniq_count, ref_id) lists.

    A path is a file or a folder of files; its base name is the reference's name. References
    without candidates need no path. All files are one scan.
    """
    rows = counts.where("uniq_count > 0").select("ref_id", base_id("path").alias("ref_name"), "path")
    placed, paths, _ = _placed(spark, rows)
    if not paths:
        return spark.createDataFrame([], "ref_id int, ref_name string, kmer string, pos long, contig string")
    found = spark.read.csv(paths, sep="\t", schema=schemas.CANDIDATES, mode="FAILFAST", quote="").select("*", _plain(F.col("_metadata.file_path")).alias("_file"))
    return found.join(placed, "_file").select("ref_id", "ref_name", "kmer", "pos", "contig")
