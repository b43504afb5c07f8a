"""Sequence files as Spark data sources that read byte ranges: `contigs` (FASTA) and `reads` (FASTA, FASTQ).

    spark.dataSource.register(ContigSource); spark.read.format("contigs").load(path)

A range of bytes is a task, whatever lies in it: a contig of any length is read by many tasks, also if it is
one line. What a range cannot know by itself comes from the ranges before it:

- contigs: how many records and letters came before, and the label that is open. A first pass gives a
  row for each range; their running sums and last labels are joined to the pieces of the second pass. A piece
  carries the k - 1 letters that follow it, so every window is in one piece.
- reads: where the first record begins. Each range guesses: the first place from which a few records read
  as such. A range knows where the record after its last one begins, which must be where the next
  range guessed; a wrong guess is put right by its predecessor's end, until all agree. By
  induction from the file's beginning the cut is that of a single reader, also where quality is wrapped and its
  lines begin with the marks of records.

Files are opened by pyarrow's file systems (local, S3, GCS, HDFS), and must not be packed; packed files are read by `files`.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Bytes of a range, and letters of a piece, at most.
RANGE_BYTES, PIECE_LETTERS = 32 << 20, 1 << 20
#: Bytes that are looked back for a header's beginning: headers are shorter.
MOST_HEADER = 1 << 16
#: Records that must read as such for a guess of where one begins, and bytes read for it at a time.
GUESSED, GUESS_BLOCK = 4, 1 << 14
_BLOCK = 1 << 20
_OTHER = bytes(range(128)) + b"N" * 128  # letters beyond ASCII are one base that is none


def _opened(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)
    return system, inner


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder by name; hidden ones are left out."""
    from pyarrow import fs

    system, inner = _opened(path)
    info = system.get_file_info(inner)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and not re.search(r"(^|/)[._]", f.path[len(inner) :]))


@dataclass
class Range(InputPartition):
    file_idx: int
    path: str
    start: int
    end: int
    size: int
    known: int = -1  # where its first record begins, if that is known
    parts: tuple[tuple[str, int], ...] = ()  # the files that the text is made of, if several

    def opened(self):
        if self.parts:
            return Joined(self.parts)
        system, inner = _opened(self.path)
        return system.open_input_file(inner)


class Joined:
    """Several files as one, in order; what a task does not reach is not opened."""

    def __init__(self, parts: tuple[tuple[str, int], ...]):
        self.parts, self.at, self.now, self.f = parts, 0, -1, None
        self.ends = list(accumulate(size for _, size in parts))

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int) -> bytes:
        out = []
        while n > 0 and self.at < self.ends[-1]:
            k = bisect_right(self.ends, self.at)
            begin = self.ends[k] - self.parts[k][1]
            if k != self.now:
                self.close()
                system, inner = _opened(self.parts[k][0])
                self.f, self.now = system.open_input_file(inner), k
            self.f.seek(self.at - begin)
            block = self.f.read(min(n, self.ends[k] - self.at))
            if not block:
                raise EOFError(f"{self.parts[k][0]} is shorter than it was")
            out.append(block)
            self.at, n = self.at + len(block), n - len(block)
        return b"".join(out)

    def close(self) -> None:
        if self.f:
            self.f.close()
        self.f, self.now = None, -1

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def ranges(path: str, most: int, joined: bool = False) -> list[Range]:
    """Ranges of `most` bytes. joined: the files of a folder, by name, are one text, as Spark writes it."""
    files = [(p, n) for p, n in listed(path) if n or not joined]
    if joined:
        size = sum(n for _, n in files)
        return [Range(0, path, at, min(size, at + most), size, parts=tuple(files)) for at in range(0, size, most)]
    return [Range(i, p, at, min(size, at + most), size) for i, (p, size) in enumerate(files) for at in range(0, max(size, 1), most)]


class Text:
    """A file's lines from a place on, read a block at a time."""

    def __init__(self, f, at: int, block: int = _BLOCK):
        self.f, self.at, self.block, self.held, self.pos = f, at, block, b"", 0
        f.seek(at)

    def placed(self) -> tuple[int, bytes] | None:
        """The next line and its place."""
        at = self.at
        line = self.line()
        return None if line is None else (at, line)

    def line(self) -> bytes | None:
        """The next line with its end; None at the file's end."""
        parts = []
        while (stop := self.held.find(b"\n", self.pos)) < 0:
            parts.append(self.held[self.pos :])
            self.held, self.pos = self.f.read(self.block), 0
            if not self.held:
                out = b"".join(parts)
                self.at += len(out)
                return out or None
        out = b"".join([*parts, self.held[self.pos : stop + 1]])
        self.pos = stop + 1
        self.at += len(out)
        return out


# --- contigs ------------------------------------------------------------------


def _stretches(f, r: Range) -> Iterator[tuple[bool, int, bytes]]:
    """(is a header, place, bytes) of a range: headers that begin in it, and what lies between, some bytes at a time without line ends."""
    at = r.start
    if at:
        back = max(0, at - MOST_HEADER)
        f.seek(back)
        before = f.read(at - back)
        line = before[before.rfind(b"\n") + 1 :]
        whole = len(line) < len(before) or not back  # the line's beginning is in sight
        if line and whole and (line[:1] == b">" or (not back and b"\n" not in before)):  # within a header, which belongs to the range before
            f.seek(at)
            while block := f.read(4096):
                if (stop := block.find(b"\n")) >= 0:
                    at += stop + 1
                    break
                at += len(block)
            fresh = True
        else:
            fresh = not line
    else:
        fresh = True
    f.seek(at)
    header, held = b"", False
    first = at == 0
    while at < r.end or held:
        block = f.read(_BLOCK if held else min(_BLOCK, r.end - at))
        if not block:
            break
        pos = 0
        while pos < len(block):
            if held:
                stop = block.find(b"\n", pos)
                header += block[pos : stop if stop >= 0 else len(block)]
                if stop < 0:
                    pos = len(block)
                    continue
                yield True, at, header
                header, held, fresh, pos = b"", False, True, stop + 1
                if at + pos >= r.end:
                    return
            elif first or (fresh and block[pos : pos + 1] == b">"):
                held, first = True, False
            else:
                limit = min(len(block), r.end - at)
                stop = block.find(b"\n>", pos, limit)
                piece = block[pos : stop + 1 if stop >= 0 else limit]
                yield False, at + pos, piece.replace(b"\n", b"")
                fresh = piece.endswith(b"\n")
                pos += len(piece)
                if at + pos >= r.end:
                    return
        at += len(block)
    if held:
        yield True, at, header


def _following(f, at: int, n: int) -> bytes:
    """The n letters from a place on, fewer where a header or the file's end comes first; the place is within a record."""
    f.seek(max(0, at - 1))
    fresh, out = at == 0 or f.read(1) == b"\n", b""
    while len(out) < n and (block := f.read(max(4096, n))):
        stop = 0 if fresh and block[:1] == b">" else block.find(b"\n>")
        out += (block if stop < 0 else block[:stop]).replace(b"\n", b"")
        fresh = block.endswith(b"\n")
        if stop >= 0:
            break
    return out[:n]


def _label(header: bytes) -> str | None:
    return header[1:].decode("utf-8", "replace").replace(" ", "_") or None


def _pieces(f, r: Range, overlap: int) -> Iterator[tuple[int, str | None, int, bytes, int]]:
    """(records begun in the range, last label in it or None, letters before in record and range, letters with overlap, own letters)."""
    record, label, done, held = 0, None, 0, bytearray()

    def cut(own_letters: int) -> Iterator[tuple[int, str | None, int, bytes, int]]:
        nonlocal done
        while own_letters > 0:
            own = min(PIECE_LETTERS, own_letters)
            yield record, label, done, bytes(held[: own + overlap]), own
            done, own_letters = done + own, own_letters - own
            del held[:own]

    for header, _, text in _stretches(f, r):
        if header:
            yield from cut(len(held))
            held.clear()
            record, label, done = record + 1, _label(text) or label, 0
        else:
            held += text
            yield from cut((len(held) - overlap) // PIECE_LETTERS * PIECE_LETTERS)  # whole pieces whose followers are here
    if held:
        own = len(held)
        held += _following(f, r.end, overlap) if r.end < r.size else b""
        yield from cut(own)


_CONTIGS = "file_idx int, path string, range_start long, record int, label string, start long, seq string, letters long"


class ContigSource(DataSource):
    """Pieces of FASTA records by range; numbers and labels are those within the range (`contigs` completes them).

    Options: path; rangebytes; overlap (letters that follow each piece); summary ("true": a row for each range only);
    joined ("true": the files of a folder are one text).
    """

    @classmethod
    def name(cls) -> str:
        return "contigs"

    def schema(self) -> str:
        return _CONTIGS

    def reader(self, schema: StructType) -> DataSourceReader:
        return ContigReader(self.options)


class ContigReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("rangebytes", RANGE_BYTES))
        self.overlap, self.summary, self.joined = int(options.get("overlap", 0)), *(options.get(x, "false") == "true" for x in ("summary", "joined"))

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.most, self.joined)

    def read(self, r: Range) -> Iterator[tuple]:
        with r.opened() as f:
            if self.summary:
                records, label, letters = 0, None, 0
                for header, _, text in _stretches(f, r):
                    if header:
                        records, letters = records + 1, 0
                        label = _label(text) or label
                    else:
                        letters += len(text)
                yield r.file_idx, r.path, r.start, records, label, 0, None, letters
                return
            for record, label, start, seq, own in _pieces(f, r, self.overlap):
                yield r.file_idx, r.path, r.start, record, label, start, seq.translate(_OTHER).decode().upper(), own


def contigs(spark: SparkSession, path: str, *, k: int, range_bytes: int = RANGE_BYTES, joined: bool = False) -> DataFrame:
    """(file_idx, path, record_idx, contig, start, seq): pieces of all records, each with the k - 1 letters that follow.

    `kmers` on seq gives every window of every record once, at start + pos. Records, labels and letters are as in
    `files.read_fasta`; letters beyond ASCII count as one base N for each byte. joined: the files of a folder are one
    text, of which a record may fill several; the file's line ends are all that ends lines.
    """
    spark.dataSource.register(ContigSource)
    reader = spark.read.format("contigs").option("rangebytes", range_bytes).option("joined", str(joined).lower())
    each = reader.option("summary", "true").load(path).select("file_idx", "range_start", "record", "label", "letters")
    file = Window.partitionBy("file_idx").orderBy("range_start")  # a row for each range
    earlier = file.rowsBetween(Window.unboundedPreceding, -1)
    before = each.withColumn("_records", F.coalesce(F.sum("record").over(earlier), F.lit(0))).withColumn("_label", F.last("label", ignorenulls=True).over(earlier))
    # Letters of the open record: of the ranges since the last one in which a record began.
    begun = F.max(F.when(F.col("record") > 0, F.col("range_start"))).over(earlier)
    before = before.withColumn("_begun", begun).withColumn("_all", F.coalesce(F.sum("letters").over(earlier), F.lit(0)))
    at_begin = before.select("file_idx", F.col("range_start").alias("_begun"), F.col("_all").alias("_less"))
    before = before.join(at_begin, ["file_idx", "_begun"], "left").select("file_idx", "range_start", "_records", "_label", (F.col("_all") - F.coalesce("_less", F.lit(0))).alias("_letters"))
    pieces = reader.option("summary", "false").option("overlap", k - 1).load(path)
    own = F.col("record") > 0
    return pieces.join(before, ["file_idx", "range_start"]).select(
        "file_idx", "path", (F.col("_records") + F.col("record") - 1).cast("long").alias("record_idx"), F.coalesce("label", "_label", F.lit("")).alias("contig"),
        (F.col("start") + F.when(own, F.lit(0)).otherwise(F.col("_letters"))).alias("start"), "seq",
    )


# --- reads --------------------------------------------------------------------


def _next_record(text: Text, line: tuple[int, bytes] | None) -> tuple[int, str, str, bool, tuple[int, bytes] | None] | None:
    """(place, name, sequence, whether its quality fits, the line after it) of the record at or after a line."""
    while line is not None and line[1][:1] not in (b">", b"@"):
        line = text.placed()
    if line is None:
        return None
    place, head = line
    name, parts, fits = (head[1:].split(None, 1) or [b""])[0], [], head[:1] == b">"
    line = text.placed()
    while line is not None and line[1][:1] not in (b">", b"@", b"+"):
        parts.append(line[1].rstrip(b"\r\n"))
        line = text.placed()
    seq = b"".join(parts)
    if line is not None and line[1][:1] == b"+":
        missing = len(seq)
        while missing > 0 and (line := text.placed()) is not None:
            missing -= len(line[1].rstrip(b"\r\n"))
        fits = missing == 0
        line = text.placed()
    return place, name.decode("utf-8", "replace"), seq.decode("utf-8", "replace"), fits, line


def _guess(f, r: Range) -> int | None:
    """Where the first record of a range probably begins; None if none seems to."""
    if not r.start:
        return 0
    text = Text(f, r.start - 1, GUESS_BLOCK)
    text.line()  # the rest of the line before
    while text.at < r.end:
        at, line = text.at, text.line()
        if line is None:
            return None
        if line[:1] in (b">", b"@"):
            tried = Text(f, at, GUESS_BLOCK)
            after, good = tried.placed(), True
            for _ in range(GUESSED):
                got = _next_record(tried, after)
                if got is None:
                    break
                after = got[4]
                good = got[3] and (after is None or after[1][:1] in (b">", b"@"))
                if not good:
                    break
            if good:
                return at
            f.seek(text.at - text.pos + len(text.held))  # where the lines go on
    return None


def _reads(f, r: Range) -> Iterator[tuple[int, str, str]]:
    """(place, name, sequence) of the records that begin in a range, and at last (place of the next record, "", None)."""
    begin = r.known if r.known >= 0 else _guess(f, r)
    if begin is None or begin >= r.end:
        yield begin if begin is not None else -1, "", None
        return
    text = Text(f, begin)
    line = text.placed()
    while got := _next_record(text, line):
        if got[0] >= r.end:
            yield got[0], "", None
            return
        yield got[:3]
        line = got[4]
    yield r.size, "", None


_READS = "file_idx int, path string, range_start long, place long, read_name string, seq string"


class ReadSource(DataSource):
    """Records of FASTA and FASTQ files, mixed or not, by range; as a stream, a new file is a task.

    Options: path; rangebytes; known (JSON: [file_idx, range's start, first record's place], ...; `reads` finds them); cuts ("true": a row for each range only: its
    first record's place as place, and the place of the record after its last as seq).
    """

    @classmethod
    def name(cls) -> str:
        return "reads"

    def schema(self) -> str:
        return _READS

    def reader(self, schema: StructType) -> DataSourceReader:
        return ReadReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ReadStream(self.options)


class ReadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.most, self.cuts = options["path"], int(options.get("rangebytes", RANGE_BYTES)), options.get("cuts", "false") == "true"
        self.known = {(i, at): place for i, at, place in json.loads(options.get("known", "[]"))}

    def partitions(self) -> list[Range]:
        out = ranges(self.path, self.most)
        for r in out:
            r.known = self.known.get((r.file_idx, r.start), -1)
        return out

    def read(self, r: Range) -> Iterator[tuple]:
        with r.opened() as f:
            first = None
            for place, name, seq in _reads(f, r):
                first = place if first is None else first
                if seq is not None and not self.cuts:
                    yield r.file_idx, r.path, r.start, place, name, seq
            if self.cuts:
                yield r.file_idx, r.path, r.start, None if first < 0 else first, "", None if place < 0 else str(place)


class ReadStream(DataSourceStreamReader):
    """Files in the order of their times and names; the offset is the last one that was read."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def _files(self) -> list[tuple[int, str, int]]:
        from pyarrow import fs

        system, inner = _opened(self.path)
        prefix = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
        return sorted((x.mtime_ns or 0, prefix + x.path, x.size) for x in found if x.type == fs.FileType.File and not re.search(r"(^|/)[._]", x.path[len(inner) :]))

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = self._files()
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        low, high = ((x["time"], x["path"]) for x in (start, end))
        return [Range(0, path, 0, size, size, 0) for time, path, size in self._files() if low < (time, path) <= high]

    def read(self, r: Range) -> Iterator[tuple]:
        with r.opened() as f:
            for place, name, seq in _reads(f, r):
                if seq is not None:
                    yield 0, r.path, 0, place, name, seq

    def commit(self, end: dict) -> None:
        pass


def reads(spark: SparkSession, path: str, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file_idx, read_idx, read_name, seq) of a file or the files of a folder; read_idx is the record's byte.

    Ranges whose guess is not where the one before ends are cut again from there, until all fit; that is rarely any.
    """
    spark.dataSource.register(ReadSource)
    reader, known = spark.read.format("reads").option("rangebytes", range_bytes), {}
    earlier = Window.partitionBy("file_idx").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    while True:
        cuts = reader.option("cuts", "true").option("known", json.dumps([[*k, v] for k, v in known.items()])).load(path)
        chained = cuts.select("file_idx", "range_start", "place", F.last(F.col("seq").cast("long"), ignorenulls=True).over(earlier).alias("want"))
        wrong = {(r["file_idx"], r["range_start"]): r["want"] for r in chained.where("range_start > 0 and not (place <=> want)").collect()}
        if all(known.get(k) == v for k, v in wrong.items()):
            break
        known |= wrong
    found = reader.option("cuts", "false").option("known", json.dumps([[*k, v] for k, v in known.items()])).load(path)
    return found.select("file_idx", F.col("place").alias("read_idx"), "read_name", "seq")


def stream_reads(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (file_idx, read_idx, read_name, seq) of the files that arrive in a folder; file_idx is 0."""
    spark.dataSource.register(ReadSource)
    return spark.readStream.format("reads").load(path).select("file_idx", F.col("place").alias("read_idx"), "read_name", "seq")
