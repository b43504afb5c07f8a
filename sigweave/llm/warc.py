"""WARC archives: a writer with payload deduplication and a salvage reader.

The writer makes one gzip member a record and lets Spark's text writer put them into files,
so archives can lie in any file system that Spark writes to. The line separator is an empty
gzip member, which readers skip.

The reader checks every member (CRC, length) and every record (version line, header lines,
block length, block and payload digest, closing line ends). Where a check fails, it searches
for the next member or version line that begins a valid record, goes on from there, and
reports the bytes between as a quarantined gap. What a damaged member inflates to is searched
in the same way: its valid records count, and each bad stretch of it is a gap; both have the
member's place. Where inflating failed (but for a cut-off end), only records with a block
digest are valid, and none that ends just where inflating stopped. A member of which only the checksum is bad and all records are valid has no gap.

A null payload is empty. Of payloads with equal digests and at least `revisit_from` bytes,
the row of the largest id is the response and the others revisit it; rows that repeat that
id are responses too, and null ids revisit unless all ids are null. A null or odd URI is
left out or percent-encoded. An empty table gives archives without records. The writer begins
a new archive after ROLL_BYTES; archives from elsewhere must be smaller than 2 GB, as one task reads one as a whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_GAP = gzip.compress(b"", 9, mtime=0)
_CHUNK = 1 << 16
#: Bytes of an archive, but for its last record.
ROLL_BYTES = 128 << 20
#: A record's header has at most so many lines and bytes; more are damage.
HEADER_LINES, HEADER_BYTES = 256, 1 << 16
#: A gzip member's name and its comment have at most so many bytes; more are damage.
NAME_BYTES = 1 << 16


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(rec_id: str, uri: str | None, payload: bytes, payload_digest: str, revisit_of: str | None, date: str, length: int | None = None) -> bytes:
    """One WARC record with its closing line ends; length: of the full payload, where a revisit leaves it out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if length is None else length}\r\n\r\n".encode()
    block = http + (b"" if revisit_of is not None else payload)
    head = ["WARC/1.1", f"WARC-Type: {'response' if revisit_of is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{rec_id}>"]
    if uri:
        head.append("WARC-Target-URI: " + "".join(c if 0x20 < ord(c) != 0x7F else "".join(f"%{x:02X}" for x in c.encode()) for c in uri))
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response"]
    if revisit_of is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{revisit_of}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


class Damage(ValueError):
    pass


class Marks:
    """Where marks come next in a text. Places are asked for in order, so each stretch is searched once for each mark."""

    def __init__(self, data: bytes):
        self.data, self.next = data, {}

    def after(self, mark: bytes, at: int) -> int:
        """The first place from `at` on; the text's length if there is none."""
        if self.next.get(mark, -1) < at:
            found = self.data.find(mark, at)
            self.next[mark] = len(self.data) if found < 0 else found
        return self.next[mark]


_VERSION = re.compile(rb"WARC/[01]\.\d{1,3}\r\n")


def parse(data: bytes, at: int, marks: Marks | None = None) -> tuple[dict, int]:
    """The record that begins at `at` and the place after it; Damage if a check fails."""
    first = _VERSION.match(data, at)
    if not first:
        raise Damage("no version line")
    stop = (marks or Marks(data)).after(b"\r\n\r\n", at)
    if stop == len(data) or stop - at > HEADER_BYTES or data.count(b"\r\n", at, stop) > HEADER_LINES:
        raise Damage("header without an end")
    lines = data[first.end() : stop].split(b"\r\n")
    if not all(b":" in line for line in lines):
        raise Damage("header line without a colon")
    headers: dict[str, str] = {}
    for line in lines:
        name, _, value = line.partition(b":")
        key = name.strip().lower().decode("latin-1")
        if key in headers and key != "warc-concurrent-to":
            raise Damage("header line twice")  # as where a cut-off header runs into the next one
        headers[key] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit() or "warc-type" not in headers:
        raise Damage("no length or type")
    start = stop + 4
    end = start + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damage("block of another length")
    block = data[start:end]
    want = headers.get("warc-block-digest", "")
    if want.startswith("sha1:") and want[5:] != digest(block):
        raise Damage("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, want = headers["warc-type"], headers.get("warc-payload-digest", "")
    if kind == "response" and want.startswith("sha1:") and want[5:] != digest(payload):
        raise Damage("payload digest")
    length = next((int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:") and x[15:].strip().isdigit()), len(payload))
    return {"type": kind, "id": headers.get("warc-record-id"), "uri": headers.get("warc-target-uri"), "refers": headers.get("warc-refers-to"), "digest": want[5:] if want.startswith("sha1:") else digest(payload), "length": len(payload) if kind == "response" else length, "payload": payload if kind == "response" else None, "checked": "warc-block-digest" in headers and headers["warc-block-digest"].startswith("sha1:")}, end + 4


def compressed_from(data: bytes, at: int) -> int | None:
    """Where the compressed data begin of the gzip member at `at`; None if there is no header, or data that cannot be."""
    if at + 18 > len(data) or data[at + 3] & 0xE0:
        return None
    flags, end = data[at + 3], at + 10
    if flags & 4:
        end += 2 + int.from_bytes(data[end : end + 2], "little")
    for flag in (8, 16):  # a name and a comment, closed by a zero
        if flags & flag and (end := data.find(b"\0", end, end + NAME_BYTES) + 1) == 0:
            return None
    end += 2 * bool(flags & 2)
    return end if end < len(data) and data[end] & 6 != 6 else None


def member(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """What the gzip member at `at` inflates to, the place after it, and what is wrong with it ("": nothing).

    The place is None if the member's compressed data do not end; without a right checksum it is where they end.
    """
    pos = compressed_from(data, at)
    if pos is None:
        return b"", None, "gzip: no member"
    d, out, size = zlib.decompressobj(-15), [], 32
    while not d.eof and pos < len(data):
        before = d.copy()
        try:
            out.append(d.decompress(data[pos : pos + size]))
        except zlib.error as e:
            # zlib keeps back what it had inflated of the failing piece: the longest beginning that inflates is looked
            # for by halves. The first 32 bytes cannot hold a record.
            while size > 1 and out:
                size //= 2
                d = before.copy()
                try:
                    out.append(d.decompress(data[pos : pos + size]))
                    before, pos = d, pos + size
                except zlib.error:
                    pass
            return b"".join(out), None, f"gzip: {e}"
        pos, size = pos + size, min(2 * size, _CHUNK)
    text, end = b"".join(out), min(pos, len(data)) - len(d.unused_data)
    if not d.eof:
        return text, None, "gzip: cut off"
    if data[end : end + 4] != zlib.crc32(text).to_bytes(4, "little"):
        return text, end, "gzip: checksum"
    if data[end + 4 : end + 8] != (len(text) & 0xFFFFFFFF).to_bytes(4, "little"):
        return text, end, "gzip: length"
    return text, end + 8, ""


def records(text: bytes, digests: bool) -> list[dict | str]:
    """The whole records of a text, and a reason for each bad stretch; digests: only records with a block digest count."""
    found: list[dict | str] = []
    pos, bad, marks = 0, False, Marks(text)
    while pos < len(text):
        try:
            r, end = parse(text, pos, marks)
            if digests and not r["checked"]:
                raise Damage("no digest in a damaged member")
        except Damage as e:
            if not bad:
                found.append(str(e))
            bad, pos = True, marks.after(b"WARC/", pos + 1)
            continue
        found.append(r)
        bad, pos = False, end
    return found


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """(start, end, record) of every whole record, and (start, end, reason) of every quarantined gap."""
    at, bad = 0, None
    held: list[dict | str] = []  # what the damage from `bad` on gives

    marks = Marks(data)

    def place(after: int) -> int:
        return min(marks.after(b"\x1f\x8b\x08", after), marks.after(b"WARC/", after))

    while at < len(data):
        error, end = "", None
        if data[at : at + 3] == b"\x1f\x8b\x08":
            text, end, error = member(data, at)
            found = records(text, bool(error) and error != "gzip: cut off")
            if error and end is None and (not found or not isinstance(found[-1], str)):
                found[-1:] = [error]  # a record that ends just where inflating stopped is not counted
        else:
            try:
                r, end = parse(data, at, marks)
                found = [r]
            except Damage as e:
                found = [str(e)]
        good = any(not isinstance(r, str) for r in found)
        if good and bad is not None:
            for r in held:
                yield bad, at, r
            bad = None
        if good and end is not None:
            if error:  # up to the next member, which begins early where the checksum is cut off
                end = min(place(end), end + 8)
            for r in found:
                yield at, end, r
        elif (found or error) and bad is None:
            bad, held = at, found if good else [error or found[0]]
        # An empty member may be chance within damage, and ends no gap.
        at = place(at + 1) if end is None or error and not good else end
    if bad is not None:
        for r in held:
            yield bad, len(data), r


_READ = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("gap_reason", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("target_uri", T.StringType()), T.StructField("refers_to", T.StringType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType()),
])


def read(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """One row a record or gap of the archives under path; gap_reason is null for records."""
    schema = storage.arrow_type(_READ)

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                rows, size = [], 0
                for start, end, r in salvage(content.as_py()):
                    row = {"archive": name.as_py(), "start": start, "end": end}
                    if isinstance(r, str):
                        row["gap_reason"] = r
                    else:
                        row |= {"record_type": r["type"], "record_id": r["id"], "target_uri": r["uri"], "refers_to": r["refers"], "payload_digest": r["digest"], "payload_bytes": r["length"], "payload": r["payload"] if payloads else None}
                        size += len(r["payload"] or b"") * payloads
                    rows.append(row)
                    if len(rows) >= 5000 or size > 8 << 20:
                        yield pa.RecordBatch.from_struct_array(pa.array(rows, schema))
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_struct_array(pa.array(rows, schema))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, _READ)


def with_decisions(pages: DataFrame, *, id_col: str, html_col: str, revisit_from: int = 0) -> DataFrame:
    """pages with _digest, _bytes and _revisits (the id of the response, null for responses)."""

    def start():
        def run(b: pa.RecordBatch) -> list:
            raw = [(x.as_py() or "").encode() for x in b.column(1)]
            return [[digest(x) for x in raw], [len(x) for x in raw]]

        return run

    known = storage.map_columns(pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html"), *[c for c in pages.columns if c not in (id_col, html_col)]), [("_digest", T.StringType()), ("_bytes", T.LongType())], start)
    # The digests are counted from a projection of their own: html does not travel for it.
    several = known.where(F.col("_bytes") >= revisit_from).groupBy("_digest").agg(F.max("_id").alias("_keep"), F.count("*").alias("_rows")).where("_rows > 1").select("_digest", "_keep")
    return known.join(several, "_digest", "left").withColumn("_revisits", F.when(~F.col("_id").eqNullSafe(F.col("_keep")), F.col("_keep"))).drop("_keep")


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 0, date: str = "2000-01-01T00:00:00Z") -> int:
    """Archives under path, one gzip member a record; a task's archives are rolled by their bytes. Returns the bytes of all archives."""
    rows = with_decisions(pages.select(id_col, url_col, html_col), id_col=id_col, html_col=html_col, revisit_from=revisit_from).select("_id", F.col(url_col).alias("_url"), "_html", "_digest", "_bytes", "_revisits")

    most = ROLL_BYTES

    def start():
        archive = size_now = 0

        def run(b: pa.RecordBatch) -> list:
            nonlocal archive, size_now
            out, places = [], []
            for i, url, html, known, size, of in zip(*(b.column(k) for k in range(6)), strict=True):
                of = of.as_py()
                name = "" if i.as_py() is None else str(i.as_py())
                raw = record(name, url.as_py(), (html.as_py() or "").encode() if of is None else b"", known.as_py(), None if of is None else str(of), date, size.as_py())
                out.append(gzip.compress(raw, 5, mtime=0))
                if size_now > most:
                    archive, size_now = archive + 1, 0
                size_now += len(out[-1]) + len(_GAP)
                places.append(archive)
            return [out, places]

        return run

    made = storage.map_columns(rows, [("_member", T.BinaryType()), ("_archive", T.LongType())], start, keep=[])
    seen = Observation()
    made = made.observe(seen, F.coalesce(F.sum(F.octet_length("_member") + len(_GAP)), F.lit(0)).alias("bytes"))
    made.select(F.col("_member").cast("string").alias("value"), "_archive").write.partitionBy("_archive").option("lineSep", _GAP.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    return seen.get["bytes"]


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_from: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder and read them back: id_col, payload_bytes, payload_digest, record_type, refers_to.

    A gap in what was written just before is an error, and so is a file that is missing or short.
    """
    spark = pages.sparkSession
    path = storage.new_path(spark, "warc")
    sent = write(pages, path, id_col=id_col, url_col=url_col, html_col=html_col, revisit_from=revisit_from)
    there = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if there != sent:
        raise ValueError(f"archives of {there} bytes are left of {sent}")
    kind = pages.schema[id_col].dataType
    named = lambda c: F.nullif(F.regexp_extract(c, "^<urn:x-page:(.*)>$", 1), F.lit("")).cast(kind)
    whole = F.when(F.col("gap_reason").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("gap in "), "archive", F.lit(": "), "gap_reason")).cast("boolean"))
    got = read(spark, path, payloads=False).where(whole)
    return got.select(named("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", named("refers_to").alias("refers_to"))
