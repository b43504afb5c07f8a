"""Alignment of the tokens that two tokenizers make of the same text.

Both token lists cut the same bytes, so each token is an interval. The intervals of B are
indexed once a document, and for every token of A two bisections find the tokens of B that it
overlaps. A gap between tokens of A that no interval of B spans is a boundary of a group: the smallest runs of
tokens of both that cover the same bytes.

Tokens are stored once, and both passes over them align anew, which costs little beside
encoding. The first pass counts how often each pair of ids is linked: a task sums its pairs,
and a shuffle adds the sums up. The second gives each document its figures. It needs the counts
of the pairs that occur in a document: pairs linked often, at most MOST_PAIRS of them, are sent to
all tasks; rarer ones, if there are so many, leave the documents as rows of (document, pair, times), meet
their counts in a join by pair, and return as one row a document.

Texts that are null, empty, or not what the tokens' bytes make (a tokenizer that changes
characters) have no tokens: zeros and empty lists. Repeated rows are documents of their own. Without
documents the result is empty. Input columns that have the name of a result column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage
from .packing import Encoder

#: Pairs of ids that are sent to all tasks, at most: 17 bytes each.
MOST_PAIRS = 2_000_000
#: Pairs, and sums of pairs, that a task gathers before it adds them up; rows that it aligns at a time; tokens whose bytes are compared at a time.
GATHERED, ROWS, STRETCH = 1 << 20, 500, 1 << 16
_IDS = T.ArrayType(T.IntegerType())


class ByteLevel:
    """Ids of space + text, and the bytes of each id, of a byte-level BPE file."""

    def __init__(self, path: str):
        self.encoder = Encoder(path, plain=True)
        vocabulary = self.encoder.slow.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if token in self.encoder.special else self.encoder.decoded(token)

    def __call__(self, text: str) -> np.ndarray:
        return self.encoder(" " + text).astype(np.int32)


class Pieces:
    """Ids of a text, before which the model puts a space, and the bytes of each id, of a sentencepiece file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def __call__(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.int32)


class Spelling:
    """The bytes of all ids in one array, to compare a text with its tokens."""

    def __init__(self, of: list[bytes]):
        self.flat = np.frombuffer(b"".join(of), np.uint8)
        self.sizes = np.array([len(x) for x in of], np.int32)
        self.starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes

    def makes(self, ids: np.ndarray, want: bytes) -> bool:
        """Whether the bytes of ids, joined, are want."""
        at = 0
        for k in range(0, len(ids), STRETCH):
            some = ids[k : k + STRETCH]
            n = self.sizes[some]
            place = np.repeat(self.starts[some] + n - np.cumsum(n, dtype=np.int32), n)
            place += np.arange(len(place), dtype=np.int32)
            if self.flat[place].tobytes() != want[at : at + len(place)]:
                return False
            at += len(place)
        return at == len(want)


class Intervals:
    """A static index of intervals that lie one after the other: sorted beginnings and ends."""

    def __init__(self, sizes: np.ndarray):
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def stab(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first interval that each [start, end) overlaps, and the one after the last."""
        return np.searchsorted(self.ends, starts, "right"), np.searchsorted(self.starts, ends, "left")


class Alignment:
    """Tokens a and b of texts, one after the other: pairs of overlapping places, and the tokens up to the end of each group.

    Both lists end with each text, so no pair or group crosses from one text to the next.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray):
        own, index = Intervals(sizes_a[a]), Intervals(sizes_b[b])
        first, after = index.stab(own.starts, own.ends)
        # Each token of a ends where the next begins, so what that one overlaps first tells whether a token of b spans the end.
        ended = np.append(first[1:], len(b)) if len(a) else first
        many = after - first
        self.links_before = np.concatenate([np.zeros(1, np.int64), np.cumsum(many)])  # those of earlier tokens of a
        self.link_a = np.repeat(np.arange(len(a)), many)
        self.link_b = np.arange(len(self.link_a)) + np.repeat(first - self.links_before[:-1], many)
        closed = np.flatnonzero(after <= ended)
        self.group_a = closed + 1
        self.group_b = ended[closed]


class Tally:
    """How often each key came. Keys are counted whenever so many are gathered, and counts merged whenever so many wait."""

    def __init__(self, gathered: int):
        self.gathered = gathered
        self.keys: list[np.ndarray] = []
        self.sums = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    @property
    def n_merged(self) -> int:
        return len(self.sums[0][0])

    def add(self, keys: np.ndarray) -> None:
        self.keys.append(keys)
        if sum(map(len, self.keys)) >= self.gathered:
            self._count()
            if sum(len(keys) for keys, _ in self.sums[1:]) >= self.gathered:
                self._merge()

    def _count(self) -> None:
        self.sums.append(np.unique(np.concatenate(self.keys), return_counts=True))
        self.keys = []

    def _merge(self) -> None:
        keys, n = (np.concatenate(x) for x in zip(*self.sums, strict=True))
        by = np.argsort(keys, kind="stable")  # runs are sorted already, and only merged
        keys, n = keys[by], n[by]
        first = np.flatnonzero(np.diff(keys, prepend=-1))  # no key is negative
        self.sums = [(keys[first], np.add.reduceat(n, first) if len(first) else n)]

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """The keys so far, sorted, and their counts; the tally is empty then."""
        if self.keys:
            self._count()
        self._merge()
        got, self.sums = self.sums[0], [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        return got


def tokens(docs: DataFrame, a_path: str, b_path: str, *, text_col: str = "text") -> DataFrame:
    """docs without text, with a_ids and b_ids, stored: ids as little-endian numbers of two bytes, or four where ids need them; empty without an alignment."""

    def start() -> Callable[[pa.RecordBatch], list]:
        a_of, b_of = ByteLevel(a_path), Pieces(b_path)
        a_spells, b_spells = Spelling(a_of.bytes), Spelling(b_of.bytes)
        none = np.zeros(0, np.int32)

        def both(text: str | None) -> tuple[np.ndarray, np.ndarray]:
            if not text:
                return none, none
            want, a, b = (" " + text).encode(), a_of(text), b_of(text)
            return (a, b) if a_spells.makes(a, want) and b_spells.makes(b, want) else (none, none)

        def run(batch: pa.RecordBatch) -> list:
            got = [both(t.as_py()) for t in batch.column(place)]
            return [[ids.astype("<u2" if len(of.bytes) <= 1 << 16 else "<u4").tobytes() for ids in some] for of, some in ((a_of, [x[0] for x in got]), (b_of, [x[1] for x in got]))]

        return run

    place = docs.columns.index(text_col)
    made = storage.map_columns(docs, [("a_ids", T.BinaryType()), ("b_ids", T.BinaryType())], start, keep=[c for c in docs.columns if c != text_col], rows=ROWS)
    return storage.written(made.withColumn("_sw_row", F.monotonically_increasing_id()), "tokens")


def _sizes(path: str, kind: Callable) -> np.ndarray:
    return np.array([len(b) for b in kind(path).bytes], np.int64)


def _flat(column: pa.Array, n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, and where each row begins (one more at the end)."""
    width = 2 if n_ids <= 1 << 16 else 4
    ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    raw = np.frombuffer(column.buffers()[2], f"<u{width}", (ends[-1] - ends[0]) // width, ends[0]) if ends[-1] > ends[0] else np.zeros(0, np.uint16)
    return raw.astype(np.int32), (ends - ends[0]) // width


def pair_counts(made: DataFrame, sizes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(pair, n, best), stored: a_id * ids of B + b_id, its links in all documents, whether no pair of that b_id has more."""
    sent = made.sparkSession.sparkContext.broadcast(sizes)
    width = len(sizes[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, tally = storage.taken(sent), Tally(GATHERED)
        for batch in storage.pieces(batches, ROWS):
            a, b = (_flat(batch.column(k), len(both[k]))[0] for k in (0, 1))
            found = Alignment(a, b, *both)
            tally.add(a[found.link_a].astype(np.int64) * width + b[found.link_b])
            if tally.n_merged >= 4 * GATHERED:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in tally.taken()], names=["pair", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in tally.taken()], names=["pair", "n"])

    each = made.select("a_ids", "b_ids").mapInArrow(storage.lean_batches(run), "pair long, n long")
    counts = storage.written(each.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    most = counts.groupBy((F.col("pair") % width).alias("_b")).agg(F.max("n").alias("_most"))  # a row for each id of B at most
    joined = counts.withColumn("_b", F.col("pair") % width).join(F.broadcast(most), "_b")
    return joined.select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def often(counts: DataFrame, most: int) -> int:
    """The smallest power of two such that at most `most` pairs have as many links."""
    sizes = {r["size"]: r["pairs"] for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).agg(F.count("*").alias("pairs")).collect()}
    held, least = 0, max(sizes, default=0) + 1
    while least > 0 and held + sizes.get(least - 1, 0) <= most:
        least -= 1
        held += sizes.get(least, 0)
    return 1 << least


def align(docs: DataFrame, a_path: str, b_path: str, *, text_col: str = "text", most_pairs: int = MOST_PAIRS, keep_groups: bool = False) -> DataFrame:
    """docs without their text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    a_path, b_path: a byte-level BPE file and a sentencepiece file, which every executor must have.
    keep_groups: also a_ids, b_ids, and in a_ends and b_ends the number of tokens up to the end of
    each group.
    """
    spark = docs.sparkSession
    sizes = (_sizes(a_path, ByteLevel), _sizes(b_path, Pieces))
    width = len(sizes[1])
    made = tokens(docs, a_path, b_path, text_col=text_col)
    counts = storage.written(pair_counts(made, sizes), "counts")
    least = often(counts, most_pairs)
    hot = counts.where(F.col("n") >= least).toArrow().sort_by("pair")
    sent = spark.sparkContext.broadcast((sizes, hot["pair"].to_numpy(), hot["n"].to_numpy(), hot["best"].to_numpy()))
    place = {c: made.columns.index(c) for c in ("a_ids", "b_ids")}

    def start() -> Callable[[pa.RecordBatch], list]:
        both, pairs, times, best = storage.taken(sent)
        written = Written(len(both[0]), width)

        def run(batch: pa.RecordBatch) -> list:
            (a, a_at), (b, b_at) = (_flat(batch.column(place[c]), len(x)) for c, x in zip(("a_ids", "b_ids"), both, strict=True))
            found = Alignment(a, b, *both)
            links, n = found.links_before[a_at], len(a_at) - 1
            mine = a[found.link_a].astype(np.int64) * width + b[found.link_b]
            at = np.minimum(np.searchsorted(pairs, mine), max(0, len(pairs) - 1))
            known = pairs[at] == mine if len(pairs) else np.zeros(len(mine), bool)
            here = at[known]
            sums = []
            for values in (best, times):
                each = np.zeros(len(mine) + 1, np.int64)
                each[1:][known] = values[here]
                np.cumsum(each, out=each)
                sums.append(np.diff(each[links]))
            doc = np.searchsorted(links, np.flatnonzero(~known), "right") - 1
            keys, n_rare = np.unique(doc * (len(both[0]) * width) + mine[~known], return_counts=True)
            rare_at = pa.array(np.searchsorted(keys, np.arange(n + 1) * (len(both[0]) * width)), pa.int32())
            rare = [pa.ListArray.from_arrays(rare_at, pa.array(x)) for x in (keys % (len(both[0]) * width), n_rare)]
            groups = np.searchsorted(found.group_a, a_at, "right")
            text = written(a, b, found)
            digests = [hashlib.sha256(text[i:j].tobytes().translate(None, b"\0")[:-1]).hexdigest() if j > i else "" for i, j in zip(a_at[:-1] + b_at[:-1], a_at[1:] + b_at[1:], strict=True)]
            lists = []
            if keep_groups:
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x, at in ((a, a_at), (b, b_at))]
                ends = [(x - np.repeat(at[:-1], np.diff(groups))).astype(np.int32) for x, at in ((found.group_a, a_at), (found.group_b, b_at))]
                lists += [pa.ListArray.from_arrays(pa.array(groups, pa.int32()), pa.array(x)) for x in ends]
            return [np.diff(a_at), np.diff(b_at), np.diff(groups), np.diff(links), *sums, digests, *rare, *lists]

        return run

    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    added = [*((c, T.LongType()) for c in numbers), ("groups_sha256", T.StringType()), *((c, T.ArrayType(T.LongType())) for c in ("_sw_rare", "_sw_times"))]
    added += [(c, _IDS) for c in ("a_ids", "b_ids", "a_ends", "b_ends")] if keep_groups else []
    kept = [c for c in made.columns if c not in ("a_ids", "b_ids")]
    out = storage.map_columns(made, added, start, keep=kept, rows=ROWS)
    if least > 1:  # some pairs are counted but not sent
        out = storage.written(out, "aligned")
        each = out.select("_sw_row", F.explode(F.arrays_zip(F.col("_sw_rare").alias("p"), F.col("_sw_times").alias("t"))).alias("x")).select("_sw_row", F.col("x.p").alias("pair"), F.col("x.t").alias("t"))
        sums = each.join(counts.where(F.col("n") < least), "pair").groupBy("_sw_row").agg(F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("_sw_best"), F.sum(F.col("t") * F.col("n")).alias("_sw_sum"))
        out = out.join(sums, "_sw_row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("_sw_best", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("_sw_sum", F.lit(0)))
    return out.select(*(c for c in out.columns if not c.startswith("_sw_")))


class Written:
    """Groups as text: `a1,a2|b1;a3|b2,b3`; a token and the mark that follows it are eight bytes, filled up by zeros."""

    def __init__(self, ids_a: int, ids_b: int):
        # Ids below 10 million; those of tokens that end their side of a group come after the others.
        table = lambda n, marks: np.array([f"{i}{mark}" for mark in marks for i in range(n)], "S8").view(np.uint64)
        self.a, self.b = table(ids_a, ",|"), table(ids_b, ",;")

    def __call__(self, a: np.ndarray, b: np.ndarray, found: Alignment) -> np.ndarray:
        """The tokens of all texts in this order."""
        out = np.empty(len(a) + len(b), np.uint64)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[found.group_a - 1] = last_b[found.group_b - 1] = True
        # A token stands after the other list's tokens of the groups before, and one of B also after A's of its own.
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        out[np.arange(len(a)) + np.concatenate([[0], found.group_b])[group_a]] = self.a[a + last_a * (len(self.a) // 2)]
        out[np.arange(len(b)) + found.group_a[group_b]] = self.b[b + last_b * (len(self.b) // 2)]
        return out
