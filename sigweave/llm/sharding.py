"""Shards of equal bytes by histogram sort.

Rows are ordered by a key of 24 bytes: the hash of the text, the hash of the id, and a
number that the stored table gives each row. Equal texts are neighbours in that order, and
no two rows are equal, so a boundary can lie anywhere, inside a group of copies too.

A splitter is the key below which a wanted number of bytes lies. Each round counts the exact
bytes and rows between all candidate keys, in the tasks that hold the rows, and draws some
rows of each open interval with a chance that grows with their size; the drawn keys and the
beginnings and ends of their groups are the next candidates. A splitter is found when a
group's beginning lies within the tolerance, or, where a group is too large for that, a
row's. Splitters between shards are exact to the tolerance; between those, looser ones cut
shards into parts of the size of a task. Rows are then exchanged once, by part, and sorted.
The counts below a part give the place of its first row, so places are gapless without a task that sees a
whole shard.

The driver holds the counts between candidates, of which there are at most some hundreds of
thousands at any size of the corpus; tasks get the candidates (24 bytes each).

A null text has no bytes, and nulls in other columns are kept. Null, empty and repeated rows
are rows as all others. A row larger than the tolerance lies on the side to which the boundary is
nearer. Without rows the result is empty. Input columns that have the name of a result
column are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage
from .textscan import chain, mix

#: Bytes of a part, about; parts of all shards together, at most (beyond, parts grow).
PART_BYTES, MOST_PARTS = 256 << 20, 1 << 16
#: Keys at equal distances, and drawn rows, that a round tries for each open splitter.
GRID, DRAWS = 8, 16
_WIDTH = 24
_LOW, _HIGH = b"", b"\xff" * (_WIDTH + 1)


def _key(*parts: Column) -> Column:
    """A binary column that is ordered as the longs in parts are, one after the other."""
    return F.concat(*(F.unhex(F.lpad(F.hex(p.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")) for p in parts))


def keyed(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """docs with _sw_key and _sw_size, stored: later passes and repeated tasks see the same rows under the same keys."""
    key = _key(F.xxhash64(text_col), F.xxhash64(id_col), F.monotonically_increasing_id())
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 16
    return storage.written(docs.select("*", key.alias("_sw_key"), size.alias("_sw_size")), "sharded")


def _raw(keys: pa.Array) -> np.ndarray:
    """The bytes of a column of keys, a row each."""
    flat = b"".join(keys.to_pylist())
    return np.frombuffer(flat, np.uint8).reshape(-1, _WIDTH)


def _places(raw: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """For each key, the number of candidates that are not above it."""
    return np.searchsorted(candidates, raw.reshape(-1).view(f"S{_WIDTH}"), "right")


def counted(rows: DataFrame, candidates: list[bytes], rates: list[float], seed: int) -> tuple[dict[int, tuple[int, int]], list[bytes]]:
    """(interval -> (bytes, rows), drawn keys). Interval i ends before candidate i; it draws its rows at rates[i] a byte."""
    sent = rows.sparkSession.sparkContext.broadcast((np.array(candidates, f"S{_WIDTH}"), np.array(rates)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cand, rate = storage.taken(sent)
        size, n = np.zeros(len(cand) + 1, np.int64), np.zeros(len(cand) + 1, np.int64)
        drawn: list[bytes] = []
        for b in batches:
            sizes, raw = b.column(0).to_numpy(), _raw(b.column(1))
            at = _places(raw, cand)
            np.add.at(size, at, sizes)
            n += np.bincount(at, minlength=len(n))
            if rate.any():
                words = raw.reshape(-1).view(">u8").reshape(-1, 3).astype(np.uint64)
                u = (chain(mix(words[:, 0] + np.uint64(seed)), words[:, 1], words[:, 2]) >> np.uint64(11)) * 2.0**-53
                drawn += [raw[k].tobytes() for k in np.flatnonzero(u < -np.expm1(-rate[at] * sizes))]
        full = np.flatnonzero(n)
        columns = [np.append(full, np.full(len(drawn), -1)), np.append(size[full], np.zeros(len(drawn), np.int64)), np.append(n[full], np.zeros(len(drawn), np.int64)), pa.array([b""] * len(full) + drawn, pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["at", "size", "n", "key"])

    each = rows.select("_sw_size", "_sw_key").mapInArrow(storage.lean_batches(run), "at long, size long, n long, key binary")
    found = each.groupBy("at", "key").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect()
    sent.destroy()
    return {r["at"]: (r["size"], r["n"]) for r in found if r["at"] >= 0}, sorted(bytes(r["key"]) for r in found if r["at"] < 0)


def _begin(key: bytes, after: int = 0) -> bytes:
    """Where the group of a key begins, or (after=1) the next one."""
    n = int.from_bytes(key[:8].ljust(8, b"\0"), "big") + after
    return _LOW if not n else n.to_bytes(8, "big").ljust(_WIDTH, b"\0") if n < 1 << 64 else _HIGH


def _number(key: bytes) -> int:
    return int.from_bytes(key[:_WIDTH].ljust(_WIDTH, b"\0"), "big") + (key == _HIGH)


class Splitters:
    """Known keys with the exact bytes and rows below them, and which targets are met."""

    def __init__(self, targets: list[int], slack: list[float], total: int, rows: int):
        self.targets, self.slack = targets, slack
        self.below = {_LOW: (0, 0), _HIGH: (total, rows)}
        self._sort()

    def _sort(self) -> None:
        self.keys = sorted(self.below)
        self.sizes = [self.below[k][0] for k in self.keys]
        whole = [k for k in self.keys if k in (_LOW, _HIGH) or not any(k[8:])]
        self.whole, self.whole_sizes = whole, [self.below[k][0] for k in whole]

    def learn(self, candidates: list[bytes], counts: dict[int, tuple[int, int]]) -> None:
        size = n = 0
        for i, key in enumerate(candidates):
            more = counts.get(i, (0, 0))
            size, n = size + more[0], n + more[1]
            self.below[key] = (size, n)
        self._sort()

    def bracket(self, t: int) -> tuple[bytes, bytes]:
        """The last known key with at most targets[t] bytes below it, and the one after."""
        at = min(bisect_right(self.sizes, self.targets[t]), len(self.keys) - 1)
        return self.keys[at - 1], self.keys[at]

    def _near(self, keys: list[bytes], sizes: list[int], t: int) -> tuple[float, bytes]:
        at = bisect_right(sizes, self.targets[t])
        return min((abs(self.below[k][0] - self.targets[t]), k) for k in keys[max(0, at - 1) : at + 1])

    def choice(self, t: int) -> bytes | None:
        """The key for targets[t]; None if a better one may still be found."""
        far, key = self._near(self.whole, self.whole_sizes, t)
        if far <= self.slack[t]:
            return key
        low, high = self.bracket(t)
        if any(k not in self.below for k in self.edges(low, high)):
            return None
        far, key = self._near(self.keys, self.sizes, t)
        one_row = self.below[high][1] - self.below[low][1] <= 1
        in_group = high <= _begin(low, 1)
        return key if one_row or (in_group and far <= self.slack[t]) else None

    @staticmethod
    def edges(low: bytes, high: bytes) -> set[bytes]:
        """The beginnings and ends of the groups in which a bracket begins and ends."""
        return {_begin(low), _begin(low, 1), _begin(high), _begin(high, 1)} if high != _HIGH else {_begin(low), _begin(low, 1)}


def splitters(rows: DataFrame, shards: int, parts: int, tolerance: float) -> tuple[list[bytes], list[tuple[int, int]], int]:
    """(keys, (bytes, rows) below each, rounds) of shards * parts - 1 splitters, of which every parts-th is between shards."""
    total, n = rows.agg(F.coalesce(F.sum("_sw_size"), F.lit(0)), F.count("*")).first()
    k = shards * parts
    found = Splitters([i * total // k for i in range(1, k)], [(tolerance if i % parts == 0 else 0.25 / parts) * total / shards for i in range(1, k)], total, n)
    open_, drawn, rounds = set(range(k - 1)), [], 0
    while open_:
        brackets = Counter(found.bracket(t) for t in open_)
        tried = {x for low, high in brackets for x in found.edges(low, high)}
        for (low, high), targets in brackets.items():
            a, b, steps = _number(low), _number(high), GRID * targets + 1
            tried |= {(a + (b - a) * i // steps).to_bytes(_WIDTH, "big") for i in range(1, steps)}
            mine = drawn[bisect_right(drawn, low) : bisect_left(drawn, high)]
            tried |= {x for key in mine for x in (key, _begin(key), _begin(key, 1))}
        candidates = sorted(x for x in tried if x not in found.below)
        # A bracket of known bytes draws about DRAWS rows for each of its targets.
        spans = sorted((low, high, DRAWS * targets / max(1, found.below[high][0] - found.below[low][0])) for (low, high), targets in brackets.items())
        begins, rates = [s[0] for s in spans], []
        for low in [_LOW, *candidates]:
            at = bisect_right(begins, low) - 1
            rates.append(spans[at][2] if at >= 0 and low < spans[at][1] else 0.0)
        counts, drawn = counted(rows, candidates, rates if rounds else [0.0] * len(rates), rounds)
        found.learn(candidates, counts)
        open_ = {t for t in open_ if found.choice(t) is None}
        rounds += 1
    chosen = [found.choice(t) for t in range(k - 1)]
    return chosen, [found.below[c] for c in chosen], rounds


def shard(docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.005) -> DataFrame:
    """docs with size (bytes of the text and 16), shard and slot (gapless from 0 in each shard).

    tolerance: how far a shard's boundary may lie from where equal shares would have it, as a part of
    a shard's bytes. Groups of equal texts up to that are not cut; a larger one is, where no group begins
    within the tolerance.
    """
    rows = keyed(docs, id_col=id_col, text_col=text_col)
    total = rows.agg(F.coalesce(F.sum("_sw_size"), F.lit(0))).first()[0]
    parts = max(1, min(MOST_PARTS // shards, max(-(-4 * storage.n_partitions(docs.sparkSession) // shards), -(-total // (PART_BYTES * shards)))))
    keys, below, _ = splitters(rows, shards, parts, tolerance)
    first = np.array([0, *(b[1] for b in below)], np.int64)  # rows before each part
    sent = docs.sparkSession.sparkContext.broadcast((np.array([k.ljust(_WIDTH, b"\0") if k != _HIGH else b"\xff" * _WIDTH for k in keys], f"S{_WIDTH}"), first))
    columns = rows.columns

    def start() -> object:
        cuts, rows_before = storage.taken(sent)
        place = columns.index("_sw_key")

        def run(b: pa.RecordBatch) -> list:
            part = _places(_raw(b.column(place)), cuts)
            of = part // parts
            return [pa.array(part), pa.array(of.astype(np.int32)), pa.array(rows_before[part] - rows_before[of * parts])]

        return run

    dealt = storage.map_columns(rows, [("_sw_part", T.LongType()), ("_sw_shard", T.IntegerType()), ("_sw_before", T.LongType())], start)
    local = F.row_number().over(Window.partitionBy("_sw_part").orderBy("_sw_key"))
    made = {"size": F.col("_sw_size"), "shard": F.col("_sw_shard"), "slot": F.col("_sw_before") + local - 1}
    return dealt.select(*(F.col(c) for c in docs.columns if c.lower() not in made), *(v.alias(c) for c, v in made.items()))


def digests(placed: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, size, text_crc32, law, shard, slot, grown_shard."""
    crc = F.crc32(F.encode(F.coalesce(text_col, F.lit("")), "UTF-8"))
    return placed.select(id_col, "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write(placed: DataFrame, path: str) -> None:
    """One folder a shard; a file holds a run of slots."""
    placed.write.partitionBy("shard").parquet(path)
