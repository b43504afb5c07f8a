"""Benchmark decontamination with one Aho-Corasick automaton.

Benchmark texts are normalised to words; every window of `window` consecutive words (or all
words of a shorter item) is a pattern. The letters of the automaton are words: the numbers of
the benchmark's distinct words, and 0 for all others. It reads each document once, and its
matches are mapped back to words and to code points of the original text.

Null and empty texts have no words, no hits and no items. Items without words have no
window. Equal windows of several items belong to all of them; repeated items count by id,
null ids not at all. Documents that repeat are scanned each on its own. Words are told apart
by 64-bit hashes.

The automaton is built once, by a task on an executor, kept in the shared folder and
broadcast; a Python worker loads it once. Where a benchmark has more than `most_words` words in
its windows, its windows are dealt by their hash into several automata, which a task loads in turn for
some MB of documents at a time: the same result from bounded memory, and no second pass over the documents.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage, textscan
from .textscan import U64, Index

#: Bytes of documents that several automata read in turn.
TURN_BYTES = 32 << 20


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and spans of a slice's words, and each document's first word."""
    low = textscan.LOWER[buf]
    starts, ends, first = textscan.word_spans(low, offs, textscan.NON_ALNUM)
    return textscan.span_hashes(low, starts, ends), starts, ends, first


class Automaton:
    """Patterns are sequences of word hashes; owners are the items of each."""

    def __init__(self, patterns: dict[bytes, list[str]]):
        items = sorted({i for ids in patterns.values() for i in ids})
        number = {x: k for k, x in enumerate(items)}
        self.items = items
        self.owners = [np.array([number[i] for i in ids], np.int64) for ids in patterns.values()]
        self.size = np.array([len(p) // 8 for p in patterns], np.int64)
        self.words = np.unique(np.frombuffer(b"".join(patterns), U64))
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, p in enumerate(patterns):
            self.auto.add_word(tuple((np.searchsorted(self.words, np.frombuffer(p, U64)) + 1).tolist()), k)
        if len(patterns):
            self.auto.make_automaton()

    def scan(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first word of each match and its pattern. Between documents lies a letter that no pattern has."""
        if not self.owners:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not hasattr(self, "index"):
            self.index = Index(self.words)
        letters = self.index.find(words) + 1
        known = np.flatnonzero(letters)
        # Runs of words that the benchmark does not have are one letter.
        doc = np.searchsorted(first, known, "right")
        apart = np.flatnonzero((np.diff(known) > 1) | (np.diff(doc) > 0)) + 1
        text = np.insert(letters[known], apart, 0)
        place = np.insert(known, apart, -1)
        got = np.array([x for m in self.auto.iter(tuple(text.tolist())) for x in m], np.int64).reshape(-1, 2)
        return place[got[:, 0]] - self.size[got[:, 1]] + 1, got[:, 1]


def windows(bench: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(window, item): distinct windows as the bytes of their words' hashes, with their items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, row = b.column(0).to_pylist(), 0
            for _, _, buf, offs in textscan.slices(b.column(1)):
                h, _, _, first = words_of(buf, offs)
                found, owner = [], []
                for k in range(len(offs) - 1):
                    mine = h[first[k] : first[k + 1]]
                    size = min(window, len(mine))
                    some = {mine[i : i + size].tobytes() for i in range(len(mine) - size + 1)} if size else set()
                    found += some
                    owner += [ids[row]] * len(some)
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(owner, pa.string())], names=["window", "item"])

    rows = bench.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null")
    return rows.mapInArrow(storage.lean_batches(run), "window binary, item string").distinct()


def automata(bench: DataFrame, id_col: str, text_col: str, window: int, most_words: int) -> Iterator[bytes]:
    """Pickled automata, one at least, each built by one task from windows of about most_words words at most."""
    found = storage.written(windows(bench, id_col, text_col, window).groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items")), "windows")
    parts = (found.agg(F.sum(F.octet_length("window"))).first()[0] or 0) // (8 * most_words) + 1

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("window")
        return pa.table({"automaton": pa.array([pickle.dumps(Automaton(dict(zip(t.column("window").to_pylist(), t.column("items").to_pylist(), strict=True))))], pa.binary())})

    kept = storage.written(found.withColumn("_part", F.pmod(F.xxhash64("window"), F.lit(parts))).groupBy("_part").applyInArrow(storage.lean(build), "automaton binary"), "automata")
    none = True
    for r in kept.toLocalIterator():
        none = False
        yield bytes(r["automaton"])
    if none:
        yield pickle.dumps(Automaton({}))


_loaded: dict[str, Automaton] = {}


def _load(sent) -> Automaton:
    """The automaton of a broadcast; a worker keeps the last one."""
    if sent.key not in _loaded:
        _loaded.clear()
        _loaded[sent.key] = pickle.loads(storage.taken(sent.data))
    return _loaded[sent.key]


class _Sent:
    """A broadcast with a key of its own."""

    def __init__(self, spark: SparkSession, key: str, data: bytes):
        self.key, self.data = key, spark.sparkContext.broadcast(data)


def hits(found: Iterator[Automaton], words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[set[str]]]:
    """Whether each word is hit by a pattern of any of the automata, and the items of each document."""
    edge = np.zeros(len(words) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(len(first) - 1)]
    for a in found:
        word, pattern = a.scan(words, first)
        np.add.at(edge, word, 1)
        np.add.at(edge, word + a.size[pattern], -1)
        doc = np.searchsorted(first, word, "right") - 1
        for d, p in np.unique(np.column_stack([doc, pattern]), axis=0):
            items[d].update(a.items[i] for i in a.owners[p])
    return np.cumsum(edge[:-1]) > 0, items


_NEW = [
    ("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items", T.ArrayType(T.StringType())), ("items_sha256", T.StringType()),
    ("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), ("contaminated", T.BooleanType()),
]


def scan(docs: DataFrame, bench: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: tuple[int, int] = (1, 20), most_words: int = 3_000_000) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (sorted ids), items_sha256, hit_spans (code points of the text) and contaminated.

    share: a document is contaminated when it is hit and n_hit / n_words is at least this fraction.
    most_words: words in the windows of one automaton; a million take some 100 MB of a worker.
    """
    spark, place = docs.sparkSession, docs.columns.index(text_col)
    sent = [_Sent(spark, hashlib.sha256(x).hexdigest(), x) for x in automata(bench, item_col, item_text_col, window, most_words)]
    slice_bytes = textscan.SLICE_BYTES if len(sent) == 1 else TURN_BYTES

    def start() -> object:
        def run(b: pa.RecordBatch) -> list:
            out: list[list] = [[] for _ in _NEW]
            for _, _, buf, offs in textscan.slices(b.column(place), slice_bytes):
                h, starts, ends, first = words_of(buf, offs)
                hit, found = hits((_load(x) for x in sent), h, first)
                for k in range(len(offs) - 1):
                    mine, own = hit[first[k] : first[k + 1]], found[k]
                    spans = []
                    if mine.any():
                        chars = textscan.char_offsets(buf[offs[k] : offs[k + 1]].tobytes())
                        change = np.diff(np.concatenate([[0], mine.view(np.int8), [0]]))
                        s, e = starts[first[k] : first[k + 1]] - offs[k], ends[first[k] : first[k + 1]] - offs[k]
                        spans = [{"start": int(chars[s[x]]), "end": int(chars[e[y - 1]])} for x, y in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1), strict=True)]
                    n, n_hit, ids = len(mine), int(mine.sum()), sorted(own)
                    made = (n, n_hit, len(ids), ids, hashlib.sha256(",".join(ids).encode()).hexdigest(), spans, n_hit > 0 and share[1] * n_hit >= share[0] * n)
                    for column, x in zip(out, made, strict=True):
                        column.append(x)
            return out

        return run

    return storage.map_columns(docs, _NEW, start)
