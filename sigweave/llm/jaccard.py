"""N-gram Jaccard join: T-occurrence search over inverted lists by DivideSkip.

A document's set holds the 64-bit hashes of its distinct word shingles. Documents with
equal sets form one class; classes are then joined:

1. Let p(n) = n - ceil(t * n) + 1. Two sets of similarity t or more share p(m) of their
   2 * p - 1 smallest hashes each, m being the smaller size. Only these are exchanged, by
   hash, one copy of a class from each task. A hash's classes, by size, are cut where the next
   is too large to link, and the smallest number in each run leads it. Runs of one class are
   dropped, and with them the classes that keep too few to have a partner. Of the others' runs the
   rarest count, so many that partners still share one (the prefix filter). They tie a
   class to their leaders, each once: linear in the classes, no pairs.
2. The components of the ties are clusters, without leaders that cannot have a partner
   themselves; classes that link are in one cluster.
3. Clusters go to tasks, small ones many to a task, large ones cut into blocks, whose components
   meet by representatives first and block by block only where several are left. A task builds inverted lists over its sets and searches them once for every set:
   the short lists are merged and counted, the long ones are probed by binary search for
   the candidates that can still reach the required overlap. Candidates that are already in
   the set's component are skipped, as their links change no component.
4. The components of the links are the result.

Nulls, empty texts and texts without words have an empty set (0 shingles) and link with
nothing. Rows that repeat are in one class. A row with a null id links with nothing and has
a null component. Ids must be integers; of an id with several texts each text is a class of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage, textscan
from .components import components
from .textscan import U64

#: Hashes a bucket of step 1 and shingles a task of step 3 hold, about; hashes a message is made from.
BUCKET, TASK, CHUNK = 600_000, 250_000, 400_000
#: Rounds in which representatives of a large cluster's components meet before its blocks do.
ROUNDS = 3
#: Bytes up to which step 3 broadcasts the classes of clusters to the documents, and what a class takes; above, both are shuffled.
BROADCAST_BYTES, ACTIVE_BYTES = 96 << 20, 96


def least_overlap(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """The overlap that a set of n needs with any set."""
    return -(-percent * n // 100)


def shingle_sets(buf: np.ndarray, offs: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a slice."""
    low = textscan.LOWER[buf]
    starts, ends, first = textscan.word_spans(low, offs, textscan.BLANKS)
    h = textscan.span_hashes(low, starts, ends)
    full = textscan.chain(h[: max(0, len(h) - size + 1)] + U64(size), *(h[k : len(h) - size + 1 + k] for k in range(1, size))) if len(h) >= size else h[:0]
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            out.append(textscan.chain(h[a : a + 1] + U64(b - a), *(h[k : k + 1] for k in range(a + 1, b))))
        else:
            out.append(h[:0])
    return out


def key_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class _Groups:
    """Labels of merged groups; the smaller group takes the label of the larger."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members: dict[int, list[int]] = {}

    def join(self, a: int, b: int) -> None:
        x, y = int(self.label[a]), int(self.label[b])
        if x != y:
            p, q = self.members.pop(x, [x]), self.members.pop(y, [y])
            if len(p) < len(q):
                x, p, q = y, q, p
            self.label[q] = x
            p += q
            self.members[x] = p


def divide_skip(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join all sets of similarity percent / 100 or more into their components.

    side: if given, only links between sets of different sides count.
    """
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    nd = len(order)
    if nd < 2:
        return []
    n = size[order]
    tokens, token = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    doc = np.repeat(np.arange(nd), n)
    # Inverted lists, one after the other: the places of a list are sorted by document, and documents by size.
    postings = token.astype(np.int64) * nd + doc
    arranged = np.argsort(postings, kind="stable")
    own = np.empty(len(postings), np.int64)
    own[arranged] = np.arange(len(postings))
    postings = postings[arranged]
    list_doc = postings % nd
    begin = np.concatenate([[0], np.cumsum(n)])
    lowest = np.searchsorted(n, least_overlap(n, percent))
    groups, links = _Groups(nd), []
    side = None if side is None else side[order]
    for k in range(1, nd):
        lo = int(lowest[k])
        if lo >= k:
            continue
        t, last = token[begin[k] : begin[k + 1]], own[begin[k] : begin[k + 1]]
        start = np.searchsorted(postings, t * nd + lo)
        length = last - start
        some = length > 0
        need = int(-(-percent * (n[k] + n[lo]) // (100 + percent)))
        if int(some.sum()) < need:
            continue
        t, start, length = t[some], start[some], length[some]
        by = np.argsort(length, kind="stable")
        n_long = min(need - 1, int(need / (0.0085 * np.log2(max(2, int(length.max()))) + 1)))
        short, long = by[: len(by) - n_long], t[by[len(by) - n_long :]]
        found, times = np.unique(list_doc[textscan.ranges(start[short], length[short])], return_counts=True)
        wanted = -(-percent * (n[k] + n[found]) // (100 + percent))
        keep = (times + n_long >= wanted) & (groups.label[found] != groups.label[k])
        if side is not None:
            keep &= side[found] != side[k]
        found, times, wanted = found[keep], times[keep], wanted[keep]
        by = np.argsort(-times, kind="stable")
        found, times, wanted, step = found[by], times[by], wanted[by], 1
        while len(found):
            some, count = found[:step], times[:step].copy()
            if len(long):
                keys = long[None, :] * nd + some[:, None]
                at = np.searchsorted(postings, keys)
                count += (postings[np.minimum(at, len(postings) - 1)] == keys).sum(1)
            for d in some[count >= wanted[:step]]:
                if groups.label[d] != groups.label[k]:
                    groups.join(int(d), k)
                    links.append((int(order[d]), int(order[k])))
            rest = np.flatnonzero(groups.label[found[step:]] != groups.label[k]) + step
            found, times, wanted, step = found[rest], times[rest], wanted[rest], min(64, step * 4)
    return links


def _n_prefix(n: int, percent: int) -> int:
    """p(n): a partner of a set of n lacks at most p(n) - 1 of its hashes."""
    return n - least_overlap(n, percent) + 1


def _class_number(key: bytes, part: int) -> int:
    return int.from_bytes(key[8 * part : 8 * part + 8], "little", signed=True)


def _scan(rows: DataFrame, size: int, text_col: str, keep: list[str]) -> DataFrame:
    """The columns to keep with the size and the key of the set of each text."""
    place = rows.columns.index(text_col)

    def start() -> object:
        def run(b: pa.RecordBatch) -> list:
            n, key = [], []
            for _, _, buf, offs in textscan.slices(b.column(place)):
                for s in shingle_sets(buf, offs, size):
                    n.append(len(s))
                    key.append(key_of(s) if len(s) else None)
            return [n, key]

        return run

    return storage.map_columns(rows, [("_n", T.LongType()), ("_key", T.BinaryType())], start, keep=keep)


_PACKED = "bucket long, kids binary, ns binary, counts binary, hashes binary, df binary"


def _pack(bucket: np.ndarray, kid: np.ndarray, n: np.ndarray, h: np.ndarray, df: np.ndarray, six: bool) -> pa.Table:
    """One row a bucket: its classes, each with its size and how many hashes follow; the hashes (six bytes, or eight); their document frequencies."""
    by = np.lexsort((kid, bucket))
    bucket, kid, n, h, df = bucket[by], kid[by], n[by], h[by], df[by]
    run = np.flatnonzero(np.concatenate([[True], (kid[1:] != kid[:-1]) | (bucket[1:] != bucket[:-1])])) if len(kid) else np.zeros(0, np.int64)
    length = np.diff(np.append(run, len(kid))).astype("<u4")
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cut, len(bucket))[1:]
    first = np.append(np.searchsorted(run, cut), len(run))
    raw = [h[i:j].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes() if six else h[i:j].tobytes() for i, j in zip(cut, ends, strict=True)]
    parts = [slice(x, y) for x, y in zip(first[:-1], first[1:], strict=True)]
    return pa.table({
        "bucket": pa.array(bucket[cut]), "kids": pa.array([kid[run[p]].tobytes() for p in parts], pa.binary()), "ns": pa.array([n[run[p]].astype("<u4").tobytes() for p in parts], pa.binary()),
        "counts": pa.array([length[p].tobytes() for p in parts], pa.binary()), "hashes": pa.array(raw, pa.binary()), "df": pa.array([df[i:j].astype("<u4").tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary()),
    })


def _unpack(t: pa.Table, six: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class, its size, hash and document frequency of every hash."""
    joined = lambda c, kind: np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
    count = joined("counts", "<u4")
    h = joined("hashes", np.uint8)
    if six:
        wide = np.zeros((len(h) // 6, 8), np.uint8)
        wide[:, 2:] = h.reshape(-1, 6)
        h = wide
    return np.repeat(joined("kids", np.int64), count), np.repeat(joined("ns", "<u4"), count), h.reshape(-1).view("<u8"), joined("df", "<u4")


def _ties(rows: DataFrame, size: int, percent: int, buckets: int, part: int) -> DataFrame:
    """(a, b): the leaders a of each class b that may have a partner, every pair once. Classes that link share a leader; a leader may be its own, or no b at all."""

    def deal(batches):
        seen, parts, kids, ns = set(), [], [], []
        total = 0

        def message():
            n = np.array([len(x) for x in parts])
            h = np.concatenate(parts)
            return _pack((h % U64(buckets)).astype(np.int64), np.repeat(np.array(kids, np.int64), n), np.repeat(np.array(ns), n), h, np.zeros(len(h), np.int64), True)

        for b in batches:
            for _, _, buf, offs in textscan.slices(b.column(1)):
                for s in shingle_sets(buf, offs, size):
                    if not len(s) or (key := key_of(s)) in seen:
                        continue
                    seen.add(key)
                    parts.append(s[: 2 * _n_prefix(len(s), percent) - 1])
                    kids.append(_class_number(key, part))
                    ns.append(len(s))
                    total += len(parts[-1])
                    if total > CHUNK:
                        yield from message().to_batches()
                        parts, kids, ns, total = [], [], [], 0
        if parts:
            yield from message().to_batches()

    def shared(t: pa.Table) -> pa.Table:
        """By class, the leader of each hash that several classes of sizes that may link hold: the smallest of those classes."""
        kid, n, h, _ = _unpack(t, True)
        n = n.astype(np.int64)
        by = np.lexsort((kid, n, h))
        kid, n, h = kid[by], n[by], h[by]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (kid[1:] != kid[:-1])])
        kid, n, h = kid[new], n[new], h[new]
        # A hash's classes by size: where the next is too large for a link, another run begins.
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (100 * n[:-1] < percent * n[1:])]))
        df = np.diff(np.append(first, len(h)))
        leader, df = np.repeat(np.minimum.reduceat(kid, first), df), np.repeat(df, df)
        some = df > 1
        return _pack(np.mod(kid[some], buckets), kid[some], n[some], leader[some], df[some], False)

    def choose(t: pa.Table) -> pa.Table:
        """Of each class that can have a partner, the leaders of its rarest hashes, each once."""
        kid, n, leader, df = _unpack(t, False)
        leader = leader.view("<i8")
        by = np.lexsort((leader, df, kid))
        kid, n, leader = kid[by], n[by].astype(np.int64), leader[by]
        first = np.flatnonzero(np.concatenate([[True], kid[1:] != kid[:-1]])) if len(kid) else np.zeros(0, np.int64)
        held = np.diff(np.append(first, len(kid)))
        least = least_overlap(n[first], percent)  # of a partner's size
        must = least - least_overlap(least, percent) + 1
        keep = textscan.ranges(first, np.where(held >= must, held - must + 1, 0))
        pairs = np.unique(np.column_stack([leader[keep], kid[keep]]), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    out = rows.mapInArrow(storage.lean_batches(deal), _PACKED)
    out = out.groupBy("bucket").applyInArrow(storage.lean(shared), _PACKED)
    return out.groupBy("bucket").applyInArrow(storage.lean(choose), "a long, b long")


def _numbered(scan: DataFrame) -> tuple[DataFrame, int]:
    """Classes (_key, rep, n, rows, kid), and the part of their keys that numbers them: one in which no two agree."""
    found = scan.where("_key is not null").groupBy("_key").agg(F.min("_id").alias("rep"), F.first("_n").alias("n"), F.count("*").alias("rows"))
    for part in (0, 1):

        def start(part: int = part) -> object:
            return lambda b: [[_class_number(k, part) for k in b.column(0).to_pylist()]]

        classes = storage.written(storage.map_columns(found, [("kid", T.LongType())], start), "classes")
        if not classes.groupBy("kid").agg(F.count("*").alias("c")).where("c > 1").limit(1).count():
            return classes, part
    raise ValueError("two different sets have keys that agree in both parts")


def _links_of_large(large: DataFrame, searched) -> DataFrame:
    """Links that join the classes of large clusters into their components.

    A cluster's classes are dealt into blocks, and each block is searched on its own. Then one class
    of every component found so far stands for it, and the representatives are searched in the
    same way: near copies of one text become one component without meeting two by two. Only
    clusters that still have several components have their blocks meet, for links between
    different components.
    """
    names = large.select("_kid", "_cluster", "n").distinct()
    links = storage.written(searched(large.withColumn("_part", F.pmod(F.xxhash64("_kid"), F.col("parts"))), "_cluster", "_part"), "links")

    def labels() -> DataFrame:
        joined = components(links, "a", "b").select(F.col("node").alias("_kid"), F.col("component").alias("_label"))
        return storage.written(names.join(joined, "_kid", "left").withColumn("_label", F.coalesce("_label", "_kid")), "labels")

    label = labels()
    for turn in range(ROUNDS):
        one = label.groupBy("_cluster", "_label").agg(F.min(F.struct("n", "_kid")).alias("_one")).select("_cluster", F.col("_one._kid").alias("_kid"), F.col("_one.n").alias("n"))
        open_ = one.groupBy("_cluster").agg(F.count("*").alias("_c"), F.ceil(F.sum("n") / TASK).alias("_parts")).where("_c > 1")
        meeting = one.join(open_, "_cluster").select("_kid", F.pmod(F.xxhash64("_kid", F.lit(turn + 1)), F.col("_parts")).alias("_part"))
        links = storage.written(links.unionByName(searched(large.join(meeting, "_kid"), "_cluster", "_part")), "links")
        before, label = label, labels()
        if label.select("_label").distinct().count() == before.select("_label").distinct().count():
            break
    open_ = label.groupBy("_cluster").agg(F.count_distinct("_label").alias("_c")).where("_c > 1").select("_cluster")
    left = large.join(label.select("_kid", "_label"), "_kid").join(open_, "_cluster")
    part = F.pmod(F.xxhash64("_kid"), F.col("parts"))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: F.struct(F.least(part, x).alias("i"), F.greatest(part, x).alias("j")))
    left = left.withColumn("_meet", F.explode(met)).where("_meet.i < _meet.j").withColumns({"_i": F.col("_meet.i"), "_j": F.col("_meet.j")}).drop("_meet")
    return links.unionByName(searched(left, "_cluster", "_i", "_j"))


def _linked(rows: DataFrame, scan: DataFrame, words: int, percent: int) -> DataFrame:
    """(_key, rep, rows, component) of every class that has several rows or a link; component: the smallest rep, first: whether the class is the one with it."""
    spark = rows.sparkSession
    classes, part = _numbered(scan)
    shuffles = storage.n_partitions(spark)
    hashes = (classes.agg(F.sum("n")).first()[0] or 0) // 2
    buckets = max(shuffles, hashes // BUCKET)
    ties = storage.written(_ties(rows.where("_id is not null"), words, percent, buckets, part), "ties")
    may_link = ties.select(F.col("b").alias("node")).distinct()
    clusters = storage.written(components(ties, "a", "b").join(may_link, "node", "left_semi"), "clusters")

    known = clusters.join(classes.select(F.col("kid").alias("node"), "rep", "_key", "n"), "node")
    sizes = known.groupBy("component").agg(F.sum("n").alias("total"), F.count("*").alias("c")).where("c > 1")
    cut = storage.written(sizes.select("component", F.ceil(F.col("total") / TASK).alias("parts"), "total"), "sizes")
    seen = clusters.count()
    total = cut.agg(F.sum("total")).first()[0] or 0
    tasks = max(shuffles * 2, int(total) // TASK + 1)
    active = known.join(cut, "component").select(F.col("rep").alias("_id"), "_key", F.col("node").alias("_kid"), "n", F.col("component").alias("_cluster"), "parts")
    active = rows.where("_id is not null").join(F.broadcast(active) if seen * ACTIVE_BYTES <= BROADCAST_BYTES else active, "_id").drop("_id")

    def search(t: pa.Table) -> pa.Table:
        kids, keys = t.column("_kid").to_numpy(), t.column("_key").to_pylist()
        sets: list[np.ndarray] = []
        for _, _, buf, offs in textscan.slices(t.column("_text")):
            sets += shingle_sets(buf, offs, words)
        first = {}
        for k, s in enumerate(sets):  # an id may have several texts; a class is the text that has its key
            if len(s) and key_of(s) == keys[k]:
                first.setdefault(keys[k], k)
        which = np.array(sorted(first.values()), np.int64)
        side = np.unique(t.column("_label").to_numpy(), return_inverse=True)[1][which] if "_label" in t.column_names else None
        links = divide_skip([sets[k] for k in which], percent, side)
        a = np.array([kids[which[x]] for x, _ in links], np.int64)
        return pa.table({"a": pa.array(a), "b": pa.array(np.array([kids[which[y]] for _, y in links], np.int64))})

    def searched(some: DataFrame, *by: str) -> DataFrame:
        return some.groupBy(*by).applyInArrow(storage.lean(search), "a long, b long")

    links = searched(active.where("parts = 1").withColumn("_bin", F.pmod(F.xxhash64("_cluster"), F.lit(tasks))), "_bin")
    if cut.where("parts > 1").limit(1).count():
        large = storage.written(active.where("parts > 1"), "large")
        links = storage.written(links.unionByName(_links_of_large(large, searched)), "links")
    found = storage.written(components(links, "a", "b"), "components")
    of = classes.select(F.col("kid").alias("node"), "rep", "_key")
    least = found.join(of, "node").groupBy("component").agg(F.min(F.struct("rep", "_key")).alias("_least"))
    labelled = classes.withColumnRenamed("kid", "node").join(found, "node", "left").where("rows > 1 or component is not null").join(least, "component", "left")
    return labelled.select("_key", "rep", "rows", F.coalesce("_least.rep", "rep").alias("component"), (F.coalesce("_least._key", "_key") == F.col("_key")).alias("first"))


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of docs."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    scan = storage.written(_scan(rows, words, "_text", ["_id"]), "sets")
    named = _linked(rows, scan, words, percent).select("_key", F.col("component").alias("_component"))
    return scan.join(named, "_key", "left").select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.when(F.col("_id").isNotNull(), F.coalesce("_component", "_id")).alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """The rows of docs without near-duplicates: of each component, one row of the document with the smallest id.

    Decided by row, not by id alone: of rows that repeat one stays, of an id with several texts each text has its own group. Rows
    without an id go if their set is that of a row with an id; of others with equal sets one stays.
    Rows without words stay.
    """
    keyed = storage.written(_scan(docs, words, text_col, docs.columns), "keyed")
    rows = keyed.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    scan = keyed.select(F.col(id_col).cast("long").alias("_id"), "_n", "_key")
    named = storage.written(_linked(rows, scan, words, percent).select("_key", F.col("rep").alias("_rep"), F.col("first").alias("_first")), "groups")
    named = F.broadcast(named) if named.count() * ACTIVE_BYTES <= BROADCAST_BYTES else named
    left = keyed.join(named, "_key", "left").where(F.col("_first").isNull() | (F.col("_first") & F.col(id_col).cast("long").eqNullSafe(F.col("_rep"))))
    # Rows that repeat are few kinds: only those pass an aggregate.
    twice = storage.written(scan.where("_key is not null").groupBy("_id", "_key").agg(F.count("*").alias("_c")).where("_c > 1").select(F.col("_id").alias("_i"), F.col("_key").alias("_k")), "twice")
    if not twice.limit(1).count():
        return left.select(docs.columns)
    same = (F.col("_k") == F.col("_key")) & F.col(id_col).cast("long").eqNullSafe(F.col("_i"))
    once = left.join(twice, same, "left_anti").select(docs.columns)
    return once.unionByName(left.join(twice, same, "left_semi").dropDuplicates([id_col, "_key"]).select(docs.columns))
