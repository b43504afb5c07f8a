"""Pairwise containment of k-mers between two lists of references.

Occurrences are summed by reference and k-mer, and dealt out and sorted by k-mer. A task then multiplies
blocks of the sparse matrices (probe x k-mer, counts) and (k-mer x filter, 0 or 1): k-mers that few
references hold as lists of pairs of entries, those that many hold as dense matrices. The sums are one
matrix of probes x filters a task, of which the cells that are not zero leave the task. Packed k-mers of numbered references are dealt out
as sorted lists instead of rows (`packs`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigweave.functions.seq import similarity_of
from sigweave.operators import packs
from sigweave.sources.shared import stored

#: Rows (k-mer, reference) that a task multiplies at a time; entries of a dense block and cells of sums, at most.
BLOCK, DENSE, CELLS = 1 << 17, 1 << 22, 1 << 22


def _groups(kmer: pa.Array) -> np.ndarray:
    """The number of each row's k-mer among those of a sorted column, from 0."""
    if len(kmer) < 2:
        return np.zeros(len(kmer), np.int64)
    return np.concatenate([[0], np.cumsum(pc.not_equal(kmer.slice(1), kmer.slice(0, len(kmer) - 1)).to_numpy(zero_copy_only=False))])


class Products:
    """Sums of probe counts over k-mers that a filter has too, by cell (probe * filters + filter)."""

    def __init__(self, probes: int, filters: int):
        self.shape, self.cells, self.more = (probes, filters), np.zeros(probes * filters if probes * filters <= CELLS else 0, np.int64), []

    def _add(self, cell: np.ndarray, n: np.ndarray) -> None:
        if len(self.cells):
            np.add.at(self.cells, cell, n)
        elif len(cell):
            keys, at = np.unique(cell, return_inverse=True)
            self.more.append((keys, np.bincount(at, n, len(keys)).astype(np.int64)))

    def add(self, group: np.ndarray, probe: np.ndarray, filter_: np.ndarray, n: np.ndarray) -> None:
        """Rows in the order of their groups (k-mers); probe or filter_ is -1 where the row is none."""
        p, f, groups = np.flatnonzero(probe >= 0), np.flatnonzero(filter_ >= 0), int(group[-1]) + 1 if len(group) else 0
        n_p, n_f = np.bincount(group[p], minlength=groups), np.bincount(group[f], minlength=groups)
        wide = (n_p * n_f > 64) & (n_p * n_f * 32 > self.shape[0] * self.shape[1])
        chosen = np.flatnonzero(wide)
        step = max(1, DENSE // max(self.shape))
        for at in range(0, len(chosen), step):
            of = np.full(groups, -1)
            of[chosen[at : at + step]] = np.arange(len(chosen[at : at + step]))
            a, b = np.zeros((len(chosen[at : at + step]), self.shape[0])), np.zeros((len(chosen[at : at + step]), self.shape[1]))
            rows = p[of[group[p]] >= 0]
            a[of[group[rows]], probe[rows]] = n[rows]
            rows = f[of[group[f]] >= 0]
            b[of[group[rows]], filter_[rows]] = 1
            out = (a.T @ b).reshape(-1)  # whole numbers below 2^53
            full = np.flatnonzero(out)
            self._add(full, out[full].astype(np.int64))
        first = np.cumsum(n_f) - n_f
        rows = p[~wide[group[p]]]
        many = n_f[group[rows]]
        for at in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(np.cumsum(many) // DENSE)) + 1):  # DENSE pairs at a time
            m = many[at]
            mate = np.repeat(first[group[rows[at]]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            self._add(np.repeat(probe[rows[at]], m) * self.shape[1] + filter_[f[mate]], np.repeat(n[rows[at]], m))

    def taken(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        full = np.flatnonzero(self.cells)
        yield full, self.cells[full]
        yield from self.more


def _matched(each: DataFrame, probes: list, filters: list, block: int) -> DataFrame:
    """(cell, n) from rows (kmer, ref1, ref2, n)."""
    kinds = [each.schema[c].dataType for c in ("ref1", "ref2")]
    from pyspark.sql.pandas.types import to_arrow_type

    sent = each.sparkSession.sparkContext.broadcast([pa.array(names, to_arrow_type(kind)) for names, kind in zip((probes, filters), kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        sums, held, rows = Products(len(known[0]), len(known[1])), [], 0

        def flush(last: bool) -> None:
            nonlocal held, rows
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            group = _groups(t.column(0))
            stop = len(group) if last else int(np.searchsorted(group, group[-1]))  # the last k-mer may go on
            if stop:
                probe, other = (pc.fill_null(pc.index_in(t.column(i + 1), known[i]), -1).to_numpy() for i in (0, 1))
                sums.add(group[:stop], probe[:stop].astype(np.int64), other[:stop].astype(np.int64), t.column(3).to_numpy()[:stop])
            held = [t.slice(stop)] if stop < len(group) else []
            rows = len(group) - stop

        for b in batches:
            if b.num_rows:
                held.append(b)
                rows += b.num_rows
            if rows >= block:
                flush(False)
        if held:
            flush(True)
        for cell, n in sums.taken():
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])

    sorted_ = each.select("kmer", "ref1", "ref2", "n").repartition("kmer").sortWithinPartitions("kmer")
    return sorted_.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("matched"))


def _packed_cells(filters: DataFrame, probes: DataFrame, listed: list[list[int]], k: int, bits: int, block: int) -> DataFrame:
    """(cell, n) of packed k-mers and numbered references, once for each cell; cells beyond probes * filters are the probes' numbers of k-mers."""
    same = filters is probes
    sent = probes.sparkSession.sparkContext.broadcast([np.array(x, np.int64) for x in listed])

    def place(names: np.ndarray, ref: np.ndarray) -> np.ndarray:
        at = np.searchsorted(names, ref)
        return np.where(np.append(names, -1)[at] == ref, at, -1) if len(names) else np.full(len(ref), -1)

    def summed(buckets: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        sums, totals = Products(len(known[0]), len(known[1])), np.zeros(len(known[0]), np.int64)
        for h, ref, n in buckets:
            name = ref if same else ref >> 1
            probe, other = place(known[0], name), place(known[1], name)
            if not same:  # a number's lowest bit tells the side
                probe, other = np.where(ref & 1, probe, -1), np.where(ref & 1, -1, other)
            mine = probe >= 0
            totals += np.bincount(probe[mine], n[mine], len(totals)).astype(np.int64)
            first = packs.firsts(h)
            group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
            at = 0
            while at < len(h):
                stop = int(first[group[at + block]]) if at + block < len(h) else len(h)
                stop = stop if stop > at else int(np.append(first, len(h))[group[at] + 1])
                sums.add(group[at:stop] - group[at], probe[at:stop], other[at:stop], n[at:stop])
                at = stop
        for cell, n in sums.taken():
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], names=["cell", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(totals)) + len(known[0]) * len(known[1])), pa.array(totals)], names=["cell", "n"])

    sided = lambda df, side: df.select("kmer", (F.col("ref").cast("long") * 2 + side).alias("ref"))
    occurrences = probes.select("kmer", "ref") if same else sided(probes, 1).unionByName(sided(filters, 0))
    return stored(packs.by_bucket(occurrences, k, bits, summed, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("matched")), "cells")


def similarity(filters: DataFrame, probes: DataFrame, filter_refs: DataFrame, probe_refs: DataFrame, *, block: int = BLOCK, packed: tuple[int, int] | None = None) -> DataFrame:
    """(ref1, ref2, uniq_ref1, all_ref1, similarity) for every pair of a probe (ref1) and a filter (ref2).

    filters, probes: occurrences (ref, kmer); filter_refs, probe_refs: all names (ref), so that
    references without k-mers and pairs without common ones have their rows. Counts are of the
    probe's occurrences: all, and those absent from the filter. An empty probe gives NaN.
    K-mers may be packed and names be numbers, which is faster. The result has a row for each pair of names by
    definition; the names, and nothing else, pass the driver. Null names have no rows.
    packed: k and `packs.bucket_bits`, where k-mers are packed longs and names whole numbers from 0: k-mers are then dealt out once, as sorted lists.
    """
    if packed:
        each = None
    elif filters is probes:
        each = probes.groupBy("kmer", "ref").agg(F.count("*").alias("n")).select("kmer", F.col("ref").alias("ref1"), F.col("ref").alias("ref2"), "n")
    else:
        none = F.lit(None)
        one = filters.select("kmer", none.alias("ref1"), F.col("ref").alias("ref2"))
        two = probes.select("kmer", F.col("ref").alias("ref1"), none.alias("ref2"))
        each = two.unionByName(one).groupBy("kmer", "ref1", "ref2").agg(F.count("*").alias("n"))
    lists = [[r["ref"] for r in refs.select("ref").distinct().where("ref IS NOT NULL").orderBy("ref").collect()] for refs in (probe_refs, filter_refs)]
    spark = probes.sparkSession
    one, two = (spark.createDataFrame([(i, x) for i, x in enumerate(names)], refs.select(F.lit(0).cast("long").alias(at), F.col("ref").alias(to)).schema) for names, refs, at, to in zip(lists, (probe_refs, filter_refs), ("_i", "_j"), ("ref1", "ref2"), strict=True))
    if packed:
        cells = _packed_cells(filters, probes, lists, *packed, block)
        size = len(lists[0]) * len(lists[1])
        totals = one.join(cells.where(F.col("cell") >= size).withColumn("_i", F.col("cell") - size), "_i").select("ref1", F.col("matched").alias("all"))
    else:
        cells = _matched(each, *lists, block)
        totals = probes.groupBy(F.col("ref").alias("ref1")).agg(F.count("*").alias("all"))
    pairs = one.join(totals, "ref1", "left").crossJoin(two).withColumn("cell", F.col("_i") * len(lists[1]) + F.col("_j"))
    full = pairs.join(cells, "cell", "left").na.fill(0, ["all", "matched"])
    return full.select("ref1", "ref2", (F.col("all") - F.col("matched")).alias("uniq_ref1"), F.col("all").alias("all_ref1"), similarity_of(F.col("matched"), F.col("all")).alias("similarity"))
