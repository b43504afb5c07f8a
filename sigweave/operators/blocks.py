"""Sums over blocks of places of long records, whose pieces come as rows.

A task sums the blocks that lie whole in one of its pieces by itself, so their k-mers are never rows. Of a block that
several pieces share each sends its distinct k-mers, packed; those of a record's pieces are few beside the record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.functions.seq import letters_of
from sigweave.operators.kmers import LONGEST_LONG, PIECE, Windows, kmers

#: Places of a block up to which the k-mers that pieces share are put together in one row; those of larger ones are rows.
MOST_PLACES = 1 << 20
_SUMS = ["kmers", "places", "least", "most", "distinct"]


def block_sums(pieces: DataFrame, k: int, size: int, *, keep: list[str], most: int = MOST_PLACES, piece: int = PIECE) -> DataFrame:
    """(keep, block, kmers, places, least, most, distinct): the k-mers of each block of `size` places of a record.

    pieces: keep, which tells records apart, start and seq, as `sequences.contigs` gives them: each with the k - 1 letters that follow, so
    that every place is in one piece. kmers, places: the number of k-mers, and the sum of their places. Blocks without k-mers have no row.
    """
    if size < 1:
        raise ValueError("size must be positive")
    if size > most or k > LONGEST_LONG:
        found = kmers(pieces, k, keep=[*keep, "start"]).withColumn("_at", F.col("start") + F.col("pos")).groupBy(*keep, F.floor(F.col("_at") / size).alias("block"))
        return found.agg(F.count("*").alias("kmers"), F.sum("_at").alias("places"), F.min("kmer").alias("least"), F.max("kmer").alias("most"), F.count_distinct("kmer").alias("distinct"))
    rows = pieces.select(*keep, F.col("start").cast("long").alias("_start"), F.col("seq").alias("_seq"))
    long = T.LongType()
    schema = T.StructType([*rows.schema.fields[:-2], *(T.StructField(c, long) for c in ("block", *_SUMS)), T.StructField("shared", T.ArrayType(long))])
    names, width = schema.names, len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Windows(k, True, True, None, piece)
        for b in batches:
            starts, seqs = b.column(width).to_numpy(), b.column(width + 1)
            ends = starts + np.array([len(s) - k + 1 for s in seqs.fill_null("").cast(pa.binary()).to_pylist()], np.int64)
            out: list[tuple] = []
            for row, block, places, made in _grouped(cutter, seqs, starts, size):
                each = np.unique(made)
                whole = block * size >= starts[row] and (block + 1) * size <= ends[row]
                out.append((row, block, len(made), places, int(each[0]), int(each[-1]), len(each) if whole else 0, None if whole else each))
            if out:
                cols = list(zip(*out, strict=True))
                at = pa.array(cols[0], pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(width)), *(pa.array(c, pa.int64()) for c in cols[1:-1]), pa.array(cols[-1], pa.list_(pa.int64()))], names=names)

    summed = rows.mapInArrow(run, schema).groupBy(*keep, "block").agg(
        F.sum("kmers").alias("kmers"), F.sum("places").alias("places"), F.min("least").alias("least"), F.max("most").alias("most"),
        (F.sum("distinct") + F.size(F.array_distinct(F.flatten(F.collect_list("shared"))))).alias("distinct"),
    )
    return summed.withColumns({c: letters_of(c, k) for c in ("least", "most")})


def _grouped(cutter: Windows, seqs: pa.Array, starts: np.ndarray, size: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(row, block, sum of places, packed k-mers) of every row's blocks that have k-mers, in order."""
    now, places, parts = None, 0, []
    for rows, pos, made in cutter.cut(seqs):
        at = starts[rows] + pos
        block, words = at // size, made.to_numpy()
        cuts = np.flatnonzero((rows[1:] != rows[:-1]) | (block[1:] != block[:-1])) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)], strict=True):
            key = int(rows[i]), int(block[i])
            if key != now:
                if parts:
                    yield *now, places, np.concatenate(parts)
                now, places, parts = key, 0, []
            places += int(at[i:j].sum())
            parts.append(words[i:j])
    if parts:
        yield *now, places, np.concatenate(parts)
