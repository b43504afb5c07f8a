"""Sums over blocks of places against plain Python."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from sigweave.operators.blocks import block_sums
from sigweave.functions.seq import letters_of


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.mark.parametrize("size,most,piece", [(7, 1 << 20, 5), (50, 1 << 20, 64), (400, 1 << 20, 1 << 16), (10_000, 1 << 20, 9), (50, 10, 64)])
def test_block_sums(spark, size, most, piece):
    r, k = random.Random(size), 5
    rows, want = [], collections.defaultdict(list)
    for record, n in enumerate((0, 3, 5, 380, 1000)):
        text = "".join(r.choices("ACGTN", [9, 9, 9, 9, 1], k=n))
        at = 0
        while at < n:
            own = r.randrange(1, 150)
            rows.append((record, f"c{record}", at, text[at : at + own + k - 1]))
            at += own
        for i in range(n - k + 1):
            if "N" not in text[i : i + k]:
                want[record, f"c{record}", i // size].append((i, min(text[i : i + k], rc(text[i : i + k]))))
    rows.append((9, "none", 0, None))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "record_idx long, contig string, start long, seq string").repartition(3)
    got = block_sums(df, k, size, keep=["record_idx", "contig"], most=most, piece=piece).collect()
    assert {tuple(x) for x in got} == {(*key, len(v), sum(i for i, _ in v), min(m for _, m in v), max(m for _, m in v), len({m for _, m in v})) for key, v in want.items()}
    assert len(got) == len(want)


def test_whole_blocks_are_one_row(spark):
    """Only blocks that pieces share send k-mers: the rows of the exchange do not grow with the letters."""
    text = "".join(random.Random(1).choices("ACGT", k=200_000 + 20))
    pieces = spark.createDataFrame([(0, at, text[at : at + 50_000 + 20]) for at in range(0, 200_000, 50_000)], "record_idx long, start long, seq string")
    sums = block_sums(pieces, 21, 1000, keep=["record_idx"])
    assert sums.count() == 200 and sums.agg(F.sum("kmers")).first()[0] == 200_000
    assert "kmer#" not in sums._jdf.queryExecution().toString()  # no k-mer is a row


def test_letters(spark):
    words = ["ACGTA", "TTTTT", "AAAAA", "GATTC"]
    df = spark.createDataFrame([(i, sum("ACGT".index(c) << 2 * (4 - j) for j, c in enumerate(w))) for i, w in enumerate(words)], "i int, w long")
    assert [r[0] for r in df.orderBy("i").select(letters_of("w", 5)).collect()] == words
