"""Sharding against exact cumulative sizes, with hot groups, odd rows and small tables."""

import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sigweave.llm import sharding
from sigweave.llm.queries import op11_sharding

DOCS = "doc_id long, text string, lang string"


def rows_of(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def checked(got, rows, shards, tolerance):
    """Whole, gapless, and every boundary as near as tolerance and the largest row allow."""
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values()) and set(by) <= set(range(shards))
    total, largest, below = sum(r.size for r in got), max(r.size for r in got), 0
    for s in range(shards - 1):
        below += sum(r.size for r in by[s])
        assert abs(below - total * (s + 1) / shards) <= max(tolerance * total / shards, largest / 2) + 1
    return by


def corpus(n=600, hot=200, seed=3):
    r = random.Random(seed)
    rows = [(i, "".join(r.choice("abcdé ") for _ in range(int(3000 * r.random() ** 4))), "en") for i in range(n)]
    return rows + [(n + i, "the same long text " * 20, "en") for i in range(hot)]


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_equal_bytes(spark, shards):
    rows = corpus()
    got = sharding.digests(sharding.shard(rows_of(spark, rows).repartition(5), shards)).collect()
    by = checked(got, rows, shards, 0.005)
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    split = [c for c, n in collections.Counter(c for rs in by.values() for c in {r.text_crc32 for r in rs}).items() if n > 1]
    assert len(split) <= shards - 1  # only what lies across a boundary


def test_order_and_groups(spark):
    """A group within the tolerance is never cut, and slots go on where the text's key does."""
    rows = [(i, f"text {i // 4} " * 5, "en") for i in range(800)]
    got = sharding.shard(rows_of(spark, rows), 4, tolerance=0.05).collect()
    of = collections.defaultdict(set)
    for r in got:
        of[r.text].add(r.shard)
    assert all(len(s) == 1 for s in of.values())
    for s in range(4):
        texts = [r.text for r in sorted((r for r in got if r.shard == s), key=lambda r: r.slot)]
        assert sum(a != b for a, b in zip(texts, texts[1:])) == len(set(texts)) - 1


def test_rows_that_are_equal_throughout(spark):
    rows = [(7, "one and the same", "en")] * 500 + [(None, None, None)] * 100 + [(1, "", "x")] * 3
    checked(sharding.digests(sharding.shard(rows_of(spark, rows).repartition(3), 6)).collect(), rows, 6, 0.005)


def test_odd_input(spark):
    rows = [(i, t, None) for i, t in enumerate([None, "", " ", "x" * 300_000, "ünï", "\x00"])] + [(None, "no id", "en")]
    docs = rows_of(spark, rows).withColumn("SIZE", F.lit("mine")).withColumn("shard", F.lit(3)).withColumn("slot", F.lit(None).cast("string"))
    got = sharding.shard(docs, 3)
    assert sorted(got.columns) == sorted(["doc_id", "text", "lang", "size", "shard", "slot"])
    checked(sharding.digests(got).collect(), rows, 3, 0.005)
    assert sharding.shard(rows_of(spark, []), 3).count() == 0


def test_splitters_are_exact(spark):
    rows = sharding.keyed(rows_of(spark, corpus(seed=9)), id_col="doc_id", text_col="text")
    keys, below, rounds = sharding.splitters(rows, 5, 3, 0.001)
    held = sorted((bytes(r._sw_key), r._sw_size) for r in rows.select("_sw_key", "_sw_size").collect())
    assert len(keys) == 14 and keys == sorted(keys) and rounds < 12
    assert below == [(sum(n for k, n in held if k < key), sum(k < key for k, _ in held)) for key in keys]


def test_written_shards(spark, tmp_path):
    sharding.write(sharding.shard(rows_of(spark, corpus(100, 30)), 4), f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == 130 and {r.shard for r in got.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_query(spark):
    got = op11_sharding(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    checked(got.collect(), rows, 40, 0.005)
