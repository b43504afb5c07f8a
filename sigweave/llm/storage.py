"""Intermediate tables in the folder that all executors share, and column helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.sources.shared import new_path, shared_dir  # noqa: F401


def taken(sent: Broadcast) -> object:
    """A broadcast's value, read from the worker's disk each time: the worker does not keep it."""
    value = sent.value
    vars(sent).pop("_value", None)
    return value


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # not glibc
    _trim = None


def trim() -> None:
    """Give freed memory back: Python workers outlive their tasks, and several of them share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(fn: Callable) -> Callable:
    """fn, a function of groups (Arrow tables), with freed memory given back after large ones."""

    def run(*tables: pa.Table) -> pa.Table:
        out = fn(*tables)
        if sum(t.nbytes for t in tables) > 1 << 20:
            trim()
        return out

    return (lambda a: run(a)) if fn.__code__.co_argcount == 1 else lambda a, b: run(a, b)  # Spark counts the arguments


def lean_batches(fn: Callable) -> Callable:
    """fn, a function of Arrow batches, with freed memory given back at the end of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        trim()

    return run


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and kept as a table in the shared folder. It cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_type(t: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def pieces(batches: Iterator[pa.RecordBatch], rows: int | None) -> Iterator[pa.RecordBatch]:
    """The batches, cut into such of `rows` rows at most."""
    for b in batches:
        for k in range(0, b.num_rows, rows or max(1, b.num_rows)):
            yield b.slice(k, rows)


def map_columns(df: DataFrame, add: list[tuple[str, T.DataType]], fn: Callable[[], Callable[[pa.RecordBatch], list]], keep: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """df with columns made by fn from Arrow batches; keep: the input columns that stay (default: all); rows: of a batch, at most.

    fn is called once a partition and gives the function from a batch to the new columns. An input
    column that has the name of a new one is replaced, as by withColumn.
    """
    made = {n.lower() for n, _ in add}
    stay = [f for f in df.schema.fields if f.name.lower() not in made and (keep is None or f.name in keep)]
    schema = T.StructType([*stay, *(T.StructField(n, t) for n, t in add)])
    places, kinds = [df.columns.index(f.name) for f in stay], [arrow_type(t) for _, t in add]
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made_by = None
        for b in pieces(batches, rows):
            made_by = made_by or fn()
            if b.num_rows:
                new = [x if isinstance(x, pa.Array) and x.type == k else pa.array(x, k) for x, k in zip(made_by(b), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in places), *new], names=names)

    return df.mapInArrow(lean_batches(run), schema)


def id_remainder(col: str, mod: int):
    """crc32 of the id as text, modulo mod; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit(""))) % mod


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fitted(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """fit(all rows of a bounded sample), computed in one task on an executor, so that the driver holds the result only."""
    import pickle

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(sample.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            t = pa.Table.from_batches(rows)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(t))], pa.binary())], names=["model"])

    got = sample.repartition(1).mapInArrow(lean_batches(run), "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else fit(schema.empty_table())
