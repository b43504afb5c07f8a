"""Connected components of a graph of long ids, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

#: Edges up to which one task (not the driver) merges them; it holds some tens of MB. Above, steps over all tasks do.
ONE_TASK_EDGES = 200_000


def merged(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges and the smallest node each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = list(range(len(nodes)))
    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        if a != b:
            root[max(a, b)] = min(a, b)
    out = np.array(root, np.int64)
    while len(out) and (out[out] != out).any():
        out = out[out]
    return nodes, nodes[out]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): every node of an edge with the smallest node it reaches.

    Edges with a null end and loops count for nothing. Every step keeps or shortens paths
    and works with one minimum a node, so a hub costs a join that can be split, and no step
    gathers a component. The steps' tables are kept in the shared folder.
    """
    x, y = F.col(a), F.col(b)
    now = storage.written(edges.where(x != y).select(F.greatest(x, y).alias("v"), F.least(x, y).alias("u")).distinct(), "edges")

    def one(batches):
        t = pa.Table.from_batches(list(batches), pa.schema([("v", pa.int64()), ("u", pa.int64())]))
        nodes, least = merged(t.column("u").to_numpy(), t.column("v").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])

    state = None
    while True:
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
        if sign["n"] <= ONE_TASK_EDGES:
            return now.repartition(1).mapInArrow(storage.lean_batches(one), "node long, component long")
        if sign == state:
            break
        state = sign
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u")))
        now = storage.written(small.where("u != v").distinct(), "edges")
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
