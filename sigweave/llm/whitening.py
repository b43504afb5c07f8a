"""Whitening of embeddings by hierarchical merging of singular value decompositions.

Entries become whole numbers first, floor(scale * c) + shift, so sums and distances are exact. The
fit list is each distinct vector once; equal vectors are packed to equal bytes and combined before the
shuffle, so that a vector which many rows share costs a task one row.

A task's state is the number of its vectors, their exact sums, and all singular values and
right vectors of its centred rows. Two states merge by stacking both factors and one row for the
distance of the means, sqrt(n1 n2 / (n1 + n2)) (m1 - m2), and decomposing again: nothing is
truncated, and no covariance is formed, so small directions keep their digits. States merge
sixteen at a time until one is left; a state has d (d + 1) numbers however many rows it
stands for. A second pass over the fit list measures the covariance of the whitened vectors, by
partial means and products that merge likewise.

Rows whose vector is null or has null, NaN or infinite entries are dropped. Ties and
repeated rows are kept and get equal results. Eigenvectors have their largest entry positive. A
component without variance cannot be whitened and is left out, so empty vectors, a single distinct vector and an empty
table give no rows. Vectors of different lengths, or entries beyond 2^40 in size, are an error. A deviation
beyond a long is null. Input columns that have the name of a result column are replaced.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage

#: States that merge in one task.
FAN_IN = 16
#: Entries of the matrix that is decomposed at once, about.
CHUNK = 1 << 21
_MOST = 1 << 40


def grid(vectors: pa.Array, scale: float, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a vector of finite entries, their whole-number entries without the shift, a row each)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    whole = vectors.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.values.slice(vectors.offsets[0].as_py(), int(vectors.offsets[-1].as_py() - vectors.offsets[0].as_py()))
    entries = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    bad = np.flatnonzero(~np.isfinite(entries))
    starts = np.concatenate([[0], np.cumsum(sizes)])
    whole[np.searchsorted(starts, bad, "right") - 1] = False
    kept = np.flatnonzero(whole)
    if not len(kept):
        return kept, np.zeros((0, 0), np.int64)
    d = sizes[kept]
    if (d != d[0]).any():
        raise ValueError(f"vectors of {d.min()} and of {d.max()} entries")
    scaled = np.floor(scale * entries[(starts[kept][:, None] + np.arange(d[0])).reshape(-1)])
    if (np.abs(scaled) >= _MOST).any():
        raise ValueError(f"an entry is beyond {_MOST}")
    return kept, scaled.astype(np.int64).reshape(len(kept), -1)


def pack(x: np.ndarray) -> list[bytes]:
    """Each row as bytes: its width, and its entries in the fewest bytes that hold them; equal rows give equal bytes."""
    most = np.maximum(x.max(1, initial=0), -1 - x.min(1, initial=0))
    width = np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], [1, 2, 4], 8)
    out = [b""] * len(x)
    for w in np.unique(width):
        for k in np.flatnonzero(width == w):
            out[k] = bytes([w]) + x[k].astype(f"<i{w}").tobytes()
    return out


def unpack(rows: list[bytes]) -> np.ndarray:
    x = [np.frombuffer(r, f"<i{r[0]}", offset=1) for r in rows]
    if len({len(r) for r in x}) > 1:
        raise ValueError(f"vectors of {min(map(len, x))} and of {max(map(len, x))} entries")
    return np.array(x, np.int64).reshape(len(rows), -1)


@dataclass
class State:
    """n vectors by their exact sums and the factor diag(s) Vt of the centred rows."""

    n: int
    sums: list[int]
    factor: np.ndarray

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _decomposed(rows: np.ndarray) -> np.ndarray:
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * vt


def merged(states: list[State]) -> State:
    """One state for all, by stacked factors and a row for each distance of means."""
    states = [s for s in states if s.n]
    if not states:
        return State(0, [], np.zeros((0, 0)))
    if len({len(s.sums) for s in states}) > 1:
        raise ValueError(f"vectors of {min(len(s.sums) for s in states)} and of {max(len(s.sums) for s in states)} entries")
    n, sums, stack = states[0].n, states[0].sums, [states[0].factor]
    for s in states[1:]:
        apart = np.array([(a * s.n - b * n) / (n * s.n) for a, b in zip(sums, s.sums, strict=True)])  # exact up to the division
        stack += [s.factor, math.sqrt(n / (n + s.n) * s.n) * apart[None]]
        n, sums = n + s.n, [a + b for a, b in zip(sums, s.sums, strict=True)]
    return State(n, sums, _decomposed(np.concatenate(stack)) if len(stack) > 1 else stack[0])


def of_rows(x: np.ndarray) -> State:
    """The state of whole-number rows; rows are centred exactly up to one division."""
    if not len(x):
        return State(0, [], np.zeros((0, 0)))
    sums = [int(v) for v in x.sum(0)]
    return State(len(x), sums, _decomposed(x - np.array([s / len(x) for s in sums])))


@dataclass
class Model:
    """components: a unit eigenvector a row, by falling eigenvalue; sums include the shift."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    total: float
    scale: float
    shift: int
    identity_error: float = math.nan

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S over n, where x is without the shift; whole numbers until the division."""
        if not x.size:
            return x.astype(np.float64)
        s = [v - self.n * self.shift for v in self.sums]
        if self.n * max(1, int(np.abs(x).max())) + max(map(abs, s)) < 1 << 62:
            return (self.n * x - np.array(s, np.int64)) / self.n
        return np.array([[(self.n * int(v) - t) / self.n for v, t in zip(row, s, strict=True)] for row in x])

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum over dimensions of (n * x - S)^2."""
        if not x.size:
            return [0] * len(x)
        s = [v - self.n * self.shift for v in self.sums]
        far = self.n * int(np.abs(x).max()) + max(map(abs, s))
        if far * far * x.shape[1] < 1 << 63:
            return ((self.n * x - np.array(s, np.int64)) ** 2).sum(1).tolist()
        each = (sum((self.n * int(v) - t) ** 2 for v, t in zip(row, s, strict=True)) for row in x)
        return [v if v < 1 << 63 else None for v in each]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.values)


def fit_list(df: DataFrame, vector_col: str, scale: float, shift: int) -> DataFrame:
    """(_sw_x): each distinct vector once, packed; stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(dict.fromkeys(pack(grid(b.column(0), scale, shift)[1]))), pa.binary())], names=["_sw_x"])

    return storage.written(df.select(vector_col).mapInArrow(storage.lean_batches(run), "_sw_x binary").distinct(), "vectors")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Rows of several batches at a time."""
    some: list[bytes] = []
    for b in batches:
        some += b.column(0).to_pylist()
        if some and len(some) * len(some[0]) >= CHUNK:
            yield unpack(some)
            some = []
    if some:
        yield unpack(some)


def _tree(df: DataFrame, partial, merge) -> object:
    """partial(batches) of each task, merged FAN_IN at a time in tasks; the last one is returned, or None."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = partial(batches)
        if state is not None:
            yield pa.RecordBatch.from_pydict({"node": pa.array([TaskContext.get().partitionId()], pa.int64()), "state": pa.array([pickle.dumps(state)], pa.binary())})

    def up(t: pa.Table) -> pa.Table:
        order = np.argsort(t["node"].to_numpy())
        states = [pickle.loads(t["state"][int(k)].as_py()) for k in order]
        return pa.table({"node": pa.array([t["node"][int(order[0])].as_py() // FAN_IN], pa.int64()), "state": pa.array([pickle.dumps(merge(states))], pa.binary())})

    states = storage.written(df.mapInArrow(storage.lean_batches(first), "node long, state binary"), "states")
    last = states.agg(F.max("node")).first()[0]
    while last:
        states = states.groupBy(F.floor(F.col("node") / FAN_IN).alias("_up")).applyInArrow(storage.lean(up), "node long, state binary")
        last //= FAN_IN
    got = states.collect()
    return pickle.loads(got[0]["state"]) if got else None


def fit(df: DataFrame, *, vector_col: str = "embedding", components: int = 16, scale: float = 64, shift: int = 1_000_000) -> Model:
    """Eigenvectors and eigenvalues of the distinct vectors, at most `components` of them, and how far the whitened ones are from white."""
    vectors = fit_list(df, vector_col, scale, shift)

    def decompose(batches: Iterator[pa.RecordBatch]) -> State | None:
        state = merged([])
        for x in _blocks(batches):
            state = merged([state, of_rows(x)])
        return state if state.n else None

    state = _tree(vectors, decompose, merged)
    if state is None:
        return Model(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, scale, shift)
    _, s, vt = np.linalg.svd(state.factor, full_matrices=False)
    values = s**2 / state.n
    rank = int((s > s.max(initial=0) * max(state.factor.shape) * np.finfo(float).eps).sum())
    k = min(components, rank)
    vt = vt * np.sign(np.take_along_axis(vt, np.abs(vt).argmax(1)[:, None], 1)) if len(vt) else vt
    model = Model(state.n, [v + state.n * shift for v in state.sums], values[:k], vt[:k], float(values.sum()), scale, shift)
    if k:
        model.identity_error = _identity_error(vectors, model)
    return model


def _identity_error(vectors: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity."""
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def merge(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
        n, mean, products = parts[0]
        for m, other, more in parts[1:]:
            apart = other - mean
            products = products + more + np.outer(apart, apart) * (n / (n + m) * m)
            mean, n = mean + apart * (m / (n + m)), n + m
        return n, mean, products

    def partial(batches: Iterator[pa.RecordBatch]) -> tuple[int, np.ndarray, np.ndarray] | None:
        fitted, state = storage.taken(sent), None
        for x in _blocks(batches):
            w = fitted.whitened(x)
            mean = w.mean(0)
            part = (len(w), mean, (w - mean).T @ (w - mean))
            state = merge([state, part]) if state else part
        return state

    n, _, products = _tree(vectors, partial, merge)
    return float(np.abs(products / n - np.eye(len(products))).max())


def whiten(df: DataFrame, model: Model, *, vector_col: str = "embedding", whitened_col: str = "whitened", deviation_col: str = "deviation") -> DataFrame:
    """df's rows that have a vector, with whitened (an array, a number for each component) and deviation."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    made = {whitened_col.lower(), deviation_col.lower()}
    stay = [f for f in df.schema.fields if f.name.lower() not in made]
    places, at = [df.columns.index(f.name) for f in stay], df.columns.index(vector_col)
    schema = T.StructType([*stay, T.StructField(deviation_col, T.LongType()), T.StructField(whitened_col, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = storage.taken(sent)
        for b in batches:
            kept, x = grid(b.column(at), fitted.scale, fitted.shift)
            if len(kept):
                w = fitted.whitened(x) if len(fitted.values) else np.zeros((len(x), 0))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.reshape(-1)))
                mine = b.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([*(mine.column(p) for p in places), pa.array(fitted.deviations(x), pa.int64()), lists], names=schema.names)

    return df.mapInArrow(storage.lean_batches(run), schema)


def by_component(df: DataFrame, model: Model, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row a vector and component: id_col, component, n, deviation, whitened, explained, identity_error."""
    rows = whiten(df.select(F.col(id_col).alias("_sw_id"), F.col(vector_col).alias("_sw_v")), model, vector_col="_sw_v")
    explained = F.array(*(F.lit(float(v / model.total)) for v in model.values)) if len(model.values) else F.array().cast("array<double>")
    each = rows.select("_sw_id", "deviation", F.posexplode("whitened"))
    return each.select(
        F.col("_sw_id").alias(id_col), (F.col("pos") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("col").alias("whitened"),
        F.get(explained, F.col("pos")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
