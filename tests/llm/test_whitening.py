"""Whitening against covariances and eigenvectors of whole matrices, by exact whole numbers where the result is exact."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigweave.llm import whitening
from sigweave.llm.queries import op12_embedding_whitening

SCHEMA = "vec_id long, embedding array<float>"


def rows_of(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)], schema)


def brute(vectors, k=16):
    """(n, exact S, deviations, eigenvalues, whitened, total) of float32 vectors."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), [int(t) for t in fit.sum(0)]
    dev = [sum((n * int(v) - t) ** 2 for v, t in zip(row, s)) for row in x]
    centred = (n * fit - np.array(s)) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return n, s, dev, e[:k], ((n * x - np.array(s)) / n) @ v[:, :k] / np.sqrt(np.maximum(e[:k], 1e-300)), e.sum()


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_against_whole_matrix(spark, parts):
    rng = np.random.default_rng(parts)
    vectors = list(rng.normal(size=(700, 20)) @ np.diag(np.geomspace(3, 0.05, 20)) + 5) + [[1.0] * 20] * 300
    df = rows_of(spark, vectors).repartition(parts)
    model = whitening.fit(df)
    got = whitening.by_component(df, model).collect()
    n, s, dev, e, white, total = brute(vectors)
    assert (model.n, model.sums) == (n, s) and n < 702 and len(got) == 16 * len(vectors)
    assert np.allclose(model.values, e, rtol=1e-9) and model.identity_error < 1e-9
    for r in got:
        assert r.deviation == dev[r.vec_id] and r.n == n and r.explained == pytest.approx(e[r.component - 1] / total, rel=1e-9)
        assert abs(r.whitened) == pytest.approx(abs(white[r.vec_id, r.component - 1]), abs=1e-7)
    assert len({(r.component, np.sign(r.whitened) == np.sign(white[r.vec_id, r.component - 1])) for r in got if abs(r.whitened) > 1e-6}) == 16


def test_merging_is_lossless():
    rng = np.random.default_rng(0)
    x = rng.integers(-40, 40, (500, 12)) + np.arange(12) * 1000
    for cuts in ([], [1], [3, 4, 5, 499], range(0, 500, 7)):
        state = whitening.merged([whitening.of_rows(p) for p in np.split(x, list(cuts))])
        assert state.n == 500 and state.sums == [int(v) for v in x.sum(0)]
        want = np.linalg.svd(x - x.mean(0), compute_uv=False)
        assert np.allclose(np.linalg.svd(state.factor, compute_uv=False)[:12], want, rtol=1e-10)
    assert whitening.merged([]).n == 0


def test_packing_of_vectors():
    x = np.array([[0, 127, -128], [0, 128, 5], [-32768, 32767, 1], [32768, 0, 0], [1 << 31, -1, -(1 << 39)]], np.int64)
    assert (whitening.unpack(whitening.pack(x)) == x).all() and len({len(p) for p in whitening.pack(x)}) == 4


def test_odd_vectors(spark):
    good = [[float(a), float(b)] for a in range(4) for b in range(5)]
    vectors = [None, [1.0, None], [float("nan"), 0.0], [float("inf"), 0.0], *good, good[0]]
    df = rows_of(spark, vectors).withColumn("n", F.lit("mine")).withColumn("WHITENED", F.lit(1))
    model = whitening.fit(df)
    assert model.n == 20 and len(model.values) == 2
    got = whitening.whiten(df, model)
    assert got.columns == ["vec_id", "embedding", "n", "deviation", "whitened"] and sorted(r.vec_id for r in got.collect()) == list(range(4, 25))
    flat = rows_of(spark, [[1.0, float(i)] for i in range(9)])  # one dimension without variance
    assert {r.component for r in whitening.by_component(flat, whitening.fit(flat)).collect()} == {1}
    for none in ([], [None], [[]], [[1.0, 2.0]], [[1.0, 2.0]] * 3):
        df = rows_of(spark, none)
        assert whitening.by_component(df, whitening.fit(df)).count() == 0
    with pytest.raises(Exception, match="vectors of 1 and of 2"):
        whitening.fit(rows_of(spark, [[1.0], [1.0, 2.0]]))


def test_large_numbers(spark):
    vectors = [[2.0**33 + i * 2.0**12, float(i % 3)] for i in range(50)]
    df = rows_of(spark, vectors)
    got = {r.vec_id: r.deviation for r in whitening.whiten(df, whitening.fit(df)).collect()}
    _, _, dev, *_ = brute(vectors)
    assert got == {i: d if d < 1 << 63 else None for i, d in enumerate(dev)}


def test_query(spark):
    got = op12_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    ids = sorted(vectors)
    n, _, dev, e, white, total = brute([vectors[i] for i in ids])
    rows = got.collect()
    assert len(rows) == 16 * len(ids) and {r.n for r in rows} == {n} and all(r.identity_error < 1e-4 for r in rows)
    for r in rows:
        k = ids.index(r.vec_id)
        assert r.deviation == dev[k] and r.explained == pytest.approx(e[r.component - 1] / total, rel=1e-9) and abs(r.whitened) == pytest.approx(abs(white[k, r.component - 1]), abs=1e-6)
