"""Packed exchanges of k-mers against plain Python."""

import collections
import random

import numpy as np
import pytest

from sigweave.operators import compare, kmers, packs


@pytest.mark.parametrize("k,b", [(1, 0), (1, 1), (5, 3), (21, 0), (21, 12), (31, 20)])
def test_lists_come_back(k, b):
    r = np.random.default_rng(k)
    for refs in (1, 300, 1 << 40):
        words = r.integers(0, 1 << 2 * k, 3000)
        words[:50] = words[0]
        assert len(np.unique(packs.mixed(words, k))) == len(np.unique(words))
        ref = r.integers(0, refs, 3000)
        ref[:50] = ref[0]
        h, got, n = packs.added(packs.mixed(words, k), ref, None, 2 * k)
        want = collections.Counter(zip(packs.mixed(words, k).tolist(), ref.tolist(), strict=True))
        assert list(zip(h.tolist(), got.tolist(), n.tolist(), strict=True)) == [(*key, c) for key, c in sorted(want.items())]
        twice = packs.added(np.concatenate([h, h]), np.concatenate([got, got]), np.concatenate([n, n * 300]), 2 * k)
        assert twice[2].tolist() == (n * 301).tolist() and (twice[0] == h).all() and (twice[1] == got).all()
        back = [(bucket, *packs._taken(*rest, 2 * k, b)) for bucket, *rest in packs._sent(h, got, n, 2 * k, b)]
        assert [x for bucket, low, _, _ in back for x in (low + packs.U64(bucket << (2 * k - b))).tolist()] == h.tolist()
        assert [x for _, _, y, z in back for x in zip(y.tolist(), z.tolist(), strict=True)] == list(zip(got.tolist(), n.tolist(), strict=True))


def rows_of(spark, seed, n, refs, k):
    r = random.Random(seed)
    pool = [r.randrange(1 << 2 * k) for _ in range(40)]
    return [(r.choice(pool), r.randrange(refs)) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "kmer long, ref int").repartition(3)


@pytest.mark.parametrize("bits", [0, 1, 4])
def test_weak_and_spectrum(spark, bits):
    rows = rows_of(spark, bits, 70, 5, 9)
    df = frame(spark, [*rows, (None, 1), (3, None)])
    count = collections.Counter(k for k, _ in rows)
    got = {x["ref"]: (x["distinct"], x["weak"]) for x in packs.weak_by_ref(df, 9, bits).collect()}
    assert got == {i: (len({k for k, x in rows if x == i}), sum(count[k] == 1 for k, x in rows if x == i)) for i in {x for _, x in rows}}
    whole = frame(spark, rows)
    assert packs.spectrum(whole, 9, bits).first() == kmers.spectrum(whole).first()
    assert packs.spectrum(whole.limit(0), 9, bits).first() == kmers.spectrum(whole.limit(0)).first()
    assert packs.weak_by_ref(whole.limit(0), 9, bits).count() == 0


def test_slices_and_buckets_are_added_up(spark):
    """A slice of few rows, and buckets that come from many tasks: nothing is lost or doubled at their edges."""
    rows = rows_of(spark, 1, 500, 3, 12)

    def summed(buckets):
        import pyarrow as pa

        for h, ref, n in buckets:
            assert len(set(zip(h.tolist(), ref.tolist(), strict=True))) == len(h)
            yield pa.RecordBatch.from_arrays([pa.array(ref), pa.array(n)], names=["ref", "n"])

    got = collections.Counter()
    for x in packs.by_bucket(frame(spark, rows), 12, 3, summed, "ref long, n long", slice_=7).collect():
        got[x["ref"]] += x["n"]
    assert got == collections.Counter(x for _, x in rows)


@pytest.mark.parametrize("same,block", [(True, 1), (True, 1 << 17), (False, 4), (False, 1 << 17)])
def test_similarity_of_packed(spark, same, block):
    a = frame(spark, rows_of(spark, 3, 300, 6, 10))
    b = a if same else frame(spark, rows_of(spark, 3, 200, 4, 10))
    refs, others = (spark.createDataFrame([(i,) for i in range(n)], "ref int") for n in (7, 7 if same else 5))
    refs, others = (refs, refs) if same else (refs, others)
    want, got = (compare.similarity(a, b, refs, others, packed=p, block=block).fillna(-1.0) for p in (None, (10, 2)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 7 * (7 if same else 5)


@pytest.mark.parametrize("name", ["weak_kmers", "similarity_matrix"])
def test_kmers_are_dealt_out_once_and_packed(spark, name):
    """The exchanges of the queries have lists of k-mers, not rows of them."""
    from sigweave.plans import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(kmer" not in plan


@pytest.mark.parametrize("estimate", [False, True])
def test_metrics_of_programs_are_packed(spark, tmp_path, estimate):
    """The query program's exact spectrum deals out lists; with an estimate no k-mers are dealt out."""
    from sigweave.plans import programs

    r = random.Random(2)
    seqs = ["".join(r.choices("ACGTN", [9, 9, 9, 9, 1], k=60)) for _ in range(30)] * 2
    (tmp_path / "r.fq").write_text("".join(f"@r{i}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(seqs)))
    count = collections.Counter(min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))) for s in seqs for w in (s[i : i + 21] for i in range(40)) if "N" not in w)
    sketch = spark.createDataFrame([(next(iter(count)), 0, "a", 1, "0", 0)], "kmer string, ref_id int, ref_name string, num_refs int, contig string, pos long")
    got = programs.query(spark, [str(tmp_path / "r.fq")], sketch, estimate=estimate)["metrics"]
    assert got.select("f1", "f0", "repeats", "weak").first() == (sum(count.values()), len(count), sum(n > 1 for n in count.values()), sum(n == 1 for n in count.values()))
    assert ("packed#" in got._jdf.queryExecution().executedPlan().toString()) is not estimate


def test_expected_numbers():
    assert packs.bucket_bits(0, 21) == 0 and packs.bucket_bits(8 * packs.BUCKET, 21) == 4 and packs.bucket_bits(1 << 60, 3) == 5
