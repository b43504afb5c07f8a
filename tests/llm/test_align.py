"""Alignment of two tokenizers against a plain walk over byte offsets."""

import collections
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sigweave.llm import align
from sigweave.llm.queries import op13_tokenizer_alignment, tokenizer_path

A, B = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n  x", "▁ no", "<|endoftext|> is text", "é日本語🙂\x00z <0x41> <s> </s>", "a" * 30_000, "a b " * 20_000, "same", "same", " Ⅳ ﬁ\r\n\t", " " * 60_000]


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in printable]
    byte = {chr(x): x for x in printable} | {chr(256 + k): x for k, x in enumerate(rest)}
    assert json.loads(a.to_str())["model"]["type"] == "BPE"

    def run(text):
        if not text:
            return None
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if any(b"".join(p) != (" " + text).encode() for p in parts):
            return None
        spans = []
        for p in parts:
            at, mine = 0, []
            for x in p:
                mine.append((at, at + len(x)))
                at += len(x)
            spans.append(mine)
        links, k = [], 0
        for i, (lo, hi) in enumerate(spans[0]):
            while spans[1][k][1] <= lo:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][0] < hi:
                links.append((ids[0][i], ids[1][j]))
                j += 1
        groups = []
        places = [0, 0]
        for end in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
            text_of = []
            for side in (0, 1):
                mine = []
                while places[side] < len(ids[side]) and spans[side][places[side]][1] <= end:
                    mine.append(str(ids[side][places[side]]))
                    places[side] += 1
                text_of.append(",".join(mine))
            groups.append("|".join(text_of))
        return len(ids[0]), len(ids[1]), len(groups), links, ";".join(groups)

    return run


def wanted(plain, rows):
    """doc -> the contract's figures, by brute force."""
    made = {i: plain(t) for i, t in rows}
    counts = collections.Counter(x for m in made.values() if m for x in m[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return {i: (0, 0, 0, 0, 0, 0, "") if m is None else (*m[:3], len(m[3]), sum(counts[x] == best[x[1]] for x in m[3]), sum(counts[x] for x in m[3]), hashlib.sha256(m[4].encode()).hexdigest()) for i, m in made.items()}


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [2_000_000, 40, 0])
def test_against_plain_walk(spark, plain, most):
    rows = list(enumerate(ODD)) + [(100 + i, f"Some words, {i}: naïve token-isation of {'x' * i} 1{i}2") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("N_A", F.lit("mine")).withColumn("a_ids", F.lit(2)).repartition(3)
    got = align.align(docs, A, B, most_pairs=most)
    assert {r.doc_id: tuple(r[c] for c in NAMES) for r in got.collect()} == wanted(plain, rows)


def test_groups(spark, plain):
    rows = [(i, t) for i, t in enumerate(ODD) if t and len(t) < 100]
    for r in align.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B, keep_groups=True).collect():
        a, b = [0, *r.a_ends], [0, *r.b_ends]
        text = ";".join("|".join(",".join(map(str, ids[i:j])) for ids, i, j in ((r.a_ids, a[k], a[k + 1]), (r.b_ids, b[k], b[k + 1]))) for k in range(r.n_groups))
        assert (hashlib.sha256(text.encode()).hexdigest() if text else "") == r.groups_sha256 and len(r.a_ids) == r.n_a and a[-1] == r.n_a and b[-1] == r.n_b


def test_empty_and_repeated(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    got = align.align(spark.createDataFrame([(1, "again"), (1, "again"), (None, "again")], "doc_id long, text string"), A, B).collect()
    assert len(got) == 3 and len({tuple(r[c] for c in NAMES) for r in got}) == 1 and got[0].count_sum == 3 * got[0].n_links


def test_query(spark, plain):
    got = op13_tokenizer_alignment(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert dict(got.dtypes) == {"doc_id": "bigint"} | dict.fromkeys(NAMES, "bigint") | {"groups_sha256": "string"}
    assert {r.doc_id: tuple(r[c] for c in NAMES) for r in got.collect()} == wanted(plain, rows)


def test_two_bisections_a_token(monkeypatch):
    """An alignment bisects twice for each token of A, not five times, and finds what a walk over all pairs of tokens finds."""
    r, calls, search = np.random.default_rng(1), [], np.searchsorted

    def counted(at, values, side="left"):
        calls.append(len(values))
        return search(at, values, side)

    monkeypatch.setattr(np, "searchsorted", counted)
    sizes = np.arange(1, 6)
    for _ in range(30):
        total = int(r.integers(0, 40))
        lists = []
        for _ in range(2):
            ids, left = [], total
            while left:
                ids.append(int(r.integers(0, min(5, left))))
                left -= ids[-1] + 1
            lists.append(np.array(ids, np.int32))
        a, b = lists
        calls.clear()
        found = align.Alignment(a, b, sizes, sizes)
        assert sum(calls) <= 2 * len(a)
        ends = [np.cumsum(sizes[x]) for x in lists]
        pairs = [(i, j) for i in range(len(a)) for j in range(len(b)) if ends[0][i] - sizes[a[i]] < ends[1][j] and ends[1][j] - sizes[b[j]] < ends[0][i]]
        assert list(zip(found.link_a.tolist(), found.link_b.tolist(), strict=True)) == pairs
        both = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        assert [ends[0][i - 1] for i in found.group_a] == both == [ends[1][j - 1] for j in found.group_b]


def test_spelling_in_stretches(monkeypatch):
    monkeypatch.setattr(align, "STRETCH", 3)
    of = align.Spelling([b"\0", b"ab", b"c" * 20, "é".encode(), b" "])
    ids = np.array([4, 1, 2, 3, 0, 0, 1], np.int32)
    want = b" ab" + b"c" * 20 + "é".encode() + b"\0\0ab"
    assert of.makes(ids, want) and of.makes(ids[:0], b"")
    assert not any(of.makes(i, w) for i, w in [(ids, want + b" "), (ids, want[:-1]), (ids[:-1], want), (ids[1:], want), (ids[:0], b" "), (ids, b"")])


def test_tally():
    r, tally = np.random.default_rng(2), align.Tally(50)
    assert [len(x) for x in tally.taken()] == [0, 0]
    for _ in range(2):
        parts = [r.integers(0, 90, n) for n in (0, 7, 120, 3, 49, 1, 60, 60, 5)]
        for x in parts:
            tally.add(x)
        keys, n = tally.taken()
        assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == collections.Counter(np.concatenate(parts).tolist()) and (np.diff(keys) > 0).all()
