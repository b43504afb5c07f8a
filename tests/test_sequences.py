"""Byte-range sources against a reader of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from sigweave.operators import kmers
from sigweave.sources import files, sequences

ODD_FASTA = ">one two\nACG\n\nTTA\n>\nGGG\n>x\ty\nccc\r\n>\n>last\n" + "ACGTN" * 40 + "\né\n>e\n"


def dna(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


def fasta(r, n=25, width=60):
    out = []
    for i in range(n):
        s = dna(r, r.choice([0, 1, 30, 59, 60, 61, 400, 3000]))
        out.append(f">{r.choice(['', f'c{i} x'])}\n" + "".join(s[j : j + width] + "\n" for j in range(0, len(s), width)) + r.choice(["", "\n"]))
    return "".join(out)


def all_kmers(df, k, start):
    return sorted((x.record_idx, x.contig, x.at, x.kmer) for x in kmers.kmers(df, k, keep=["record_idx", "contig", *start]).select("record_idx", "contig", (F.col("pos") + (F.col("start") if start else F.lit(0))).alias("at"), "kmer").collect())


TEXTS = [ODD_FASTA, "no mark\nACGTACGTAC", ">one line\n" + "ACGGT" * 40, ">a\nACGTA\n>b", "", "\n\n>a\nACGTACGT\n", ">a\n\n\n>\nACG\n\nT\n>b"]


@pytest.mark.parametrize("text", TEXTS)
def test_stretches_of_all_ranges(tmp_path, text):
    """Headers and letters of the ranges, put together, are those of the file, whatever the ranges' size."""
    (tmp_path / "a.fa").write_bytes(text.encode())
    size, want = len(text.encode()), []
    for i, line in enumerate(text.encode().split(b"\n")[: None if text[-1:] != "\n" else -1] if text else []):
        want.append((True, line) if not i or line[:1] == b">" else (False, line))
    def merged(found):
        out = []
        for header, x in found:
            if header or not out or out[-1][0]:
                out.append((header, x))
            else:
                out[-1] = (False, out[-1][1] + x)
        return [o for o in out if o[0] or o[1]]

    with open(tmp_path / "a.fa", "rb") as f:
        for most in range(1, 45):
            got = [(h, x) for at in range(0, size, most) for h, _, x in sequences._stretches(f, sequences.Range(0, "", at, min(size, at + most), size))]
            assert merged(got) == merged(want), most


@pytest.mark.parametrize("text,most", [(ODD_FASTA, 40), (">one line\n" + "ACGGT" * 3000, 997), ("no mark\nACGTACGTAC", 7), ("", 10)])
def test_contigs_in_ranges(spark, tmp_path, text, most):
    (tmp_path / "a.fa").write_text(text, newline="")
    want = all_kmers(files.read_fasta(spark, files.references(spark, [str(tmp_path / "a.fa")])), 5, [])
    got = sequences.contigs(spark, str(tmp_path / "a.fa"), k=5, range_bytes=most)
    assert all_kmers(got, 5, ["start"]) == want


def test_joined_files(spark, tmp_path):
    """A record that fills several files of a folder, of which one is empty and one ends within a line."""
    seq = dna(random.Random(2), 900)
    for name, text in (("part-0", ">all of it\n" + seq[:100] + "\n"), ("part-1", ""), ("part-2", seq[100:333]), ("part-3", seq[333:] + "\n>b\nACGTACGTA\n"), ("_SUCCESS", "no")):
        (tmp_path / name).write_text(text)
    got = all_kmers(sequences.contigs(spark, str(tmp_path), k=11, range_bytes=150, joined=True), 11, ["start"])
    assert [x[2] for x in got] == list(range(890)) and {x[1] for x in got} == {"all_of_it"}


@pytest.mark.parametrize("most,k", [(3000, 31), (2000, 70)])
def test_random_contigs(spark, tmp_path, most, k):
    r = random.Random(most)
    for name in ("b.fa", "a.fa"):
        (tmp_path / name).write_text(fasta(r))
    got = sequences.contigs(spark, str(tmp_path), k=k, range_bytes=most)
    for i, name in enumerate(("a.fa", "b.fa")):
        want = all_kmers(files.read_fasta(spark, files.references(spark, [str(tmp_path / name)])), k, [])
        assert all_kmers(got.where(F.col("file_idx") == i), k, ["start"]) == want


def test_pieces_of_a_range(tmp_path, monkeypatch):
    """Pieces are bounded, and carry what follows them, over the range's end too."""
    monkeypatch.setattr(sequences, "PIECE_LETTERS", 10)
    seq = dna(random.Random(1), 137)
    (tmp_path / "a.fa").write_text(f">c\n{seq[:50]}\n{seq[50:90]}\n{seq[90:]}\n>d\nAC\n")
    size = (tmp_path / "a.fa").stat().st_size
    with open(tmp_path / "a.fa", "rb") as f:
        parts = [p for at in range(0, size, 33) for p in sequences._pieces(f, sequences.Range(0, "", at, min(at + 33, size), size), 4)]
    own = "".join(p[3][: p[4]].decode() for p in parts)
    assert own == seq + "AC" and max(p[4] for p in parts) == 10
    at = 0
    for p in parts[:-1]:
        assert p[3].decode() == seq[at : at + p[4] + 4]
        at += p[4]


def fastq(r, n, wrap):
    out, want = [], []
    for i in range(n):
        s = dna(r, r.randrange(0, 200))
        q = "".join(r.choice("@+>I") for _ in s)
        cut = (lambda x: "\n".join(x[j : j + 30] for j in range(0, len(x), 30))) if wrap else (lambda x: x)
        out.append(f"@r{i} extra\n{cut(s)}\n+\n{cut(q)}\n")
        want.append((f"r{i}", s))
    return "".join(out), want


@pytest.mark.parametrize("wrap,most", [(False, 4000), (True, 500), (True, 4000)])
def test_reads_in_ranges(spark, tmp_path, wrap, most):
    text, want = fastq(random.Random(most), 60 if most < 1000 else 250, wrap)
    (tmp_path / "a.fq").write_text(text)
    got = sequences.reads(spark, str(tmp_path / "a.fq"), range_bytes=most).orderBy("read_idx").collect()
    assert [(x.read_name, x.seq) for x in got] == want and all(text[x.read_idx] == "@" for x in got)


def test_wrong_guesses_are_put_right(spark, tmp_path):
    """Quality that reads as records of its own, over many ranges."""
    fake = "@f\nAC\n+\nII\n" * 30
    seq = "\n".join("A" * len(x) for x in fake.splitlines())
    text = f"@one\n{seq}\n+\n{fake}@two\nACGT\n+\n@@@@\n" * 3
    (tmp_path / "a.fq").write_text(text)
    want = [tuple(x)[1:] for x in files.read_reads(spark, [str(tmp_path / "a.fq")]).orderBy("read_idx").select("file_idx", "read_name", "seq").collect()]
    got = sequences.reads(spark, str(tmp_path / "a.fq"), range_bytes=150).orderBy("read_idx").collect()
    assert [x.read_name for x in got] == ["one", "two"] * 3 and [(x.read_name, x.seq) for x in got] == want


def test_fasta_reads_and_stream(spark, tmp_path):
    r = random.Random(4)
    (tmp_path / "in").mkdir()
    rows = {}
    for name in ("a.fa", "b.fq"):
        text, want = fastq(r, 30, True) if name == "b.fq" else ("".join(f">s{i} x\n{dna(r, 90)}\n" for i in range(30)), None)
        (tmp_path / "in" / name).write_text(text)
        rows[name] = sorted((x.read_name, x.seq) for x in files.read_reads(spark, [str(tmp_path / "in" / name)]).collect())
    assert sorted((x.read_name, x.seq) for x in sequences.reads(spark, str(tmp_path / "in"), range_bytes=300).collect()) == sorted(rows["a.fa"] + rows["b.fq"])
    out, at = str(tmp_path / "out"), str(tmp_path / "at")

    def run():
        sequences.stream_reads(spark, str(tmp_path / "in")).writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
        return sorted((x.read_name, x.seq) for x in spark.read.parquet(out).collect())

    assert run() == sorted(rows["a.fa"] + rows["b.fq"])
    (tmp_path / "in" / "c.fa").write_text(">new\nACGT\n")
    assert run() == sorted([*rows["a.fa"], *rows["b.fq"], ("new", "ACGT")])  # a restart reads what is new only
