"""Golden cases, rules at their edges, and randomised comparisons with plain Python."""

import bz2
import collections
import gzip
import lzma
import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from sigweave.functions import complexity, seq
from sigweave.operators import compare, index, kmers, query
from sigweave.plans import programs
from sigweave.sources import files, shared, sinks
from sigweave.sources import universe
from sigweave.streaming import match as streaming
from sigweave.streaming.match import stream_counts, stream_hits

REFS = {0: [("0", "CAGGCTACAAA"), ("1", "GAGACTGAACT")], 1: [("3", "CTTAGCTGAGG"), ("4", "CAGGCTACAAC")]}
UNIQUE = {(0, "AGGCTACAAA", 1, "0"), (0, "GAGACTGAAC", 0, "1"), (0, "AGACTGAACT", 1, "1"), (1, "CTCAGCTAAG", 0, "3"), (1, "CCTCAGCTAA", 1, "3"), (1, "AGGCTACAAC", 1, "4")}
SCORES = {"AGGCTACAAA": 0.7533, "GAGACTGAAC": 0.7278, "AGACTGAACT": 0.7226, "CTCAGCTAAG": 0.7526, "CCTCAGCTAA": 0.7582, "AGGCTACAAC": 0.7582}


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def contigs(spark):
    return spark.createDataFrame([(r, f"ref{r}", i, c, s) for r, cs in REFS.items() for i, (c, s) in enumerate(cs)], "ref_id int, ref_name string, record_idx long, contig string, seq string")


def reads(spark, rows):
    return spark.createDataFrame(rows, "file_idx int, read_idx long, read_name string, seq string")


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_column_functions(spark):
    assert column(spark, ["GTTTATTTACC", "AGGTTAGCTTTC", "ACGT", "", None], seq.canonical) == ["GGTAAATAAAC", "AGGTTAGCTTTC", "ACGT", "", None]
    assert column(spark, ["acgtnX"], seq.reverse_complement) == ["NNACGT"]
    assert column(spark, ["/home/user/workspace/test/ref1.fasta", "ref2.fa", "x.fa.gz", "plain", "/a.b/c"], seq.base_id) == ["ref1", "ref2", "x.fa", "plain", "c"]
    with pytest.raises(Exception, match="no base name"):
        column(spark, [".hidden"], seq.base_id)
    assert column(spark, ["a b\tc"], seq.contig_label) == ["a_b\tc"]
    r = random.Random(1)
    some = ["".join(r.choice("ACGT") for _ in range(r.randrange(1, 30))) for _ in range(50)]
    assert column(spark, some, seq.canonical) == [min(s, rc(s)) for s in some] == column(spark, [rc(s) for s in some], seq.canonical)


def entropy(s):
    total = 0.0
    for j in range(1, 6):
        c = collections.Counter(s[i : i + j] for i in range(len(s) - j + 1))
        total -= sum(v / (len(s) - j + 1) * math.log2(v / (len(s) - j + 1)) for v in c.values())
    return total / (12 + math.log2(len(s) - 3) + math.log2(len(s) - 4))


def test_entropy(spark):
    assert complexity.max_entropy(81) == pytest.approx(24.5522, abs=1e-4) and complexity.max_entropy(10) == pytest.approx(17.3923, abs=1e-4)
    assert column(spark, list(SCORES), complexity.entropy_score) == pytest.approx(list(SCORES.values()), abs=1e-4)
    r = random.Random(2)
    some = ["".join(r.choice("ACGT") for _ in range(k)) for k in (6, 10, 21, 81, 6, 300)] + ["A" * 81]
    assert column(spark, some, complexity.entropy_score) == pytest.approx([entropy(s) for s in some])
    assert column(spark, ["ACGTA", "A" * 81, some[3], None], complexity.is_low_complexity) == [True, True, False, None]
    assert column(spark, ["ACGTNACGTA", None], complexity.entropy_score) == [None, None]


def brute_kmers(s, k):
    s = s.upper()
    return [(i, min(s[i : i + k], rc(s[i : i + k]))) for i in range(len(s) - k + 1) if set(s[i : i + k]) <= set("ACGT")]


@pytest.mark.parametrize("piece", [1, 7, 512])
def test_kmers(spark, piece):
    r = random.Random(piece)
    rows = [(i, "".join(r.choice("ACGTacgtN" if i % 3 else "ACGT") for _ in range(r.choice([0, 4, 5, 6, 20, 300])))) for i in range(40)] + [(90, None)]
    got = collections.defaultdict(list)
    for x in kmers.kmers(spark.createDataFrame(rows, "id int, seq string"), 5, piece=piece).collect():
        got[x.id].append((x.pos, x.kmer))
    for i, s in rows:
        assert sorted(got[i]) == brute_kmers(s or "", 5)


def test_index_golden(spark):
    found = kmers.kmers(contigs(spark), 10)
    s = kmers.spectrum(found).first()
    assert (s.f1, s.f0, s.repeats, s.weak) == (8, 7, 1, 6) and kmers.approx_spectrum(found).first().f0 == 7
    assert {(x.n, x.kmers) for x in kmers.histogram(found).collect()} == {(1, 6), (2, 1)}
    unique = index.unique_kmers(found, ["ref_id", "ref_name", "contig", "pos"])
    assert {(x.ref_id, x.kmer, x.pos, x.contig) for x in unique.collect()} == UNIQUE
    refs = spark.createDataFrame([(0, "ref0"), (1, "ref1"), (2, "none")], "ref_id int, ref_name string")
    assert {(x.ref_id, x.uniq_count) for x in index.unique_counts(unique, refs).collect()} == {(0, 3), (1, 3), (2, 0)}
    one, two = ([tuple(x) for x in index.build_sketch(unique.repartition(n), refs, c=2).orderBy("kmer").collect()] for n in (1, 5))
    assert one == two and collections.Counter(x[1] for x in one) == {0: 2, 1: 2} and {(x[1], x[0], x[5], x[4]) for x in one} <= UNIQUE and {x[3] for x in one} == {3}
    assert index.build_sketch(unique, refs, c=2, threshold=0.755).count() == 2  # two of ref 1 pass, none of ref 0


def test_unique_means_once_in_the_universe(spark):
    rows = spark.createDataFrame([(0, "ACGTTACGTT"), (1, "GGCATTCAGA")], "ref_id int, seq string")
    found = {x.kmer for x in index.unique_kmers(kmers.kmers(rows, 5), ["ref_id"]).collect()}
    assert min("ACGTT", rc("ACGTT")) not in found and min("GGCAT", rc("GGCAT")) in found


SKETCH = [("AGGCTACAAA", 0, "ref0", 2, "0", 1), ("AGACTGAACT", 0, "ref0", 2, "1", 1), ("CTCAGCTAAG", 1, "ref1", 2, "3", 0), ("AGGCTACAAC", 1, "ref1", 2, "4", 1)]
READS = [(0, 0, "1", "AGACTGAACTC"), (0, 1, "2", "AGACTGAACTG"), (0, 2, "3", "AGACTGAACTT")]


def sketch(spark, rows=SKETCH):
    return spark.createDataFrame(rows, "kmer string, ref_id int, ref_name string, num_refs int, contig string, pos long")


def test_query_golden(spark):
    hits = query.match(reads(spark, READS), sketch(spark), 10)
    assert {(x.ref_id, x["count"], x.reads) for x in query.hit_counts(hits).collect()} == {(0, 3, 3)}
    assert [tuple(x) for x in query.report(hits, sketch(spark), hit_cutoff=1, read_cutoff=0).collect()] == [("ref0", 1.0, 3)]
    assert {(x.ref_id, x["count"], x.reads) for x in query.hit_counts(hits, solid=True).collect()} == {(0, 3, 2)}
    log = [tuple(x) for x in query.signature_log(hits, sketch(spark), solid=True).collect()]
    assert log == [("ref0", 2, "AGACTGAACT", 2)]
    shuffled = query.match(reads(spark, READS), sketch(spark), 10, broadcast_bytes=1)
    assert shuffled.count() == hits.count()


def test_query_cutoffs(spark):
    rows = [(0, i, f"r{i}", "AGACTGAACT") for i in range(3)] + [(1, 0, "r0", "AGACTGAACT"), (0, 9, "x", "CTCAGCTAAG"), (0, 10, "y", "CTTAGCTGAG"), (0, 11, "z", "nnACG")]
    hits = query.match(reads(spark, rows), sketch(spark), 10)
    counts = {x.ref_id: (x["count"], x.reads) for x in query.hit_counts(hits).collect()}
    assert counts == {0: (4, 3), 1: (2, 2)}  # a name that both files have is one read
    rep = lambda **k: [tuple(x) for x in query.report(hits, sketch(spark), **k).collect()]
    assert rep(hit_cutoff=2, read_cutoff=1) == [("ref0", 4 / 6, 4), ("ref1", 2 / 6, 2)]
    assert rep(hit_cutoff=2, read_cutoff=2) == [("ref0", 1.0, 4)] and rep(hit_cutoff=5, read_cutoff=0) == []
    assert rep(hit_cutoff=2, read_cutoff=1, abundance_cutoff=2 / 6) == [("ref0", 4 / 6, 4)]  # strict, and no new total
    with pytest.raises(ValueError):
        rep(read_cutoff=-1)


def test_solid_adds_one_a_reference(spark):
    two = [("AGGCTACAAA", 0, "ref0", 1, "0", 1), ("AGACTGAACT", 0, "ref0", 1, "1", 1)]
    rows = [(0, 0, "a", "AGACTGAACT"), (0, 1, "b", "AGACTGAACT"), (0, 2, "c", "AGGCTACAAA"), (1, 0, "d", "TTTGTAGCCT"), (1, 1, "e", "AGGCTACAAA")]
    hits = query.match(reads(spark, rows), sketch(spark, two), 10)
    assert {(x.ref_id, x["count"], x.reads) for x in query.hit_counts(hits, solid=True).collect()} == {(0, 4, 3)}


def test_first_sketch_row_wins(spark):
    twice = spark.createDataFrame([("AGACTGAACT", 5, "a", 1), ("AGACTGAACT", 2, "b", 2)], "kmer string, ref_id int, ref_name string, line_no long")
    assert query.signatures(twice, "line_no").first().ref_id == 5


def test_similarity(spark):
    rows = spark.createDataFrame([("a", "ACGTTGCA"), ("a", "ACGTTGCA"), ("b", "ACGTTGGG"), ("c", "TTTTTTTT"), ("e", "AC")], "ref string, seq string")
    occ, names = kmers.kmers(rows, 5), rows.select("ref").distinct()
    got = {(x.ref1, x.ref2): (x.uniq_ref1, x.all_ref1, x.similarity) for x in compare.similarity(occ, occ, names, names).collect()}
    assert len(got) == 16
    by = collections.defaultdict(list)
    for r, s in (tuple(x) for x in rows.collect()):
        by[r] += [k for _, k in brute_kmers(s, 5)]
    for (p, f), (uniq, total, sim) in got.items():
        assert (uniq, total) == (sum(k not in by[f] for k in by[p]), len(by[p]))
        assert math.isnan(sim) if not total else sim == (total - uniq) / total


def fasta(path, text):
    path.write_text(text, newline="")
    return str(path)


def test_fasta(spark, tmp_path):
    a = fasta(tmp_path / "ref+1 a.fa", ">one two\nACG\n\nTTA\n>\nGGG\n>x\ty\nccc\r\n")
    b = fasta(tmp_path / "b.x.fa", "no mark\nACGT")
    c = fasta(tmp_path / "c.fa", "")
    refs = files.references(spark, [b, a, c])
    assert {(x.ref_id, x.ref_name) for x in refs.collect()} == {(0, "b.x"), (1, "ref+1 a"), (2, "c")}
    got = {(x.ref_id, x.record_idx): (x.contig, x.seq) for x in files.read_fasta(spark, refs).collect()}
    assert got == {(0, 0): ("o_mark", "ACGT"), (1, 0): ("one_two", "ACGTTA"), (1, 1): ("one_two", "GGG"), (1, 2): ("x\ty", "CCC\r")}


def test_fasta_in_splits(spark, tmp_path):
    r = random.Random(7)
    want = [(f"c{i}", "".join(r.choice("ACGT") for _ in range(r.randrange(1, 400)))) for i in range(80)]
    p = fasta(tmp_path / "big.fa", "".join(f">{n}\n{s[:60]}\n{s[60:]}\n" for n, s in want))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = sorted((x.record_idx, x.contig, x.seq) for x in files.read_fasta(spark, files.references(spark, [p])).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(i, n, s) for i, (n, s) in enumerate(want)]


def test_reads(spark, tmp_path):
    fq = "@r1 extra\nACGT\n+\n@@@@\n@r2\nAC\nGT\n+r2\n@I\n+I\n"
    fa = ">r3 x\nAC\nGT\n>r4\n\n"
    (tmp_path / "a.fq").write_text(fq)
    gzip.open(tmp_path / "b.fq.gz", "wt").write(fq)
    bz2.open(tmp_path / "c.fa.bz2", "wt").write(fa)
    lzma.open(tmp_path / "d.fa.xz", "wt").write(fa)
    with zipfile.ZipFile(tmp_path / "e.fa.zip", "w") as z:
        z.writestr("e.fa", fa)
    paths = [str(tmp_path / x) for x in ("a.fq", "b.fq.gz", "c.fa.bz2", "d.fa.xz", "e.fa.zip")]
    got = sorted(tuple(x) for x in files.read_reads(spark, paths).collect())
    assert got == [(f, i, n, s) for f in range(5) for i, (n, s) in enumerate([("r1", "ACGT"), ("r2", "ACGT")] if f < 2 else [("r3", "ACGT"), ("r4", "")])]


def test_programs(spark, tmp_path):
    paths = [fasta(tmp_path / f"ref_{r}.fa", "".join(f">{c}\n{s}\n" for c, s in cs)) for r, cs in REFS.items()]
    (tmp_path / "list").write_text("\n".join(paths) + "\n")
    got = programs.index(spark, [f"@{tmp_path}/list"], k=10, c=2)
    assert {(x.ref_id, x.kmer, x.pos, x.contig) for x in got["unique"].collect()} == UNIQUE
    assert [(x.ref_id, x.uniq_count) for x in got["counts"].orderBy("ref_id").collect()] == [(0, 3), (1, 3)]
    sinks.write_sketch(got["sketch"], str(tmp_path / "sketch"))
    sinks.write_candidates(got["unique"], str(tmp_path / "candidates"))
    sinks.write_counts(got["counts"], str(tmp_path / "counts"))
    table = files.read_sketch(spark, str(tmp_path / "sketch"))
    assert sorted(tuple(x)[:6] for x in table.collect()) == sorted(tuple(x) for x in got["sketch"].collect())
    (tmp_path / "r.fq").write_text("".join(f"@{n}\n{s}\n+\n{'I' * len(s)}\n" for _, _, n, s in READS))
    sinks.write_sketch(sketch(spark), str(tmp_path / "given"))
    out = programs.query(spark, [str(tmp_path / "r.fq")], files.read_sketch(spark, str(tmp_path / "given")), hit=1, rcutoff=0)
    sinks.write_report(out["report"], str(tmp_path / "report"))
    assert "".join(p.read_text() for p in (tmp_path / "report").glob("part*")) == "ref\tabundance\tcount\nref0\t1\t3\n"
    assert [tuple(x) for x in out["log"].collect()] == [("ref0", 3, "AGACTGAACT", 3)]
    sims = programs.compare(spark, paths, paths, k=10)
    assert {(x.ref1, x.ref2): (x.uniq_ref1, x.all_ref1) for x in sims.collect()} == {("ref_0", "ref_0"): (0, 4), ("ref_1", "ref_1"): (0, 4), ("ref_0", "ref_1"): (3, 4), ("ref_1", "ref_0"): (3, 4)}
    sinks.write_similarity(sims, str(tmp_path / "sim"))
    assert "ref_0\tref_1\t3\t4\t0.25" in "".join(p.read_text() for p in (tmp_path / "sim").glob("part*"))


def test_shared_files_are_cleaned(spark):
    import os

    path = shared.new_path(spark, "some")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path) and shared.clean(spark) >= 1 and not os.path.exists(path)


def test_reads_in_splits(spark, tmp_path):
    r = random.Random(9)
    want = [(f"r{i}", "".join(r.choice("ACGT") for _ in range(r.randrange(1, 200)))) for i in range(150)]
    fq = "".join(f"@{n} x\n{s}\n+\n{''.join(r.choice('@+I>') for _ in s)}\n" for n, s in want)
    (tmp_path / "a.fq").write_text(fq)
    (tmp_path / "b.fa").write_text("".join(f">{n}\n{s[:50]}\n{s[50:]}\n" for n, s in want))
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("1.fq", fq)
        z.writestr("2.fq", ">last\nAC\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = files.read_reads(spark, [str(tmp_path / x) for x in ("a.fq", "b.fa", "c.zip")]).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for f in (0, 1):
        mine = sorted((x.read_idx, x.read_name, x.seq) for x in rows if x.file_idx == f)
        assert [x[1:] for x in mine] == want and len({x[0] for x in mine}) == len(want)
    assert [(x.read_name, x.seq) for x in sorted((x for x in rows if x.file_idx == 2), key=lambda x: x.read_idx)] == [*want, ("last", "AC")]


def test_labels_across_splits(spark, tmp_path):
    p = fasta(tmp_path / "big.fa", ">first\nACGT\n" + "".join(f">\n{'ACGT' * 20}\n" for _ in range(60)) + ">second\nGG\n>\nCC\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        got = sorted((x.record_idx, x.contig) for x in files.read_fasta(spark, files.references(spark, [p])).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [*((i, "first") for i in range(61)), (61, "second"), (62, "second")]


def test_physical_options_are_taken(spark, tmp_path, capsys):
    paths = [fasta(tmp_path / f"ref_{r}.fa", "".join(f">{c}\n{s}\n" for c, s in cs)) for r, cs in REFS.items()]
    out = {n: str(tmp_path / n) for n in ("sketch", "dir", "stat")}
    programs.main(["index", *paths, "-k", "10", "-c", "2", "-t", "4", "-b", "64", "-d", "3", "-s", "3", "-o", out["sketch"], "-f", out["dir"], "-r", out["stat"]])
    assert sorted(x.split("\t")[0] for p in (tmp_path / "stat").glob("part*") for x in p.read_text().splitlines()) == [f"{out['dir']}/ref_{r}.tsv" for r in REFS]
    (tmp_path / "r.fq").write_text("".join(f"@{n}\n{s}\n+\n{'I' * len(s)}\n" for _, _, n, s in READS))
    programs.main(["query", "-l", str(tmp_path / "r.fq"), "-g", out["sketch"], "-t", "2", "-b", "16", "--hit", "1", "-s", "0", "-o", str(tmp_path / "report")])
    assert "references" in capsys.readouterr().out
    for n in (1, 2):
        (tmp_path / f"list{n}").write_text("\n".join(paths) + "\n")
    programs.main(["compare", str(tmp_path / "list1"), str(tmp_path / "list2"), "-k", "10", "-b", "8", "-d", "2", "-g", "100", "-t", "2", "-o", str(tmp_path / "sim")])
    assert len([x for p in (tmp_path / "sim").glob("part*") for x in p.read_text().splitlines() if "ref_" in x]) == 4


def test_malformed_sketch(spark, tmp_path):
    (tmp_path / "bad.tsv").write_text("AGACTGAACT\tzero\tref\t1\tc\t1\n")
    with pytest.raises(Exception):
        files.read_sketch(spark, str(tmp_path / "bad.tsv")).collect()


def test_six_digits(spark):
    xs = [1.0, 0.0, 1 / 3, 2 / 3, 0.5, 0.0000123456789, 123456.7, 1234567.0, 0.1, 0.25, float("nan"), 99999.96, 0.00012345678]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(sinks.six_digits("x")).collect()]
    assert got == [f"{x:.6g}" for x in xs]


def test_stream(spark, tmp_path):
    reads(spark, READS).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("file_idx int, read_idx long, read_name string, seq string").parquet(f"{tmp_path}/in")
    q = stream_counts(stream, sketch(spark), 10).writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(x) for x in spark.table("counts").collect()] == [(0, 3, 3)]
    assert stream_hits(stream, sketch(spark), 10).isStreaming


def test_repeats_and_uniques_add_up(spark):
    r = random.Random(11)
    rows = spark.createDataFrame([(i, "".join(r.choice("ACGT") for _ in range(60))) for i in range(40)], "ref_id int, seq string")
    found = kmers.kmers(rows, 4)
    s = kmers.spectrum(found).first()
    assert s.f0 == index.unique_kmers(found, ["ref_id"]).count() + s.repeats and s.f1 == 40 * 57


def test_solid_stream_in_any_order(spark, tmp_path):
    """Batches that come out of order, a restart between them, and the same rows as all reads at once."""
    r = random.Random(5)
    rows = [(0, i, f"r{i}", "".join(r.choice(["AGACTGAACT", "AGTTCAGTCT", "CTCAGCTAAG", "GG"]) for _ in range(3))) for i in range(40)]
    columns = ["ref_id", "kmer", "file_idx", "read_idx", "read_name", "pos"]
    solid = lambda some: sorted(tuple(x) for x in query.drop_weak(query.match(reads(spark, some), sketch(spark), 10)).select(columns).collect())
    source, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    order = list(range(40))
    r.shuffle(order)
    schema = "file_idx int, read_idx long, read_name string, seq string"
    for part in range(0, 40, 10):  # each round is a stream of its own that goes on from the checkpoint
        reads(spark, [rows[i] for i in order[part : part + 10]]).coalesce(1).write.mode("append").parquet(source)
        stream = streaming.stream_solid_hits(spark.readStream.schema(schema).parquet(source), sketch(spark), 10)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
        assert sorted(tuple(x) for x in spark.read.parquet(out).select(columns).collect()) == solid([rows[i] for i in order[: part + 10]])
    assert solid(rows)


def test_stream_report_merges_batches(spark, tmp_path):
    rows = [(0, i, f"r{i % 900}", "AGACTGAACT" if i % 3 else "CTCAGCTAAG") for i in range(2000)]
    for part in range(4):
        reads(spark, rows[part::4]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("file_idx int, read_idx long, read_name string, seq string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streaming.stream_report(stream_hits(stream, sketch(spark), 10), f"{tmp_path}/sums", f"{tmp_path}/at")
    got = {x.ref: (x.abundance, x["count"], x.approx_reads) for x in streaming.report_so_far(sketch(spark), f"{tmp_path}/sums").collect()}
    exact = query.match(reads(spark, rows), sketch(spark), 10)
    want = {x.ref: (x.abundance, x["count"]) for x in query.report(exact, sketch(spark)).collect()}
    distinct = {f"ref{x.ref_id}": x.reads for x in query.hit_counts(exact).collect()}
    assert {k: v[:2] for k, v in got.items()} == want and all(abs(v[2] - distinct[k]) <= 0.04 * distinct[k] for k, v in got.items())
    assert {x.ref for x in streaming.report_so_far(sketch(spark), f"{tmp_path}/sums", hit_cutoff=1000).collect()} == {"ref0"}


def test_sketch_lines_in_order(spark, tmp_path):
    """The larger file comes later by name; k-mers and names of several lines; an empty sketch."""
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "part-0.tsv").write_text("AGACTGAACT\t5\told\t9\tc\t1\nAGACTGAACT\t2\tb\t9\tc\t1\n")
    (tmp_path / "s" / "part-1.tsv").write_text("".join(f"AGACTGAAC{x}\t2\tb\t9\tc\t1\n" for x in "ACGT") * 50 + "CTCAGCTAAG\t5\tnew\t9\tc\t1\n")
    table = files.read_sketch(spark, str(tmp_path / "s"))
    assert {x.kmer: x.ref_id for x in query.signatures(table, "line_no").collect()}["AGACTGAACT"] == 5
    assert {x.ref_id: x.ref_name for x in query.reference_names(table).collect()} == {5: "new", 2: "b"}
    hits = query.match(reads(spark, READS), table, 10, order_col="line_no")
    assert [tuple(x) for x in query.report(hits, table, hit_cutoff=1, read_cutoff=0).collect()] == [("new", 1.0, 3)]
    assert [tuple(x) for x in query.signature_log(hits, table).collect()] == [("new", 3, "AGACTGAACT", 3)]
    (tmp_path / "r.fq").write_text("@a\nAGACTGAACT\n+\nIIIIIIIIII\n")
    out = programs.query(spark, [str(tmp_path / "r.fq")], sketch(spark, []))
    assert out["report"].count() == 0 and out["log"].count() == 0 and out["metrics"].first().k == 81
    (tmp_path / "list").mkdir()
    (tmp_path / "list" / "part-0").write_text("a\n\n")
    (tmp_path / "list" / "part-1").write_text("".join(f"b{i}\n" for i in range(500)))
    assert files.path_list(spark, str(tmp_path / "list")) == ["a", *(f"b{i}" for i in range(500))]


def test_universe(spark, tmp_path):
    """Extension counts only what is new, equals a count of all, and leaves older generations readable."""
    paths = [fasta(tmp_path / f"ref_{r}.fa", "".join(f">{c}\n{s}\n" for c, s in cs)) for r, cs in REFS.items()]
    store = str(tmp_path / "universe")
    one = universe.create(spark, store, paths[:1], 10, buckets=3)
    assert (one.spectrum().first().f1, one.unique().count()) == (4, 4)
    (tmp_path / "ref_0.fa").rename(tmp_path / "gone.fa")  # what is kept is not read again
    two = universe.opened(spark, store).extend(paths)
    assert two.generation == 1 and {(x.ref_id, x.kmer, x.pos, x.contig) for x in two.unique().collect()} == UNIQUE
    s = universe.opened(spark, store).spectrum().first()
    assert (s.f1, s.f0, s.repeats, s.weak) == (8, 7, 1, 6) and [(x.ref_id, x.ref_name, x.uniq_count) for x in two.counts().orderBy("ref_id").collect()] == [(0, "ref_0", 3), (1, "ref_1", 3)]
    assert universe.opened(spark, store).extend(paths).generation == 1 and one.unique().count() == 4
    plan = one.kmers.join(spark.range(3).selectExpr("string(id) AS kmer", "id AS x").hint("merge"), "kmer", "full")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the kept side is bucketed
    with pytest.raises(ValueError):
        programs.index(spark, paths, k=9, store=store)
    assert not universe.exists(spark, str(tmp_path / "none"))


def test_sketch_of_candidates(spark, tmp_path):
    """Equal base names, a reference without candidates, and a sketch from files that equals the direct one."""
    (tmp_path / "x").mkdir()
    paths = [fasta(d / "same.fa", "".join(f">{c}\n{s}\n" for c, s in cs)) for d, cs in zip((tmp_path, tmp_path / "x"), REFS.values())] + [fasta(tmp_path / "none.fa", ">short\nACG\n")]
    out = {n: str(tmp_path / n) for n in ("sketch", "dir", "stat")}
    programs.main(["index", *paths, "-k", "10", "-c", "2", "-o", out["sketch"], "-f", out["dir"], "-r", out["stat"]])
    counts = files.read_counts(spark, out["stat"])
    assert {(x.ref_id, x.uniq_count) for x in counts.collect()} == {(0, 3), (1, 3), (2, 0)} and all((tmp_path / x.path).is_dir() for x in counts.collect())
    assert {(x.ref_id, x.kmer, x.pos, x.contig) for x in files.read_candidates(spark, counts).collect()} == UNIQUE
    direct = {tuple(x)[:6] for x in files.read_sketch(spark, out["sketch"]).collect()}
    assert {tuple(x) for x in programs.sketch_of_candidates(spark, out["stat"], c=2).collect()} == direct and len(direct) == 4


@pytest.mark.parametrize("bits", [12, 20])
def test_estimated_spectrum(spark, bits):
    r = random.Random(bits)
    pool = ["".join(r.choice("ACGT") for _ in range(120)) for _ in range(300)]
    rows = spark.createDataFrame([(pool[i % 300] if i < 420 else "".join(r.choice("ACGTN") for _ in range(200)),) for i in range(700)] + [(None,), ("",)], "seq string")
    exact = kmers.spectrum(kmers.kmers(rows, 13, keep=[])).first()
    got = kmers.estimated_spectrum(rows, 13, bits=bits).first()
    slack = 0.15 if bits == 12 else 0.01
    assert got.f1 == exact.f1 and all(abs(got[c] - exact[c]) <= slack * exact.f0 for c in ("f0", "repeats", "weak"))
    assert tuple(kmers.estimated_spectrum(rows.where("seq = ''"), 13).first()) == (0, 0, 0, 0)
    wide = kmers.estimated_spectrum(rows, 40).first()
    assert abs(wide.f0 - kmers.spectrum(kmers.kmers(rows, 40, keep=[])).first().f0) <= 0.01 * wide.f0


def test_similarity_of_many_references(spark):
    """K-mers that all hold, that few hold, and names that are text; with blocks of a few rows."""
    r = random.Random(8)
    common = "".join(r.choice("ACGT") for _ in range(40))
    rows = [(f"r{i:03}", common + "".join(r.choice("ACGT") for _ in range(r.randrange(0, 60)))) for i in range(60)]
    mine, other = (spark.createDataFrame(rows[a:b], "ref string, seq string") for a, b in ((0, 40), (20, 60)))
    for f, p in ((mine, mine), (other, mine)):
        fo, po = kmers.kmers(f, 7), kmers.kmers(p, 7)
        fo = po if f is p else fo
        got = {(x.ref1, x.ref2): (x.uniq_ref1, x.all_ref1) for x in compare.similarity(fo, po, f.select("ref"), p.select("ref"), block=50).collect()}
        held = {n: [k for _, k in brute_kmers(s, 7)] for n, s in rows}
        names = [[x.ref for x in d.collect()] for d in (p, f)]
        assert got == {(a, b): (sum(k not in set(held[b]) for k in held[a]), len(held[a])) for a in names[0] for b in names[1]}
    empty = spark.createDataFrame([], "ref string, kmer string")
    assert [tuple(x)[:4] for x in compare.similarity(empty, empty, mine.limit(1).select("ref"), mine.limit(1).select("ref")).collect()] == [("r000", "r000", 0, 0)]


def test_table_function(spark):
    kmers.register(spark)
    rows = [(i, s) for i, s in enumerate(["ACGTTGCA", "acgtn", None, "", "ACG", "TTTTTTTT"])]
    spark.createDataFrame(rows, "id int, seq string").createOrReplaceTempView("some_reads")
    got = spark.sql("SELECT id, pos, kmer FROM some_reads, LATERAL kmers(seq, 5)").collect()
    assert sorted(tuple(x) for x in got) == sorted((i, *x) for i, s in rows for x in brute_kmers(s or "", 5))


@pytest.mark.parametrize("most", [100, 4000, 1 << 17])
def test_hits_and_spectrum_of_one_scan(spark, most):
    r = random.Random(most)
    pool = ["".join(r.choice("ACGT") for _ in range(120)) for _ in range(300)]
    rows = [(0, i, f"r{i}", pool[i % 300] if i < 420 else "".join(r.choice("ACGTN") for _ in range(200))) for i in range(700)] + [(0, 700, "null", None), (0, 701, "none", "")]
    reads = spark.createDataFrame(rows, "file_idx int, read_idx long, read_name string, seq string")
    own = spark.createDataFrame([(i, f"ref{i}", s) for i, s in enumerate(pool[:3])], "ref_id int, ref_name string, seq string")
    sigs = kmers.kmers(own, 13).groupBy("kmer").agg({"ref_id": "min"}).withColumnRenamed("min(ref_id)", "ref_id")
    hits, seen = query.match_and_spectrum(reads, sigs, 13)
    assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, query.match(reads, sigs, 13).collect()))
    exact = kmers.spectrum(kmers.kmers(reads, 13, keep=[])).first()
    assert tuple(seen.first()) == tuple(exact)  # fewer k-mers than a task's sample holds
    told = kmers.kmers_and_sample(reads, 13, keep=["read_name"], among=kmers.membership(sigs, 13, sigs.count()), most=most)
    got = kmers.sampled_spectrum(told.where("hash IS NOT NULL")).first()
    assert told.where("kmer IS NULL").count() <= (most + 1) * reads.rdd.getNumPartitions() and got.repeats + got.weak == got.f0
    slack = {100: 0.4, 4000: 0.06}.get(most, 0)
    assert got.f1 == exact.f1 and all(abs(got[c] - exact[c]) <= slack * exact.f0 for c in ("f0", "repeats", "weak"))
    assert tuple(kmers.sampled_spectrum(told.where("hash IS NOT NULL AND n < 0")).first()) == (0, 0, 0, 0)


def test_one_packed_file_for_all_tasks(spark, tmp_path):
    rows = [(f"r{i}", "ACGT" * (i % 7)) for i in range(200)]
    with gzip.open(tmp_path / "a.fq.gz", "wt") as f:
        f.write("".join(f"@{n}\n{s}\n+\n{'I' * len(s)}\n" for n, s in rows))
    got = files.read_reads(spark, [str(tmp_path / "a.fq.gz")])
    assert got.rdd.getNumPartitions() > 1
    assert [(x.read_name, x.seq) for x in got.orderBy("read_idx").collect()] == rows


def test_folder_of_packed_files_is_read_in_order(spark, tmp_path):
    """Solid hits of reads in the gz files of one folder are those of one file: the files' reads follow each other by name."""
    r = random.Random(5)
    seqs = ["".join(r.choices("ACGT", k=30)) for _ in range(40)]
    rows = [(f"r{i}", r.choice(seqs)) for i in range(300)]
    (tmp_path / "many").mkdir()
    for i in range(0, 300, 25):
        with gzip.open(tmp_path / "many" / f"part-{i:05}.gz", "wt") as f:
            f.write("".join(f"@{n}\n{s}\n+\n{'@' * len(s)}\n" for n, s in rows[i : i + 25]))
    with gzip.open(tmp_path / "one.fq.gz", "wt") as f:
        f.write("".join(f"@{n}\n{s}\n+\n{'@' * len(s)}\n" for n, s in rows))
    sketch = spark.createDataFrame([(min(s[:21], rc(s[:21])), i % 3, f"ref{i % 3}") for i, s in enumerate(seqs)], "kmer string, ref_id int, ref_name string")
    both = [files.read_reads(spark, [str(tmp_path / x)]) for x in ("many", "one.fq.gz")]
    assert [(x.file_idx, x.read_name, x.seq) for x in both[0].orderBy("read_idx").collect()] == [(0, *x) for x in rows]
    many, one = (sorted(tuple(x) for x in query.drop_weak(query.match(x, sketch, 21)).select("kmer", "read_name", "pos").collect()) for x in both)
    assert many == one and len(one) == 300 - len({s for _, s in rows})


def test_reads_are_packed_by_many_tasks(spark):
    """The query programs' reads are not one gz file, which one task would write and read."""
    from sigweave.plans import file_queries

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = file_queries._read_file(spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = spark.read.format("binaryFile").load(path).select("path").collect()
    assert len(found) > 1 and all(x.path.endswith(".gz") for x in found)
