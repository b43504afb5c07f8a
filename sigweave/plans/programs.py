"""The three programs: index, query and compare, from files to files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.functions.complexity import THRESHOLD
from sigweave.operators import compare as _compare
from sigweave.operators import index as _index
from sigweave.operators import packs
from sigweave.operators import query as _query
from sigweave.functions.seq import base_id
from sigweave.operators.kmers import LONGEST_LONG, kmers, spectrum
from sigweave.sources import files, sinks, universe
from sigweave.sources.shared import new_path, stored

#: Presets of the tools' options. The defaults in `main` are fixed values as well.
INDEX_PRESETS = {"sensitive": 100, "very-sensitive": 1000}
QUERY_PRESETS = {"sensitive": 10, "very-sensitive": 5}
K = 81


def index(spark: SparkSession, paths: list[str], *, k: int = K, c: int = 100, entropy: float = THRESHOLD, seed: str = "", store: str | None = None) -> dict[str, DataFrame]:
    """unique k-mers, counts a reference, the sketch and the spectrum, from FASTA paths and @lists.

    K-mers are counted once, into a universe under store (default: the shared folder); all results read
    it. A store that is there already is extended by the references it lacks, and must have the same k.
    """
    listed, path = files.expand(spark, paths), store or new_path(spark, "universe")
    if store and universe.exists(spark, path):
        kept = universe.opened(spark, path)
        if kept.k != k:
            raise ValueError(f"{path} has k-mers of {kept.k}, not {k}")
        kept = kept.extend(listed)
    else:
        kept = universe.create(spark, path, listed, k)
    return {"refs": kept.refs, "unique": kept.unique(), "counts": kept.counts(), "sketch": kept.sketch(c=c, threshold=entropy, seed=seed), "spectrum": kept.spectrum()}


def sketch_of_candidates(spark: SparkSession, stat: str, *, c: int = 100, entropy: float = THRESHOLD, seed: str = "") -> DataFrame:
    """The sketch from a stat table and the candidate files that it lists; no sequence is read."""
    counts = files.read_counts(spark, stat)
    refs = counts.select("ref_id", base_id("path").alias("ref_name"))
    return _index.build_sketch(files.read_candidates(spark, counts), refs, c=c, threshold=entropy, seed=seed)


def reads_spectrum(rows: DataFrame, k: int, size: int) -> DataFrame:
    """The exact spectrum of reads from files of so many bytes; k-mers that fit a long are dealt out as packed lists."""
    found = kmers(rows, k, keep=[], packed=True)
    return packs.spectrum(found, k, packs.bucket_bits(size, k)) if k <= LONGEST_LONG else spectrum(found)


def query(spark: SparkSession, reads: list[str], sketch: DataFrame, *, hit: int = 10, acutoff: float = 0.0, rcutoff: int = 2, solid: bool = False, estimate: bool = False, keep: bool = False) -> dict[str, DataFrame]:
    """The report and the log of reads (r1, or r1 and r2) against a sketch, and metrics; k is the length of its first k-mer.

    metrics: k, references, sketch (signatures), f1, f0, repeats (solid k-mers) and weak of the reads; estimate:
    the last three from samples that the scan for hits takes along, so the reads are read once and their k-mers not shuffled.
    keep: hits are stored first, for when several results are asked for; with estimate they always are. An empty sketch has no hits, and the k of the
    tools' default.
    """
    ordered = "line_no" in sketch.columns
    length = sketch.agg((F.min_by(F.length("kmer"), "line_no") if ordered else F.max(F.length("kmer"))).alias("k")).first()["k"]
    k = K if length is None else length
    rows = files.read_reads(spark, reads)
    order_col = "line_no" if ordered else None
    if estimate:
        hits, seen = _query.match_and_spectrum(rows, sketch, k, order_col=order_col)
    else:
        hits, seen = _query.match(rows, sketch, k, order_col=order_col), reads_spectrum(rows, k, files.total_bytes(spark, reads))
    if keep:
        hits = stored(hits, "hits")
    size = sketch.agg(F.lit(k).alias("k"), F.count_distinct("ref_id").alias("references"), F.count_distinct("kmer").alias("sketch"))
    metrics = size.join(seen, F.lit(True))
    return {"hits": hits, "report": _query.report(hits, sketch, hit_cutoff=hit, read_cutoff=rcutoff, abundance_cutoff=acutoff, solid=solid), "log": _query.signature_log(hits, sketch, solid=solid), "metrics": metrics}


def compare(spark: SparkSession, filters: list[str], probes: list[str], *, k: int = K) -> DataFrame:
    """Similarity of every probe file to every filter file."""

    def side(paths: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
        refs = files.references(spark, paths)
        # Equal base names stay apart by their numbers until the rows are named.
        return kmers(files.read_fasta(spark, refs), k, keep=["ref_id"], packed=True).select(F.col("ref_id").alias("ref"), "kmer"), refs.select(F.col("ref_id").alias("ref")), refs

    a, a_refs, a_names = side(filters)
    b, b_refs, b_names = side(probes)
    out = _compare.similarity(a, b, a_refs, b_refs).withColumnsRenamed({"ref1": "_1", "ref2": "_2"})
    named = out.join(b_names.select(F.col("ref_id").alias("_1"), F.col("ref_name").alias("ref1")), "_1").join(a_names.select(F.col("ref_id").alias("_2"), F.col("ref_name").alias("ref2")), "_2")
    return named.select("ref1", "ref2", "uniq_ref1", "all_ref1", "similarity")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="sigweave", conflict_handler="resolve")
    sub = p.add_subparsers(dest="program", required=True)
    i = sub.add_parser("index")
    i.add_argument("paths", nargs="+")
    i.add_argument("-k", "--kmer", type=int, default=K)
    i.add_argument("-c", "--cov", type=int, default=100)
    i.add_argument("-e", "--entropy", type=float, default=THRESHOLD)
    i.add_argument("-o", "--out", default="sketch_uniq.tsv")
    i.add_argument("-f", "--outdir", default="outdir_index")
    i.add_argument("-r", "--stat", default="db_uniq_count.tsv")
    i.add_argument("-u", "--universe", help="keep the counted k-mers here, or extend those that are there")
    q = sub.add_parser("query", conflict_handler="resolve")
    q.add_argument("-l", "--r1", required=True)
    q.add_argument("-r", "--r2")
    q.add_argument("-g", "--ref", required=True)
    q.add_argument("-h", "--hit", type=int, default=10)
    q.add_argument("-a", "--acutoff", type=float, default=0.0)
    q.add_argument("-s", "--rcutoff", type=int, default=2)
    q.add_argument("--solid", action="store_true")
    q.add_argument("--estimate", action="store_true", help="metrics of the reads as estimates")
    q.add_argument("-o", "--out", default="out_sketch.tsv")
    for one, name in ((i, "cov"), (q, "hit")):
        for preset, value in (INDEX_PRESETS if name == "cov" else QUERY_PRESETS).items():
            one.add_argument(f"--{preset}", dest=name, action="store_const", const=value)
    c = sub.add_parser("compare")
    c.add_argument("list1")
    c.add_argument("list2")
    c.add_argument("-k", "--kmer", type=int, default=K)
    c.add_argument("-o", "--out", default="reference_similarity.tsv")
    # Sizes of filters and threads: taken, so that old command lines run, and without effect on exact results in Spark.
    for one, flags in ((i, ("-b --bits", "-d --hash1", "-s --hash2", "-t --threads")), (q, ("-b --bit", "-t --threads")), (c, ("-b --bits", "-d --hash", "-g --gsize", "-t --threads"))):
        for flag in flags:
            one.add_argument(*flag.split(), type=int, help=argparse.SUPPRESS, dest=f"unused{flag[:2]}")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.program == "index":
        got = index(spark, a.paths, k=a.kmer, c=a.cov, entropy=a.entropy, store=a.universe)
        sinks.write_candidates(got["unique"], a.outdir)
        sinks.write_counts(got["counts"].drop("path").join(sinks.name_candidates(got["refs"], a.outdir), "ref_id"), a.stat)
        sinks.write_sketch(got["sketch"], a.out)
        got["spectrum"].show()
    elif a.program == "query":
        got = query(spark, [x for x in (a.r1, a.r2) if x], files.read_sketch(spark, a.ref), hit=a.hit, acutoff=a.acutoff, rcutoff=a.rcutoff, solid=a.solid, estimate=a.estimate, keep=True)
        head, _, name = a.out.rpartition("/")
        got["metrics"].show()
        sinks.write_report(got["report"], a.out)
        sinks.write_signature_log(got["log"], f"{head + '/' if head else ''}log_{name}")
    else:
        sinks.write_similarity(compare(spark, files.path_list(spark, a.list1), files.path_list(spark, a.list2), k=a.kmer), a.out)


if __name__ == "__main__":
    main()
