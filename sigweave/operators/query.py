"""The query side: reads against a sketch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigweave.operators.kmers import kmers, kmers_and_sample, membership, sampled_spectrum
from sigweave.sources.shared import stored

#: Bytes of signatures up to which they are broadcast to the hits; above, candidates and signatures are shuffled.
BROADCAST_BYTES = 64 << 20


def signatures(sketch: DataFrame, order_col: str | None = None) -> DataFrame:
    """(kmer, ref_id): of a k-mer with several rows the first counts, by order_col or else the smallest reference."""
    first = F.min_by("ref_id", order_col) if order_col else F.min("ref_id")
    return sketch.groupBy("kmer").agg(first.alias("ref_id"))


def reference_names(refs: DataFrame) -> DataFrame:
    """(ref_id, ref_name), a row an id: of several names the last counts, by line_no where there is one, else the largest."""
    last = F.max_by("ref_name", "line_no") if "line_no" in refs.columns else F.max("ref_name")
    return refs.groupBy("ref_id").agg(last.alias("ref_name"))


_READ = ["file_idx", "read_idx", "read_name"]


def _measured(sketch: DataFrame, order_col: str | None, broadcast_bytes: int) -> tuple[DataFrame, int, DataFrame]:
    """The signatures, computed once, their number, and how to join them."""
    sig = stored(signatures(sketch, order_col), "signatures")
    seen = sig.agg(F.count("*").alias("n"), F.sum(F.octet_length("kmer") + 40).alias("size")).first()
    return sig, seen["n"], F.broadcast(sig) if (seen["size"] or 0) <= broadcast_bytes else sig


def match(reads: DataFrame, sketch: DataFrame, k: int, *, order_col: str | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row a hit: ref_id, kmer, file_idx, read_idx, read_name, pos.

    reads: file_idx, read_idx, read_name, seq. The signatures are computed once and measured.
    A bitmap of their hashes, of bounded size, goes to the reads, where nearly all other
    k-mers end before they become rows; what is left joins the signatures themselves.
    """
    sig, n, joined = _measured(sketch, order_col, broadcast_bytes)
    return kmers(reads, k, keep=_READ, among=membership(sig, k, n)).join(joined, "kmer").select("ref_id", "kmer", *_READ, "pos")


def match_and_spectrum(reads: DataFrame, sketch: DataFrame, k: int, *, order_col: str | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, DataFrame]:
    """The hits of `match`, and an estimate of the reads' spectrum (`kmers.sampled_spectrum`), from one scan of the reads.

    The scan's few k-mers that pass the bitmap and its tasks' samples are one table in the shared folder, which both results read.
    """
    sig, n, joined = _measured(sketch, order_col, broadcast_bytes)
    scanned = stored(kmers_and_sample(reads, k, keep=_READ, among=membership(sig, k, n)), "scan")
    hits = scanned.where("kmer IS NOT NULL").join(joined, "kmer").select("ref_id", "kmer", *_READ, "pos")
    return hits, sampled_spectrum(scanned.where("hash IS NOT NULL").select("hash", "n", "level"))


def drop_weak(hits: DataFrame) -> DataFrame:
    """Hits without the first occurrence of each k-mer, by file, read and position.

    A k-mer's first place is an aggregate that is combined before the shuffle, and hot k-mers
    meet it in a join that Spark can split; no window gathers a k-mer's hits. Hits are stored, so reads are not cut twice.
    Hits without a k-mer are left out, as a null equals nothing.
    """
    place, hits = F.struct("file_idx", "read_idx", "pos"), stored(hits, "hits")
    first = hits.groupBy("kmer").agg(F.min(place).alias("_first"))
    return hits.join(first, "kmer").where(place != F.col("_first")).drop("_first")


def hit_counts(hits: DataFrame, *, solid: bool = False) -> DataFrame:
    """(ref_id, count, reads) of references with a hit; solid: weak hits dropped, one added back to each reference that is left.

    One pass: hits are summed by reference and read name, and those sums by reference.
    """
    each = (drop_weak(hits) if solid else hits).groupBy("ref_id", "read_name").agg(F.count("*").alias("_hits"))
    return each.groupBy("ref_id").agg((F.sum("_hits") + (1 if solid else 0)).alias("count"), F.count("*").alias("reads"))


def shares(counts: DataFrame, *, hit_cutoff: int, read_cutoff: int, abundance_cutoff: float) -> DataFrame:
    """(ref_id, count, reads) that pass the cutoffs of `report`, with abundance."""
    if read_cutoff < 0:
        raise ValueError("read_cutoff must not be negative")
    kept = counts.where((F.col("count") >= hit_cutoff) & (F.col("reads") > read_cutoff))
    return kept.withColumn("abundance", F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(0)))).where(F.col("abundance") > abundance_cutoff)


def report(hits: DataFrame, refs: DataFrame, *, hit_cutoff: int = 10, read_cutoff: int = 2, abundance_cutoff: float = 0.0, solid: bool = False) -> DataFrame:
    """(ref, abundance, count), the most hits first.

    References need count >= hit_cutoff and more than read_cutoff distinct reads; the
    abundance is their share of the hits of all such references; those of at most
    abundance_cutoff are then left out, without a new total. Ties are in the order of ids. refs: ref_id, ref_name
    and, if there is one, line_no; an id with several names has the last, and one without a name has no row.
    """
    kept = shares(hit_counts(hits, solid=solid), hit_cutoff=hit_cutoff, read_cutoff=read_cutoff, abundance_cutoff=abundance_cutoff)
    return kept.join(reference_names(refs), "ref_id").orderBy(F.desc("count"), "ref_id").select(F.col("ref_name").alias("ref"), "abundance", "count")


def signature_log(hits: DataFrame, refs: DataFrame, *, solid: bool = False) -> DataFrame:
    """(ref, total_reads, signature, count) of every signature with a hit; solid counts get nothing added back."""
    hits = drop_weak(hits) if solid else hits
    each = hits.groupBy("ref_id", "kmer").agg(F.count("*").alias("count"))
    reads = hits.select("ref_id", "read_name").distinct().groupBy("ref_id").agg(F.count("*").alias("total_reads"))
    return each.join(reads, "ref_id").join(reference_names(refs), "ref_id").select(F.col("ref_name").alias("ref"), "total_reads", F.col("kmer").alias("signature"), "count")
