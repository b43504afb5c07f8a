"""The index side: k-mers that occur once in the whole universe, and the sketch sampled from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigweave.functions.complexity import THRESHOLD, is_low_complexity


def unique_kmers(occurrences: DataFrame, payload: list[str]) -> DataFrame:
    """K-mers of total multiplicity 1, with the payload columns of their only occurrence.

    Twice within one reference is not unique. One shuffle: the payload rides along in the
    aggregate, since of a k-mer that occurs once the smallest payload is the only one. Payloads
    of numbers alone are aggregated by hash; with strings Spark has to sort.
    """
    one = occurrences.groupBy("kmer").agg(F.count("*").alias("_n"), *(F.min(c).alias(c) for c in payload)).where("_n = 1")
    return one.select("kmer", *payload)


def unique_counts(unique: DataFrame, refs: DataFrame, ref_col: str = "ref_id") -> DataFrame:
    """refs with uniq_count; 0 for references without candidates."""
    counts = unique.groupBy(ref_col).agg(F.count("*").alias("uniq_count"))
    return refs.join(counts, ref_col, "left").withColumn("uniq_count", F.coalesce("uniq_count", F.lit(0).cast("long")))


def build_sketch(unique: DataFrame, refs: DataFrame, *, c: int = 100, threshold: float = THRESHOLD, seed: str = "") -> DataFrame:
    """Up to c signatures a reference that are not of low complexity, in the order of md5(kmer + seed).

    unique: kmer, ref_id, contig, pos; refs: ref_id, ref_name. The order is a fixed shuffle:
    the same for every run and every partitioning. Spark keeps c rows a reference in each
    task before it shuffles, so a reference of any size costs c rows a task.
    """
    passing = unique.select("kmer", "ref_id", "contig", "pos").where(~is_low_complexity("kmer", threshold))
    order = Window.partitionBy("ref_id").orderBy(F.md5(F.concat("kmer", F.lit(seed))), "kmer")
    chosen = passing.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= c)
    names = refs.select("ref_id", "ref_name").crossJoin(refs.agg(F.count("*").cast("int").alias("num_refs")))
    return chosen.join(names, "ref_id").select("kmer", "ref_id", "ref_name", "num_refs", "contig", "pos")
