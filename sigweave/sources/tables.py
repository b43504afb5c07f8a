"""Tables of text as sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.functions.seq import text_to_bases


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its scan has fewer partitions than that, as a file of one row group; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def benchmark_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as references: ref_id, ref_name, contig, seq."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("int").alias("ref_id"), F.concat(F.lit("item"), F.col("item_id")).alias("ref_name"), F.lit("0").alias("contig"), text_to_bases("text").alias("seq"))


def document_reads(spark: SparkSession, sf_dir: str, ordered: bool = False) -> DataFrame:
    """Documents as reads of one file: file_idx, read_idx, read_name, seq. ordered: sorted by read_idx, as texts, which are turned into bases once after that."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = rows.orderBy("doc_id") if ordered else spread(rows)
    return rows.select(F.lit(0).alias("file_idx"), F.col("doc_id").alias("read_idx"), F.col("doc_id").cast("string").alias("read_name"), text_to_bases("text").alias("seq"))


def document_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records of their sources: ref, doc_id, seq."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(F.col("source").alias("ref"), "doc_id", text_to_bases("text").alias("seq"))
