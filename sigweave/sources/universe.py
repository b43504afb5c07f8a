"""A universe of references that is kept: its k-mers are counted once, and later runs read or extend the counts.

Under the universe's path lie, for each generation, its references, the labels of their records,
and one row for every distinct k-mer with its count and the place of its (if unique, only)
occurrence. K-mers are bucketed and sorted by k-mer, so an extension shuffles the k-mers of the new
references only: they meet the kept ones bucket by bucket. A generation counts once its manifest is written, which is last; what a
failed run leaves is never read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.functions.complexity import THRESHOLD
from sigweave.operators.index import build_sketch, unique_counts
from sigweave.operators.kmers import kmers
from sigweave.sources import files

_KMERS = "kmer STRING, n BIGINT, ref_id INT, record_idx BIGINT, pos BIGINT"


@dataclass
class Universe:
    """One generation: k, refs (ref_id, ref_name, path), labels (ref_id, record_idx, contig), kmers (kmer, n, ref_id, record_idx, pos)."""

    spark: SparkSession
    path: str
    k: int
    generation: int
    buckets: int
    refs: DataFrame
    labels: DataFrame
    kmers: DataFrame

    def unique(self) -> DataFrame:
        """(kmer, ref_id, ref_name, contig, record_idx, pos) of the k-mers that occur once."""
        named = self.labels.join(self.refs.select("ref_id", "ref_name"), "ref_id")
        return self.kmers.where("n = 1").join(named, ["ref_id", "record_idx"]).select("kmer", "ref_id", "ref_name", "contig", "record_idx", "pos")

    def counts(self) -> DataFrame:
        """refs with uniq_count."""
        return unique_counts(self.kmers.where("n = 1"), self.refs)

    def sketch(self, *, c: int = 100, threshold: float = THRESHOLD, seed: str = "") -> DataFrame:
        return build_sketch(self.unique(), self.refs, c=c, threshold=threshold, seed=seed)

    def spectrum(self) -> DataFrame:
        """One row: f1, f0, repeats and weak, of the kept counts."""
        repeats = F.count(F.when(F.col("n") > 1, 1))
        return self.kmers.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("f1"), F.count("*").alias("f0"), repeats.alias("repeats"), (F.count("*") - repeats).alias("weak"))

    def extend(self, paths: list[str]) -> Universe:
        """The universe with the references of paths that it does not have yet; only those are read."""
        known = {r["path"] for r in self.refs.select("path").collect()}
        new = [p for p in dict.fromkeys(paths) if p not in known]
        return _added(self, self.spark, self.path, new, self.k, self.buckets) if new else self


def _table(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    """The k-mers of a generation, with their buckets known to Spark in any session."""
    name, place = f"universe_{uuid.uuid4().hex}", path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({_KMERS}) USING parquet CLUSTERED BY (kmer) SORTED BY (kmer) INTO {buckets} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def _opened(spark: SparkSession, path: str, generation: int, k: int, buckets: int, data: str) -> Universe:
    at = f"{path}/{data}"
    refs = spark.read.schema("ref_id int, ref_name string, path string").parquet(f"{at}/refs")
    labels = spark.read.schema("ref_id int, record_idx long, contig string").parquet(f"{at}/labels")
    return Universe(spark, path, k, generation, buckets, refs, labels, _table(spark, f"{at}/kmers", buckets))


def _added(old: Universe | None, spark: SparkSession, path: str, paths: list[str], k: int, buckets: int) -> Universe:
    generation, data = (old.generation + 1 if old else 0), f"generation-{uuid.uuid4().hex}"
    at = f"{path}/{data}"
    base = old.refs.agg(F.coalesce(F.max("ref_id") + 1, F.lit(0))).first()[0] if old else 0
    refs = files.references(spark, paths).withColumn("ref_id", (F.col("ref_id") + base).cast("int"))
    listed = files.Listed(spark, refs)
    labels = files.read_fasta(spark, listed, sequences=False).select("ref_id", "record_idx", "contig")
    found = kmers(files.read_fasta(spark, listed), k, keep=["ref_id", "record_idx"])
    # Numbers ride in a hash aggregate; of a k-mer that occurs once the smallest place is the only one.
    new = found.groupBy("kmer").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("ref_id", "record_idx", "pos")))
    if old:
        refs, labels = old.refs.unionByName(refs), old.labels.unionByName(labels)
        a, b = old.kmers.alias("a"), new.alias("b")
        both = a.join(b, F.col("a.kmer") == F.col("b.kmer"), "full")
        first = lambda c: F.coalesce(f"a.{c}", f"b.{c}").alias(c)
        new = both.select(first("kmer"), (F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"), first("ref_id"), first("record_idx"), first("pos"))
    refs.write.parquet(f"{at}/refs")
    labels.write.parquet(f"{at}/labels")
    name = f"universe_{uuid.uuid4().hex}"
    (new if old else new.repartition(buckets, "kmer")).write.bucketBy(buckets, "kmer").sortBy("kmer").format("parquet").option("path", f"{at}/kmers").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    spark.createDataFrame([(generation, k, buckets, data)], "generation int, k int, buckets int, data string").coalesce(1).write.json(f"{path}/manifest/{generation}")
    return _opened(spark, path, generation, k, buckets, data)


def create(spark: SparkSession, path: str, paths: list[str], k: int, *, buckets: int | None = None) -> Universe:
    """A new universe of FASTA files under path. buckets: default, the session's number of shuffle partitions."""
    return _added(None, spark, path, list(paths), k, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))


def opened(spark: SparkSession, path: str) -> Universe:
    """The last generation under path."""
    last = spark.read.schema("generation int, k int, buckets int, data string").json(f"{path}/manifest/*").orderBy(F.desc("generation")).first()
    if last is None:
        raise ValueError(f"no universe in {path}")
    return _opened(spark, path, last["generation"], last["k"], last["buckets"], last["data"])


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
