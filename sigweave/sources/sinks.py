"""Tab-separated files in the layouts of the command-line tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def six_digits(x: Column | str) -> Column:
    """A double as text with six significant digits, without trailing zeros."""
    x = F.col(x) if isinstance(x, str) else x
    digits = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(x))))
    fixed = F.regexp_replace(F.format_string("%.12f", F.round(x * F.pow(F.lit(10.0), 5 - digits)) / F.pow(F.lit(10.0), 5 - digits)), r"\.?0+$", "")
    power = F.format_string("%.5e", x)
    short = F.concat(F.regexp_replace(F.substring_index(power, "e", 1), r"\.?0+$", ""), F.lit("e"), F.substring_index(power, "e", -1))
    return F.when(F.isnan(x), "nan").when(x == 0, "0").when((digits < -4) | (digits > 5), short).otherwise(fixed)


def _write(df: DataFrame, path: str, header: bool, one_file: bool) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").csv(path, sep="\t", header=header, quote="", emptyValue="", nullValue="")


def write_candidates(unique: DataFrame, path: str) -> None:
    """kmer, pos, contig in one folder a reference id; equal names do not collide."""
    unique.select("ref_id", "kmer", "pos", "contig").write.mode("overwrite").partitionBy("ref_id").csv(path, sep="\t", quote="")


def name_candidates(refs: DataFrame, path: str) -> DataFrame:
    """Give the folders of `write_candidates` the names <ref_name>.tsv, and references without candidates an empty one; (ref_id, path).

    Of equal names each after the first lies in a folder of its id. A rename or folder is one call to the file system for each reference, from the driver.
    """
    spark = refs.sparkSession
    jvm, taken, placed = spark._jvm.org.apache.hadoop.fs, set(), []
    root = jvm.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for r in refs.select("ref_id", "ref_name").orderBy("ref_id").collect():
        to = f"{path}/{r['ref_name']}.tsv" if r["ref_name"] not in taken else f"{path}/{r['ref_id']}/{r['ref_name']}.tsv"
        taken.add(r["ref_name"])
        made, place = jvm.Path(f"{path}/ref_id={r['ref_id']}"), jvm.Path(to)
        fs.mkdirs(place.getParent())
        if not (fs.rename(made, place) if fs.exists(made) else fs.mkdirs(place)):
            raise OSError(f"{to} cannot be made")
        placed.append((r["ref_id"], to))
    return spark.createDataFrame(placed, "ref_id int, path string")


def write_counts(counts: DataFrame, path: str) -> None:
    _write(counts.orderBy("ref_id").select("path", "uniq_count", "ref_id"), path, False, True)


def write_sketch(sketch: DataFrame, path: str) -> None:
    _write(sketch.select("kmer", "ref_id", "ref_name", "num_refs", "contig", "pos"), path, False, False)


def write_report(report: DataFrame, path: str) -> None:
    """With a header even without rows, the most hits first."""
    _write(report.select("ref", six_digits("abundance").alias("abundance"), "count"), path, True, True)


def write_signature_log(log: DataFrame, path: str) -> None:
    _write(log.select("ref", "total_reads", "signature", "count"), path, True, False)


def write_similarity(pairs: DataFrame, path: str) -> None:
    _write(pairs.select("ref1", "ref2", "uniq_ref1", "all_ref1", six_digits("similarity").alias("similarity")), path, True, False)
