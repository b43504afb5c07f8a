"""Queries over the driver's tables, and the same in SQL.

Benchmark items play references, documents play reads, and documents by source play the two
lists of the comparison. Every query covers its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigweave.functions.complexity import THRESHOLD, entropy_score, is_low_complexity
from sigweave.functions.seq import base_id, complement, contig_label, reverse_complement
from sigweave.operators import packs
from sigweave.operators.compare import similarity
from sigweave.operators.index import build_sketch, unique_counts, unique_kmers
from sigweave.operators.kmers import estimated_spectrum, histogram, kmers, membership, multiplicities, register, spectrum
from sigweave.operators.query import drop_weak, hit_counts, match, report, signature_log
from sigweave.sources.shared import stored
from sigweave.sources.tables import benchmark_refs, document_reads, document_sources, table

K = 21


def _ref_kmers(spark: SparkSession, d: str) -> DataFrame:
    return kmers(benchmark_refs(spark, d), K)


def _unique(spark: SparkSession, d: str) -> DataFrame:
    found = unique_kmers(_ref_kmers(spark, d), ["ref_id", "pos"])
    return found.join(benchmark_refs(spark, d).select("ref_id", "ref_name", "contig"), "ref_id")


def _numbered_sources(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The sources (ref_id, ref), and packed k-mers with ref_id: numbers take less of an exchange than names and ride in hash aggregates."""
    names = stored(table(spark, d, "documents").select(F.col("source").alias("ref")).distinct().withColumn("ref_id", F.row_number().over(Window.orderBy("ref"))), "names")
    return names, kmers(document_sources(spark, d).join(names, "ref").select("ref_id", "seq"), K, packed=True).drop("pos")


def _bits(spark: SparkSession, d: str) -> int:
    """Bits of a bucket's number for the documents' k-mers, of which there are at most as many as bytes."""
    return packs.bucket_bits(table(spark, d, "documents").agg(F.sum(F.octet_length("text"))).first()[0] or 0, K)


def _source_kmers(spark: SparkSession, d: str, keep: list[str] | None = None) -> DataFrame:
    """Packed: two bits a base, as nobody asks for the letters."""
    return kmers(document_sources(spark, d), K, keep=keep or [], packed=True)


def _sketch(spark: SparkSession, d: str) -> DataFrame:
    return build_sketch(_unique(spark, d), benchmark_refs(spark, d), c=100)


def _all_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Every unique k-mer of the references, for a dense index."""
    return _unique(spark, d).select("kmer", "ref_id", "ref_name")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return match(document_reads(spark, d), _all_signatures(spark, d), K)


def kmer_counts_per_doc(spark: SparkSession, d: str) -> DataFrame:
    return kmers(document_sources(spark, d), K, keep=["doc_id"], canonicalise=False, packed=True).groupBy("doc_id").agg(F.count("*").alias("kmers"))


def canonical_kmers(spark: SparkSession, d: str) -> DataFrame:
    return _ref_kmers(spark, d).select("ref_id", "pos", "kmer")


def strand_functions(spark: SparkSession, d: str) -> DataFrame:
    refs = benchmark_refs(spark, d)
    return refs.select("ref_id", complement("seq").alias("complement"), reverse_complement("seq").alias("reverse_complement"))


def base_ids(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return pages.select("page_id", base_id("url").alias("base_id"), contig_label(F.concat(F.col("url"), F.lit(" a b"))).alias("label"))


def kmer_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return spectrum(_source_kmers(spark, d))


def kmer_histogram(spark: SparkSession, d: str) -> DataFrame:
    return histogram(_source_kmers(spark, d))


def weak_kmers(spark: SparkSession, d: str) -> DataFrame:
    """Of each source, the k-mers that occur once in the universe, and those that occur again."""
    names, found = _numbered_sources(spark, d)
    each = packs.weak_by_ref(found.withColumnRenamed("ref_id", "ref"), K, _bits(spark, d)).withColumnRenamed("ref", "ref_id")
    return names.join(each, "ref_id").select("ref", "weak", (F.col("distinct") - F.col("weak")).alias("repeated"))


def unique_kmers_of_refs(spark: SparkSession, d: str) -> DataFrame:
    return _unique(spark, d).select("kmer", "ref_id", "pos", "contig")


def unique_count_per_source(spark: SparkSession, d: str) -> DataFrame:
    """Uniqueness is over all occurrences: twice in one source is not unique."""
    names, found = _numbered_sources(spark, d)
    return unique_counts(unique_kmers(found, ["ref_id"]), names, "ref_id").select("ref", "uniq_count")


def unique_count_per_ref(spark: SparkSession, d: str) -> DataFrame:
    return unique_counts(_unique(spark, d), benchmark_refs(spark, d).select("ref_id")).select("ref_id", "uniq_count")


def entropy_scores(spark: SparkSession, d: str) -> DataFrame:
    return _unique(spark, d).select("kmer", F.round(entropy_score("kmer"), 6).alias("score"))


def low_complexity(spark: SparkSession, d: str) -> DataFrame:
    scored = _unique(spark, d).select("ref_id", is_low_complexity("kmer", 0.8).alias("low"))
    return scored.groupBy("ref_id").agg(F.count(F.when(F.col("low"), 1)).alias("low"), F.count(F.when(~F.col("low"), 1)).alias("passing"))


def sketch_topc(spark: SparkSession, d: str) -> DataFrame:
    return build_sketch(_unique(spark, d), benchmark_refs(spark, d), c=20)


def sketch_hits_per_ref(spark: SparkSession, d: str) -> DataFrame:
    return hit_counts(_hits(spark, d))


def sketch_hits_solid(spark: SparkSession, d: str) -> DataFrame:
    return hit_counts(_hits(spark, d), solid=True)


def solid_hits(spark: SparkSession, d: str) -> DataFrame:
    return drop_weak(_hits(spark, d)).select("ref_id", "kmer", "read_idx", "pos")


def reads_per_ref(spark: SparkSession, d: str) -> DataFrame:
    hits = match(document_reads(spark, d), _sketch(spark, d), K)
    return hit_counts(hits).select("ref_id", "reads")


def abundance_report(spark: SparkSession, d: str) -> DataFrame:
    refs = benchmark_refs(spark, d).select("ref_id", "ref_name")
    return report(_hits(spark, d), refs, hit_cutoff=10, read_cutoff=0)


def abundance_report_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    refs = benchmark_refs(spark, d).select("ref_id", "ref_name")
    return report(_hits(spark, d), refs, hit_cutoff=100, read_cutoff=0, abundance_cutoff=0.25, solid=True)


def signature_counts(spark: SparkSession, d: str) -> DataFrame:
    return signature_log(_hits(spark, d), benchmark_refs(spark, d).select("ref_id", "ref_name"))


def similarity_matrix(spark: SparkSession, d: str) -> DataFrame:
    names, found = _numbered_sources(spark, d)
    occ, refs = found.withColumnRenamed("ref_id", "ref"), names.select(F.col("ref_id").alias("ref"))
    one, two = (names.select(F.col("ref_id").alias(f"ref{i}"), F.col("ref").alias(f"name{i}")) for i in (1, 2))
    return similarity(occ, occ, refs, refs, packed=(K, _bits(spark, d))).join(one, "ref1").join(two, "ref2").select(F.col("name1").alias("ref1"), F.col("name2").alias("ref2"), "uniq_ref1", "all_ref1", "similarity")


def kmer_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    """Multiplicity of the references' k-mers in the documents and in the references."""
    mine = stored(multiplicities(_ref_kmers(spark, d)).withColumnRenamed("n", "in_refs"), "multiplicities")
    seqs = document_sources(spark, d)
    docs = multiplicities(kmers(seqs, K, keep=[], among=membership(mine, K, mine.count()))).withColumnRenamed("n", "in_docs")
    return mine.join(docs, "kmer", "left").select("kmer", "in_refs", F.coalesce("in_docs", F.lit(0).cast("long")).alias("in_docs"))


def spectrum_estimate(spark: SparkSession, d: str) -> DataFrame:
    """The exact number of k-mers, and whether the estimates of distinct, repeated and single ones are within 1 % of f0 of the exact counts."""
    seqs = document_sources(spark, d).select("seq")
    near = lambda c: (F.abs(F.col(f"e.{c}") - F.col(f"x.{c}")) <= 0.01 * F.col("x.f0")).alias(f"{c}_within_1_percent")
    both = estimated_spectrum(seqs, K).alias("e").join(spectrum(kmers(seqs, K, keep=[], packed=True)).alias("x"), F.lit(True))
    return both.select(F.col("e.f1").alias("f1"), near("f0"), near("repeats"), near("weak"))


def kmers_in_sql(spark: SparkSession, d: str) -> DataFrame:
    """The references' k-mers by a table function, in SQL."""
    register(spark, "sigweave_kmers")
    benchmark_refs(spark, d).createOrReplaceTempView("sigweave_refs")
    return spark.sql(f"SELECT ref_id, pos, kmer FROM sigweave_refs, LATERAL sigweave_kmers(seq, {K})")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return abundance_report(spark, d)


QUERIES = {
    f.__name__: f
    for f in (
        kmer_counts_per_doc, canonical_kmers, strand_functions, base_ids, kmer_spectrum, kmer_histogram, weak_kmers, kmer_multiplicity, unique_kmers_of_refs,
        unique_count_per_source, unique_count_per_ref, entropy_scores, low_complexity, sketch_topc, sketch_hits_per_ref, sketch_hits_solid, solid_hits,
        reads_per_ref, abundance_report, abundance_report_cutoffs, signature_counts, similarity_matrix, spectrum_estimate, kmers_in_sql,
    )
}

_BASES = "'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', '" + (("ACGT" * 7)[:26]) * 2 + "'"


def _seq(col: str) -> str:
    return rf"regexp_replace(translate(regexp_replace({col}, '[ \n\t.,]+', '', 'g'), {_BASES}), '[^ACGT]', 'N', 'g')"


def _kmers_of(name: str, table: str, cols: str, seq: str) -> str:
    """Common table expressions: name_raw (windows) and name (valid canonical k-mers)."""
    return f"""{name}_raw AS (SELECT *, substr(seq, p + 1, {K}) AS w FROM (SELECT *, unnest(range(0, length(seq) - {K - 1})) AS p FROM (SELECT {cols}, {seq} AS seq FROM {table}))),
{name} AS (SELECT * EXCLUDE (seq, w, p), p::BIGINT AS pos, least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer FROM {name}_raw WHERE NOT regexp_matches(w, '[^ACGT]'))"""


_REFS = _kmers_of("r", "benchmark", "item_id::INT AS ref_id, 'item' || item_id AS ref_name, '0' AS contig", _seq("text"))
_DOCS = _kmers_of("d", "documents", "source AS ref, doc_id", _seq("text"))
_UNIQUE = f"""{_REFS},
u AS (SELECT kmer, any_value(ref_id) AS ref_id, any_value(ref_name) AS ref_name, any_value(contig) AS contig, any_value(pos) AS pos FROM r GROUP BY kmer HAVING count(*) = 1)"""
_SCORED = f"""{_UNIQUE},
m AS (SELECT kmer, j, substr(kmer, p, j) AS mer, count(*) AS c FROM (SELECT kmer, j, unnest(range(1, {K} - j + 2)) AS p FROM u, (SELECT unnest([1, 2, 3, 4, 5]) AS j)) GROUP BY ALL),
e AS (SELECT kmer, sum(-(c::DOUBLE / ({K} - j + 1)) * log2(c::DOUBLE / ({K} - j + 1))) / (12 + log2({K} - 3) + log2({K} - 4)) AS score FROM m GROUP BY kmer)"""
_HITS = f"""{_UNIQUE}, {_DOCS},
h AS (SELECT u.ref_id, u.ref_name, kmer, doc_id AS read_idx, pos FROM (SELECT doc_id, pos, kmer FROM d) JOIN (SELECT kmer, ref_id, ref_name FROM u) u USING (kmer)),
s AS (SELECT * EXCLUDE (o) FROM (SELECT *, row_number() OVER (PARTITION BY kmer ORDER BY read_idx, pos) AS o FROM h) WHERE o > 1)"""
_TOPC = "t AS (SELECT kmer, ref_id, ref_name, contig, pos FROM (SELECT u.*, row_number() OVER (PARTITION BY ref_id ORDER BY md5(kmer), kmer) AS o FROM u JOIN e USING (kmer) WHERE score > {threshold}) WHERE o <= {c})"


def _counts(hits: str, more: int) -> str:
    return f"c AS (SELECT ref_id, any_value(ref_name) AS ref_name, count(*) + {more} AS count, count(DISTINCT read_idx) AS reads FROM {hits} GROUP BY ref_id)"


ORACLES = {
    "kmer_counts_per_doc": f"WITH {_DOCS} SELECT doc_id, count(*) AS kmers FROM d GROUP BY doc_id",
    "canonical_kmers": f"WITH {_REFS} SELECT ref_id, pos, kmer FROM r",
    "strand_functions": f"SELECT item_id::INT AS ref_id, translate({_seq('text')}, 'ACGT', 'TGCA') AS complement, reverse(translate({_seq('text')}, 'ACGT', 'TGCA')) AS reverse_complement FROM benchmark",
    "base_ids": r"SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]*$', '') AS base_id, replace(url || ' a b', ' ', '_') AS label FROM pages",
    "kmer_spectrum": f"WITH {_DOCS}, n AS (SELECT count(*) AS n FROM d GROUP BY kmer) SELECT sum(n)::BIGINT AS f1, count(*) AS f0, count(*) FILTER (n > 1) AS repeats, count(*) FILTER (n = 1) AS weak FROM n",
    "kmer_histogram": f"WITH {_DOCS}, n AS (SELECT count(*) AS n FROM d GROUP BY kmer) SELECT n, count(*) AS kmers FROM n GROUP BY n",
    "weak_kmers": f"WITH {_DOCS}, n AS (SELECT ref, kmer, sum(count(*)) OVER (PARTITION BY kmer) AS n FROM d GROUP BY ref, kmer) SELECT ref, count(*) FILTER (n = 1) AS weak, count(*) FILTER (n > 1) AS repeated FROM n GROUP BY ref",
    "kmer_multiplicity": f"WITH {_REFS}, {_DOCS} SELECT kmer, in_refs, coalesce(in_docs, 0) AS in_docs FROM (SELECT kmer, count(*) AS in_refs FROM r GROUP BY kmer) LEFT JOIN (SELECT kmer, count(*) AS in_docs FROM d GROUP BY kmer) USING (kmer)",
    "unique_kmers_of_refs": f"WITH {_UNIQUE} SELECT kmer, ref_id, pos, contig FROM u",
    "unique_count_per_source": f"WITH {_DOCS}, n AS (SELECT any_value(ref) AS ref FROM d GROUP BY kmer HAVING count(*) = 1), c AS (SELECT ref, count(*) AS n FROM n GROUP BY ref) SELECT x.ref, coalesce(c.n, 0) AS uniq_count FROM (SELECT DISTINCT source AS ref FROM documents) x LEFT JOIN c ON c.ref = x.ref",
    "unique_count_per_ref": f"WITH {_UNIQUE}, c AS (SELECT ref_id, count(*) AS n FROM u GROUP BY ref_id) SELECT item_id::INT AS ref_id, coalesce(n, 0) AS uniq_count FROM benchmark LEFT JOIN c ON c.ref_id = item_id",
    "entropy_scores": f"WITH {_SCORED} SELECT kmer, round(score, 6) AS score FROM e",
    "low_complexity": f"WITH {_SCORED} SELECT ref_id, count(*) FILTER (score <= 0.8) AS low, count(*) FILTER (score > 0.8) AS passing FROM u JOIN e USING (kmer) GROUP BY ref_id",
    "sketch_topc": f"WITH {_SCORED}, {_TOPC.format(threshold=THRESHOLD, c=20)} SELECT kmer, ref_id, ref_name, (SELECT count(*) FROM benchmark)::INT AS num_refs, contig, pos FROM t",
    "sketch_hits_per_ref": f"WITH {_HITS}, {_counts('h', 0)} SELECT ref_id, count, reads FROM c",
    "sketch_hits_solid": f"WITH {_HITS}, {_counts('s', 1)} SELECT ref_id, count, reads FROM c",
    "solid_hits": f"WITH {_HITS} SELECT ref_id, kmer, read_idx, pos FROM s",
    "reads_per_ref": f"WITH {_SCORED}, {_TOPC.format(threshold=THRESHOLD, c=100)}, {_DOCS} SELECT t.ref_id, count(DISTINCT doc_id) AS reads FROM d JOIN t ON t.kmer = d.kmer GROUP BY t.ref_id",
    "abundance_report": f"WITH {_HITS}, {_counts('h', 0)} SELECT ref_name AS ref, count / sum(count) OVER () AS abundance, count FROM c WHERE count >= 10 AND reads > 0",
    "abundance_report_cutoffs": f"WITH {_HITS}, {_counts('s', 1)}, a AS (SELECT ref_name AS ref, count / sum(count) OVER () AS abundance, count FROM c WHERE count >= 100 AND reads > 0) SELECT * FROM a WHERE abundance > 0.25",
    "signature_counts": f"WITH {_HITS}, {_counts('h', 0)} SELECT c.ref_name AS ref, reads AS total_reads, kmer AS signature, x.count FROM (SELECT ref_id, kmer, count(*) AS count FROM h GROUP BY ALL) x JOIN c ON c.ref_id = x.ref_id",
    "spectrum_estimate": f"WITH {_DOCS} SELECT count(*) AS f1, true AS f0_within_1_percent, true AS repeats_within_1_percent, true AS weak_within_1_percent FROM d",
    "kmers_in_sql": f"WITH {_REFS} SELECT ref_id, pos, kmer FROM r",
    "similarity_matrix": f"""WITH {_DOCS}, n AS (SELECT ref, kmer, count(*) AS n FROM d GROUP BY ALL), x AS (SELECT DISTINCT source AS ref FROM documents),
t AS (SELECT ref, sum(n)::BIGINT AS n FROM n GROUP BY ref), m AS (SELECT a.ref AS ref1, b.ref AS ref2, sum(a.n)::BIGINT AS n FROM n a JOIN n b ON a.kmer = b.kmer GROUP BY ALL)
SELECT a.ref AS ref1, b.ref AS ref2, coalesce(t.n, 0) - coalesce(m.n, 0) AS uniq_ref1, coalesce(t.n, 0) AS all_ref1, coalesce(m.n, 0) / t.n AS similarity
FROM x a CROSS JOIN x b LEFT JOIN t ON t.ref = a.ref LEFT JOIN m ON m.ref1 = a.ref AND m.ref2 = b.ref""",
}
