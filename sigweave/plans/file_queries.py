"""Sources, sinks, programs and streams over files that are made from the driver's tables, and the same in SQL.

Every query writes its files to a new path in the shared folder and reads them back with the
library, so its rows went through the source or sink that it is named after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigweave.plans import programs
from sigweave.plans.queries import _DOCS, _HITS, _REFS, _SCORED, _TOPC, _UNIQUE, K, _counts, _seq, _unique
from sigweave.functions.complexity import THRESHOLD
from sigweave.operators.blocks import block_sums
from sigweave.operators.index import build_sketch
from sigweave.operators.query import hit_counts, match, reference_names, signatures
from sigweave.sources import files, sequences, sinks
from sigweave.sources.shared import new_path
from sigweave.sources.tables import benchmark_refs, document_reads, document_sources
from sigweave.streaming import match as streaming


def _fasta_folders(rows: DataFrame, name: str) -> tuple[str, list[str]]:
    """Records (ref, label, seq) as FASTA text in one folder a reference; the root and the folders in the order of ref."""
    root = new_path(rows.sparkSession, name)
    lines = rows.select("ref", F.concat(F.lit(">"), "label", F.lit("\n"), "seq").alias("value"))
    lines.repartition("ref").write.partitionBy("ref").text(root)
    return root, [f"{root}/ref={r['ref']}" for r in rows.select("ref").distinct().orderBy("ref").collect()]


def _reference_files(spark: SparkSession, d: str) -> list[str]:
    refs = benchmark_refs(spark, d).select(F.format_string("item%06d", "ref_id").alias("ref"), F.lit("0").alias("label"), "seq")
    return _fasta_folders(refs, "references")[1]


def _read_file(spark: SparkSession, d: str) -> str:
    """The documents as reads in one folder of gz files, in the order of ids by the files' names: each file is one task's work to pack and to read."""
    path = new_path(spark, "reads")
    quality = F.repeat(F.lit("@"), F.length("seq"))
    reads = document_reads(spark, d, ordered=True).select(F.concat(F.lit("@"), "read_name", F.lit(" document\n"), "seq", F.lit("\n+\n"), quality).alias("value"))
    reads.write.option("compression", "gzip").text(path)
    return path


def _named(ref_name: str):
    """The item of a reference's name."""
    return F.concat(F.lit("item"), F.regexp_extract(ref_name, "(\\d+)$", 1).cast("int").cast("string"))


def fasta_source(spark: SparkSession, d: str) -> DataFrame:
    rows = files.read_fasta(spark, files.references(spark, _reference_files(spark, d)))
    return rows.select(_named("ref_name").alias("ref_name"), "record_idx", "contig", "seq")


def fasta_source_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """All documents of a source in one folder: many records a reference."""
    rows = document_sources(spark, d).where("seq != ''").select("ref", F.concat(F.lit("doc "), "doc_id").alias("label"), "seq")
    root, folders = _fasta_folders(rows, "sources")
    got = files.read_fasta(spark, files.references(spark, folders))
    return got.select(F.substring_index("ref_name", "=", -1).alias("ref"), "contig", "seq")


def fastq_source(spark: SparkSession, d: str) -> DataFrame:
    """Quality lines of nothing but `@`, packed by gzip."""
    return files.read_reads(spark, [_read_file(spark, d)]).select("file_idx", "read_name", "seq")


def long_contig_source(spark: SparkSession, d: str) -> DataFrame:
    """All documents as one record, a line each, in the files of one folder, cut by byte ranges: its k-mers by blocks of 10,000 places."""
    path = new_path(spark, "contig")
    rows = document_reads(spark, d).where("seq != ''").select("read_idx", F.col("seq").alias("value"))
    head = spark.createDataFrame([(-1, ">all documents")], "read_idx long, value string")
    rows.unionByName(head).orderBy("read_idx").select("value").write.text(path)
    pieces = sequences.contigs(spark, path, k=K, range_bytes=1 << 20, joined=True)
    return block_sums(pieces, K, 10_000, keep=["record_idx", "contig"])


def read_source(spark: SparkSession, d: str) -> DataFrame:
    """Reads of the registered source: FASTQ whose sequences and qualities are wrapped, quality of nothing but marks, in byte ranges."""
    path = new_path(spark, "ranges")
    wrapped = lambda x: F.regexp_replace(x, "(.{60})", "$1\n")
    quality = F.regexp_replace("seq", ".", "@")
    document_reads(spark, d).select(F.concat(F.lit("@"), "read_name", F.lit(" document\n"), wrapped("seq"), F.lit("\n+\n"), wrapped(quality)).alias("value")).write.text(path)
    return sequences.reads(spark, path, range_bytes=1 << 20).select("read_name", "seq")


def path_list_source(spark: SparkSession, d: str) -> DataFrame:
    """Paths from a list file, numbered and named as references."""
    path = new_path(spark, "list")
    names = benchmark_refs(spark, d).select(F.format_string("/data/refs/item%06d.x.fa", "ref_id").alias("value"))
    names.orderBy("value").coalesce(1).write.text(path)
    return files.references(spark, files.expand(spark, [f"@{path}"])).select("ref_id", "ref_name")


def sketch_sink(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "sketch")
    sinks.write_sketch(build_sketch(_unique(spark, d), benchmark_refs(spark, d), c=20), path)
    return files.read_sketch(spark, path).drop("line_no")


def candidate_sink(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "candidates")
    sinks.write_candidates(_unique(spark, d), path)
    return spark.read.csv(path, sep="\t", schema="kmer string, pos long, contig string, ref_id int", quote="")


def candidate_source(spark: SparkSession, d: str) -> DataFrame:
    """Candidates and stat table from files, under the paths that the stat table has; the sketch from them, without sequences."""
    got = programs.index(spark, _reference_files(spark, d), k=K, c=20)
    where, stat = new_path(spark, "candidates"), new_path(spark, "stat")
    sinks.write_candidates(got["unique"], where)
    sinks.write_counts(got["counts"].drop("path").join(sinks.name_candidates(got["refs"], where), "ref_id"), stat)
    sketch = programs.sketch_of_candidates(spark, stat, c=20)
    return sketch.select("kmer", _named("ref_name").alias("ref_name"), "num_refs", "contig", "pos")


def index_program_extended(spark: SparkSession, d: str) -> DataFrame:
    """Half of the references counted and kept, the others added by a later run: counts a reference."""
    paths, store = _reference_files(spark, d), new_path(spark, "universe")
    programs.index(spark, paths[::2], k=K, store=store)
    got = programs.index(spark, paths, k=K, store=store)
    return got["counts"].select(_named("ref_name").alias("ref_name"), "uniq_count")


def sketch_source_with_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """A sketch in several files with k-mers and names that come twice: the first line of a k-mer and the last name of an id count."""
    path = new_path(spark, "sketch")
    rows = _sketch_file(spark, d).drop("line_no")
    other = rows.select("kmer", (F.col("ref_id") + 1).alias("ref_id"), F.concat(F.lit("new_"), "ref_name").alias("ref_name"), "num_refs", "contig", "pos")
    sinks.write_sketch(rows.orderBy("kmer"), f"{path}/0")
    sinks.write_sketch(other.unionByName(rows.limit(0)).orderBy("kmer"), f"{path}/1")
    both = files.read_sketch(spark, f"{path}/*")
    return signatures(both, "line_no").join(reference_names(both), "ref_id").select("kmer", "ref_id", "ref_name")


def query_program_pairs(spark: SparkSession, d: str) -> DataFrame:
    """r1 and r2, plain FASTA and FASTQ packed by bzip2: the log of both."""
    reads = document_reads(spark, d)
    one, two = new_path(spark, "pairs"), new_path(spark, "pairs")
    reads.where("read_idx % 2 = 0").select(F.concat(F.lit(">"), "read_name", F.lit("\n"), "seq").alias("value")).write.text(f"{one}.fa")
    reads.where("read_idx % 2 = 1").select(F.concat(F.lit("@"), "read_name", F.lit("\n"), "seq", F.lit("\n+\n"), F.regexp_replace("seq", ".", "I")).alias("value")).write.option("compression", "bzip2").text(two)
    return programs.query(spark, [f"{one}.fa", two], _sketch_file(spark, d))["log"]


def index_program(spark: SparkSession, d: str) -> DataFrame:
    """FASTA files to the sketch."""
    got = programs.index(spark, _reference_files(spark, d), k=K, c=20)
    return got["sketch"].select("kmer", _named("ref_name").alias("ref_name"), "num_refs", "contig", "pos")


def index_program_counts(spark: SparkSession, d: str) -> DataFrame:
    """FASTA files to the table of unique k-mers a reference, written and read again."""
    path = new_path(spark, "counts")
    sinks.write_counts(programs.index(spark, _reference_files(spark, d), k=K)["counts"], path)
    return spark.read.csv(path, sep="\t", schema="path string, uniq_count long, ref_id int").select(_named("path").alias("ref_name"), "uniq_count")


def _sketch_file(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "sketch")
    sinks.write_sketch(build_sketch(_unique(spark, d), benchmark_refs(spark, d), c=100), path)
    return files.read_sketch(spark, path)


def query_program(spark: SparkSession, d: str) -> DataFrame:
    """Reads and a sketch from files to the report, written with six digits and read again; with cutoffs that some references miss."""
    path = new_path(spark, "report")
    got = programs.query(spark, [_read_file(spark, d)], _sketch_file(spark, d), hit=3, rcutoff=1, acutoff=0.01)
    sinks.write_report(got["report"], path)
    return spark.read.csv(path, sep="\t", schema="ref string, abundance double, count long", header=True)


def query_program_log(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "log")
    sinks.write_signature_log(programs.query(spark, [_read_file(spark, d)], _sketch_file(spark, d), solid=True)["log"], path)
    return spark.read.csv(path, sep="\t", schema="ref string, total_reads long, signature string, count long", header=True)


def query_program_metrics(spark: SparkSession, d: str) -> DataFrame:
    return programs.query(spark, [_read_file(spark, d)], _sketch_file(spark, d))["metrics"]


def query_program_one_scan(spark: SparkSession, d: str) -> DataFrame:
    """Hits and metrics of one scan of the reads: the numbers of all k-mers and hits, and whether the sampled numbers are within 2 % of f0 of the exact ones."""
    path = _read_file(spark, d)
    got = programs.query(spark, [path], _sketch_file(spark, d), estimate=True)
    exact = programs.reads_spectrum(files.read_reads(spark, [path]), K, files.total_bytes(spark, [path]))
    near = lambda c: (F.abs(F.col(f"m.{c}") - F.col(f"x.{c}")) <= 0.02 * F.col("x.f0")).alias(f"{c}_within_2_percent")
    both = got["metrics"].alias("m").join(exact.alias("x"), F.lit(True)).join(got["hits"].agg(F.count("*").alias("hits")), F.lit(True))
    return both.select("k", "references", "sketch", "hits", F.col("m.f1").alias("f1"), near("f0"), near("repeats"), near("weak"))


def compare_program(spark: SparkSession, d: str) -> DataFrame:
    """References against each other, from files to the similarity table, written with six digits and read again."""
    path, paths = new_path(spark, "similarity"), _reference_files(spark, d)
    sinks.write_similarity(programs.compare(spark, paths, paths, k=K), path)
    got = spark.read.csv(path, sep="\t", schema="ref1 string, ref2 string, uniq_ref1 long, all_ref1 long, similarity double", header=True)
    return got.select(_named("ref1").alias("ref1"), _named("ref2").alias("ref2"), "uniq_ref1", "all_ref1", "similarity")


def _read_stream(spark: SparkSession, d: str) -> DataFrame:
    """The documents as a stream of reads, some files at a time."""
    reads = new_path(spark, "stream")
    document_reads(spark, d).write.parquet(reads)
    return spark.readStream.schema("file_idx int, read_idx long, read_name string, seq string").option("maxFilesPerTrigger", 2).parquet(reads)


def _all_of(stream: DataFrame) -> DataFrame:
    out, at = new_path(stream.sparkSession, "hits"), new_path(stream.sparkSession, "checkpoint")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def _stream_signatures(spark: SparkSession, d: str) -> DataFrame:
    return _unique(spark, d).select("kmer", "ref_id", "ref_name")


def stream_hit_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a stream of reads, all that there are, by reference."""
    hits = _all_of(streaming.stream_hits(_read_stream(spark, d), _stream_signatures(spark, d), K))
    return hits.groupBy("ref_id").agg(F.count("*").alias("count"), F.count_distinct("read_name").alias("reads"))


def stream_solid_hits(spark: SparkSession, d: str) -> DataFrame:
    """Solid hits of a stream of reads that comes in several batches."""
    return _all_of(streaming.stream_solid_hits(_read_stream(spark, d), _stream_signatures(spark, d), K)).select("ref_id", "kmer", "read_idx", "pos")


def stream_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of a stream from merged sketches of its batches: whether each estimate of distinct reads is within 4 % of the exact number."""
    path, sigs = new_path(spark, "sums"), _stream_signatures(spark, d)
    streaming.stream_report(streaming.stream_hits(_read_stream(spark, d), sigs, K), path, new_path(spark, "checkpoint"))
    got = streaming.report_so_far(sigs, path, read_cutoff=0)
    exact = hit_counts(match(document_reads(spark, d), sigs, K)).join(reference_names(sigs), "ref_id").select(F.col("ref_name").alias("ref"), "reads")
    near = F.abs(F.col("approx_reads") - F.col("reads")) <= F.greatest(F.lit(1), 0.04 * F.col("reads"))
    return got.join(exact, "ref").select("ref", "abundance", "count", near.alias("reads_within_4_percent"))


QUERIES = {
    f.__name__: f
    for f in (
        fasta_source, fasta_source_of_documents, fastq_source, path_list_source, sketch_sink, candidate_sink, index_program, index_program_counts, query_program, query_program_log,
        query_program_metrics, compare_program, stream_hit_counts, stream_solid_hits, stream_report, long_contig_source, read_source, candidate_source, index_program_extended,
        sketch_source_with_duplicates, query_program_pairs, query_program_one_scan,
    )
}

_SIX = "format('{{:.6g}}', {})::DOUBLE"
_SKETCH = f"{_SCORED}, {_TOPC.format(threshold=THRESHOLD, c=100)}"
_SKETCH_HITS = f"""{_SKETCH}, {_DOCS},
h AS (SELECT t.ref_id, t.ref_name, kmer, doc_id AS read_idx, pos FROM (SELECT doc_id, pos, kmer FROM d) JOIN (SELECT kmer, ref_id, ref_name FROM t) t USING (kmer)),
s AS (SELECT * EXCLUDE (o) FROM (SELECT *, row_number() OVER (PARTITION BY kmer ORDER BY read_idx, pos) AS o FROM h) WHERE o > 1)"""

ORACLES = {
    "fasta_source": f"SELECT 'item' || item_id AS ref_name, 0::BIGINT AS record_idx, '0' AS contig, {_seq('text')} AS seq FROM benchmark",
    "fasta_source_of_documents": f"SELECT source AS ref, 'doc_' || doc_id AS contig, {_seq('text')} AS seq FROM documents WHERE {_seq('text')} <> ''",
    "fastq_source": f"SELECT 0::INT AS file_idx, doc_id::VARCHAR AS read_name, {_seq('text')} AS seq FROM documents",
    "path_list_source": "SELECT (row_number() OVER (ORDER BY item_id) - 1)::INT AS ref_id, 'item' || lpad(item_id::VARCHAR, 6, '0') || '.x' AS ref_name FROM benchmark",
    "sketch_sink": f"WITH {_SCORED}, {_TOPC.format(threshold=THRESHOLD, c=20)} SELECT kmer, ref_id, ref_name, (SELECT count(*) FROM benchmark)::INT AS num_refs, contig, pos FROM t",
    "candidate_sink": f"WITH {_UNIQUE} SELECT ref_id, kmer, pos, contig FROM u",
    "index_program": f"WITH {_SCORED}, {_TOPC.format(threshold=THRESHOLD, c=20)} SELECT kmer, ref_name, (SELECT count(*) FROM benchmark)::INT AS num_refs, contig, pos FROM t",
    "index_program_counts": f"WITH {_UNIQUE}, c AS (SELECT ref_id, count(*) AS n FROM u GROUP BY ref_id) SELECT 'item' || item_id AS ref_name, coalesce(n, 0) AS uniq_count FROM benchmark LEFT JOIN c ON c.ref_id = item_id",
    "query_program": f"WITH {_SKETCH_HITS}, {_counts('h', 0)}, a AS (SELECT ref_name AS ref, count / sum(count) OVER () AS abundance, count FROM c WHERE count >= 3 AND reads > 1) SELECT ref, {_SIX.format('abundance')} AS abundance, count FROM a WHERE abundance > 0.01",
    "query_program_log": f"WITH {_SKETCH_HITS}, {_counts('s', 0)} SELECT c.ref_name AS ref, reads AS total_reads, kmer AS signature, x.count FROM (SELECT ref_id, kmer, count(*) AS count FROM s GROUP BY ALL) x JOIN c ON c.ref_id = x.ref_id",
    "query_program_metrics": f'WITH {_SKETCH}, {_DOCS}, n AS (SELECT count(*) AS n FROM d GROUP BY kmer) SELECT {K}::INT AS k, (SELECT count(DISTINCT ref_id) FROM t) AS "references", (SELECT count(*) FROM t) AS sketch, sum(n)::BIGINT AS f1, count(*) AS f0, count(*) FILTER (n > 1) AS repeats, count(*) FILTER (n = 1) AS weak FROM n',
    "query_program_one_scan": f'WITH {_SKETCH_HITS} SELECT {K}::INT AS k, (SELECT count(DISTINCT ref_id) FROM t) AS "references", (SELECT count(*) FROM t) AS sketch, (SELECT count(*) FROM h) AS hits, (SELECT count(*) FROM d) AS f1, true AS f0_within_2_percent, true AS repeats_within_2_percent, true AS weak_within_2_percent',
    "compare_program": f"""WITH {_REFS}, n AS (SELECT ref_name AS ref, kmer, count(*) AS n FROM r GROUP BY ALL), x AS (SELECT 'item' || item_id AS ref FROM benchmark),
t AS (SELECT ref, sum(n)::BIGINT AS n FROM n GROUP BY ref), m AS (SELECT a.ref AS ref1, b.ref AS ref2, sum(a.n)::BIGINT AS n FROM n a JOIN n b ON a.kmer = b.kmer GROUP BY ALL)
SELECT a.ref AS ref1, b.ref AS ref2, coalesce(t.n, 0) - coalesce(m.n, 0) AS uniq_ref1, coalesce(t.n, 0) AS all_ref1, CASE WHEN t.n > 0 THEN {_SIX.format('coalesce(m.n, 0) / t.n')} ELSE 'nan'::DOUBLE END AS similarity
FROM x a CROSS JOIN x b LEFT JOIN t ON t.ref = a.ref LEFT JOIN m ON m.ref1 = a.ref AND m.ref2 = b.ref""",
    "long_contig_source": f"""WITH a AS (SELECT string_agg({_seq('text')}, '' ORDER BY doc_id) AS s FROM documents),
c AS (SELECT i * 1000 AS b, substr(s, i * 1000 + 1, {1000 + K - 1}) AS s FROM (SELECT s, unnest(range(0, length(s) // 1000 + 1)) AS i FROM a)),
w AS (SELECT b + p AS place, substr(s, p::INT + 1, {K}) AS w FROM (SELECT b, s, unnest(range(0, length(s) - {K - 1})) AS p FROM c)),
k AS (SELECT place AS "at", least(w, reverse(translate(w, 'ACGT', 'TGCA'))) AS kmer FROM w WHERE NOT regexp_matches(w, '[^ACGT]'))
SELECT 0::BIGINT AS record_idx, 'all_documents' AS contig, "at" // 10000 AS block, count(*) AS kmers, sum("at")::BIGINT AS places, min(kmer) AS "least", max(kmer) AS most, count(DISTINCT kmer) AS "distinct" FROM k GROUP BY 3""",
    "read_source": f"SELECT doc_id::VARCHAR AS read_name, {_seq('text')} AS seq FROM documents",
    "candidate_source": f"WITH {_SCORED}, {_TOPC.format(threshold=THRESHOLD, c=20)} SELECT kmer, ref_name, (SELECT count(*) FROM benchmark)::INT AS num_refs, contig, pos FROM t",
    "index_program_extended": f"WITH {_UNIQUE}, c AS (SELECT ref_id, count(*) AS n FROM u GROUP BY ref_id) SELECT 'item' || item_id AS ref_name, coalesce(n, 0) AS uniq_count FROM benchmark LEFT JOIN c ON c.ref_id = item_id",
    "sketch_source_with_duplicates": f"WITH {_SKETCH}, n AS (SELECT ref_id + 1 AS ref_id, 'new_' || ref_name AS ref_name FROM t), o AS (SELECT DISTINCT ref_id, ref_name FROM t WHERE ref_id NOT IN (SELECT ref_id FROM n)) SELECT kmer, t.ref_id, x.ref_name FROM t JOIN (SELECT DISTINCT * FROM n UNION SELECT * FROM o) x ON x.ref_id = t.ref_id",
    "query_program_pairs": f"WITH {_SKETCH_HITS}, {_counts('h', 0)} SELECT c.ref_name AS ref, reads AS total_reads, kmer AS signature, x.count FROM (SELECT ref_id, kmer, count(*) AS count FROM h GROUP BY ALL) x JOIN c ON c.ref_id = x.ref_id",
    "stream_solid_hits": f"WITH {_HITS} SELECT ref_id, kmer, read_idx, pos FROM s",
    "stream_report": f"WITH {_HITS}, {_counts('h', 0)} SELECT ref_name AS ref, count / sum(count) OVER () AS abundance, count, true AS reads_within_4_percent FROM c WHERE count >= 10 AND reads > 0",
    "stream_hit_counts": f"WITH {_HITS}, {_counts('h', 0)} SELECT ref_id, count, reads FROM c",
}
