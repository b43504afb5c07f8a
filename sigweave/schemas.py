"""Schemas of the tables that the engine reads and makes."""

from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _schema(**fields) -> StructType:
    return StructType([StructField(n, t()) for n, t in fields.items()])


SEQUENCES = _schema(source_id=IntegerType, source_name=StringType, record_idx=LongType, record_name=StringType, seq=StringType)
UNIQUE = _schema(ref_id=IntegerType, ref_name=StringType, contig=StringType, pos=LongType, kmer=StringType)
SKETCH = _schema(kmer=StringType, ref_id=IntegerType, ref_name=StringType, num_refs=IntegerType, contig=StringType, pos=LongType)
CANDIDATES = _schema(kmer=StringType, pos=LongType, contig=StringType)
COUNTS = _schema(path=StringType, uniq_count=IntegerType, ref_id=IntegerType)
REPORT = _schema(ref=StringType, abundance=DoubleType, count=LongType)
SIGNATURE_LOG = _schema(ref=StringType, total_reads=LongType, signature=StringType, count=LongType)
SIMILARITY = _schema(ref1=StringType, ref2=StringType, uniq_ref1=LongType, all_ref1=LongType, similarity=DoubleType)
