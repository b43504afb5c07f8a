"""A pipeline of five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and reread
as the next one's docs. All but the last give the columns of documents. Stages whose model
is learnt see the labels of all rows, as no row is held out here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigweave.llm import decontam, jaccard, langid, packing, storage, toxicity
from sigweave.llm.queries import tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of a toxicity score of 0.3 or more."""
    model = toxicity.train(docs, storage.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score_col="_toxicity").where("_toxicity < 0.3").select(docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose text is too far from every language's centroids, or has no letter."""
    named = langid.identify(docs, langid.train(docs), lang_col="_lang_pred", score_col="_cosine", rejected_col="_rejected")
    return named.where("not _rejected").select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates, that of the smallest id; decided by row, see jaccard.keep_one."""
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which benchmark windows cover a twentieth or more."""
    return decontam.scan(docs, storage.table(spark, sf_dir, "benchmark")).where("not contaminated").select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences of at most 1024."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", without_toxic), ("language_id", known_language), ("near_duplicates", one_of_each), ("decontamination", decontaminated), ("packing", packed)]

#: Models and tokenizers are not SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = storage.written(docs, name)
    return docs
