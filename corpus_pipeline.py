"""The corpus pipeline: documents in, tokenised clean documents out.

Each stage takes (spark, docs, sf_dir) and judges all rows its predecessor kept. All but the last return the
columns of documents. Rows are judged by what they hold, not by their id, so null and repeated ids are no special
case. Null and empty texts have no letter and go with the first stage; very long texts are judged whole; an empty
table stays empty in every stage; further columns come through until the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, common, decontaminate, langid, repetition, simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: a learnt one with a posterior of a half at least. Those without a letter go, null texts among them."""
    return langid.sure_only(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the repetition limits keep. Each row is judged by its text alone."""
    return repetition.kept_only(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one with the smallest id, rows without id last; of equal ids and null ones the smallest digest. Rows that are alike in all columns count as one."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of any benchmark item; all of them if there is none. Each row is judged by its text alone."""
    return decontaminate.clean_only(docs, common.table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's text, their number, and digests of ids and decoded text."""
    common.bound_batches(spark)
    return docs.select("doc_id", "lang", "source", bpe.digests(F.col("text"), with_ids=True).alias("_d")).select("doc_id", "lang", "source", "_d.*")


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("tokens", tokens),
]
#: The learnt and iterative stages have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
