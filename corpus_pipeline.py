"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which run() writes as Parquet to the shared folder and reads again as the next one's docs. All
stages but the last return the columns of their input. A stage works on everything that its
predecessor kept.

1. quality: the compression classifier, fitted on the labelled rows; rows scored below 0.7 go.
2. near_duplicates: SimHash groups at 4 bits; one row of each group stays, of the smallest id.
3. repeats: bytes of strings of 100 bytes that also start earlier are cut out of the texts.
4. decontamination: documents with a word in twenty inside benchmark windows go.
5. packing: token ids packed into sequences of at most 1024.

Defined cases: null texts pass as empty ones through the scores and stay null where they are not
cut; every row is judged by its own text, so rows that share an id, repeated rows and rows with a
null id are treated like others (near duplicates keep one row of a group, null ids last; repeats
cut nothing out of texts with a null id, which have no place in the order); empty tables pass
through; very long texts are worked on whole; columns beside doc_id and text are carried along
(n_chars follows the text where it is cut).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontamination, packing, quality, simhash, suffixes
from siltstone.llm.shared import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs, table(spark, sf_dir, "labels"), quality.fold(4, 2)).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.dedup(docs).select(docs.columns)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffixes.dedup(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_documents(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeat_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Compression, XXH64 and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
