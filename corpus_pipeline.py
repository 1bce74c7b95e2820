"""A corpus pipeline of five stages over `documents`, each on all that the one before kept.

language    documents without a letter, or in which no learned language stands out, go
near        one document of each group of near copies stays: the one with the smallest id
repeats     what lies in a string of 400 bytes, or of 51 words, that occurs anywhere else is cut out of the texts
benchmark   words in runs of 10 or more that a benchmark item holds are cut out; texts that are mostly such runs go
mix         sources are mixed to weights 5, 2, 1; copies is how often a document is taken, documents not taken go
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qcloom.llm import decontaminate, langid, mixing, ngramjoin, repeats
from qcloom.llm.common import written
from qcloom.sources.readers import spread


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts have no letter and go; equal texts share a verdict; an empty table stays empty."""
    return langid.keep_known(docs, langid.fit(docs.where(~langid.held_out())))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngramjoin.keep_one(docs)


def repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeats.clean(docs, words=repeats.PASSAGE)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without words have size 0 and come only with whole copies of their source; a null source is a
    source; rows equal in id and text share a draw; an empty table stays empty."""
    return mixing.mix(docs, whole_rows=True)


STAGES = [("language", language), ("near", near), ("repeats", repeated), ("benchmark", benchmark), ("mix", mix)]

#: SQL has no form for the classifier and the byte-level stages; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = docs if k == len(STAGES) - 1 else written(docs)
    return docs
