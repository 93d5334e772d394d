"""A training-data pipeline of five operators, from documents to token files.

Each stage takes (spark, documents, table directory) and returns a frame that
is written as Parquet and read again as the next stage's documents. All stages
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.llm import decontamination, mixing, ngram_join, quality, token_files
from stocklens.llm.queries import END_ID, shared, table, tokenizer_file
from stocklens.sources.scratch import materialized, run_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from all labels."""
    shared(spark)
    forest = quality.train(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.keep_good(docs, forest)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each group of near copies, and every ungrouped one."""
    shared(spark)
    return ngram_join.one_of_each_group(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have their target weights."""
    shared(spark)
    return mixing.sample_mixture(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token files, and what is read back from them."""
    shared(spark)
    path = run_path(spark, "tokens")
    token_files.write_tokens(docs, path, tokenizer_file("byte_bpe_50k.json"), END_ID)
    return token_files.checksums(token_files.read_tokens(spark, path))


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("mixing", mixed),
    ("token_files", token_output),
]

#: A fitted classifier decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a directory."""
    shared(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialized(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
