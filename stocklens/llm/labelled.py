"""Bounded samples of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_texts(
    docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: int,
) -> DataFrame:
    """doc_id, text and label of at most ``bound`` documents to learn from.

    ``train`` is a condition on ``doc_id``. The labels with the smallest hash of
    their id are taken; a document with several labels counts as its largest,
    null labels as none. Only the sampled ids, of bounded number, are broadcast.
    """
    sample = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(train).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    texts = docs.select("doc_id", "text")
    return texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")


def held_out(mod: int, rest: int) -> Column:
    """Whether a document's label is kept for measuring."""
    return F.coalesce(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))
