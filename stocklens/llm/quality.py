"""Operator 5: a quality classifier over document statistics.

Gradient-boosted trees are fitted on a bounded sample of labelled documents;
the statistics of that sample are all that reaches the driver. The trees are
flat arrays, broadcast to the tasks, where one Arrow batch of documents walks
them together. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from stocklens.llm.boosting import Forest, fit
from stocklens.llm.labelled import labelled_texts
from stocklens.llm.text import VISIBLE, Hasher, byte_rows, grams

#: Labelled documents that the trees are fitted on, at most.
SAMPLE = 20_000
#: Scores from here on are class 1.
LIMIT = 0.3

STATISTICS = (
    "log_bytes", "log_words", "mean_word", "longest_word", "upper", "digit", "space", "line_ends",
    "wide", "stop_marks", "bars", "shouts", "symbols", "brackets", "entropy", "distinct_words",
    "top_word", "repeats_before", "distinct_grams", "mean_line", "distinct_lines", "capitals",
    "upper_words", "short_words", "marked_words",
)


def _classes() -> np.ndarray:
    out = np.zeros(256, np.int64)
    for i, group in enumerate(
        (range(65, 91), range(48, 58), b" ", b"\n", range(128, 256), b".,;:", b"|", b"!?",
         b"#$%&*@^~=+_<>\\/", b"()[]{}\"'`"), 1,
    ):
        out[list(group)] = i
    return out


_CLASS = _classes()


def statistics(data: np.ndarray, hasher: Hasher) -> np.ndarray:
    """The statistics of one text, all 0 for the empty one."""
    out = np.zeros(len(STATISTICS))
    n = len(data)
    if not n:
        return out
    counts = np.bincount(data, minlength=256)
    kinds = np.bincount(_CLASS, counts, 11)[1:] / n
    share = counts[counts > 0] / n
    lines = np.flatnonzero(data == 10)
    starts, ends = hasher.spans(data)
    k = len(starts)
    out[0], out[1] = np.log1p(n), np.log1p(k)
    out[4:14] = kinds
    out[14] = -(share * np.log2(share)).sum()
    out[19] = np.log1p(n / (len(lines) + 1))
    out[20] = _distinct_lines(data, lines, hasher)
    if not k:
        return out
    sizes, words = ends - starts, hasher.hashes(data, starts, ends)
    _, often = np.unique(words, return_counts=True)
    runs = grams(words, 4)
    first, last = data[starts], data[ends - 1]
    second = data[np.minimum(starts + 1, n - 1)]
    upper = (first >= 65) & (first <= 90)
    out[2], out[3] = sizes.mean(), np.log1p(sizes.max())
    out[15], out[16] = len(often) / k, often.max() / k
    out[17] = (words[1:] == words[:-1]).mean() if k > 1 else 0
    out[18] = len(np.unique(runs)) / len(runs) if len(runs) else 1
    out[21] = upper.mean()
    out[22] = (upper & (second >= 65) & (second <= 90)).mean()
    out[23] = (sizes <= 3).mean()
    out[24] = (_CLASS[last] >= 6).mean()
    return out


def _distinct_lines(data: np.ndarray, ends: np.ndarray, hasher: Hasher) -> float:
    if not len(ends):
        return 1.0
    starts = np.concatenate([[0], ends + 1])
    ends = np.concatenate([ends, [len(data)]])
    full = ends > starts
    if not full.any():
        return 0.0
    return len(np.unique(hasher.hashes(data, starts[full], ends[full]))) / full.sum()


def _batch(column: pa.Array, hasher: Hasher) -> np.ndarray:
    rows = [statistics(data, hasher) for data in byte_rows(column)]
    return np.array(rows).reshape(len(rows), len(STATISTICS))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher(VISIBLE, lower=False)
    for batch in batches:
        values = _batch(batch.column(1), hasher)
        rows = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(STATISTICS))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), rows.cast(pa.list_(pa.float64())), batch.column(2)],
            ["doc_id", "statistics", "label"],
        )


def train(
    docs: DataFrame, labels: DataFrame, train_rows: Column, label: str = "quality",
    sample: int = SAMPLE,
) -> Forest:
    """Fit the trees on at most ``sample`` labelled documents.

    Rows that share an id are taken up to the bound as well. Without labels
    every score is 0.5.
    """
    texts = labelled_texts(docs, labels, label, train_rows, sample)
    measured = texts.mapInArrow(
        _measured, "doc_id long, statistics array<double>, label int"
    ).orderBy(F.xxhash64("doc_id"), "doc_id", "statistics").limit(sample).toArrow()
    values = measured.column("statistics").combine_chunks()
    values = np.asarray(values.flatten(), float).reshape(-1, len(STATISTICS))
    return fit(values, np.asarray(measured.column("label"), float))


def _scored(shared, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, hasher = shared.value, Hasher(VISIBLE, lower=False)
        for batch in batches:
            scores = forest.scores(_batch(batch.column(text), hasher))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores)], [*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """The rows with a ``score`` column: the probability of label 1.

    Whole texts are measured; null and empty texts have statistics 0 and are
    scored like others. An existing ``score`` column is replaced; other extra
    columns stay as they are.
    """
    docs = docs.drop("score")
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    return docs.mapInArrow(_scored(shared, docs.columns.index("text")), schema)


def keep_good(docs: DataFrame, forest: Forest, limit: float = LIMIT) -> DataFrame:
    """The documents scored at least ``limit``, with their columns."""
    return docs.mapInArrow(_passing(
        docs.sparkSession.sparkContext.broadcast(forest), docs.columns.index("text"), limit,
    ), docs.schema)


def _passing(shared, text: int, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, hasher = shared.value, Hasher(VISIBLE, lower=False)
        for batch in batches:
            scores = forest.scores(_batch(batch.column(text), hasher))
            yield batch.filter(pa.array(scores >= limit))

    return run
