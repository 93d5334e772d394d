"""Operator 2: find benchmark text in documents by winnowing.

A text's fingerprints are the smallest hash of each run of ``WINDOW`` word
grams of ``GRAM`` words. Two texts that share ``GRAM + WINDOW - 1`` words in a
row share the fingerprint of that span. Fingerprints of documents are looked
up among those of the benchmark, and each hit is extended word by word to the
longest common span around it; spans of at least that guaranteed length are
contamination.

The benchmark is the query set: it is taken in blocks of a fixed number of
words, so that what a task holds has a bound whatever the benchmark's size.
Each block is one pass over the documents without a shuffle; more than one
block is followed by one merge per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.llm.text import LETTERS, Hasher, byte_rows, distinct, grams, mix, sliding_argmin, whole

#: Words of a gram and grams of a window: spans of 10 words are never missed.
GRAM, WINDOW = 5, 6
SPAN = GRAM + WINDOW - 1
#: UTF-8 bytes of benchmark text that a task holds at a time.
BLOCK_BYTES = 16 << 20

SCHEMA = (
    "doc_id long, text_key string, n_words long, hits array<struct<start:int,end:int>>, "
    "item_ids array<string>"
)


def fingerprints(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the winnowed grams of a text of at least ``SPAN`` words."""
    hashes = grams(words, GRAM)
    places = distinct(sliding_argmin(hashes, WINDOW))
    return hashes[places], places


class Items:
    """Fingerprints of one block of the benchmark, sorted by hash."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        hasher = Hasher(LETTERS, lower=True)
        self.names = [name for name, _ in rows]
        words = [hasher.words(np.frombuffer(text, np.uint8)) for _, text in rows]
        self.bounds = np.zeros(len(words) + 1, np.int64)
        np.cumsum([len(w) for w in words], out=self.bounds[1:])
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        found, owners, places, short = [], [], [], []
        for i, w in enumerate(words):
            if len(w) >= SPAN:
                hashes, at = fingerprints(w)
                found.append(hashes)
                owners.append(np.full(len(at), i))
                places.append(at + self.bounds[i])
            elif len(w):
                short.append((len(w), whole(w), i))
        none = np.zeros(0, np.int64)
        hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.owners = np.concatenate([none, *owners])[order]
        self.places = np.concatenate([none, *places])[order]
        self.short: dict[int, dict[int, list[int]]] = {}
        for n, h, i in short:
            self.short.setdefault(n, {}).setdefault(int(h), []).append(i)

    def find(self, words: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Common spans (first word, word after) and the items they are from."""
        spans: set[tuple[int, int]] = set()
        items: set[int] = set()
        if len(words) >= SPAN and len(self.hashes):
            self._long(words, spans, items)
        for n, known in self.short.items():
            if len(words) >= n:
                keys = np.fromiter(known, np.uint64, len(known))
                hashes = mix(grams(words, n) + np.uint64(n))
                for at in np.flatnonzero(np.isin(hashes, keys)):
                    spans.add((int(at), int(at) + n))
                    items.update(known[int(hashes[at])])
        return sorted(spans), items

    def _long(self, words: np.ndarray, spans: set, items: set) -> None:
        hashes, places = fingerprints(words)
        left = np.searchsorted(self.hashes, hashes, "left")
        hit = np.flatnonzero(self.hashes[np.minimum(left, len(self.hashes) - 1)] == hashes)
        done: dict[tuple[int, int], int] = {}  # end of the last span by item and shift
        for k in hit:
            at, j = int(places[k]), int(left[k])
            while j < len(self.hashes) and self.hashes[j] == hashes[k]:
                item, there = int(self.owners[j]), int(self.places[j])
                j += 1
                if done.get((item, there - at), -1) > at:
                    continue
                start, end = self._extend(words, at, item, there)
                done[item, there - at] = end
                if end - start >= SPAN:
                    spans.add((start, end))
                    items.add(item)

    def _extend(self, words: np.ndarray, at: int, item: int, there: int) -> tuple[int, int]:
        before = min(at, there - int(self.bounds[item]))
        after = min(len(words) - at, int(self.bounds[item + 1]) - there)
        back = words[at - before:at][::-1] != self.words[there - before:there][::-1]
        ahead = words[at:at + after] != self.words[there:there + after]
        return (at - (int(back.argmax()) if back.any() else before),
                at + (int(ahead.argmax()) if ahead.any() else after))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, hasher = shared.value, Hasher(LETTERS, lower=True)
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            counts, hits, names = [], [], []
            for data in byte_rows(batch.column(2)):
                words = hasher.words(data)
                spans, found = items.find(words)
                counts.append(len(words))
                hits.append([{"start": a, "end": b} for a, b in _merged(spans)])
                names.append(sorted({items.names[i] for i in found}))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()),
                 pa.array(hits, pa.list_(span)), pa.array(names, pa.list_(pa.string()))],
                ["doc_id", "text_key", "n_words", "hits", "item_ids"],
            )

    return run


def _blocks(items: DataFrame) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of bounded size, streamed through the driver."""
    block, size = [], 0
    for row in items.toLocalIterator():
        text = row["text"].encode()
        if block and size + len(text) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block


def _named(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """Items with a text; a null id is the empty one."""
    return benchmark.select(
        F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item_id"),
        F.col(text).alias("text")).where("text IS NOT NULL")


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    item_column: str = "item_id", item_text_column: str = "text",
) -> DataFrame:
    """doc_id, n_words, hits (separate word spans) and item_ids of every document row.

    Words are runs of digits, letters and characters beyond ASCII, compared
    without ASCII case. An item of fewer than ``SPAN`` words counts as one span
    and is looked up whole. Null or wordless texts and items hit nothing; an
    item id that repeats is one item, and a null one is the item of the empty id.
    An empty benchmark gives documents
    without hits. Rows with equal ids stay separate.
    """
    spark: SparkSession = docs.sparkSession
    items = _named(benchmark, item_column, item_text_column)
    blocks = [spark.sparkContext.broadcast(Items(b)) for b in _blocks(items)]
    blocks = blocks or [spark.sparkContext.broadcast(Items([]))]
    text = F.col(text_column)
    texts = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        (F.md5(text.cast("binary")) if len(blocks) > 1 else F.lit("")).alias("text_key"),
        text.alias("text"),
    )
    found = [texts.mapInArrow(_scan(b), SCHEMA) for b in blocks]
    return (found[0] if len(found) == 1 else _merge(found)).drop("text_key")


def _merge(found: list[DataFrame]) -> DataFrame:
    """Results of several blocks; rows of equal id and text are equal and stay as many."""
    rows = reduce(DataFrame.unionByName, found).groupBy("doc_id", "text_key").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_set("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
        (F.count("*") / len(found)).cast("int").alias("_copies"),
    )
    apart = F.aggregate(
        "hits", F.array().cast("array<struct<start:int,end:int>>"),
        lambda a, s: F.when(
            (F.size(a) > 0) & (F.element_at(a, -1)["end"] >= s["start"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(
                F.element_at(a, -1)["start"].alias("start"),
                F.greatest(F.element_at(a, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(s))),
    )
    rows = rows.withColumn("hits", apart)
    return rows.withColumn("_copies", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copies")


def hit_words(hits: str = "hits") -> Column:
    """Number of words in separate spans."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark span, with their columns.

    A row stays or goes with its own text, also where ids repeat. Items count
    whether they have an id or not. Extra columns stay as they are.
    """
    spark: SparkSession = docs.sparkSession
    items = _named(benchmark, "item_id", "text")
    for block in _blocks(items):
        shared = spark.sparkContext.broadcast(Items(block))
        docs = docs.mapInArrow(_without(shared, docs.columns.index("text")), docs.schema)
    return docs


def _without(shared, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, hasher = shared.value, Hasher(LETTERS, lower=True)
        for batch in batches:
            keep = [not items.find(hasher.words(t))[1] for t in byte_rows(batch.column(text))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run
