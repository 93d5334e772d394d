"""Operator 10: remove passages that an earlier document holds, by phrase automata.

1. Anchors, the smallest hash of each run of word grams, are taken from every
   document: equal windows have equal anchors. One shuffle by anchor tells
   which anchors recur in several documents; a bit table of bounded size keeps
   most windows around other anchors out of the next step.
2. Consecutive windows of one anchor are a stretch, of at least a phrase's words.
   Documents that hold a whole stretch share all its windows, so only the
   smallest document of a stretch is looked at more closely, and only where an
   anchor has several stretches: there passages are confirmed window by window.
3. Documents that hold a stretch or window later than another one are dealt to
   buckets of bounded size, and each bucket gets the confirmed phrases that its
   documents hold, once per bucket. There the phrases are compiled into
   Aho-Corasick automata of bounded size over word numbers, and all documents
   of the bucket stream through them; every occurrence of a phrase first held by
   a smaller id is removed.

A phrase is sent as its hash and the document of the bucket that has it, so
phrase texts are not moved. Copies are spread over buckets by their id, and
anchors, stretches and windows are added up, so no task depends on a group's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.llm.bit_tables import bit_table, may_hold
from stocklens.llm.text import (
    VISIBLE,
    Hasher,
    byte_rows,
    covered,
    distinct,
    grams,
    joined,
    mix,
    sliding_argmin,
)
from stocklens.sources.scratch import materialized, removed, run_path

#: Words of a phrase and of an anchor.
PHRASE, ANCHOR = 13, 5
#: Bytes of text of a bucket of documents, about.
BUCKET_BYTES = 1 << 20
#: Phrases of one automaton.
SHARD = 5_000
#: A word is spelt in digits of this base: an automaton looks through a node's
#: branches one by one, and a branch for each word of the vocabulary would be slow.
BASE = 64


def batch_words(hasher: Hasher, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of a batch's texts one after another, and the text of each."""
    data, texts = joined(column)
    starts, ends = hasher.spans(data)
    counts = np.diff(np.searchsorted(starts, texts))
    return hasher.hashes(data, starts, ends), np.repeat(np.arange(len(counts)), counts)


def anchor_spans(words: np.ndarray, rows: np.ndarray, phrase: int) -> tuple[np.ndarray, ...]:
    """Anchor, first window and window after the last of each stretch.

    A stretch is the windows of one text next to each other that have one anchor.
    """
    if len(words) < phrase:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none
    hashes = grams(words, ANCHOR)
    places = sliding_argmin(hashes, phrase - ANCHOR + 1)
    # Windows that reach into the next text are none.
    places[rows[:len(places)] != rows[phrase - 1:]] = -1
    edges = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
    after = np.append(edges[1:], len(places))
    inside = places[edges] >= 0
    return hashes[places[edges[inside]]], edges[inside], after[inside]


def stretches(words: np.ndarray, rows: np.ndarray, phrase: int) -> tuple[np.ndarray, ...]:
    """Anchor, hash, first window and window after the last of each stretch; and all windows.

    The hash is that of the first and last window and their number, which hold
    the stretch's words.
    """
    anchors, first, after = anchor_spans(words, rows, phrase)
    windows = grams(words, phrase)
    with np.errstate(over="ignore"):
        keys = mix(mix(windows[first] + (after - first).astype(np.uint64)) ^ windows[after - 1])
    return anchors, keys, first, after, windows


def _anchors(phrase: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(VISIBLE, lower=False)
        for batch in batches:
            words, rows = batch_words(hasher, batch.column(1))
            anchors, first, _ = anchor_spans(words, rows, phrase)
            rows = rows[first]
            # Each anchor of a text once.
            order = np.lexsort((anchors, rows))
            anchors, rows = anchors[order], rows[order]
            new = np.append(True, (anchors[1:] != anchors[:-1]) | (rows[1:] != rows[:-1]))
            new = new[:len(anchors)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors[new].view(np.int64)), batch.column(0).take(pa.array(rows[new]))],
                ["anchor", "doc_id"])

    return run


def _stretches(shared, phrase: int):
    """The stretches of documents whose anchors may recur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, recurring = Hasher(VISIBLE, lower=False), shared.value
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            words, rows = batch_words(hasher, batch.column(1))
            anchors, keys, first, *_ = stretches(words, rows, phrase)
            near = may_hold(recurring, anchors)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchors[near].view(np.int64)), pa.array(keys[near].view(np.int64)),
                 batch.column(0).take(pa.array(rows[first[near]]))],
                ["anchor", "stretch", "doc_id"])

    return run


def _held(stretch: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """A hash of a stretch and a document that holds it."""
    return mix(stretch ^ mix(doc_id))


def _open_marks(batch: pa.RecordBatch) -> np.ndarray:
    """What the bit table of open stretches holds: documents, and stretches with documents."""
    stretch, ids = (c.to_numpy().view(np.uint64) for c in batch.columns)
    return np.concatenate([mix(ids), _held(stretch, ids)])


def _windows(shared, phrase: int):
    """The windows of the open stretches of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, marks = Hasher(VISIBLE, lower=False), shared.value
        for batch in _sift(shared)(batches):
            words, rows = batch_words(hasher, batch.column(1))
            _, keys, first, after, windows = stretches(words, rows, phrase)
            ids = batch.column(0).to_numpy().view(np.uint64)
            met = may_hold(marks, _held(keys, ids[rows[first]]))
            inside = np.zeros(len(windows) + 1, np.int8)
            inside[first[met]] += 1
            inside[after[met]] -= 1
            inside = np.flatnonzero(np.cumsum(inside[:len(windows)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(windows[inside].view(np.int64)),
                 batch.column(0).take(pa.array(rows[inside]))], ["window", "doc_id"])

    return run


def _sift(shared):
    """Leave out documents whose id is surely not wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy().view(np.uint64)
            yield batch.filter(pa.array(may_hold(shared.value, mix(ids))))

    return run


def _mixed(batch: pa.RecordBatch) -> np.ndarray:
    return mix(batch.column(0).to_numpy().view(np.uint64))


def _spelt(numbers: np.ndarray) -> tuple[np.ndarray, int]:
    """Word numbers as digits, and digits per word; each place has its own digits.

    So a phrase is only found where a word begins.
    """
    digits = 1
    while BASE**digits <= numbers.max(initial=0):
        digits += 1
    places = [numbers // BASE**d % BASE + BASE * d for d in range(digits)]
    return np.stack(places, axis=1).ravel(), digits


def _repeated(
    numbers: list[tuple[int, ...]], ids: list, phrases: np.ndarray, digits: int,
) -> list[np.ndarray]:
    """Which words of each document an occurrence of a phrase covers, by automata.

    A phrase is the place of its document, its first word, its length and its
    smallest holder. Only the phrases of one automaton are spelt out at a time, and
    only the occurrences in one document are held: in a group of near copies a
    word may be in many.
    """
    import ahocorasick

    found = [np.zeros(len(sequence) // digits, bool) for sequence in numbers]
    for at in range(0, len(phrases), SHARD):
        shard = phrases[at:at + SHARD]
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        # Of equal phrases the last one added counts: the one of the smallest holder.
        for place, first, length, holder in shard[np.argsort(-shard[:, 3])].tolist():
            words = numbers[place][first * digits:(first + length) * digits]
            automaton.add_word(words, (holder, length))
        automaton.make_automaton()
        for sequence, doc_id, out in zip(numbers, ids, found):
            if doc_id is not None:
                places = np.array([((end + 1) // digits - length, length)
                                   for end, (holder, length) in automaton.iter(sequence)
                                   if holder < doc_id], np.int64).reshape(-1, 2)
                out |= covered(places[:, 0], places[:, 1], len(out))
    return found


def _places(wanted: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the hashes that are wanted, and their holders; ``wanted`` is in order."""
    at = np.minimum(np.searchsorted(wanted[:, 0], hashes), len(wanted) - 1)
    met = np.flatnonzero(wanted[at, 0] == hashes)
    return met, wanted[at[met], 1]


def _phrases_of(words: np.ndarray, wanted: np.ndarray, phrase: int) -> np.ndarray:
    """First word, length and holder of a document's stretches and windows that are wanted."""
    _, keys, first, after, windows = stretches(words, np.zeros(len(words), np.int8), phrase)
    whole, holder = _places(wanted, keys.view(np.int64))
    single, other = _places(wanted, windows.view(np.int64))
    return np.concatenate([
        np.stack([first[whole], after[whole] - first[whole] + phrase - 1, holder], axis=1),
        np.stack([single, np.full(len(single), phrase), other], axis=1)])


def _clean(phrase: int):
    """Remove phrases from the documents of one bucket."""

    def run(docs: pa.Table, phrases: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        hasher = Hasher(VISIBLE, lower=False)
        texts = list(byte_rows(docs.column("text")))
        ids = docs.column("doc_id").to_pylist()
        spans = [hasher.spans(t) for t in texts]
        words = [hasher.hashes(t, *s) for t, s in zip(texts, spans)]
        _, numbers = np.unique(
            np.concatenate([np.zeros(0, np.uint64), *words]), return_inverse=True)
        spelt, digits = _spelt(numbers)
        cuts = digits * np.cumsum([0, *(len(w) for w in words)])
        numbers = [tuple(spelt[a:b].tolist()) for a, b in zip(cuts[:-1], cuts[1:])]
        phrases = phrases.combine_chunks()
        columns = [phrases.column(c).to_numpy() for c in ("source", "hash", "holder")]
        order = np.lexsort(columns[1::-1])
        source, *columns = (c[order] for c in columns)
        wanted = np.stack(columns, axis=1)
        compiled = [np.zeros((0, 4), np.int64)]
        for place, (doc_id, w) in enumerate(zip(ids, words)):
            a, b = (0, 0) if doc_id is None else np.searchsorted(source, [doc_id, doc_id + 1])
            if a < b and len(w) >= phrase:
                of = _phrases_of(w, wanted[a:b], phrase)
                compiled.append(np.column_stack([np.full(len(of), place), of]))
        found = _repeated(numbers, ids, np.concatenate(compiled), digits)
        kept, gone, removed = [], [], []
        for text, drop in zip(texts, found):
            raw = text.tobytes().split()
            kept.append(b" ".join([r for r, d in zip(raw, drop.tolist()) if not d]).decode())
            gone.append(int(drop.sum()))
            edges = np.flatnonzero(np.diff(np.concatenate([[0], drop.astype(np.int8), [0]])))
            removed.append([{"start": a, "end": b} for a, b in
                            zip(edges[::2].tolist(), edges[1::2].tolist())])
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        return pa.table({
            "doc_id": docs.column("doc_id"), "text_key": docs.column("text_key"),
            "n_removed": pa.array(gone, pa.int64()), "removed": pa.array(removed, pa.list_(span)),
            "kept": pa.array(kept, pa.string()),
        })

    return run


_CLEANED = ("doc_id long, text_key long, n_removed long, "
            "removed array<struct<start:int,end:int>>, kept string")


def _later(held: DataFrame, first: DataFrame, key: str) -> DataFrame:
    """doc_id, hash and holder of the documents that hold a key later than the first one."""
    first = first.where("holder < last").select(key, "holder")
    return held.join(first, key).where("doc_id > holder").select(
        "doc_id", F.col(key).alias("hash"), "holder")


def _first(held: DataFrame, *keys: str) -> DataFrame:
    return held.groupBy(*keys).agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last"))


def _later_holders(texts: DataFrame, phrase: int) -> DataFrame:
    """doc_id, hash and holder: stretches and windows that the document ``holder`` has before.

    A document that is not the first one of a stretch loses all its windows. For
    the first one each window counts, and all stretches that hold a window have
    the same anchor; so windows are looked at where an anchor has several
    stretches, and of each stretch only those of its first document.

    The result is written; what it is made from is removed.
    """
    spark = texts.sparkSession
    texts = texts.select("doc_id", "text")
    anchors = texts.mapInArrow(_anchors(phrase), "anchor long, doc_id long")
    recurring = _first(anchors, "anchor").where("holder < last").select("anchor")
    table = spark.sparkContext.broadcast(bit_table(recurring))
    found = []

    def kept(df: DataFrame, label: str) -> DataFrame:
        found.append(run_path(spark, label))
        df.write.parquet(found[-1])
        return spark.read.schema(df.schema).parquet(found[-1])

    held = kept(texts.mapInArrow(
        _stretches(table, phrase), "anchor long, stretch long, doc_id long"), "stretches")
    first = kept(_first(held, "anchor", "stretch"), "first")
    several = first.groupBy("anchor").agg(
        F.min("stretch").alias("a"), F.max("stretch").alias("b")).where("a < b").select("anchor")
    unsure = first.join(several, "anchor").select("stretch", "holder")
    marks = spark.sparkContext.broadcast(bit_table(unsure, _open_marks))
    windows = kept(texts.mapInArrow(_windows(marks, phrase), "window long, doc_id long"), "windows")
    later = _later(held, first, "stretch").union(
        _later(windows, _first(windows, "window"), "window"))
    later = materialized(later, "later")
    for path in found:
        removed(spark, path)
    return later


def cleaned_documents(docs: DataFrame, phrase: int = PHRASE) -> DataFrame:
    """doc_id, text_key, n_removed, removed (word spans) and kept text.

    Rows are the documents that lose words, and a few others. ``text_key`` is
    the hash of the text and tells rows of equal id apart. A null id is not
    larger than any other, so such a document loses nothing.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("text_key"), "text")
    later = _later_holders(texts, phrase)
    losing = spark.sparkContext.broadcast(bit_table(later.select("doc_id").distinct(), _mixed))
    near = texts.mapInArrow(_sift(losing), texts.schema)
    size = near.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, size // BUCKET_BYTES)
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).alias("bucket")
    # Dealt out by bucket once, for the phrases and for the documents that meet them.
    phrases = later.select("*", bucket).repartition("bucket").groupBy("bucket", "hash").agg(
        F.min("doc_id").alias("source"), F.min("holder").alias("holder"))
    left = near.select(bucket, "doc_id", "text_key", "text").groupBy("bucket")
    return left.cogroup(phrases.groupBy("bucket")).applyInArrow(_clean(phrase), _CLEANED)


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, texts = [], []
        for data in byte_rows(batch.column(2)):
            words = data.tobytes().split()
            counts.append(len(words))
            texts.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(counts, pa.int64()),
             pa.array(texts, pa.string())],
            ["doc_id", "text_key", "n_words", "plain"])


def remove_repeats(
    docs: DataFrame, phrase: int = PHRASE, value: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """doc_id, n_words, n_removed, removed (word spans) and kept of every document.

    A word goes if a window of ``phrase`` words around it also starts in a
    document with a smaller id; windows are judged on the texts as given.
    ``kept`` is the text of the other words, joined by one space, or ``value``
    of that text, which is then taken before rows are joined. Null texts are
    empty; a document of fewer words than a phrase loses nothing, and neither
    does one with a null id. Rows with equal ids count as one document but are
    cut by themselves.
    """
    value = value or (lambda text: text)
    keys = ["doc_id", "text_key"]
    cleaned = cleaned_documents(docs, phrase).withColumn("kept", value(F.col("kept")))
    cleaned = cleaned.dropDuplicates(keys)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce("text", F.lit("")).alias("text"))
    plain = texts.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        _plain, "doc_id long, text_key long, n_words long, plain string")
    plain = plain.withColumn("plain", value(F.col("plain"))).alias("p")
    cleaned = cleaned.alias("c")
    same = F.expr("p.doc_id <=> c.doc_id and p.text_key = c.text_key")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return plain.join(cleaned, same, "left").select(
        "p.doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("removed", none).alias("removed"), F.coalesce("kept", "plain").alias("kept"))
