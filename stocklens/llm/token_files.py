"""Operator 8: token ids in Parquet, for whole reads and selective ones.

``write_tokens`` encodes documents in ascending id order and writes a folder:

* ``tokens``: one row per document (id, part, place of its first id within the
  part, number of ids, list of ids). Ids are dictionary encoded, the other
  whole numbers delta encoded; row groups and pages have a set size and the
  files carry page indexes, so a reader that asks for some documents or only
  for the counts skips the pages and columns it does not need.
* ``parts``: one row per file in order, with the number of ids before it.

The text is moved once, by ranges of the document id. A document's place in
the whole stream is its place in the part plus the ids of all earlier parts,
so nothing is written twice and no task sees more than its part.
"""

from __future__ import annotations

import os
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stocklens.llm.text import VISIBLE, Hasher, byte_rows

#: Different pieces of text that a Python process remembers with their ids.
KEPT_PIECES = 1_500_000
#: Bytes of text that are encoded together.
GROUP = 3 << 20
#: Pieces that go through the library as one text.
LINES = 512

WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#part_start": "false",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
}

_LINE = 10
_WHITE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 28, 29, 30, 31, 32))
_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
_MARK = np.isin(np.arange(256), tuple(b".,;:!?"))
#: Bytes before which a text may be cut, and those after which it may.
_MAYBE = np.isin(np.arange(256), tuple(b" \n.,;:!?"))
#: First bytes of characters among which there is white space beyond ASCII.
_WIDE = np.isin(np.arange(256), (0xC2, 0xE1, 0xE2, 0xE3))


def cuts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """First bytes of the pieces of UTF-8 texts, from where BPE never merges back.

    ``data`` holds texts that begin at ``begins``. The vocabulary's pre-split
    keeps white space together with what follows it and letters apart from
    marks. So a text may be cut before a space or line end that follows
    something else, between a letter and a mark, and after a single line end.
    Where the character before might be white space or a mark beyond ASCII it
    is not cut; a longer piece is encoded just as well.
    """
    inside = np.ones(len(data), bool)
    inside[begins[begins < len(data)]] = False  # texts begin pieces in any case
    at = np.flatnonzero(_MAYBE[data] & inside)
    left = data[at - 1]
    before = np.where(inside[at - 1], data[at - 2], np.uint8(0))
    # Last bytes of the white space characters beyond ASCII.
    wide = ((before == 0xC2) & ((left == 0x85) | (left == 0xA0))
            | (before == 0x80) & (left >= 0x80) | (before == 0x9A) & (left == 0x80)
            | (before == 0x81) & (left == 0x9F))
    accented = (before == 0xC3) & (left != 0x97) & (left != 0xB7)
    mark = _MARK[data[at]]
    ahead = at[np.where(mark, _LETTER[left] | accented, ~_WHITE[left] & ~wide)]
    lines = np.flatnonzero(data[:-1] == _LINE) + 1
    lines = lines[inside[lines] & _LETTER[data[lines]]]
    first = ~inside[lines - 1]
    two = data[lines - 2]
    lines = lines[first | ((two < 0x80) & ~_WHITE[two])]
    cut = ~inside
    cut[ahead] = True
    cut[lines] = True
    return np.flatnonzero(cut)


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The given stretches of an array, one after the other."""
    before = np.cumsum(sizes) - sizes
    return data[np.repeat(starts - before, sizes) + np.arange(sizes.sum())]


class Known:
    """Ids of the pieces that this Python process has met, by hash."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, -1 for those not met."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember new pieces; their hashes are sorted."""
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        at = np.searchsorted(self.keys, hashes)
        self.keys = np.insert(self.keys, at, hashes)
        self.starts = np.insert(self.starts, at, starts)
        self.sizes = np.insert(self.sizes, at, sizes)
        self.ids = np.concatenate([self.ids, ids])


def _known(name: str) -> Known:
    """Kept from task to task of one Python process, and started anew when full."""
    holder = sys.modules.setdefault("_token_pieces", types.ModuleType("_token_pieces")).__dict__
    if name not in holder or len(holder[name].keys) > KEPT_PIECES:
        holder[name] = Known()
    return holder[name]


class Encoder:
    """Token ids of many texts at once; each different piece is encoded once.

    With ``special`` the text of a special token, such as ``<|endoftext|>``, is
    that token's one id, as in the library's own call; without, it is encoded
    like any other text.
    """

    def __init__(self, file: str, special: bool = False):
        # Tasks already run side by side; the library's own threads would add to them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.kept = f"{file}:{special}"
        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = not special
        self.hasher = Hasher(VISIBLE, lower=False)
        (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in found]

    def _pieces(
        self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
    ) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of the given pieces.

        Plain pieces, a word or marks with at most one space before, go through
        the library as lines of one text. Others, and a batch that does not
        come back as so many lines, are encoded one by one.
        """
        odd = np.append(0, np.cumsum(_WHITE[data] | _WIDE[data]))
        inner = starts + (data[starts] == 32)
        plain = (inner < ends) & (odd[inner] == odd[ends])
        order = np.argsort(~plain, kind="stable")
        out, sizes = [], np.zeros(len(starts), np.int64)
        lined = order[:plain.sum()]
        for k in range(0, len(lined), LINES):
            some = lined[k:k + LINES]
            lengths = ends[some] - starts[some] + 1
            text = gather(data, starts[some], lengths - 1)
            text = np.insert(text, np.cumsum(lengths - 1)[:-1], _LINE).tobytes()
            (ids,) = self._ids([text.decode()])
            breaks = np.flatnonzero(ids == self.line)
            if len(breaks) == len(some) - 1:
                sizes[some] = np.diff(breaks, prepend=-1, append=len(ids)) - 1
                out.append((some, ids[ids != self.line]))
            else:
                order = np.concatenate([order, some])
        raw = None
        for i in order[plain.sum():]:
            raw = raw or data.tobytes()
            (ids,) = self._ids([raw[starts[i]:ends[i]].decode(errors="replace")])
            sizes[i] = len(ids)
            out.append((np.array([i]), ids))
        which = np.concatenate([i for i, _ in out])
        begin = np.zeros(len(starts), np.int64)
        begin[which] = np.cumsum(sizes[which]) - sizes[which]
        return gather(np.concatenate([ids for _, ids in out]), begin, sizes), sizes

    def __call__(self, texts: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, with ``end`` after each, and the numbers per text."""
        known = _known(self.kept)
        data = np.concatenate([np.zeros(0, np.uint8), *texts])
        lengths = np.array([len(t) for t in texts])
        begins = np.cumsum(lengths) - lengths
        starts = cuts(data, begins[lengths > 0])
        ends = np.append(starts[1:], len(data))[:len(starts)]
        hashes, first, which = np.unique(
            self.hasher.hashes(data, starts, ends), return_index=True, return_inverse=True)
        new = np.flatnonzero(known.places(hashes) < 0)
        if len(new):
            known.add(hashes[new], *self._pieces(data, starts[first[new]], ends[first[new]]))
        place = known.places(hashes)[which]
        sizes = known.sizes[place]
        ids = gather(known.ids, known.starts[place], sizes)
        last = np.searchsorted(starts, begins + lengths)  # piece after each text
        text_ends = np.append(0, np.cumsum(sizes))[last]
        counts = np.diff(text_ends, prepend=0) + 1
        return np.insert(ids, text_ends, end), counts


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Rows of a batch in groups of bounded size: first row and texts."""
    first, group, size = 0, [], 0
    for i, text in enumerate(byte_rows(batch.column(1))):
        if group and size + len(text) > GROUP:
            yield first, group
            first, group, size = i, [], 0
        group.append(text)
        size += len(text)
    if group:
        yield first, group


def _encoder(file: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, start, part = Encoder(file, special=True), 0, TaskContext.get().partitionId()
        for batch in batches:
            for first, texts in _groups(batch):
                ids, sizes = encode(texts, end)
                starts = start + np.cumsum(sizes) - sizes
                start += len(ids)
                offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)),
                     pa.array(np.full(len(texts), part, np.int32)), pa.array(starts),
                     pa.array(sizes.astype(np.int64)),
                     pa.ListArray.from_arrays(offsets, pa.array(ids.view(np.int32)))],
                    ["doc_id", "part", "part_start", "n_tokens", "ids"],
                )

    return run


SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def write_tokens(
    docs: DataFrame, path: str, tokenizer_file: str, end_id: int,
    id_column: str = "doc_id", text_column: str = "text",
) -> None:
    """Encode all documents and write them below ``path``.

    Every text is encoded whole, as by the library without added special
    tokens, null as the empty text; ``end_id`` is added to each. A special
    token that a text spells out is one id. Rows with equal ids stay separate, ordered by text; a null id comes
    first. Other columns are not stored.
    """
    ordered = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                          F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(_encoder(tokenizer_file, end_id), SCHEMA)
    encoded.write.options(**WRITER).parquet(f"{path}/tokens")
    spark = docs.sparkSession
    tokens = spark.read.schema(SCHEMA).parquet(f"{path}/tokens")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tokens.groupBy("part").agg(
        F.sum("n_tokens").alias("part_tokens"), F.count("*").alias("part_docs"),
        F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
    ).withColumn(  # one row per file
        "before", F.coalesce(F.sum("part_tokens").over(earlier), F.lit(0))
    ).write.parquet(f"{path}/parts")


def read_tokens(
    spark: SparkSession, path: str, first_doc: int | None = None, last_doc: int | None = None,
    ids: bool = True,
) -> DataFrame:
    """Documents of a written folder: doc_id, start, n_tokens and, if asked for, ids.

    The range of documents reaches the Parquet reader, and without ``ids`` only
    the numbers are read. ``start`` counts the ids of all documents before.
    """
    tokens = spark.read.schema(SCHEMA).parquet(f"{path}/tokens")
    if first_doc is not None:
        tokens = tokens.where(F.col("doc_id") >= first_doc)
    if last_doc is not None:
        tokens = tokens.where(F.col("doc_id") <= last_doc)
    parts = spark.read.parquet(f"{path}/parts").select("part", "before")
    out = ["doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens"]
    return tokens.join(parts, "part").select(*out, *(["ids"] if ids else []))


def _crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(3)
        bounds = np.asarray(ids.offsets) - (ids.offsets[0].as_py() if len(ids) else 0)
        data = np.ascontiguousarray(np.asarray(ids.flatten()), "<u4")
        crcs = [zlib.crc32(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(crcs, pa.int64())],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids of each document read."""
    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        _crcs, "doc_id long, start long, n_tokens long, ids_crc32 long")
