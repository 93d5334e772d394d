"""Operator 13: how far the sources of a language differ in their terms.

A group is a source within a language. A term's smoothed share in a group
depends on the group and on the term's count there only. So terms are not
compared one by one:

1. Terms are counted per language and source, map-side first. Those in enough
   documents of their language are kept and dealt to blocks of about ``BLOCK``
   terms, in which each has a place.
2. For each (group, count) of a block the places are stored as a bitset, 64 to
   a word. That table is written: it is the index.
3. AND and popcount of two groups' bitsets give the number of terms with each
   pair of counts (the joint cells), which is multiplied by the difference of
   the two shares. Terms that only one group has, or neither, follow from the
   complement: a bitset's size less its joint cells, the block's size less both.

A block holds no more rows than it has terms for each source. Where a language
has many sources, a block is cut into tiles of ``BAND`` by ``BAND`` sources.
All numbers are whole, so sums do not depend on the order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.llm.text import Hasher, byte_rows
from stocklens.llm.token_files import gather
from stocklens.sources.scratch import materialized

#: Term bytes of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``.
LETTERS = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Documents of a language that a kept term is in at least, and ranks of terms.
LEAST_DOCS, TOP_TERMS = 30, 50
#: Terms of a block, about, and sources of a tile's side.
BLOCK, BAND = 512, 64
#: Shares are in parts of ``UNIT``; ``ADD`` is added to every count.
UNIT, ADD = 1_000_000_000, 5
#: Bytes of text that are counted together, and numbers of a comparison in memory.
GROUP, CELLS = 8 << 20, 1 << 21

_GROUP = ("lang", "source")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of the terms of each group, added up over many texts."""
    hasher = Hasher(LETTERS, lower=True)
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    for batch in batches:
        names = pa.StructArray.from_arrays(batch.columns[:2], _GROUP)
        texts, first, size = [], 0, 0
        for i, text in enumerate(byte_rows(batch.column(2))):
            texts.append(text)
            size += len(text)
            if size >= GROUP or i + 1 == len(batch):
                yield _terms(texts, names.slice(first, len(texts)), hasher, lower)
                texts, first, size = [], i + 1, 0


def _terms(
    texts: list[np.ndarray], names: pa.StructArray, hasher: Hasher, lower: np.ndarray,
) -> pa.RecordBatch:
    gap = np.zeros(1, np.uint8)  # no term goes on from one text to the next
    data = np.concatenate([x for t in texts for x in (t, gap)])
    ends_of_texts = np.cumsum([len(t) + 1 for t in texts])
    starts, ends = hasher.spans(data)
    hashes = hasher.hashes(data, starts, ends)
    doc = np.searchsorted(ends_of_texts, starts, "right")
    keys: dict[tuple, int] = {}
    numbers = np.array([keys.setdefault((r["lang"], r["source"]), len(keys)) for r in names.to_pylist()])
    group = numbers[doc]
    order = np.lexsort((doc, hashes, group))  # the terms of a group together, then their documents
    g, h, d = group[order], hashes[order], doc[order]
    new = np.append(True, (g[1:] != g[:-1]) | (h[1:] != h[:-1]))[:len(g)]
    new_doc = new | np.append(True, d[1:] != d[:-1])[:len(d)]
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(g)))
    docs = np.add.reduceat(new_doc.astype(np.int64), at) if len(at) else counts
    one = order[at]
    sizes = ends[one] - starts[one]
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    raw = lower[gather(data, starts[one], sizes)]
    terms = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(raw))
    langs, sources = ([k[i] for k in keys] for i in range(2))
    place = pa.array(g[at], pa.int32())
    return pa.RecordBatch.from_arrays(
        [*(pa.array(x, pa.string()).take(place) for x in (langs, sources)), terms,
         pa.array(counts.astype(np.int64)), pa.array(docs.astype(np.int64))],
        ["lang", "source", "term", "n", "docs"])


def _share(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share, exactly: a whole number of parts of ``UNIT``."""
    wide = "decimal(38,0)"
    parts = F.call_function("div", (count + ADD).cast(wide) * F.lit(UNIT).cast(wide),
                            (total + terms * ADD).cast(wide))
    return F.lit(1) + parts.cast("long")


class Index:
    """The kept terms, their counts by group, and the bitsets of each (group, count).

    ``groups``: lang, source, number (0.. within the language), total (occurrences of
    kept terms), n_terms (kept terms of the language), blocks, bands.
    ``held``: lang, source, term, block, place, n, p, q; counts above 0.
    ``bitsets``: lang, block, source, number, bands, n, p, n_block, bits (list of word
    number and 64 bits); the row with n = 0 has no bits and stands for the zeros.
    """

    def __init__(self, docs: DataFrame, least_docs: int, block: int = BLOCK, band: int = BAND):
        self.band = band
        named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in (*_GROUP, "text")])
        counts = named.mapInArrow(
            _counted, "lang string, source string, term string, n long, docs long",
        ).groupBy(*_GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        counts = materialized(counts, "term-counts")
        kept = counts.groupBy("lang", "term").agg(
            F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"),
        ).where(F.col("docs") >= least_docs).drop("docs")
        kept = materialized(kept, "kept-terms")
        # Written, so that Spark knows its size: a few languages are joined without a shuffle by language.
        sizes = materialized(kept.groupBy("lang").agg(
            F.count("*").alias("n_terms"), F.sum("n_lang").alias("total_lang")), "sizes")
        blocks = F.greatest(F.lit(1), F.ceil(F.col("n_terms") / block)).cast("int")
        in_block = Window.partitionBy("lang", "block").orderBy("term")
        terms = kept.join(sizes, "lang").withColumn(
            "block", F.pmod(F.xxhash64("term"), blocks).cast("int"),
        ).withColumn("place", F.row_number().over(in_block) - 1)
        q = _share(F.col("n_lang"), F.col("total_lang"), F.col("n_terms"))
        terms = terms.select("lang", "term", "block", "place", "n_terms", q.alias("q"))
        held = materialized(
            counts.select(*_GROUP, "term", "n").join(terms, ["lang", "term"]), "kept-counts")

        none = F.lit(0).cast("long")
        totals = held.groupBy(*_GROUP).agg(F.sum("n").alias("total"))
        groups = named.select(*_GROUP).distinct().join(totals, [*_GROUP], "left").join(
            sizes, "lang", "left").select(
            *_GROUP, F.coalesce("total", none).alias("total"),
            F.coalesce("n_terms", none).alias("n_terms"), F.coalesce(blocks, F.lit(1)).alias("blocks"))
        by_lang = Window.partitionBy("lang")
        self.groups = materialized(groups.withColumns({
            "number": F.row_number().over(by_lang.orderBy("source")) - 1,
            "bands": F.ceil(F.count("*").over(by_lang) / band).cast("int")}), "groups")

        p = _share(F.col("n"), F.col("total"), F.col("n_terms"))
        about = self.groups.select(*_GROUP, "number", "bands", "total")
        self.held = held.join(about, [*_GROUP]).withColumn("p", p)
        keys = ["lang", "block", "source", "number", "bands", "n", "p"]
        bit = F.expr("shiftleft(1L, place % 64)")
        words = self.held.groupBy(*keys, F.expr("place div 64").cast("int").alias("word")).agg(
            F.bit_or(bit).alias("bits"))
        levels = words.groupBy(*keys).agg(F.collect_list(F.struct("word", "bits")).alias("bits"))
        in_blocks = terms.groupBy("lang", "block").agg(F.count("*").alias("n_block"))
        zero = self.groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        zero = zero.join(in_blocks, ["lang", "block"], "left").select(
            "lang", "block", "source", "number", "bands", none.alias("n"),
            F.when(F.col("n_terms") > 0, _share(none, F.col("total"), F.col("n_terms")))
            .otherwise(0).alias("p"),
            F.coalesce("n_block", none).alias("n_block"))
        self.bitsets = materialized(
            levels.unionByName(zero, allowMissingColumns=True), "bitsets")


def _dense(bits: pa.ListArray, words: int) -> np.ndarray:
    """The bitsets as rows of a table of words."""
    sizes = pc.fill_null(pc.list_value_length(bits), 0).to_numpy()
    flat = bits.flatten()
    out = np.zeros((len(bits), words), np.uint64)
    rows = np.repeat(np.arange(len(bits)), sizes)
    out[rows, flat.field("word").to_numpy()] = flat.field("bits").to_numpy().view(np.uint64)
    return out


def _tile_sums(rows: pa.Table, band: int) -> pa.Table:
    """Sums of differences over a tile's terms for each pair of its groups, the smaller number first.

    Rows of a group are its counts; the first of them is count 0.
    """
    rows = rows.sort_by([("number", "ascending"), ("n", "ascending")]).combine_chunks()
    number, p = rows["number"].to_numpy(), rows["p"].to_numpy()
    flat = rows["bits"].combine_chunks()
    words = flat.flatten().field("word")
    bits = _dense(flat, 1 + (pc.max(words).as_py() or 0))
    begin = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
    end = np.append(begin[1:], len(number))
    sizes = np.bitwise_count(bits).sum(1, dtype=np.int64)
    sizes[begin] = rows["n_block"].to_numpy(zero_copy_only=False)[begin].astype(np.int64) - (
        np.add.reduceat(sizes, begin))  # terms that the group lacks
    left, right = rows["left"][0].as_py(), rows["right"][0].as_py()
    found = []
    for i in range(len(begin)):
        if number[begin[i]] // band != left or i + 1 == len(begin):
            continue
        later = max(i + 1, int(np.searchsorted(number[begin], right * band)))
        if later >= len(begin):
            continue
        lo = begin[later]
        own, step = slice(begin[i] + 1, end[i]), max(1, CELLS // max(1, bits[lo:].size))
        total = np.zeros(len(p) - lo, np.int64)
        matched = np.zeros(len(p) - lo, np.int64)  # of another group's terms, those the group has
        zeros = np.zeros(len(begin) - later, np.int64)  # of the group's terms, those another lacks
        for a in range(own.start, own.stop, step):
            some = slice(a, min(a + step, own.stop))
            cells = np.bitwise_count(bits[some, None] & bits[None, lo:]).sum(2, dtype=np.int64)
            total += (cells * np.abs(p[some, None] - p[None, lo:])).sum(0)
            matched += cells.sum(0)
            lacking = sizes[some, None] - np.add.reduceat(cells, begin[later:] - lo, axis=1)
            zeros += (lacking * np.abs(p[some, None] - p[None, begin[later:]])).sum(0)
        others = begin[later:] - lo
        lacked = sizes[lo:] - matched
        lacked[others] = 0
        total += lacked * np.abs(p[begin[i]] - p[lo:])
        # Neither has: what the other lacks, less what the group has of that.
        own_terms = sizes[own].sum()
        both = np.add.reduceat(matched, others)
        neither = sizes[begin[later:]] - (own_terms - both)
        sums = np.add.reduceat(total, others) + zeros
        sums += neither * np.abs(p[begin[i]] - p[begin[later:]])
        found.append((np.full(len(sums), number[begin[i]]), number[begin[later:]], sums))
    u, v, value = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else (
        np.zeros(0, np.int64),) * 3
    return pa.table({"lang": pa.array([rows["lang"][0].as_py()] * len(u), pa.string()),
                     "u": u.astype(np.int32), "v": v.astype(np.int32), "value": value})


def _joint(band: int):
    return lambda rows: _tile_sums(rows, band)


def pair_sums(index: Index) -> DataFrame:
    """lang, source, item (another source of the language) and value, both ways."""
    band = F.expr(f"number div {index.band}").cast("int")
    tiled = index.bitsets.withColumn("_band", F.explode(F.sequence(F.lit(0), F.col("bands") - 1)))
    tiled = tiled.select(
        "lang", "block", F.least(band, "_band").alias("left"), F.greatest(band, "_band").alias("right"),
        "number", "n", "p", "n_block", "bits")
    sums = tiled.groupBy("lang", "block", "left", "right").applyInArrow(
        _joint(index.band), "lang string, u int, v int, value long")
    sums = sums.groupBy("lang", "u", "v").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")),
                   F.struct(F.col("v").alias("a"), F.col("u").alias("b")))
    sums = sums.select("lang", F.explode(ways).alias("way"), "value").select("lang", "way.*", "value")
    for side, name in (("a", "source"), ("b", "item")):
        names = index.groups.select("lang", F.col("number").alias(side), F.col("source").alias(name))
        sums = sums.join(names, ["lang", side])
    return sums.select("lang", "source", "item", "value")


def audit(
    docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS,
    block: int = BLOCK, band: int = BAND,
) -> DataFrame:
    """lang, source, part, item, value and rank: what sets each source apart in its language.

    Part ``pair``: every other source of the language with the sum over all kept
    terms of the difference of the two shares. Part ``term``: kept terms that the
    source has and that are more frequent there than in the language, with the
    difference, up to ``top_terms`` ranks. Ranks go by value, the largest first,
    and among ties by the item's UTF-8 bytes.

    Terms are runs of ASCII letters and of all characters beyond ASCII, with A-Z
    lower-cased, of whole texts of any length. Null texts, languages and sources
    are empty strings, which are groups of their own. A language without kept
    terms has pairs of value 0 and no terms, a language with one source no pairs,
    an empty table no rows. Repeated rows count as often as they occur, ids and
    other columns do not matter. Within one group of texts in a task, terms are
    told apart by 64 hash bits.
    """
    index = Index(docs, least_docs, block, band)
    pairs = pair_sums(index).withColumn("part", F.lit("pair"))
    terms = index.held.where("p > q").select(
        *_GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(
        Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")).alias("rank")
    ranked = [pairs.select(*_GROUP, "part", "item", "value", rank)]
    terms = terms.select(*_GROUP, F.lit("term").alias("part"), "item", "value", rank)
    ranked.append(terms.where(F.col("rank") <= top_terms))
    return ranked[0].unionByName(ranked[1])
