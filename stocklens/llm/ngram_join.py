"""Operator 9: similarity join of documents on word n-grams.

A document is the set of its shingles. Documents of equal sets form a class,
and classes are joined exactly:

1. Shingles are put in several global orders. All of them put rare shingles
   first, by a table of hashed counts of bounded size, and break ties in their
   own way. If two sets of ``n`` and ``m`` shingles are similar enough, each
   shares a shingle of its prefix (its first ``n - ceil(t * n) + 1``) with the
   other's, in every order, and since the prefix misses few shingles it shares
   a certain number of them.
2. Prefixes in the first order are shuffled by shingle and band of set sizes.
   Nearly all are held by one class only and drop out; the rest are the hits.
   Whole sets are read again for the classes with hits.
3. Rounds link classes to hubs: each class is compared with the one class
   that it shares most hits with, among one random class per shingle. A round
   joins much of a large group of near copies with as many pairs as classes.
   Rounds go on while each thins out what is left, and that would make many more
   pairs than there are hits.
4. Where a key's classes still make many pairs of different components, as in a
   group of texts just below the threshold, the classes are cut into blocks of
   bounded size. Every two blocks meet in one task, which counts the shared
   shingles of all their pairs at once and gives links of a spanning forest, so
   rows grow with the classes and not with their pairs.
5. All other pairs of classes of different components that share a hit are then
   compared one by one, so that no link between components is lost. Pairs within
   a component need no look; they cannot change it.

A pair of steps 3 and 5 must pass the filters of all orders before its whole sets
are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.llm.bit_tables import bit_table, may_hold
from stocklens.llm.components import components
from stocklens.llm.cuts import free_names
from stocklens.llm.text import VISIBLE, Hasher, byte_rows, distinct, grams, lists, mix, whole
from stocklens.sources.scratch import materialized, temporary

#: Bits of a shingle's hash that choose its counter, and counters sent in one row.
COUNTER_BITS, SLICE = 20, 1 << 12
#: Rounds of links to hubs: at least, and at most while hits still make many pairs of components.
HUB_ROUNDS, MOST_HUB_ROUNDS = 2, 12
#: Pairs for each hit from which on another round is made, and the share of them that it may leave.
CROWDED, LEFT = 16, 0.8
#: Classes of a block, and shingles of all its classes, about.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Holders up to which a shingle is counted pair by pair, and other shingles counted at a time.
FEW, AT_ONCE = 16, 2048

_SEEDS = tuple(np.uint64(s) for s in (0x243F6A8885A308D3, 0x13198A2E03707344))


def shingles(data: np.ndarray, hasher: Hasher, k: int) -> np.ndarray:
    """The sorted set of a text's shingles; shorter texts are one shingle."""
    words = hasher.words(data)
    if not len(words):
        return words
    return distinct(grams(words, k)) if len(words) >= k else np.array([whole(words)])


def _class(tokens: np.ndarray) -> int:
    """A hash of a set."""
    with np.errstate(over="ignore"):
        total = mix(tokens ^ _SEEDS[0]).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.array([total]))[0].view(np.int64))


def _buckets(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _tally(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(VISIBLE, lower=True)
        counts = np.zeros(1 << COUNTER_BITS, np.int32)
        for batch in batches:
            for data in byte_rows(batch.column(0)):
                np.add.at(counts, _buckets(shingles(data, hasher, k)), 1)
        yield from _slices(counts)

    return run


def _slices(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = counts.reshape(-1, SLICE)
    used = np.flatnonzero(rows.any(1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array([rows[i].tobytes() for i in used], pa.binary())],
        ["slice", "counts"])


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            total = totals.setdefault(number, np.zeros(SLICE, np.int64))
            total += np.frombuffer(counts.as_buffer(), np.int32)
    levels = [np.minimum(255, 8 * np.log2(t + 1)).astype(np.uint8).tobytes()
              for t in totals.values()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(totals), pa.int32()), pa.array(levels, pa.binary())], ["slice", "levels"])


def frequency_levels(texts: DataFrame, k: int) -> np.ndarray:
    """How often shingles of each counter occur, on a logarithmic scale of one byte.

    All documents are counted. What a task sends and what reaches the driver
    does not grow with the input (1 MB).
    """
    return _added_up(texts.mapInArrow(_tally(k), _SLICES))


_SLICES = "slice int, counts binary"


def _added_up(slices: DataFrame) -> np.ndarray:
    levels = np.zeros(1 << COUNTER_BITS, np.uint8).reshape(-1, SLICE)
    summed = slices.repartition("slice").mapInArrow(_sum_slices, "slice int, levels binary")
    for row in summed.collect():
        levels[row["slice"]] = np.frombuffer(row["levels"], np.uint8)
    return levels.ravel()


def prefix_size(n: int, percent: int) -> int:
    """Shingles of which a set shares one with any similar set that is not larger."""
    return n - -(-percent * n // 100) + 1


def short_size(n: int, percent: int) -> int:
    """The same for similar sets that are not smaller; these share more."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def prefixes(tokens: np.ndarray, levels: np.ndarray, percent: int) -> list[np.ndarray]:
    """The prefix of a set in each order, in that order."""
    size = prefix_size(len(tokens), percent)
    rare = levels[_buckets(tokens)].astype(np.uint64) << np.uint64(56)
    out = []
    for seed in _SEEDS:
        keys = rare | (mix(tokens ^ seed) >> np.uint64(8))
        first = np.argpartition(keys, size - 1)[:size]
        out.append(tokens[first[np.argsort(keys[first])]])
    return out


def _measure(shared, k: int, percent: int):
    """Class of each document, and the first prefix of classes new to the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, levels, met = Hasher(VISIBLE, lower=True), shared.value, set()
        for batch in batches:
            sizes, classes, first, found = [], [], [], []
            for data in byte_rows(batch.column(2)):
                tokens = shingles(data, hasher, k)
                key = _class(tokens) if len(tokens) else None
                new = key is not None and key not in met
                met.add(key)
                sizes.append(len(tokens))
                classes.append(key)
                first.append(new)
                prefix = prefixes(tokens, levels, percent)[0] if new else tokens[:0]
                found.append(prefix.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                 pa.array(classes, pa.int64()), pa.array(first, pa.bool_()),
                 lists(found, pa.int64())],
                ["doc_id", "text_key", "n", "class", "first", "prefix"])

    return run


_MEASURED = "doc_id long, text_key long, n long, class long, first boolean, prefix array<long>"


def _whole_sets(shared, wanted, k: int, percent: int):
    """Class, set and prefixes of the rows whose hash may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, levels = Hasher(VISIBLE, lower=True), shared.value
        for batch in batches:
            near = may_hold(wanted.value, batch.column(0).to_numpy().view(np.uint64))
            batch = batch.filter(pa.array(near))
            sets = [shingles(data, hasher, k) for data in byte_rows(batch.column(1))]
            sets = [s for s in sets if len(s)]
            both = [prefixes(s, levels, percent) for s in sets]
            columns = [sets, [b[0] for b in both], [b[1] for b in both]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_class(x) for x in sets], pa.int64()),
                 pa.array([len(x) for x in sets], pa.int64()),
                 *(lists([x.view(np.int64) for x in c], pa.int64()) for c in columns)],
                ["class", "n", "tokens", "prefix0", "prefix1"])

    return run


_SETS = "class long, n long, tokens array<long>, prefix0 array<long>, prefix1 array<long>"


def _row_buckets(column: pa.Array) -> np.ndarray:
    return _buckets(column.to_numpy().view(np.uint64))


def _tally_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << COUNTER_BITS, np.int32)
    for batch in batches:
        counts[_row_buckets(batch.column(0))] = 1
    yield from _slices(counts)


def _sift(shared):
    """Leave out rows whose hash is surely not wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value[_row_buckets(batch.column(1))] > 0))

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in batch.columns[2:]:
                bounds, values = np.asarray(column.offsets), np.asarray(column.values)
                sides.append([values[a:b] for a, b in zip(bounds[:-1], bounds[1:])])
            keep = []
            for left, right in zip(*sides):
                both = len(left) + len(right)
                shared = both - len(distinct(np.concatenate([left, right])))
                keep.append(100 * shared >= percent * (both - shared))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def overlaps(sizes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Shared elements of every two of the sets that follow each other in ``tokens``."""
    m = len(sizes)
    row = np.repeat(np.arange(m), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, row = tokens[order], row[order]
    first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])[:len(tokens)])
    holders = np.diff(np.append(first, len(tokens)))
    held = np.repeat(holders, holders)
    out = np.zeros((m, m), np.float32)
    rare = held <= FEW
    keys, rows = tokens[rare], row[rare]
    for step in range(1, FEW):
        # Rows of one element ascend, so each pair is met once.
        met = keys[step:] == keys[:-step]
        if not met.any():
            break
        np.add.at(out.reshape(-1), rows[:-step][met] * m + rows[step:][met], np.float32(1))
    out += out.T
    rows = row[~rare]
    column = np.repeat(np.arange((holders > FEW).sum()), holders[holders > FEW])
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, AT_ONCE):
        a, b = np.searchsorted(column, [at, at + AT_ONCE])
        some = np.zeros((m, min(AT_ONCE, int(column[-1]) + 1 - at)), np.float32)
        some[rows[a:b], column[a:b] - at] = 1
        out += some @ some.T
    return out


def _forest(percent: int):
    """Links of a spanning forest of a block's classes, between different components."""

    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        node, part, n = (block.column(c).to_numpy() for c in ("class", "part", "n"))
        tokens = block.column("tokens").combine_chunks().flatten().to_numpy()
        shared = overlaps(n, tokens)
        seen, links = np.zeros(len(node), bool), []
        for root in range(len(node)):
            seen[root], reached = True, [] if seen[root] else [root]
            while reached:
                x = reached.pop()
                near = (100 + percent) * shared[x].astype(np.int64) >= percent * (n[x] + n)
                new = np.flatnonzero(near & (part != part[x]) & ~seen)
                seen[new] = True
                reached.extend(new.tolist())
                links.append((np.full(len(new), node[x]), node[new]))
        u, v = (np.concatenate([np.zeros(0, np.int64), *side]) for side in zip(*links))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _least_shared(n: Column, m: Column, percent: int) -> Column:
    """Prefix shingles that similar sets of these sizes share at least.

    The set whose prefix ends first has all of the other's shingles up to there
    among that one's prefix, so a prefix shingle of it that the other's prefix
    lacks is missing from the whole set.
    """
    overlap = F.ceil((n + m) * percent / (100 + percent) - 1e-9)

    def of(size: Column) -> Column:
        prefix = size - F.ceil(size * percent / 100 - 1e-9) + 1
        return overlap - size + prefix

    return F.greatest(F.least(of(n), of(m)), F.lit(1))


def _least_across(n: Column, m: Column, percent: int) -> Column:
    """The same for the smaller set's short prefix and the larger one's prefix."""
    overlap = F.ceil((n + m) * percent / (100 + percent) - 1e-9)
    of_small = overlap - F.ceil(F.least(n, m) * 2 * percent / (100 + percent) - 1e-9) + 1
    of_large = overlap - F.ceil(F.greatest(n, m) * percent / 100 - 1e-9) + 1
    return F.greatest(F.least(of_small, of_large), F.lit(1))


def _band(n: Column, percent: int) -> Column:
    """Band of a set's size; similar sets are in one or in neighbouring bands."""
    return F.floor(F.log(n.cast("double")) / (math.log(100 / percent) * (1 + 1e-9))).cast("int")


class _Join:
    """The classes that share a prefix shingle with another one, and their links.

    A hit is a key that several classes hold. A key is a shingle and a band of
    sizes: a class holds its prefix in its own band, and its short prefix in
    the next one, for the larger sets there.
    """

    def __init__(self, docs: DataFrame, measured: DataFrame, levels, k: int, percent: int, kept):
        self.percent = percent
        n = F.col("n")
        short = n - F.ceil(n * 2 * percent / (100 + percent) - 1e-9) + 1
        band = _band(n, percent)
        own = F.transform("prefix", lambda t: F.struct(
            F.xxhash64(t, band).alias("key"), F.lit(True).alias("own")))
        other = F.transform(F.slice("prefix", F.lit(1), short.cast("int")), lambda t: F.struct(
            F.xxhash64(t, band + 1).alias("key"), F.lit(False).alias("own")))
        firsts = measured.where("first")
        postings = firsts.select("class", "n", F.explode(F.concat(own, other)).alias("held")).select(
            "class", F.col("n").cast("int").alias("n"), "held.key", "held.own").repartition("key")
        several = postings.groupBy("key").agg(
            F.min("class").alias("a"), F.max("class").alias("b"), F.max("own").alias("own"),
        ).where("a != b and own").select("key")
        self.hits = kept(
            postings.join(several, "key").select("key", "class", "n").distinct(), "hits")
        met = self.hits.select("class").distinct()
        # One document of each of these classes stands for it.
        spoken = firsts.join(met, "class").groupBy("class").agg(
            F.min(F.struct("doc_id", "text_key")).alias("one")).select(
            "class", "one.doc_id", "one.text_key")
        spoken = kept(spoken, "spoken")
        spark = docs.sparkSession
        # The row is known by a hash, so texts are not moved; a few other rows come along.
        row = F.xxhash64("doc_id", "text_key")
        wanted = spark.sparkContext.broadcast(bit_table(spoken.select(row)))
        texts = docs.select(row.alias("row"), "text")
        self.sets = kept(
            texts.mapInArrow(_whole_sets(levels, wanted, k, percent), _SETS), "sets")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) of classes that are similar enough.

        ``pairs`` has the sizes n_u and n_v and the number of shared keys. Sets of
        one band hold their whole prefixes under the same keys, those of
        neighbouring bands the short prefix of the smaller and the whole one of
        the larger. The links are written, what leads to them is deleted.
        """
        with temporary(pairs.sparkSession) as kept:
            return materialized(self._links(pairs, kept), "found")

    def _links(self, pairs: DataFrame, kept) -> DataFrame:
        n, m = F.col("n_u"), F.col("n_v")
        least = _least_shared(n, m, self.percent)
        together = _band(n, self.percent) == _band(m, self.percent)
        fits = F.least(n, m) * 100 >= F.greatest(n, m) * self.percent
        keys = F.when(together, least).otherwise(_least_across(n, m, self.percent))
        pairs = kept(pairs.where(fits & (F.col("shared") >= keys)), "pairs")
        orders = [f"prefix{i}" for i in range(len(_SEEDS))]
        passed = F.lit(True)
        for p in orders:
            passed &= F.size(F.array_intersect(f"{p}_u", f"{p}_v")) >= least
        met = self._with_sets(pairs, orders)
        passing = kept(met.where(passed).select("u", "v"), "passing")
        both = self._with_sets(passing, ["tokens"]).select("u", "v", "tokens_u", "tokens_v")
        return both.mapInArrow(_verify(self.percent), "u long, v long")

    def _with_sets(self, pairs: DataFrame, columns: list[str]) -> DataFrame:
        """Pairs with columns of both classes' sets.

        Sets of other classes are left out before they are shuffled.
        """
        classes = pairs.select(F.explode(F.array("u", "v")).alias("class")).distinct()
        wanted = self._sets_of(classes, columns)
        for side in "uv":
            pairs = pairs.join(wanted.select(
                F.col("class").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
        return pairs

    def _sets_of(self, classes: DataFrame, columns: list[str]) -> DataFrame:
        """Columns of the sets of the given classes, and of a few others."""
        table = classes.sparkSession.sparkContext.broadcast(
            _added_up(classes.mapInArrow(_tally_rows, _SLICES)))
        wanted = self.sets.select(F.lit(0).alias("_"), "class", *columns)
        return wanted.mapInArrow(_sift(table), wanted.schema)

    def open_hits(self, roots: DataFrame, kept) -> DataFrame:
        """Hits whose key is held by several components, with the component of each class."""
        known = roots.select(F.col("node").alias("class"), "root")
        placed = self.hits.join(known, "class", "left").select(
            "key", "class", "n", F.coalesce("root", "class").alias("part"))
        several = placed.groupBy("key").agg(
            F.min("part").alias("a"), F.max("part").alias("b")).where("a != b").select("key")
        return kept(placed.join(several, "key"), "open")

    def crowd(self, placed: DataFrame) -> float:
        """Pairs that the hits of different components make, for each hit."""
        held = placed.groupBy("key").agg(F.count("*").cast("double").alias("n"))
        row = held.agg(F.sum("n").alias("hits"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("pairs")).first()
        return row["pairs"] / row["hits"] if row["hits"] else 0.0

    def hub_pairs(self, placed: DataFrame, number: int) -> DataFrame:
        """Each class with the hub of another component that it shares most hits with."""
        order = F.xxhash64(F.lit(number), F.col("class"))
        hubs = placed.groupBy("key").agg(
            F.min(F.struct(order.alias("order"), "class", "part", "n")).alias("hub"))
        met = placed.join(hubs, "key").where(F.col("part") != F.col("hub.part"))
        counted = met.groupBy("class", "n", F.col("hub.class").alias("hub"), F.col("hub.n").alias(
            "n_hub")).agg(F.count("*").alias("shared"))
        best = counted.groupBy("class", "n").agg(
            F.max(F.struct("shared", "hub", "n_hub")).alias("best"))
        # A hub is that of some of the keys that both hold; a quarter of what they must
        # share is promising. Pairs left out here are looked at later.
        return best.select(
            F.col("class").alias("u"), F.col("best.hub").alias("v"), F.col("n").alias("n_u"),
            F.col("best.n_hub").alias("n_v"), (F.col("best.shared") * 4).alias("shared"))

    def crowds(self, placed: DataFrame) -> DataFrame:
        """Keys whose classes make many pairs of different components: key and number of blocks."""
        parts = placed.groupBy("key", "part").agg(
            F.count("*").cast("double").alias("m"), F.sum("n").alias("n"))
        held = parts.groupBy("key").agg(
            F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("same"), F.sum("n").alias("n"))
        held = held.where((F.col("m") * F.col("m") - F.col("same")) / 2 > F.col("m") * CROWDED)
        return held.select("key", F.ceil(F.greatest(
            F.col("m") / BLOCK, F.col("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))

    def crowd_links(self, placed: DataFrame, crowds: DataFrame) -> DataFrame:
        """Links that join the components of each crowd like all links of its pairs; written.

        Each block of a key meets every other one in a task of its own; so a class
        is sent there once for each other block, with its set.
        """
        members = placed.join(crowds, "key")
        own = F.pmod(F.xxhash64(F.lit("block"), "class"), F.col("blocks"))
        others = F.when(F.col("blocks") < 3, F.array(F.lit(0).cast("long"))).otherwise(F.filter(
            F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1).cast("long")), lambda x: x != own))
        own = F.when(F.col("blocks") < 3, F.lit(0).cast("long")).otherwise(own)
        met = members.select("key", "class", "part", "n", own.alias("own"), F.explode(others).alias("other"))
        met = met.select("key", "class", "part", "n", F.least("own", "other").alias("low"),
                         F.greatest("own", "other").alias("high"))
        sets = self._sets_of(members.select("class").distinct(), ["tokens"]).select("class", "tokens")
        found = met.join(sets, "class").groupBy("key", "low", "high").applyInArrow(
            _forest(self.percent), "u long, v long")
        return materialized(found, "found")

    def all_pairs(self, placed: DataFrame, crowds: DataFrame) -> DataFrame:
        """Every pair of classes of different components that shares a hit, once.

        Pairs that share the key of a crowd have been looked at. Keys of no crowd
        make a bounded number of pairs for each hit.
        """
        rows = placed.join(crowds, "key", "left_anti")
        left, right = (rows.select("key", *[F.col(x).alias(f"{x}_{c}") for x in
                                            ("class", "part", "n")]) for c in "uv")
        apart = (F.col("class_u") < F.col("class_v")) & (F.col("part_u") != F.col("part_v"))
        met = left.join(right, "key").where(apart)
        return met.groupBy(F.col("class_u").alias("u"), F.col("class_v").alias("v"), "n_u", "n_v").agg(
            F.count("*").alias("shared"))


def _texts(docs: DataFrame) -> DataFrame:
    """Id, hash of the text, and text; the first two know a row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", F.xxhash64("text").alias("text_key"), "text")


def ngram_components(
    docs: DataFrame, k: int = 5, percent: int = 80, hub_rounds: int = HUB_ROUNDS,
) -> DataFrame:
    """doc_id, text_key, n_shingles, class_id and component_id of every document.

    Two documents are linked when their shingle sets have a Jaccard similarity
    of at least ``percent`` hundredths. ``class_id`` is the smallest id with
    the same set, ``component_id`` the smallest id that links lead to. Words are
    what white space separates, without ASCII case; a text of fewer than ``k``
    words is one shingle, a null or wordless text has none and is linked with
    nothing, so it stays alone. Rows with equal ids are separate documents, and
    ``text_key``, the hash of the text, tells them apart; null ids are larger
    than all others. Sets and shingles are known by 64 hash bits.
    """
    rows = _rooted(docs, k, percent, hub_rounds)
    alone = F.col("class").isNull()
    return rows.select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"),
        *[F.when(alone, F.col("doc_id")).otherwise(F.col(c)).alias(c)
          for c in ("class_id", "component_id")],
    )


def _rooted(docs: DataFrame, k: int, percent: int, hub_rounds: int) -> DataFrame:
    """Every row's class with its smallest id, and its component's root and smallest id."""
    texts = _texts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(frequency_levels(texts.select("text"), k))
    measured = materialized(texts.mapInArrow(_measure(shared, k, percent), _MEASURED), "measured")
    with temporary(docs.sparkSession) as kept:
        roots = _roots(_Join(texts, measured, shared, k, percent, kept), hub_rounds, kept)
    classes = measured.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.min("doc_id").alias("class_id"))
    classes = classes.join(
        roots.select(F.col("node").alias("class"), "root"), "class", "left",
    ).withColumn("root", F.coalesce("root", "class"))
    least = classes.groupBy("root").agg(F.min("class_id").alias("component_id"))
    classes = classes.join(least, "root")
    return measured.select("doc_id", "text_key", "n", "class").join(classes, "class", "left")


def _roots(join: _Join, hub_rounds: int, kept) -> DataFrame:
    """node and root of every class that is linked to a smaller one; written."""
    roots = join.hits.limit(0).select(F.col("class").alias("node"), F.col("class").alias("root"))
    placed, number, crowd, before = join.open_hits(roots, kept), 0, 0.0, math.inf
    # Rounds go on while they thin out what would else be compared pair by pair.
    while number < hub_rounds or number < MOST_HUB_ROUNDS and CROWDED < crowd < LEFT * before:
        roots = _tied(roots, join.links(join.hub_pairs(placed, number)))
        placed = join.open_hits(roots, kept)
        number, before, crowd = number + 1, crowd or math.inf, join.crowd(placed)
    crowds = kept(join.crowds(placed), "crowds")
    if not crowds.isEmpty():
        roots = _tied(roots, join.crowd_links(placed, crowds))
        placed = join.open_hits(roots, kept)
    return _tied(roots, join.links(join.all_pairs(placed, crowds)))


def _tied(roots: DataFrame, found: DataFrame) -> DataFrame:
    """Roots after more links: components known so far go on as their links to the root."""
    return components(
        roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(found))


def one_of_each_group(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, and every row without words, with their columns.

    It is the row of the smallest document id, null ids last, and among equal
    ids that of the smallest ``text_key``. Of rows that repeat id and text any
    one stays.
    """
    rows = _rooted(docs, k, percent, HUB_ROUNDS)
    each = rows.where(F.col("root").isNotNull()).groupBy("root", "doc_id", "text_key").agg(
        F.count("*").alias("n"))
    least = each.groupBy("root").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "n")).alias("row"))
    wordless = rows.where(F.col("root").isNull()).select("doc_id", "text_key").distinct()
    stay = least.select("row.doc_id", "row.text_key", (F.col("row.n") > 1).alias("repeats")).union(
        wordless.withColumn("repeats", F.lit(False)))
    stay_id, stay_key, repeats = free_names(docs, "_id", "_key", "_repeats")
    stay = materialized(stay.toDF(stay_id, stay_key, repeats), "stay")
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(stay_id)) & (key == F.col(stay_key))
    kept = docs.join(stay.where(~F.col(repeats)), same, "left_semi")
    if stay.where(repeats).isEmpty():
        return kept
    repeated = docs.join(stay.where(repeats), same, "left_semi").withColumn(stay_key, key)
    return kept.union(repeated.dropDuplicates(["doc_id", stay_key]).drop(stay_key))
