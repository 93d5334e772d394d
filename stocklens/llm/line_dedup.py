"""Operator 3: drop repeated lines with levelled sorted runs of line hashes.

The lines seen so far are kept as runs: tables of (key hash, number of
documents), sorted by hash. A new batch of documents is anti-joined against
the runs; the keys that no run holds are new, and the batch's largest document
with such a key becomes its holder. Then the batch adds its own run. Runs are
kept in levels: as soon as a level has ``FAN`` runs, they are merged into one
run of the next level, so a batch meets few runs however many came before.

Batches go through the documents from the largest id down. So the holder of a
key is the last document with it, and the runs hold the number of documents
with the key, whichever batches they were in. Only hashes, counts and ids
move; texts stay where they are until the lines to drop are known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.llm.cuts import cut_points, free_names
from stocklens.sources.scratch import run_path

#: Runs of a level that are merged into the next.
FAN = 2
#: Batches that a whole table is cut into.
BATCHES = 4
#: Keys that may be so frequent that their places are looked up instead of shuffled.
HOT = 1000

_WHITE = "\t\n\v\f\r "
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_KEY = ("h1", "h2")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def line_key(line: Column) -> Column:
    """What makes lines equal: white space at both ends and ASCII case do not count."""
    return ascii_lower(F.btrim(line, F.lit(_WHITE)))


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_places(docs: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, text_key, place, h1, h2 of the lines whose key is long enough.

    A key is known by 128 hash bits, a row by its id and the hash of its text.
    """
    lines = docs.select("doc_id", "text_key", F.posexplode(lines_of(F.col("text"))))
    keyed = lines.where(F.char_length("col") >= least_chars).select(
        "doc_id", "text_key", F.col("pos").alias("place"), line_key(F.col("col")).alias("key"))
    return keyed.where(F.char_length("key") >= least_chars).select(
        "doc_id", "text_key", "place", F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit("line"), "key").alias("h2"))


class LineRuns:
    """Levelled runs of line keys below a shared folder."""

    def __init__(self, spark: SparkSession, path: str, fan: int = FAN):
        self.spark, self.path, self.fan = spark, path, fan
        self.levels: list[list[str]] = [[]]
        self._made = 0

    def _write(self, run: DataFrame) -> str:
        path = f"{self.path}/run-{self._made:05d}"
        self._made += 1
        ranged = run.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY)
        ranged.write.parquet(path)
        return path

    def runs(self) -> list[DataFrame]:
        """All runs, the largest first."""
        return [self.spark.read.parquet(p) for level in reversed(self.levels) for p in level]

    def new_keys(self, keys: DataFrame) -> DataFrame:
        """The keys of a batch that no run holds."""
        return reduce(lambda left, run: left.join(run, list(_KEY), "left_anti"), self.runs(), keys)

    def add(self, keys: DataFrame) -> None:
        """Add a batch's keys with their document counts, and merge full levels."""
        self.levels[0].append(self._write(keys.select(*_KEY, "n_docs")))
        level = 0
        while len(self.levels[level]) >= self.fan:
            full, self.levels[level] = self.levels[level], []
            merged = self._merged([self.spark.read.parquet(p) for p in full])
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(merged))
            level += 1

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy(*_KEY).agg(
            F.sum("n_docs").alias("n_docs"))

    def counts(self) -> DataFrame:
        """Each key with the number of documents that hold it."""
        return self._merged(self.runs())


def _batch_bounds(docs: DataFrame, batches: int) -> list[tuple[int | None, int | None]]:
    """Ranges (from, below) of document ids with about equal numbers of rows, largest first."""
    edges = [None, *cut_points(docs, "doc_id", batches), None]
    return list(zip(edges[:-1], edges[1:]))[::-1]


def repeated_lines(
    docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = BATCHES,
    fan: int = FAN,
) -> DataFrame:
    """doc_id, text_key and places of the lines to drop, one row per document that loses any.

    ``docs`` has doc_id, text_key and text.
    """
    spark = docs.sparkSession
    folder = run_path(spark, "lines")
    line_places(docs, least_chars).write.parquet(f"{folder}/places")
    places = spark.read.parquet(f"{folder}/places")
    runs, holders = LineRuns(spark, f"{folder}/runs", fan), []
    for number, (low, below) in enumerate(_batch_bounds(docs, batches)):
        batch, doc = places, F.col("doc_id")
        if low is not None:
            batch = batch.where(doc >= low)
        if below is not None:
            batch = batch.where((doc < below) | doc.isNull() if low is None else doc < below)
        # One row per key and document first, so that a frequent line is added up early.
        keys = batch.groupBy(*_KEY, "doc_id").agg(F.lit(1).alias("one")).groupBy(*_KEY).agg(
            F.count("*").alias("n_docs"), F.max("doc_id").alias("holder"))
        keys.write.parquet(f"{folder}/batch-{number}")
        keys = spark.read.parquet(f"{folder}/batch-{number}")
        runs.new_keys(keys).select(*_KEY, "holder").write.parquet(f"{folder}/new-{number}")
        holders.append(spark.read.parquet(f"{folder}/new-{number}"))
        runs.add(keys)
    often = runs.counts().where(F.col("n_docs") >= least_docs)
    dropped = often.join(reduce(DataFrame.unionByName, holders), list(_KEY))
    dropped.write.parquet(f"{folder}/dropped")
    dropped = spark.read.parquet(f"{folder}/dropped")
    # At most HOT keys are found in so many documents; their places are not shuffled by key.
    hot = F.col("n_docs") >= max(least_docs, places.count() // HOT)
    first = F.broadcast(dropped.where(hot).select(*_KEY, F.col("holder").alias("hot_holder"), F.lit(True).alias("hot")))
    met = places.join(first, list(_KEY), "left")
    rest = met.where("hot IS NULL").drop("hot", "hot_holder")
    found = met.where("hot").withColumnRenamed("hot_holder", "holder").drop("hot").unionByName(
        rest.join(dropped.where(~hot).select(*_KEY, "holder"), list(_KEY)))
    return (
        found.where(~F.col("doc_id").eqNullSafe(F.col("holder")))
        .groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("places"))
    )


def drop_repeated_lines(
    docs: DataFrame, least_chars: int = 20, least_docs: int = 3, batches: int = BATCHES,
    fan: int = FAN,
) -> DataFrame:
    """The documents with ``text`` cut, and with n_lines (before) and n_dropped.

    Lines whose key has at least ``least_chars`` characters and is found in at
    least ``least_docs`` documents stay only in the largest document id that
    holds the key, there as often as they occur. Rows with equal ids are one
    document; a null id is one that is smaller than all others. Null and empty
    texts are one empty line, which is always too short. The result has no null
    text. Extra columns stay, whatever their names; existing n_lines and n_dropped are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped")
    key, own = F.xxhash64("text"), free_names(docs, "_id", "_key", "_places")
    rows = docs.select("doc_id", key.alias("text_key"), "text")
    found = repeated_lines(rows, least_chars, least_docs, batches, fan).select(
        *[F.col(c).alias(n) for c, n in zip(("doc_id", "text_key", "places"), own)])
    joined = docs.join(
        found, docs["doc_id"].eqNullSafe(F.col(own[0])) & (key == F.col(own[1])), "left")
    lines, places = lines_of(F.col("text")), F.col(own[2])
    kept = F.filter(lines, lambda line, place: ~F.array_contains(places, place))
    text = F.when(places.isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(kept, "\n"))
    return joined.withColumns({
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.when(places.isNull(), 0).otherwise(F.size(places)).cast("long"),
        "text": text,
    }).drop(*own)
