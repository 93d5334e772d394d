"""T3 without copies of the table: a snapshot with delta runs, merged when read.

A micro-batch of updates is reduced to one row per key and written as a run of
level 0. When a level has ``FANOUT`` runs they are merged into one run of the
next level, so an update is written again once per level. When the oldest run
has grown to a share of the snapshot, it is folded into it. What a batch writes
follows the batch, but for a fold, which many batches share.

A row of a run holds, per column, the value and the sequence number of the
newest update that set it; of two runs the higher number wins, column by
column. So runs may be merged in any order and updates may arrive in any.

Rows are dealt to buckets by key, a folder each: a reader of some keys opens
their buckets only. ``commits/N`` names the files of version N and is made in
one step after they are complete. A batch that is run again after a failure
writes the same folder, and a reader never sees a half-written version.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from stocklens.sources import commits
from stocklens.sources.readers import child_names
from stocklens.sources.scratch import run_path

#: Runs of one level that are merged.
FANOUT = 4
#: Buckets of keys, at least, and rows of the snapshot in one.
BUCKETS, BUCKET_ROWS = 16, 1_000_000
#: Rows of the oldest run over those of the snapshot from which it is folded in.
FOLD = 0.5
#: Versions whose files are kept.
KEPT = 2

BUCKET, APPLIED, STAMP = "_bucket", "_applied_", "_stamp"


@dataclass(frozen=True)
class Run:
    """Files below the directory with the updates of some batches."""

    path: str
    level: int
    rows: int


@dataclass(frozen=True)
class Version:
    """What a reader needs: the snapshot's files, and the runs since."""

    number: int
    key: str
    changed: list[str]
    buckets: int
    schema: str
    base: str
    base_rows: int
    runs: list[Run]

    @property
    def columns(self) -> T.StructType:
        """The snapshot's columns."""
        return T.StructType.fromJson(json.loads(self.schema))

    def stored_columns(self, run: bool) -> T.StructType:
        """Those of its files, or of the files of a run."""
        names = [self.key, *self.changed] if run else self.columns.names
        fields = [self.columns[n] for n in names]
        fields += [T.StructField(APPLIED + c, T.LongType()) for c in self.changed]
        if run:
            fields.append(T.StructField(STAMP, self.columns["updated_at"].dataType))
        return T.StructType([*fields, T.StructField(BUCKET, T.IntegerType())])

    def files(self) -> set[str]:
        return {self.base, *(r.path for r in self.runs)}


def versions(spark: SparkSession, directory: str) -> list[int]:
    """Numbers of the published versions, ascending."""
    return commits.numbers(spark, directory)


def _commit(spark: SparkSession, directory: str, version: Version) -> None:
    commits.publish(spark, directory, version.number, asdict(version))


def read_commit(spark: SparkSession, directory: str, number: int | None = None) -> Version:
    """A published version; the last one without a number."""
    fields = commits.content(spark, directory, number)
    return Version(**fields | {"runs": [Run(**r) for r in fields["runs"]]})


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, version: Version, path: str) -> int:
    """Write rows by bucket, replacing what a failed attempt left; the number of rows."""
    rows = rows.withColumn(BUCKET, _bucket(F.col(version.key), version.buckets))
    # A bucket goes to one task, so a run has one file per bucket at most.
    rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).count()


def _newest(rows: DataFrame, key: str, changed: Sequence[str]) -> DataFrame:
    """One row per key: of each column the value with the highest sequence number."""
    newest = [F.max_by(c, APPLIED + c).alias(c) for c in changed]
    numbers = [F.max(APPLIED + c).alias(APPLIED + c) for c in changed]
    return rows.groupBy(key).agg(*newest, *numbers, F.max(STAMP).alias(STAMP))


def _as_run(updates: DataFrame, version: Version, stamp: str, seq: str) -> DataFrame:
    """A batch of updates as rows of a run; a null value sets nothing."""
    number, schema = F.col(seq).cast("long"), version.columns
    rows = updates.where(F.col(version.key).isNotNull()).select(
        F.col(version.key).cast(schema[version.key].dataType).alias(version.key),
        *[F.col(c).cast(schema[c].dataType).alias(c) for c in version.changed],
        *[F.when(F.col(c).isNotNull(), number).alias(APPLIED + c) for c in version.changed],
        F.lit(stamp).cast(schema["updated_at"].dataType).alias(STAMP))
    return _newest(rows, version.key, version.changed)


def create(
    snapshot: DataFrame, directory: str, changed: Sequence[str], key: str = "product_id",
    buckets: int | None = None,
) -> Version:
    """Write the snapshot as version 0; updates may set the ``changed`` columns.

    A directory that has versions stays as it is.
    """
    spark = snapshot.sparkSession
    if versions(spark, directory):
        return read_commit(spark, directory)
    never = [F.lit(None).cast("long").alias(APPLIED + c) for c in changed]
    buckets = buckets or max(BUCKETS, snapshot.count() // BUCKET_ROWS)
    version = Version(0, key, list(changed), buckets, snapshot.schema.json(), "base/0", 0, [])
    rows = _write(snapshot.select("*", *never), version, f"{directory}/base/0")
    version = replace(version, base_rows=rows)
    _commit(spark, directory, version)
    return version


def _stored(
    spark: SparkSession, directory: str, version: Version, path: str,
    buckets: Sequence[int] | None,
) -> DataFrame:
    schema = version.stored_columns(run=path != version.base)
    rows = spark.read.schema(schema).parquet(f"{directory}/{path}")
    if buckets is not None:
        rows = rows.where(F.col(BUCKET).isin(list(buckets)))
    return rows.drop(BUCKET)


def _merged(
    spark: SparkSession, directory: str, version: Version, runs: Sequence[Run],
    buckets: Sequence[int] | None = None,
) -> DataFrame:
    parts = [_stored(spark, directory, version, r.path, buckets) for r in runs]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows if len(parts) == 1 else _newest(rows, version.key, version.changed)


def _with_runs(
    spark: SparkSession, directory: str, version: Version, runs: Sequence[Run],
    buckets: Sequence[int] | None = None,
) -> DataFrame:
    """The snapshot's rows with the runs applied, and the sequence numbers."""
    base = _stored(spark, directory, version, version.base, buckets)
    if not runs:
        return base
    delta = _merged(spark, directory, version, runs, buckets)
    changed = version.changed
    hit = delta.select(F.col(version.key).alias("_hit"), STAMP, *[
        F.col(c).alias(f"_new_{c}") for c in changed], *[
        F.col(APPLIED + c).alias(f"_seq_{c}") for c in changed])
    joined = base.join(hit, base[version.key] == hit["_hit"], "left")
    out = {c: F.col(c) for c in version.columns.names}
    out["updated_at"] = F.coalesce(STAMP, "updated_at")
    for c in changed:
        before, after = F.col(APPLIED + c), F.col(f"_seq_{c}")
        newer = after.isNotNull() & (before.isNull() | (after > before))
        out[c] = F.when(newer, F.col(f"_new_{c}")).otherwise(F.col(c))
        out[APPLIED + c] = F.when(newer, after).otherwise(before)
    return joined.select(*[column.alias(name) for name, column in out.items()])


def read_snapshot(
    spark: SparkSession, directory: str, number: int | None = None,
    keys: Sequence | None = None,
) -> DataFrame:
    """The snapshot of a version, the last one without a number; of some keys, if given.

    A few keys are looked up in their buckets alone.
    """
    version = read_commit(spark, directory, number)
    chosen = None
    if keys is not None:
        key = T.StructType([T.StructField("k", version.columns[version.key].dataType)])
        wanted = spark.createDataFrame([(k,) for k in keys], key).select(
            _bucket(F.col("k"), version.buckets))
        chosen = sorted({r[0] for r in wanted.collect()})
    rows = _with_runs(spark, directory, version, version.runs, chosen)
    rows = rows.select(*version.columns.names)
    return rows if keys is None else rows.where(F.col(version.key).isin(list(keys)))


def _compacted(
    spark: SparkSession, directory: str, version: Version, fanout: int, fold: float,
) -> Version:
    """Merge full levels upwards, and the oldest run into the snapshot when it is large."""
    runs = list(version.runs)
    level = 0
    while len(full := [r for r in runs if r.level == level]) >= fanout:
        path = f"runs/{level + 1}-{version.number}"
        rows = _write(_merged(spark, directory, version, full), version, f"{directory}/{path}")
        runs = [r for r in runs if r.level != level] + [Run(path, level + 1, rows)]
        level += 1
    oldest = max(runs, key=lambda r: r.level)  # a level's runs are older than those below
    if oldest.level and oldest.rows >= fold * version.base_rows:
        path = f"base/{version.number}"
        _write(_with_runs(spark, directory, version, [oldest]), version, f"{directory}/{path}")
        runs.remove(oldest)
        version = replace(version, base=path)
    return replace(version, runs=runs)


def _drop_old(spark: SparkSession, directory: str, version: Version) -> None:
    """Remove commits before the last versions, and the files that no version names."""
    numbers = [n for n in versions(spark, directory) if n <= version.number]
    named = set().union(*(read_commit(spark, directory, n).files() for n in numbers[-KEPT:]))
    paths = {f"{kind}/{name}" for kind in ("base", "runs")
             for name in child_names(spark, f"{directory}/{kind}")}
    # What a later version has written so far is not named yet.
    old = {p for p in paths - named if int(re.split("[-/]", p)[-1]) <= version.number}
    commits.remove(spark, directory, old | {f"commits/{n}" for n in numbers[:-KEPT]})


def apply_batch(
    updates: DataFrame, directory: str, number: int, now: str | None = None, seq: str = "seq",
    fanout: int = FANOUT, fold: float = FOLD,
) -> Version:
    """Add a batch of updates as version ``number``, the one after the last.

    A version that is there already stays as it is, so a batch may be applied
    again. One that leaves out a version fails.
    """
    spark = updates.sparkSession
    if number in versions(spark, directory):
        return read_commit(spark, directory, number)
    before = read_commit(spark, directory, number - 1)
    stamp = now or spark.sql("SELECT cast(localtimestamp() AS string)").first()[0]
    path = f"runs/0-{number}"
    rows = _write(_as_run(updates, before, stamp, seq), before, f"{directory}/{path}")
    runs = [*before.runs, Run(path, 0, rows)] if rows else before.runs
    version = replace(before, number=number, runs=runs)
    if rows:
        version = _compacted(spark, directory, version, fanout, fold)
    _commit(spark, directory, version)
    _drop_old(spark, directory, version)
    return version


def upsert_stream(
    updates: DataFrame, directory: str, now: str | None = None, seq: str = "seq",
    fanout: int = FANOUT, fold: float = FOLD,
) -> DataStreamWriter:
    """Fold a stream of updates into a directory that ``create`` made, a version per micro-batch."""
    def add(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, directory, batch_id + 1, now, seq, fanout, fold)

    return updates.writeStream.foreachBatch(add)


def run_upsert(snapshot: DataFrame, updates: DataFrame, now: str, **options) -> DataFrame:
    """Fold all present updates of a stream; the snapshot of the last version.

    The result is that of ``snapshot.upsert_snapshot``: the newest value of each
    column counts in whatever order updates arrive, a null leaves the column
    alone, every row that is hit gets ``updated_at = now``, and an unknown or null
    key hits nothing.
    """
    spark = snapshot.sparkSession
    directory = run_path(spark, "delta-snapshot")
    changed = [c for c in updates.columns if c in snapshot.columns and c != "product_id"]
    create(snapshot, directory, changed)
    query = (
        upsert_stream(updates, directory, now, **options)
        .option("checkpointLocation", run_path(spark, "delta-checkpoint"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return read_snapshot(spark, directory)
