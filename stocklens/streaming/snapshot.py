"""Apply row updates to the product snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from stocklens.sources.readers import child_names, path_exists
from stocklens.sources.scratch import run_path


APPLIED = "_applied_"  # column of a version: the sequence number that set another column


def _changed(snapshot: DataFrame, updates: DataFrame, key: str) -> list[str]:
    return [c for c in updates.columns if c in snapshot.columns and c != key]


def _upsert(
    snapshot: DataFrame, updates: DataFrame, now: str, key: str, seq: str
) -> DataFrame:
    """The snapshot after the updates, with the sequence numbers applied so far."""
    changed = _changed(snapshot, updates, key)
    given = {c: F.when(F.col(c).isNotNull(), F.col(seq)) for c in changed}
    latest = updates.groupBy(F.col(key).alias("_hit")).agg(
        *[F.max_by(c, given[c]).alias(f"_new_{c}") for c in changed],
        *[F.max(given[c]).alias(f"_seq_{c}") for c in changed],
    )
    joined = snapshot.join(latest, F.col(key) == F.col("_hit"), "left")
    stamp = F.lit(now).cast(snapshot.schema["updated_at"].dataType)
    never = F.lit(None).cast("long")
    out = {c: F.col(c) for c in snapshot.columns if not c.startswith(APPLIED)}
    out["updated_at"] = F.when(F.col("_hit").isNotNull(), stamp).otherwise(F.col("updated_at"))
    for c in changed:
        before = F.col(APPLIED + c) if APPLIED + c in snapshot.columns else never
        newer = F.col(f"_seq_{c}").isNotNull() & (before.isNull() | (F.col(f"_seq_{c}") > before))
        out[c] = F.when(newer, F.col(f"_new_{c}")).otherwise(F.col(c))
        out[APPLIED + c] = F.when(newer, F.col(f"_seq_{c}")).otherwise(before)
    return joined.select(*[column.alias(name) for name, column in out.items()])


def upsert_snapshot(
    snapshot: DataFrame, updates: DataFrame, now: str,
    key: str = "product_id", seq: str = "seq",
) -> DataFrame:
    """The snapshot after the updates, columns as before.

    Of several updates to a row the last value of each column counts; a NULL
    in an update leaves the column alone. Every row that an update hits gets
    ``updated_at = now``, also when no value changes. An update of an unknown
    key hits nothing; ``unknown_updates`` has those.
    """
    return _upsert(snapshot, updates, now, key, seq).select(*snapshot.columns)


def unknown_updates(
    snapshot: DataFrame, updates: DataFrame, key: str = "product_id"
) -> DataFrame:
    """The updates whose key the snapshot lacks."""
    return updates.join(snapshot.select(key), key, "left_anti")


def _version(directory: str, batch: int) -> str:
    return f"{directory.rstrip('/')}/version={batch}"


def read_version(spark: SparkSession, directory: str, batch: int) -> DataFrame:
    version = spark.read.parquet(_version(directory, batch))
    return version.drop(*[c for c in version.columns if c.startswith(APPLIED)])


def upsert_stream(
    snapshot: DataFrame, updates: DataFrame, directory: str, now: str | None = None,
    key: str = "product_id", seq: str = "seq",
) -> DataStreamWriter:
    """Fold a stream of updates into versions of the snapshot, one per micro-batch.

    A version also holds the sequence number that set each column, so an update
    that arrives after a newer one changes nothing, in whichever batch. A batch
    reads the version before it and overwrites its own, so a batch that is run
    again after a failure gives the same files. Only the first batch starts
    from ``snapshot``; a later one whose version before is gone fails.
    """
    def fold(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        base = snapshot
        if batch_id > 0:
            before = _version(directory, batch_id - 1)
            if not path_exists(spark, before):
                raise FileNotFoundError(f"version before batch {batch_id} is missing: {before}")
            base = spark.read.parquet(before)
        stamp = now or spark.sql("SELECT cast(localtimestamp() AS string)").first()[0]
        folded = _upsert(base, batch, stamp, key, seq)
        folded.write.mode("overwrite").parquet(_version(directory, batch_id))

    return updates.writeStream.foreachBatch(fold)


def run_upsert(snapshot: DataFrame, updates: DataFrame, now: str) -> DataFrame:
    """Fold all present updates of a stream; the last version as a frame."""
    spark = snapshot.sparkSession
    directory = run_path(spark, "snapshot")
    query = (
        upsert_stream(snapshot, updates, directory, now)
        .option("checkpointLocation", run_path(spark, "snapshot-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    versions = [int(n.removeprefix("version=")) for n in child_names(spark, directory)]
    return read_version(spark, directory, max(versions)) if versions else snapshot
