"""T4: live sums per movement kind, and the stream source and sink."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from stocklens.sources.readers import child_names
from stocklens.sources.scratch import run_path

WINDOW = "5 minutes"
LATENESS = "10 minutes"


EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def live_kpis(movements: DataFrame, window: str = WINDOW, lateness: str = LATENESS) -> DataFrame:
    """Movements and amount per kind in tumbling windows of ``ts``.

    Rows later than the watermark are dropped from a stream; a batch frame
    keeps all. The watermark needs a zoned timestamp: a stream's wall-clock
    times are read as UTC and written back so, whatever the session's zone.
    Windows are whole seconds long.
    """
    rows, start, end = movements, F.col("w.start"), F.col("w.end")
    if movements.isStreaming:
        wall = F.concat(F.col("ts").cast("timestamp_ntz").cast("string"), F.lit("Z"))
        rows = movements.withColumn("ts", wall.cast("timestamp")).withWatermark("ts", lateness)
        start, end = (
            F.expr(f"{EPOCH} + make_dt_interval(0, 0, 0, unix_seconds(w.{side}))")
            for side in ("start", "end")
        )
    sums = rows.groupBy(F.window("ts", window).alias("w"), "kind").agg(
        F.count("*").alias("movements"),
        F.sum(F.col("amount").cast("decimal(18,2)")).cast("decimal(18,2)").alias("amount"),
    )
    return sums.select(
        start.cast("timestamp_ntz").alias("window_start"),
        end.cast("timestamp_ntz").alias("window_end"),
        "kind", "movements", "amount",
    )


def file_stream(
    spark: SparkSession, directory: str, schema: T.StructType | str, glob: str = "*.parquet",
    files_per_trigger: int | None = None, bytes_per_trigger: int = 256 * 2**20,
) -> DataFrame:
    """A Parquet directory as a stream whose micro-batches are bounded, by size or by files."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    return reader.parquet(directory)


def date_by_name(spark: SparkSession, directory: str, glob: str = "*.parquet") -> None:
    """Date the files of a directory a second apart by name, so that a stream reads them so.

    A file stream takes the oldest file first. Storage that keeps no set times
    raises an error, as the order would be left to chance.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{directory}/{glob}")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())

    def listed() -> list:
        return sorted(files.globStatus(place) or [], key=lambda f: f.getPath().getName())

    found = listed()
    if not found:
        return
    first = max(f.getModificationTime() for f in found) - 1000 * len(found)
    wanted = [first + 1000 * i for i in range(len(found))]
    for status, time in zip(found, wanted):
        files.setTimes(status.getPath(), time, -1)
    times = [f.getModificationTime() for f in listed()]
    if any(a >= b for a, b in zip(times, times[1:])):
        raise ValueError(f"the storage does not keep the times of files: {directory}")


#: A stream keeps its partitions for good, and few cores may be there when it starts.
STATE_PARTITIONS = 8


@contextmanager
def state_partitions(spark: SparkSession) -> Iterator[None]:
    """A stream started in this block keeps its state in as many partitions as there are cores, at most.

    Micro-batches are bounded, so a setting that grows with the table would only add tasks, each of
    which loads and commits its part of the state in every one of them. Up to ``STATE_PARTITIONS``
    are taken in any case.
    """
    setting = "spark.sql.shuffle.partitions"
    before = spark.conf.get(setting)
    most = max(STATE_PARTITIONS, spark.sparkContext.defaultParallelism)
    spark.conf.set(setting, min(int(before), most))
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def start_to_files(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet files, exactly once, for all data there is."""
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    with state_partitions(stream.sparkSession):
        return writer.start(out)


def run_to_files(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over all present data; the files it wrote as a frame."""
    spark = stream.sparkSession
    out, checkpoint = run_path(spark, label), run_path(spark, f"{label}-checkpoint")
    query = start_to_files(stream, out, checkpoint)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


BATCH = "_batch"


def start_updates(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the changed rows of each micro-batch to a folder of its own.

    A batch that is run again overwrites its folder.
    """
    def put(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/{BATCH}={batch_id}")

    writer = (
        stream.writeStream.foreachBatch(put)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    with state_partitions(stream.sparkSession):
        return writer.start()


def latest_rows(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    """Of each key the row that was written last."""
    written = spark.read.option("basePath", out).parquet(out)
    values = [c for c in written.columns if c not in (*keys, BATCH)]
    last = written.groupBy(*keys).agg(F.max_by(F.struct(*values), BATCH).alias("last"))
    return last.select(*keys, "last.*")


def run_updates(stream: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Run an aggregation over all present data; the last state of every key.

    Open windows are part of it, so on data within the lateness the result is
    that of the batch frame.
    """
    spark = stream.sparkSession
    out, checkpoint = run_path(spark, label), run_path(spark, f"{label}-checkpoint")
    start_updates(stream, out, checkpoint).awaitTermination()
    if not child_names(spark, out):
        return spark.createDataFrame([], stream.schema)
    return latest_rows(spark, out, keys).select(*stream.columns)
