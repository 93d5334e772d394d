"""T4 with bounded state and without loss: window sums that close, and corrections for late rows.

``live.live_kpis`` as a stream drops rows behind the watermark. Here a micro-batch
is summed per window first, map-side combined as any aggregation. Then:

* sums of open windows are added to those kept from the batches before;
* windows that the watermark has passed are written once, as final, and leave
  the kept ones, so these span about the lateness, whatever the stream has seen;
* sums for windows that closed earlier are late. They go to a folder of
  corrections, small rows that are added to the final ones when read.

The watermark is the newest time of the batches before, less the lateness, as
Spark has it. It is part of the commit that ends a micro-batch, so a batch that
is run again after a failure decides alike and writes the same folders.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from stocklens.sources import commits
from stocklens.sources.readers import path_exists
from stocklens.sources.scratch import run_path
from stocklens.streaming.live import LATENESS, WINDOW, live_kpis

KEYS = ("window_start", "window_end", "kind")
SUMS = "window_start timestamp_ntz, window_end timestamp_ntz, kind string, movements long, amount decimal(18,2)"
#: Commits, and folders of kept sums, that stay for a batch that is run again.
KEPT = 2


def _added(sums: DataFrame) -> DataFrame:
    return sums.groupBy(*KEYS).agg(
        F.sum("movements").cast("long").alias("movements"),
        F.sum("amount").cast("decimal(18,2)").alias("amount"))


def _read(spark: SparkSession, path: str) -> DataFrame:
    """Sums of a folder; none where no batch has written any."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], SUMS)
    return spark.read.schema(SUMS).parquet(path)


def _place(directory: str, name: str, number: int) -> str:
    return f"{directory}/{name}/version={number}"


def _instant(text: str | None):
    return F.lit(text).cast("timestamp_ntz")


def settle_batch(
    movements: DataFrame, directory: str, number: int,
    window: str = WINDOW, lateness: str = LATENESS,
) -> dict:
    """Add a micro-batch of movements (ts, kind, amount) as version ``number``; what was done.

    The commit holds the watermark it went by, the newest time so far, and the
    numbers of windows kept, closed and corrected.
    """
    spark = movements.sparkSession
    if number in commits.numbers(spark, directory):
        return commits.content(spark, directory, number)
    before = {"newest": None} if number == 0 else commits.content(spark, directory, number - 1)
    # Summed and measured in one pass over the batch; the sums are read three times.
    path = f"{directory}/batches/{number}"
    live_kpis(movements.where("ts IS NOT NULL"), window).write.mode("overwrite").parquet(path)
    batch = _read(spark, path)
    newest = movements.agg(F.max("ts").cast("timestamp_ntz").cast("string")).first()[0]
    newest = max((t for t in (before["newest"], newest) if t), default=None)
    passed = before.get("watermark_after")
    watermark = spark.range(1).select(
        (_instant(newest) - F.expr(f"INTERVAL {lateness}")).cast("string")).first()[0]
    late = F.coalesce(F.col("window_end") <= _instant(passed), F.lit(False))
    closing = F.coalesce(F.col("window_end") <= _instant(watermark), F.lit(False))
    kept = _added(_read(spark, _place(directory, "open", number - 1)).union(batch.where(~late)))
    parts = {"open": kept.where(~closing), "final": kept.where(closing), "corrections": batch.where(late)}
    counts = {}
    for name, rows in parts.items():
        rows.write.mode("overwrite").parquet(_place(directory, name, number))
        counts[name] = _read(spark, _place(directory, name, number)).count()
    done = {"newest": newest, "watermark": passed, "watermark_after": watermark, **counts}
    commits.publish(spark, directory, number, done)
    old = [n for n in commits.numbers(spark, directory) if n <= number - KEPT]
    gone = {f"open/version={n}" for n in old} | {f"commits/{n}" for n in old}
    commits.remove(spark, directory, gone | {f"batches/{number}"})
    return done


def settling_stream(
    movements: DataFrame, directory: str, window: str = WINDOW, lateness: str = LATENESS,
) -> DataStreamWriter:
    """Fold a stream of movements into the directory, a version per micro-batch."""
    def fold(batch: DataFrame, batch_id: int) -> None:
        settle_batch(batch, directory, batch_id, window, lateness)

    return movements.writeStream.foreachBatch(fold)


def read_sums(spark: SparkSession, directory: str, final_only: bool = False) -> DataFrame:
    """Sums per window and kind of all movements of the published batches.

    With ``final_only`` those of closed windows. Corrections are part of both;
    files of a batch that was not published are not read.
    """
    last = max(commits.numbers(spark, directory), default=None)
    if last is None:
        return spark.createDataFrame([], SUMS)
    written = spark.read.schema(f"{SUMS}, version int")
    closed = written.parquet(f"{directory}/final").union(written.parquet(f"{directory}/corrections"))
    rows = closed.where(F.col("version") <= last).drop("version")
    return _added(rows if final_only else rows.union(_read(spark, _place(directory, "open", last))))


def run_settling(
    movements: DataFrame, window: str = WINDOW, lateness: str = LATENESS,
) -> tuple[DataFrame, str]:
    """Fold all present movements of a stream; the sums, and the directory."""
    spark = movements.sparkSession
    directory = run_path(spark, "settling")
    writer = settling_stream(movements, directory, window, lateness)
    writer.option("checkpointLocation", run_path(spark, "settling-checkpoint")).trigger(
        availableNow=True).start().awaitTermination()
    return read_sums(spark, directory), directory
