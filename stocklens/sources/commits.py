"""Numbered commits of a folder: what a version consists of, published in one step.

Files are written first, each attempt in a place of its own or over what a
failed one left; then ``commits/N`` names them. A reader takes the last commit, so
it never sees half of a version, and a failure leaves the one before.
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from stocklens.sources.readers import child_names, path_exists


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def publish(spark: SparkSession, directory: str, number: int, content: dict) -> None:
    """Make commit ``number`` by one rename; one that is there stays as it is."""
    files, draft = _hadoop(spark, f"{directory}/commits/_draft-{number}")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    _, final = _hadoop(spark, f"{directory}/commits/{number}")
    if not files.rename(draft, final) and not files.exists(final):
        raise OSError(f"version {number} cannot be published below {directory}")


def numbers(spark: SparkSession, directory: str) -> list[int]:
    """Numbers of the published versions, ascending."""
    return sorted(int(n) for n in child_names(spark, f"{directory}/commits") if n.isdigit())


def content(spark: SparkSession, directory: str, number: int | None = None) -> dict:
    """What a commit holds; the last one without a number."""
    number = max(numbers(spark, directory), default=None) if number is None else number
    path = f"{directory}/commits/{number}"
    if number is None or not path_exists(spark, path):
        raise FileNotFoundError(f"version {number} is missing below {directory}")
    return json.loads("".join(r.value for r in spark.read.text(path, wholetext=True).collect()))


def remove(spark: SparkSession, directory: str, paths: set[str]) -> None:
    """Delete files or folders below the directory."""
    for path in paths:
        files, place = _hadoop(spark, f"{directory}/{path}")
        files.delete(place, True)
