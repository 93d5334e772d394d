"""Readers: typed CSV/Parquet tables, optional tables, JDBC, and whole sets."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stocklens.sources.schemas import ALL_TABLES, FILE_NAMES, NOW, Field, Table
from stocklens.sources.tables import Tables


#: First lines of CSV files that are read at a time.
HEADER_READERS = 32

# Column, lower bound, upper bound, partitions of a parallel database read.
Split = tuple[str, int, int, int]


def _spec(table: str | Table) -> Table:
    return table if isinstance(table, Table) else ALL_TABLES[table]


def _hadoop(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists, on whatever file system it names."""
    fs, hadoop_path = _hadoop(spark, path)
    return fs.exists(hadoop_path)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a directory; none when it is missing."""
    fs, hadoop_path = _hadoop(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return [s.getPath().getName() for s in fs.listStatus(hadoop_path)]


def _parsed(column: str, source: T.DataType, target: T.DataType) -> str:
    """The column in the target type; values that do not parse become NULL."""
    if source == target:
        return column
    if isinstance(source, T.StringType):
        column = f"trim({column})"
        if isinstance(target, T.DateType):
            # A time of day is allowed and cut off.
            return f"to_date(try_to_timestamp({column}))"
    return f"try_cast({column} AS {target.simpleString()})"


def _default(field: Field, now: str | None) -> str:
    value = now if field.default is NOW else field.default
    if field.default is NOW and now is None:
        return "localtimestamp()"
    text = "NULL" if value is None else f"'{value}'"
    return f"CAST({text} AS {field.type.simpleString()})"


def conform(df: DataFrame, table: str | Table, now: str | None = None) -> DataFrame:
    """Give a frame the table's columns and types.

    Columns may carry the library name or the file header. Text that is no
    valid value of the type becomes NULL. Columns that are absent are added
    with the default; columns that are present keep their NULLs. ``now`` is
    the load time for time defaults (ISO text); without it the time of the
    query is used.
    """
    present = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for f in _spec(table).fields:
        source = next((n for n in (f.name, f.header) if n in present), None)
        if source is None:
            value = _default(f, now)
        else:
            value = _parsed(f"`{source}`", present[source], f.type)
        columns.append(f"{value} AS {f.name}")
    return df.selectExpr(*columns)


def _csv_files(spark: SparkSession, path: str) -> list:
    """Data files of a path, a folder or a pattern, as Spark would list them."""
    fs, place = _hadoop(spark, path)
    found, open_ = [], list(fs.globStatus(place) or [])
    while open_:
        status = open_.pop()
        if status.isDirectory():
            # Names with = are partition folders; other folders are not descended into.
            inner = fs.listStatus(status.getPath())
            open_ += [s for s in inner if not s.isDirectory() or "=" in s.getPath().getName()]
        elif status.getLen() and status.getPath().getName()[0] not in "._":
            found.append(status.getPath())
    return found


def _first_line(spark: SparkSession, file) -> str:
    """A file's first line; compressed files are opened through their codec."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    stream = file.getFileSystem(conf).open(file)
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
    try:
        source = codec.createInputStream(stream) if codec else stream
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(source, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def _csv_by_header(spark: SparkSession, path: str) -> list[DataFrame]:
    """CSV text by header name, one frame for each different header among the files.

    Spark takes the first file's header for all files it reads together, so
    files are read together only if their headers are equal. Only first lines
    are looked at here, side by side; one header gives one plain scan.
    """
    def scan(paths: list[str], **options: str) -> DataFrame:
        return (
            spark.read.options(**options)
            .option("header", True)
            .option("encoding", "UTF-8")
            .option("nullValue", "NULL")
            .csv(paths)
        )

    files = _csv_files(spark, path)
    with ThreadPoolExecutor(HEADER_READERS) as pool:
        headers = list(pool.map(lambda f: _first_line(spark, f), files))
    groups: dict[str, list[str]] = {}
    for header, file in sorted(zip(headers, map(lambda f: f.toString(), files))):
        groups.setdefault(header, []).append(file)
    if len(groups) <= 1:
        return [scan([path])]
    fs, place = _hadoop(spark, path)
    base = {"basePath": path} if fs.exists(place) else {}  # keeps columns from partition folders
    return [scan(group, **base) for group in groups.values()]


def read_table(
    spark: SparkSession, table: str | Table, path: str, fmt: str = "csv", now: str | None = None
) -> DataFrame:
    """Read one table with its declared types.

    CSV is read as text by each file's own header and then conformed, so files
    with fewer or reordered columns are fine; a column that a file lacks has its
    default there. Column pruning still reaches the scan. ``NULL`` as text is a NULL.
    """
    if fmt == "csv":
        parts = [conform(part, table, now) for part in _csv_by_header(spark, path)]
        return reduce(DataFrame.unionByName, parts)
    return conform(spark.read.format(fmt).load(path), table, now)


def empty_table(spark: SparkSession, table: str | Table) -> DataFrame:
    return spark.createDataFrame([], _spec(table).schema)


def read_optional(
    spark: SparkSession, table: str | Table, path: str, fmt: str = "csv", now: str | None = None
) -> DataFrame:
    """As ``read_table``; a missing path gives an empty table with the schema."""
    if not path_exists(spark, path):
        return empty_table(spark, table)
    return read_table(spark, table, path, fmt, now)


def read_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    options: dict[str, str] | None = None,
    split: Split | None = None,
) -> DataFrame:
    """Run a query at a database.

    ``split`` is (column, lower, upper, partitions): Spark then reads ranges
    of that column in parallel, in place of one connection for everything.
    """
    reader = spark.read.format("jdbc").option("url", url).options(**(options or {}))
    if split is None:
        return reader.option("query", query).load()
    column, lower, upper, partitions = split
    return (
        reader.option("dbtable", f"({query}) q")
        .option("partitionColumn", column)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .load()
    )


def run_sql(
    spark: SparkSession, query: str, params: dict[str, Any] | None = None
) -> DataFrame:
    """A parameterised query over registered views; errors are raised."""
    return spark.sql(query, args=params or {})


def load_directory(
    spark: SparkSession, directory: str, fmt: str = "csv", now: str | None = None
) -> Tables:
    """All tables of a directory; alerts and movements may be missing."""
    suffix = {"csv": ".csv"}.get(fmt, "")

    def path(name: str) -> str:
        return f"{directory.rstrip('/')}/{FILE_NAMES[name]}{suffix}"

    def opener(name: str):
        read = read_optional if name in ("movements", "alerts") else read_table
        return lambda: read(spark, name, path(name), fmt, now)

    return Tables(**{name: opener(name) for name in FILE_NAMES})


def load_database(
    spark: SparkSession,
    url: str,
    options: dict[str, str] | None = None,
    splits: dict[str, Split] | None = None,
) -> Tables:
    """The same set from a database, one query per table.

    ``splits`` names the tables that are read in parallel, and how.
    """

    def opener(name: str):
        query = f"SELECT * FROM {ALL_TABLES[name].header}"
        split = (splits or {}).get(name)
        return lambda: conform(read_jdbc(spark, url, query, options, split), name)

    return Tables(**{name: opener(name) for name in FILE_NAMES})


def load_inventory(
    spark: SparkSession,
    jdbc: dict[str, Any] | None = None,
    directory: str | None = None,
    fmt: str = "csv",
    now: str | None = None,
) -> tuple[Tables, bool]:
    """The tables and whether they come from the database.

    The database is used when it is configured (``jdbc`` holds the arguments
    of ``load_database``) and has products; otherwise the directory is. Errors
    of the database are raised.
    """
    if jdbc:
        tables = load_database(spark, **jdbc)
        if directory is None or not tables.products.isEmpty():
            return tables, True
    if directory is None:
        raise ValueError("neither a database nor a directory is given")
    return load_directory(spark, directory, fmt, now), False
