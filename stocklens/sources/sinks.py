"""Writers: managed tables, dated exports, snapshots, SQL views."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.sources import commits
from stocklens.sources.readers import child_names
from stocklens.sources.schemas import ALL_TABLES


def materialize(df: DataFrame, table: str, force: bool = False) -> bool:
    """Save a frame as a table; a table with rows is kept unless ``force``.

    Returns whether the frame was written.
    """
    spark = df.sparkSession
    if not force and spark.catalog.tableExists(table):
        if not spark.table(table).isEmpty():
            return False
    df.write.mode("overwrite").saveAsTable(table)
    return True


# File headers of measures that the tables do not hold.
MEASURE_HEADERS = {
    "unit_profit": "utilidad_unitaria",
    "margin_pct": "margen_porcentaje",
    "profit_month": "utilidad_mes",
    "stock_value": "valor_inventario",
    "revenue_month": "ingresos_mes",
    "turnover_month": "rotacion_mensual",
    "turnover_year": "rotacion_anual",
    "months_of_stock": "meses_inventario",
    "stock_state": "estado_stock",
    "growth_pct": "crecimiento_pct",
    "projection": "proyeccion_siguiente_mes",
    "suggested_purchase": "compra_sugerida",
    "cumulative_pct": "porcentaje_acumulado",
    "abc_class": "clasificacion_abc",
    "location_code": "ubicacion_codigo",
    "idle_days": "dias_sin_venta",
}


def with_file_headers(df: DataFrame, table: str | None = None) -> DataFrame:
    """Rename library columns to the headers used in exchange files."""
    names = dict(MEASURE_HEADERS)
    specs = [ALL_TABLES[table]] if table else [
        ALL_TABLES[n] for n in ("locations", "suppliers", "categories", "products")
    ]
    for spec in specs:
        names.update({f.name: f.header for f in spec.fields})
    return df.withColumnsRenamed({c: names[c] for c in df.columns if c in names})


def export_report(
    df: DataFrame, directory: str, name: str, as_of: str, single_file: bool = False
) -> str:
    """Write a report as CSV to ``<directory>/<name>_<yyyymmdd>``.

    Many files in parallel by default. ``single_file`` is for reports whose
    size is known to be small, since one task then writes everything.
    """
    path = f"{directory.rstrip('/')}/{name}_{as_of.replace('-', '')}"
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)
    return path


def snapshot_tables(tables: Mapping[str, DataFrame], directory: str, stamp: str) -> dict[str, str]:
    """A dated Parquet copy of every table; returns the path of each."""
    paths = {n: f"{directory.rstrip('/')}/{stamp}/{n}" for n in tables}
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(paths[name])
    return paths


def publish_tables(
    tables: Mapping[str, DataFrame], directory: str, stamp: str, kept: int = 2,
) -> int:
    """A copy of a whole set of tables that readers see at once or not at all; its number.

    Every table is written to a folder of this attempt. When all are complete, one
    commit names them; a failure half way leaves the set before. Sets older than
    the last ``kept`` are removed, and so is what failed attempts left before them.
    """
    spark = next(iter(tables.values())).sparkSession
    numbers = commits.numbers(spark, directory)
    number = max(numbers, default=0) + 1
    attempt = uuid.uuid4().hex
    paths = {n: f"sets/{number}-{attempt}/{n}" for n in tables}
    for name, df in tables.items():
        df.write.parquet(f"{directory}/{paths[name]}")
    commits.publish(spark, directory, number, {"stamp": stamp, "paths": paths})
    old = [n for n in commits.numbers(spark, directory) if n <= number - kept]
    gone = {f"sets/{n}" for n in child_names(spark, f"{directory}/sets")
            if int(n.partition("-")[0]) <= number - kept}
    commits.remove(spark, directory, gone | {f"commits/{n}" for n in old})
    return number


def published_tables(
    spark: SparkSession, directory: str, number: int | None = None,
) -> tuple[str, dict[str, DataFrame]]:
    """Stamp and tables of a published set; of the last complete one without a number."""
    held = commits.content(spark, directory, number)
    return held["stamp"], {n: spark.read.parquet(f"{directory}/{p}") for n, p in held["paths"].items()}


def table_stats(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per table, largest first."""
    counts = [
        df.agg(F.count("*").alias("live_rows")).select(
            F.lit(name).alias("table_name"), "live_rows"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).orderBy(
        F.col("live_rows").desc(), "table_name"
    )


def register_views(spark: SparkSession, views: Mapping[str, DataFrame]) -> list[str]:
    """Publish frames as temporary views; returns their names."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)

