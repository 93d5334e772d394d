"""Named sets of reports, and the standing exports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from stocklens.operators.select import critical
from stocklens.plans import finance, kpis, sales, stock
from stocklens.sources.scratch import materialized
from stocklens.sources.sinks import export_report
from stocklens.sources.tables import Tables

# The set that runs when none is named.
STANDARD: dict[str, Callable[[Tables], DataFrame]] = {
    "critical_products": stock.critical_products,
    "top15_sales": sales.top15_sales,
    "category_profitability": finance.category_profitability_brief,
    "executive_kpis": kpis.executive_kpis,
}


@dataclass(frozen=True)
class Outcome:
    """A report's lazy result, or the error that kept it from being built."""

    result: DataFrame | None
    error: Exception | None = None


def run_report_suite(
    tables: Tables, reports: Mapping[str, Callable[[Tables], DataFrame]] | None = None
) -> dict[str, Outcome]:
    """Build every report; a failing one does not stop the others."""
    outcomes = {}
    for name, report in (STANDARD if reports is None else reports).items():
        try:
            outcomes[name] = Outcome(report(tables))
        except (PySparkException, AttributeError, KeyError, ValueError) as error:
            outcomes[name] = Outcome(None, error)
    return outcomes


def shared_tables(tables: Tables, names: Sequence[str] = ("products",)) -> Tables:
    """The set with some tables written once, for several reports to read.

    A snapshot that is derived from sales is then derived once. Reports read the
    columns and rows they need from what was written.
    """
    def once(name: str) -> Callable[[], DataFrame]:
        return lambda: materialized(getattr(tables, name), f"shared-{name}")

    held = tables.names()
    return Tables(**{n: once(n) if n in names else (lambda n=n: getattr(tables, n)) for n in held})


def export_standard(selection: DataFrame, directory: str, as_of: str) -> dict[str, str]:
    """The selection, its critical products and its ABC table as dated CSV."""
    # File names of the exports.
    reports = {
        "inventario_completo": selection,
        "productos_criticos": critical(selection),
        "analisis_abc": finance.abc_table(selection),
    }
    return {n: export_report(df, directory, n, as_of) for n, df in reports.items()}
