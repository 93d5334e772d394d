"""The set of tables that reports read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from stocklens.sources.schemas import ALL_TABLES

Source = DataFrame | Callable[[], DataFrame]


class Tables:
    """Inventory tables by name, as attributes.

    A table is given as a frame or as a function that opens it; the function
    is called when a report first asks for the table.
    """

    products: DataFrame
    categories: DataFrame
    suppliers: DataFrame
    locations: DataFrame
    movements: DataFrame
    alerts: DataFrame
    purchases: DataFrame
    purchase_lines: DataFrame

    def __init__(self, **sources: Source) -> None:
        unknown = set(sources) - set(ALL_TABLES)
        if unknown:
            raise ValueError(f"unknown tables: {sorted(unknown)}")
        self._sources = sources

    def __getattr__(self, name: str) -> DataFrame:
        # Only called for tables that are not open yet.
        sources = self.__dict__.get("_sources", {})
        if name not in sources:
            raise AttributeError(f"no table {name!r}")
        source = sources[name]
        frame = source() if callable(source) else source
        self.__dict__[name] = frame
        return frame

    def names(self) -> list[str]:
        """Names of the set's tables; none is opened."""
        return list(self._sources)

    def as_dict(self) -> dict[str, DataFrame]:
        """Table name -> frame, for all tables of the set."""
        return {name: getattr(self, name) for name in self._sources}
