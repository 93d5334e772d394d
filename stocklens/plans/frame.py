"""The enriched product frame that selections and their reports start from."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame

from stocklens.functions import labels as L
from stocklens.functions import measures as M
from stocklens.functions.classes import stock_state4
from stocklens.operators.joins import enrich
from stocklens.operators.ordering import asc, desc
from stocklens.operators.select import active
from stocklens.sources.tables import Tables


def enriched_inventory(t: Tables, include_inactive: bool = False) -> DataFrame:
    """Products with category, supplier and location attributes, by id."""
    products = active(t.products, include_inactive)
    out = enrich(products, t.categories, t.suppliers, t.locations)
    return out.select(
        *t.products.columns,
        "category",
        "category_margin",
        "supplier",
        "supplier_rating",
        "lead_days",
        "location_code",
        "location_description",
    ).orderBy(asc("product_id"))


def with_measures(df: DataFrame) -> DataFrame:
    """Margins, turnover, months of stock, stock state and growth."""
    return (
        df.transform(M.with_margin, half_even=True)
        .transform(M.with_turnover)
        .transform(M.with_months_of_stock, no_sales=L.NO_SALES_MONTHS)
        .transform(M.with_growth)
        .withColumn("stock_state", stock_state4(L.STATE_ICON))
    )


def analysis_frame(
    t: Tables, include_inactive: bool = False,
    dims: Collection[str] = ("categories", "suppliers", "locations"),
) -> DataFrame:
    """Enriched products with all measures; input of the selection reports.

    ``dims`` names the dimensions to join. A left join is not pruned when its
    columns go unused, so reports that need fewer should say so. Cache the
    frame when several reports are taken from one selection.
    """
    products = active(t.products, include_inactive)
    return with_measures(enrich(products, **{name: getattr(t, name) for name in dims}))


def recent_movements(t: Tables, k: int = 100) -> DataFrame:
    """The newest movements."""
    ties = ("movement_id", "product_id", "kind", "quantity")
    return t.movements.orderBy(desc("moved_at"), *[asc(c) for c in ties]).limit(k)
