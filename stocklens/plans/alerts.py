"""Reorder and idle-stock alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.functions import labels as L
from stocklens.functions import measures as M
from stocklens.functions.classes import idle_priority, position_in, reorder_priority
from stocklens.operators.joins import join_dims
from stocklens.operators.ordering import asc
from stocklens.operators.select import active, is_critical
from stocklens.sources.tables import Tables


def auto_alerts(t: Tables, as_of: str, idle_after: int = 45) -> DataFrame:
    """Reorder alerts and idle-stock alerts, most urgent first.

    A product can raise both kinds. They are built side by side and exploded,
    so the products are read and joined once, not once per kind.
    """
    days = M.idle_days(as_of)
    reorder = F.struct(
        F.lit(L.ALERT_REORDER).alias("alert_kind"),
        F.format_string(L.MESSAGE_REORDER, "stock", "min_stock").alias("message"),
        reorder_priority().alias("priority"),
        F.col("lead_days"),
        M.reorder_investment().alias("investment"),
    )
    idle = F.struct(
        F.lit(L.ALERT_IDLE).alias("alert_kind"),
        F.format_string(L.MESSAGE_IDLE, days).alias("message"),
        idle_priority(days).alias("priority"),
        F.lit(None).cast("int").alias("lead_days"),
        M.stock_value().alias("investment"),
    )
    raised = F.array_compact(F.array(
        F.when(is_critical(), reorder),
        F.when((days > idle_after) & (F.col("stock") > 0), idle),
    ))
    return (
        join_dims(active(t.products), suppliers=t.suppliers)
        .withColumn("alert", F.explode(raised))
        .select(
            "alert.alert_kind", "product_id", "name", "alert.message", "alert.priority",
            "supplier", "alert.lead_days", "alert.investment",
            F.lit(as_of).cast("date").alias("raised_on"),
        )
        .orderBy(
            position_in(F.col("alert_kind"), [L.ALERT_REORDER]),
            position_in(F.col("priority"), L.PRIORITIES[:3]),
            asc("product_id"),
        )
    )
