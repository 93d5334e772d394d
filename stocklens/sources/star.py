"""Inventory tables derived from a retail star schema.

Maps part, supplier, lineitem, orders and events tables (Parquet) to the
inventory tables. ``AS_OF`` stands for "today". The product snapshot is
aggregated per part and supplier, then per part. Both steps combine on the
map side, so a frequent part costs one row per supplier and task in the shuffle.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.functions import labels as L
from stocklens.sources.readers import conform
from stocklens.sources.tables import Tables

AS_OF = "2001-08-01"
NOW = "2001-08-01 00:00:00"
LEVEL_MIN = 100


# The columns that are used. With a schema Spark need not open files to plan.
STAR_SCHEMAS = {
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_returnflag string, "
                "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}


def star_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.schema(STAR_SCHEMAS[name]).parquet(f"{directory}/{name}.parquet")


# Sales counters: the days before "today" that they leave out and reach back to.
COUNTERS = {
    "sales_month": (0, 30),
    "sales_prev_month": (30, 60),
    "sales_quarter": (0, 90),
    "sales_year": (0, 365),
}


def _sales(lineitem: DataFrame, as_of: str, main_supplier: bool, days: int | None) -> DataFrame:
    """Units per window, last sale and main supplier per part.

    With ``days`` only that many days are read, and only what they tell is given.
    """
    day = F.lit(as_of).cast("date")
    upto = lineitem.filter(F.col("l_shipdate") <= F.lit(as_of).cast("timestamp_ntz"))
    if days is not None:
        first = date.fromisoformat(as_of) - timedelta(days=days - 1)
        upto = upto.filter(F.col("l_shipdate") >= F.lit(str(first)).cast("timestamp_ntz"))
    shipped = F.col("l_shipdate").cast("date")

    def units(first_age: int, last_age: int):
        inside = (shipped > F.date_sub(day, last_age)) & (shipped <= F.date_sub(day, first_age))
        return F.sum(F.when(inside, F.col("l_quantity")).otherwise(0.0))

    windows = {n: units(*ages) for n, ages in counters(days).items()}
    last_sale = F.max(shipped).alias("last_sale")
    if not main_supplier:
        return upto.groupBy("l_partkey").agg(
            *[c.cast("int").alias(n) for n, c in windows.items()],
            *([last_sale] if days is None else []),
        )
    per_supplier = upto.groupBy("l_partkey", "l_suppkey").agg(
        *[c.alias(n) for n, c in windows.items()],
        F.sum("l_quantity").alias("quantity"),
        last_sale,
    )
    # Largest quantity, then lowest key, packed into one number: the maximum of
    # a decimal is hash-aggregated, while that of a struct would need a sort. A
    # number that does not fit raises an error.
    span, top = (F.lit(str(n)).cast("decimal(20,0)") for n in (2**64, 2**63 - 1))
    units_sold = F.col("quantity").cast("decimal(17,0)")
    packed = units_sold * span + (top - F.col("l_suppkey").cast("decimal(20,0)"))
    per_part = per_supplier.groupBy("l_partkey").agg(
        *[F.sum(n).cast("int").alias(n) for n in windows],
        F.max("last_sale").alias("last_sale"),
        F.max(packed).alias("packed"),
    )
    main = (top - F.pmod(F.col("packed"), span)).cast("bigint")
    return per_part.withColumn("supplier_id", main).drop("packed")


def _unit_cost():
    """55 to 84 percent of the price, cut off to whole cents."""
    cents = F.round(F.col("p_retailprice") * 100, 0).cast("bigint")
    scaled = cents * (55 + F.col("p_size") % 30)
    whole = (scaled - scaled % 100).cast("decimal(14,0)")
    return (whole * F.lit("0.0001").cast("decimal(5,4)")).cast("decimal(10,2)")


def _brand_number():
    return F.substring("p_brand", 7, 4).cast("int")


def counters(days: int | None) -> dict[str, tuple[int, int]]:
    """The counters that can be told from the last ``days`` days."""
    return {n: ages for n, ages in COUNTERS.items() if days is None or ages[1] <= days}


def _category_id():
    """A number of 60 bits from the part type: any type has its own, without a list."""
    return F.conv(F.substring(F.md5(F.col("p_type").cast("binary")), 1, 15), 16, 10).cast("bigint")


def products(
    spark: SparkSession, directory: str, as_of: str = AS_OF, main_supplier: bool = True,
    days: int | None = None,
) -> DataFrame:
    """The product snapshot.

    The main supplier needs every (part, supplier) pair. Reports that do not
    look at suppliers can leave it out, and one aggregation per part is left.
    Reports that look back a number of ``days`` only can say so: older sales
    are then not read, and the snapshot lacks the last sale and the counters
    that reach back further.
    """
    if main_supplier and days is not None:
        raise ValueError("the main supplier needs the whole history")
    part = star_table(spark, directory, "part")
    sales = _sales(star_table(spark, directory, "lineitem"), as_of, main_supplier, days)
    key = F.col("p_partkey")
    known = counters(days)
    snapshot = part.join(sales, key == F.col("l_partkey"), "left").select(
        key.alias("product_id"),
        F.col("p_name").alias("name"),
        _category_id().alias("category_id"),
        *(["supplier_id"] if main_supplier else []),
        _brand_number().alias("location_id"),
        F.when(key % 20 == 0, 0).otherwise(F.col("p_size")).alias("stock"),
        _unit_cost().alias("unit_cost"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in known],
        *(["last_sale"] if days is None else []),
        (key % 50 != 7).alias("active"),
    )
    unknown = [] if days is None else [c for c in COUNTERS if c not in known] + ["last_sale"]
    return conform(snapshot, "products", NOW).drop(*unknown)


def categories(spark: SparkSession, directory: str) -> DataFrame:
    kinds = star_table(spark, directory, "part").select("p_type").distinct()
    return conform(
        kinds.select(_category_id().alias("category_id"), F.col("p_type").alias("category")),
        "categories", NOW,
    )


def suppliers(spark: SparkSession, directory: str) -> DataFrame:
    key = F.col("s_suppkey")
    tenths = (30 + key % 20).cast("decimal(3,0)") * F.lit("0.1").cast("decimal(2,1)")
    return conform(
        star_table(spark, directory, "supplier").select(
            key.alias("supplier_id"),
            F.col("s_name").alias("supplier"),
            (2 + key % 9).cast("int").alias("lead_days"),
            tenths.cast("decimal(3,2)").alias("rating"),
            (key % 10 != 3).alias("active"),
        ),
        "suppliers", NOW,
    )


def locations(spark: SparkSession, directory: str) -> DataFrame:
    """One per brand, some with missing parts, and one that holds nothing."""
    brands = star_table(spark, directory, "part").select("p_brand").distinct()
    number = F.col("location_id")
    empty = F.array_compact(F.array(F.when(number == 1, F.lit(0)), number))
    coded = brands.select(_brand_number().alias("location_id")).select(
        F.explode(empty).alias("location_id")
    )
    return conform(
        coded.select(
            "location_id",
            F.lit("B").alias("section"),
            number.cast("string").alias("aisle"),
            F.when(number % 5 != 0, F.concat(F.lit("E"), number % 5)).alias("shelf"),
            (number % 3).cast("string").alias("level"),
            F.lit(2000).alias("capacity"),
        ),
        "locations", NOW,
    )


def _line_id():
    return F.col("l_orderkey") * 10 + F.col("l_linenumber")


def movements(spark: SparkSession, directory: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", L.KIND_IN).otherwise(L.KIND_OUT)
    return conform(
        star_table(spark, directory, "lineitem").select(
            _line_id().alias("movement_id"),
            F.col("l_partkey").alias("product_id"),
            kind.alias("kind"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_shipdate").alias("moved_at"),
        ),
        "movements", NOW,
    )


def as_stock_updates(events: DataFrame, *more: str) -> DataFrame:
    """Events as stock readings: key, sequence, level, minimum and a name, and more columns."""
    return events.select(
        *more,
        F.col("user_id").alias("product_id"),
        F.col("event_id").alias("seq"),
        F.col("value").alias("level"),
        F.lit(float(LEVEL_MIN)).alias("min_level"),
        F.col("event_type").alias("name"),
    )


def stock_updates(spark: SparkSession, directory: str) -> DataFrame:
    return as_stock_updates(star_table(spark, directory, "events"))


def alerts(spark: SparkSession, directory: str) -> DataFrame:
    """Errors as alerts; every third is resolved."""
    state = F.when(F.col("event_id") % 3 == 0, L.STATUS_RESOLVED).otherwise(L.STATUS_ACTIVE)
    return conform(
        star_table(spark, directory, "events").filter(F.col("event_type") == "error").select(
            F.col("event_id").alias("alert_id"),
            F.col("user_id").alias("product_id"),
            F.lit(L.ALERT_LOW_STOCK).alias("kind"),
            F.col("props").alias("message"),
            state.alias("status"),
            F.col("ts").alias("raised_at"),
        ),
        "alerts", NOW,
    )


def purchases(spark: SparkSession, directory: str) -> DataFrame:
    state = (
        F.when(F.col("o_orderstatus") == "F", "RECIBIDA")
        .when(F.col("o_orderstatus") == "O", "PENDIENTE")
        .otherwise(F.col("o_orderstatus"))
    )
    return conform(
        star_table(spark, directory, "orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("supplier_id"),
            F.col("o_orderdate").cast("date").alias("ordered_on"),
            state.alias("status"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("total"),
        ),
        "purchases", NOW,
    )


def purchase_lines(spark: SparkSession, directory: str) -> DataFrame:
    return conform(
        star_table(spark, directory, "lineitem").select(
            _line_id().alias("line_id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("ordered"),
            (F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(10,2)").alias("unit_price"),
            F.col("l_extendedprice").cast("decimal(10,2)").alias("subtotal"),
        ),
        "purchase_lines", NOW,
    )


def star_tables(
    spark: SparkSession, directory: str, as_of: str = AS_OF, main_supplier: bool = True,
    days: int | None = None,
) -> Tables:
    return Tables(
        products=lambda: products(spark, directory, as_of, main_supplier, days),
        categories=lambda: categories(spark, directory),
        suppliers=lambda: suppliers(spark, directory),
        locations=lambda: locations(spark, directory),
        movements=lambda: movements(spark, directory),
        alerts=lambda: alerts(spark, directory),
        purchases=lambda: purchases(spark, directory),
        purchase_lines=lambda: purchase_lines(spark, directory),
    )
