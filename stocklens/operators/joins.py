"""Joins of the product snapshot with its dimensions.

No join is hinted. Spark broadcasts a dimension whose measured size is below
``spark.sql.autoBroadcastJoinThreshold``; a larger one is sort-merge joined,
where adaptive execution splits the partitions of a frequent key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.functions.measures import location_code


def category_dim(categories: DataFrame) -> DataFrame:
    return categories.select(
        "category_id",
        "category",
        F.col("description").alias("category_description"),
        F.col("target_margin").alias("category_margin"),
        F.col("active").alias("category_active"),
    )


def supplier_dim(suppliers: DataFrame) -> DataFrame:
    return suppliers.select(
        "supplier_id",
        "supplier",
        "lead_days",
        F.col("rating").alias("supplier_rating"),
        F.col("contact").alias("supplier_contact"),
        F.col("phone").alias("supplier_phone"),
        F.col("email").alias("supplier_email"),
        F.col("address").alias("supplier_address"),
        F.col("city").alias("supplier_city"),
        F.col("country").alias("supplier_country"),
        F.col("active").alias("supplier_active"),
        F.col("registered_at").alias("supplier_registered_at"),
    )


def location_dim(locations: DataFrame) -> DataFrame:
    return locations.select(
        "location_id",
        F.col("section").alias("location_section"),
        F.col("aisle").alias("location_aisle"),
        F.col("shelf").alias("location_shelf"),
        F.col("level").alias("location_level"),
        F.col("capacity").alias("location_capacity"),
        F.col("description").alias("location_description"),
        location_code(("section", "aisle", "shelf")).alias("location_code"),
    )


def join_dims(
    products: DataFrame,
    categories: DataFrame | None = None,
    suppliers: DataFrame | None = None,
    how: str = "inner",
) -> DataFrame:
    """Category and/or supplier attributes; ``inner`` drops unmatched products."""
    if categories is not None:
        products = products.join(category_dim(categories), "category_id", how)
    if suppliers is not None:
        products = products.join(supplier_dim(suppliers), "supplier_id", how)
    return products


def enrich(
    products: DataFrame,
    categories: DataFrame | None = None,
    suppliers: DataFrame | None = None,
    locations: DataFrame | None = None,
) -> DataFrame:
    """The given dimensions, keeping every product.

    Attributes that clash carry the dimension's name as prefix, so ``active``
    and ``description`` stay the product's.
    """
    joined = join_dims(products, categories, suppliers, how="left")
    if locations is not None:
        joined = joined.join(location_dim(locations), "location_id", "left")
    return joined


def location_left_join(locations: DataFrame, products: DataFrame) -> DataFrame:
    """Every location with the totals of its active products.

    The products are reduced to one row per location before the join, so a
    crowded location is one row in it; empty locations survive with NULLs.
    """
    from stocklens.functions.measures import AMOUNT, stock_value

    totals = (
        products.filter(F.col("active"))
        .groupBy("location_id")
        .agg(
            F.count("product_id").alias("products"),
            F.sum("stock").alias("units"),
            F.sum(stock_value()).cast(AMOUNT).alias("value"),
        )
    )
    return locations.join(totals, "location_id", "left")


def supplier_join(suppliers: DataFrame, products: DataFrame) -> DataFrame:
    """Suppliers with their products; suppliers without any drop out."""
    return join_dims(products, suppliers=suppliers)
