"""The declared key, reference and NOT NULL rules as a violations report."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.sources.schemas import ALL_TABLES, VALUE_SETS

DUPLICATE_KEY = "duplicate_key"
ORPHAN_KEY = "orphan_key"
NULL_VALUE = "null_value"
BAD_VALUE = "bad_value"


#: Rule of an entry, as the report has it.
_RULE = "table_name string, rule string, column_name string"


def _entries(name: str, df: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """What one scan of a table tells about all its rules, as (domain, value, rule) per row.

    The domain of a key or reference is the table whose key it is. A row that
    breaks a rule by itself gives an entry without domain and value.
    """
    spec = ALL_TABLES[name]

    def entry(rule: str, column: str, domain: str = "", value: Column | None = None) -> Column:
        rules = F.struct(*[F.lit(x).alias(n) for n, x in zip(
            ("table_name", "rule", "column_name"), (name, rule, column))])
        value = F.lit(None).cast("string") if value is None else value.cast("string")
        return F.struct(F.lit(domain).alias("domain"), value.alias("value"), rules.alias("rule"))

    def of_key(rule: str, column: str, domain: str) -> Column:
        return F.when(F.col(column).isNotNull(), entry(rule, column, domain, F.col(column)))

    found = [of_key(DUPLICATE_KEY, spec.key, name)]
    found += [of_key(ORPHAN_KEY, c, parent) for c, parent in spec.refs if parent in tables]
    found += [F.when(F.col(f.name).isNull(), entry(NULL_VALUE, f.name))
              for f in spec.fields if f.required]
    # NULL passes, as in a CHECK constraint.
    found += [F.when(~F.col(c).isin(*values), entry(BAD_VALUE, c))
              for (table, c), values in VALUE_SETS.items() if table == name]
    return df.select(F.explode(F.array_compact(F.array(*found))).alias("e")).select("e.*")


def _rules(name: str, tables: Mapping[str, DataFrame]) -> list[tuple[str, str, str]]:
    spec = ALL_TABLES[name]
    return [
        (name, DUPLICATE_KEY, spec.key),
        *((name, ORPHAN_KEY, c) for c, parent in spec.refs if parent in tables),
        *((name, NULL_VALUE, f.name) for f in spec.fields if f.required),
        *((name, BAD_VALUE, c) for table, c in VALUE_SETS if table == name),
    ]


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Key values that occur more than once, with their row count."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("n"))
        .filter("n > 1")
    )


def orphan_keys(df: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Key values without a parent row, with their row count.

    Rows are counted per key before the join, so a hot key is one row in it.
    """
    per_key = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("_key"))
        .agg(F.count("*").alias("n"))
    )
    parents = parent.select(F.col(parent_key).alias("_parent"))
    return per_key.join(parents, F.col("_key") == F.col("_parent"), "left_anti")


def check_integrity(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per rule with its number of violations, from one scan of each table.

    Duplicate keys count the rows beyond the first of each key; orphan keys
    count rows. Rows are counted per value and rule before they are shuffled, so
    a key that many rows refer to is one row of each task. A value then meets the
    parent's key and all references to it in one place.
    """
    spark = next(iter(tables.values())).sparkSession
    entries = reduce(DataFrame.unionByName, [_entries(n, df, tables) for n, df in tables.items()])
    counted = entries.groupBy("domain", "value", "rule").agg(F.count("*").alias("n"))
    # As many entries of a value as there are rules about its domain.
    met = counted.groupBy("domain", "value").agg(
        F.max(F.col("rule.rule") == DUPLICATE_KEY).alias("there"),
        F.collect_list(F.struct("rule", "n")).alias("entries"))
    each = met.select("there", F.explode("entries").alias("e")).select("there", "e.rule.*", "e.n")
    broken = (
        F.when(F.col("rule") == DUPLICATE_KEY, F.col("n") - 1)
        .when((F.col("rule") == ORPHAN_KEY) & F.col("there"), 0)
        .otherwise(F.col("n"))
    )
    sums = each.groupBy("table_name", "rule", "column_name").agg(F.sum(broken).alias("violations"))
    rules = spark.createDataFrame([r for n in tables for r in _rules(n, tables)], _RULE)
    return rules.join(sums, ["table_name", "rule", "column_name"], "left").select(
        "table_name", "rule", "column_name",
        F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations"),
    ).orderBy("table_name", "rule", "column_name")
