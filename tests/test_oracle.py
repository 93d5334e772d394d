"""Every query with comparison SQL, side by side on the smallest tables."""

import datetime
import shutil
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from inventory_oracle import ORACLE
from inventory_queries import QUERIES

DIRECTORY = Path("/root/testdata/sf0.001")
FITTED = {
    "forecast_demand", "forecast_metrics", "critical_actions", "feature_importance",
    "simulate_scenarios", "detect_anomalies", "cluster_products", "cluster_stats",
    "opportunities", "recommendations",
}

pytestmark = pytest.mark.skipif(not DIRECTORY.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DIRECTORY.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def normal(columns, rows):
    """Columns by name and rows in some fixed order, types kept."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, datetime.date):
            return str(v)
        return (v, v.as_tuple().exponent) if isinstance(v, Decimal) else (type(v), v)

    return sorted(columns), sorted(([cell(r[i]) for i in order] for r in rows), key=str)


def test_only_fitted_models_lack_sql():
    assert set(QUERIES) - set(ORACLE) == FITTED
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_without_the_training_text_folders(tmp_path):
    """A copy without them still names every other query, with and without the pipeline's file."""
    root = Path(driver.__file__).resolve().parent
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "tests", "corpus_pipeline.py")
    shutil.copytree(root, tmp_path / "copy", ignore=skip)
    code = ("import __spark_entry__ as d; from inventory_queries import QUERIES; "
            "assert set(d.queries()) == set(QUERIES) and d.oracle_sql()")
    for left in ("", "corpus_pipeline.py"):
        if left and (root / left).exists():
            shutil.copy(root / left, tmp_path / "copy")
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = driver.queries()[name](spark, str(DIRECTORY))
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(driver.oracle_sql()[name])
    assert got == normal([c[0] for c in cursor.description], cursor.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() == 6
