import datetime
import gzip
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException

from conftest import AS_OF, NOW, by_id
from stocklens.plans import frame, suite
from stocklens.sources import quality, readers, sinks
from stocklens.sources.schemas import ALL_TABLES
from stocklens.sources.scratch import materialized, shared_dir

# A product file with a bare quote, a bad date, text NULL, and fewer columns
# than the table, in another order.
PRODUCT_FILE = """\
nombre,producto_id,categoria_id,proveedor_id,ubicacion_id,costo_unitario,precio_venta,\
stock_actual,fecha_ultima_venta,codigo_barras,activo
Wrench 8",1,1,1,1,2.50,4.00,7,2024-02-01,007,TRUE
Paint,2,2,1,NULL,3.10,5.25,NULL,31/02/2024,,FALSE
"""
CATEGORY_FILE = "categoria_id,nombre_categoria\n1,tools\n2,paint\n"
SUPPLIER_FILE = 'proveedor_id,nombre_proveedor,direccion\n1,north,"Road 1, yard 2"\n'
LOCATION_FILE = "ubicacion_id,seccion,pasillo,estante,nivel\n1,A,01,X,2\n"


@pytest.fixture
def directory(tmp_path):
    files = {
        "inventario_expandido": PRODUCT_FILE, "categorias": CATEGORY_FILE,
        "proveedores": SUPPLIER_FILE, "ubicaciones": LOCATION_FILE,
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(tmp_path)


def test_read_conforms_to_the_table(spark, directory):
    df = readers.read_table(spark, "products", f"{directory}/inventario_expandido.csv", now=NOW)
    assert df.schema.simpleString() == ALL_TABLES["products"].schema.simpleString()
    one, two = df.orderBy("product_id").collect()
    assert (one.name, one.unit_cost, one.barcode) == ('Wrench 8"', Decimal("2.50"), "007")
    assert one.last_sale == datetime.date(2024, 2, 1) and one.active is True
    # What does not parse is NULL; NULL stays NULL in a column that is present.
    assert two.last_sale is None and two.stock is None and two.active is False
    # Absent columns get their defaults.
    assert (one.min_stock, one.max_stock, one.currency, one.unit) == (5, 100, "GTQ", "pieza")
    assert one.created_at == datetime.datetime(2024, 3, 1)
    assert one.expires_on is None


def test_only_needed_columns_are_parsed(spark, directory):
    df = readers.read_table(spark, "products", f"{directory}/inventario_expandido.csv")
    plan = df.select("product_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<producto_id:string>" in plan


def rows_of(spark, path):
    df = readers.read_table(spark, "categories", str(path), now=NOW)
    return {r.category_id: (r.category, r.active) for r in df.collect()}


def test_each_csv_file_has_its_own_header(spark, tmp_path):
    """Other order, other columns, library names, compressed, empty and hidden files in one folder."""
    folder = tmp_path / "categorias.csv"
    (folder / "year=2024").mkdir(parents=True)
    files = {
        "a.csv": "categoria_id,nombre_categoria,activo\n1,A,false\n2,B,true\n",
        "b.csv": "nombre_categoria,categoria_id\nC,4\n",
        "c.csv": "category,category_id,unknown\nD,5,x\n",
        "d.csv": "categoria_id,nombre_categoria,activo\n6,E,false\n",
        "empty.csv": "", "_hidden.csv": "categoria_id\n99\n",
        "year=2024/e.csv": "activo,nombre_categoria,categoria_id\nfalse,F,7\n",
    }
    for name, text in files.items():
        (folder / name).write_text(text, encoding="utf-8")
    with gzip.open(folder / "z.csv.gz", "wt", encoding="utf-8") as out:
        out.write("nombre_categoria,activo,categoria_id\nÑ,false,8\n")
    expected = {1: ("A", False), 2: ("B", True), 4: ("C", True), 5: ("D", True), 6: ("E", False),
                7: ("F", False), 8: ("Ñ", False)}
    assert rows_of(spark, folder) == expected
    assert rows_of(spark, folder / "[ab].csv") == {k: expected[k] for k in (1, 2, 4)}


def test_files_of_one_header_are_one_scan(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.csv").write_text(f"categoria_id,nombre_categoria\n{i},x\n")
    df = readers.read_table(spark, "categories", str(tmp_path), now=NOW)
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert df.count() == 5


def test_conform_of_typed_frames(spark):
    df = spark.createDataFrame([(1, "x", 2.5)], "category_id long, category string, extra double")
    out = readers.conform(df, "categories", NOW)
    assert out.schema.simpleString() == ALL_TABLES["categories"].schema.simpleString()
    assert out.first().target_margin == Decimal("0.30")


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json"])
def test_round_trip(spark, directory, tmp_path, fmt):
    t, _ = readers.load_inventory(spark, directory=directory, now=NOW)
    t.products.write.format(fmt).option("ignoreNullFields", False).save(f"{tmp_path}/p")
    back = readers.read_table(spark, "products", f"{tmp_path}/p", fmt=fmt)
    assert back.schema.simpleString() == t.products.schema.simpleString()
    assert back.orderBy("product_id").collect() == t.products.orderBy("product_id").collect()


def test_database_comes_first_unless_empty(spark, directory, tables, monkeypatch):
    asked = []

    def fake(spark, url, query, options=None, split=None):
        asked.append((query, split))
        return tables.products.limit(0) if url == "jdbc:empty" else tables.products

    monkeypatch.setattr(readers, "read_jdbc", fake)
    splits = {"products": ("producto_id", 0, 9, 3)}
    jdbc = {"url": "jdbc:full", "splits": splits}
    t, from_database = readers.load_inventory(spark, jdbc=jdbc, directory=directory)
    assert from_database and t.products.count() == 10
    assert asked[0] == ("SELECT * FROM inventario", splits["products"])
    t, from_database = readers.load_inventory(spark, {"url": "jdbc:empty"}, directory)
    assert not from_database and t.products.count() == 2


def test_missing_optional_tables_are_empty(spark, directory):
    t, from_database = readers.load_inventory(spark, directory=directory)
    assert not from_database
    assert t.alerts.count() == 0 and t.movements.count() == 0
    assert t.movements.columns == [f.name for f in ALL_TABLES["movements"].fields]
    assert t.suppliers.first().address == "Road 1, yard 2"


def test_missing_required_table_raises(spark, tmp_path):
    t, _ = readers.load_inventory(spark, directory=str(tmp_path))
    with pytest.raises(PySparkException):
        t.products.count()


def test_no_source_raises(spark):
    with pytest.raises(ValueError):
        readers.load_inventory(spark)


class Options:
    """Records what a JDBC reader is asked for."""

    def __init__(self):
        self.read = self
        self.seen = {}

    def format(self, name):
        self.seen["format"] = name
        return self

    def option(self, key, value):
        self.seen[key] = value
        return self

    def options(self, **values):
        self.seen.update(values)
        return self

    def load(self):
        return self.seen


def test_jdbc_options():
    plain = readers.read_jdbc(Options(), "jdbc:x", "SELECT 1", {"user": "u"})
    assert plain == {"format": "jdbc", "url": "jdbc:x", "user": "u", "query": "SELECT 1"}
    split = readers.read_jdbc(Options(), "jdbc:x", "SELECT * FROM t", split=("id", 0, 100, 8))
    assert split["dbtable"] == "(SELECT * FROM t) q"
    assert (split["partitionColumn"], split["numPartitions"]) == ("id", 8)


def test_run_sql_takes_parameters_and_raises(spark):
    spark.range(5).createOrReplaceTempView("numbers")
    found = readers.run_sql(spark, "SELECT * FROM numbers WHERE id > :low", {"low": 2})
    assert found.count() == 2
    with pytest.raises(PySparkException):
        readers.run_sql(spark, "SELECT * FROM no_such_table").count()


def test_materialize_keeps_rows_unless_forced(spark):
    spark.sql("DROP TABLE IF EXISTS kept")
    assert sinks.materialize(spark.range(3), "kept")
    assert not sinks.materialize(spark.range(9), "kept")
    assert spark.table("kept").count() == 3
    assert sinks.materialize(spark.range(9), "kept", force=True)
    assert spark.table("kept").count() == 9
    spark.sql("DROP TABLE kept")


def test_export_names_the_day(spark, tables, tmp_path):
    path = sinks.export_report(tables.categories, str(tmp_path), "cats", AS_OF, single_file=True)
    assert path.endswith("/cats_20240301")
    assert spark.read.option("header", True).csv(path).count() == 2


def test_standard_exports(spark, tables, tmp_path):
    paths = suite.export_standard(frame.analysis_frame(tables), str(tmp_path), AS_OF)
    counts = {n: spark.read.option("header", True).csv(p).count() for n, p in paths.items()}
    assert counts == {"inventario_completo": 9, "productos_criticos": 4, "analisis_abc": 7}


def test_file_headers_round_trip(spark, tables):
    named = sinks.with_file_headers(tables.products, "products")
    assert named.columns[:2] == ["producto_id", "nombre"] and "ventas_año" in named.columns
    assert readers.conform(named, "products").columns == tables.products.columns


def test_snapshot_and_stats(spark, tables, tmp_path):
    paths = sinks.snapshot_tables(tables.as_dict(), str(tmp_path), "20240301_000000")
    assert spark.read.parquet(paths["products"]).count() == 10
    with pytest.raises(PySparkException):
        sinks.snapshot_tables(tables.as_dict(), str(tmp_path), "20240301_000000")
    stats = [(r.table_name, r.live_rows) for r in sinks.table_stats(tables.as_dict()).collect()]
    assert stats[0] == ("products", 10) and stats[1] == ("movements", 7)


def test_integrity(spark, tables):
    broken = tables.as_dict()
    products = broken["products"]
    broken["products"] = products.unionByName(products.filter("product_id = 1"))
    broken["alerts"] = broken["alerts"].selectExpr(
        *[c for c in broken["alerts"].columns if c not in ("message", "status")],
        "CAST(NULL AS string) AS message", "'UNKNOWN' AS status",
    )
    found = {
        (r.table_name, r.rule, r.column_name): r.violations
        for r in quality.check_integrity(broken).collect() if r.violations
    }
    assert found == {
        ("products", quality.DUPLICATE_KEY, "product_id"): 1,
        ("products", quality.ORPHAN_KEY, "category_id"): 1,
        ("alerts", quality.NULL_VALUE, "message"): 3,
        ("alerts", quality.BAD_VALUE, "status"): 3,
    }
    orphans = quality.orphan_keys(products, "category_id", broken["categories"], "category_id")
    assert by_id(orphans, "n", key="_key") == {9: 1}


def test_scratch_folder(spark):
    assert shared_dir(spark) == shared_dir(spark)
    df = spark.createDataFrame([(1, "a")], "id int, s string")
    out = materialized(df, "t")
    assert out.collect() == df.collect() and out.schema == df.schema


def test_temporary_results_are_deleted_at_the_end(spark, tmp_path, monkeypatch):
    from stocklens.sources import scratch

    monkeypatch.setattr(scratch, "shared_dir", lambda _: str(tmp_path))
    with scratch.temporary(spark) as kept:
        rows = kept(spark.range(3).repartition(2), "rows")
        assert rows.count() == 3 and any((tmp_path / "stocklens").iterdir())
    assert not any(p.is_dir() for p in (tmp_path / "stocklens").iterdir())
