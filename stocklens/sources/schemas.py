"""Table schemas: column names, file headers, types, defaults and keys.

Library columns have English names. ``header`` is the column's name in the
exchange files, so the same files can be read and written back.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

INT, LONG, STR, BOOL = T.IntegerType(), T.LongType(), T.StringType(), T.BooleanType()
DATE, STAMP = T.DateType(), T.TimestampNTZType()
MONEY = T.DecimalType(10, 2)

# Marks a column whose default is the load time.
NOW = object()


@dataclass(frozen=True)
class Field:
    name: str
    header: str
    type: T.DataType
    required: bool = False
    default: Any = None


@dataclass(frozen=True)
class Table:
    name: str
    header: str
    key: str
    fields: tuple[Field, ...]
    refs: tuple[tuple[str, str], ...] = ()

    def field(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.type) for f in self.fields])

    @property
    def file_types(self) -> dict[str, T.DataType]:
        """Type per file header, for readers that see the original names."""
        return {f.header: f.type for f in self.fields}


def _f(name, header, type_, *, required=False, default=None) -> Field:
    return Field(name, header, type_, required, default)


# File headers, defaults, required columns and foreign keys.
CATEGORIES = Table("categories", "categorias", "category_id", (
    _f("category_id", "categoria_id", LONG, required=True),
    _f("category", "nombre_categoria", STR, required=True),
    _f("description", "descripcion", STR),
    _f("target_margin", "margen_promedio", T.DecimalType(5, 2), default="0.30"),
    _f("active", "activo", BOOL, default=True),
    _f("created_at", "fecha_creacion", STAMP, default=NOW),
))

SUPPLIERS = Table("suppliers", "proveedores", "supplier_id", (
    _f("supplier_id", "proveedor_id", LONG, required=True),
    _f("supplier", "nombre_proveedor", STR, required=True),
    _f("contact", "contacto", STR),
    _f("phone", "telefono", STR),
    _f("email", "email", STR),
    _f("address", "direccion", STR),
    _f("city", "ciudad", STR),
    _f("country", "pais", STR, default="Guatemala"),
    _f("lead_days", "tiempo_entrega_dias", INT, default=7),
    _f("rating", "calificacion", T.DecimalType(3, 2), default="4.0"),
    _f("active", "activo", BOOL, default=True),
    _f("registered_at", "fecha_registro", STAMP, default=NOW),
))

LOCATIONS = Table("locations", "ubicaciones", "location_id", (
    _f("location_id", "ubicacion_id", INT, required=True),
    _f("section", "seccion", STR, required=True),
    _f("aisle", "pasillo", STR),
    _f("shelf", "estante", STR),
    _f("level", "nivel", STR),
    _f("capacity", "capacidad_maxima", INT, default=100),
    _f("description", "descripcion", STR),
))

PRODUCTS = Table("products", "inventario", "product_id", (
    _f("product_id", "producto_id", LONG, required=True),
    _f("name", "nombre", STR, required=True),
    _f("description", "descripcion", STR),
    _f("category_id", "categoria_id", LONG),
    _f("supplier_id", "proveedor_id", LONG),
    _f("location_id", "ubicacion_id", INT),
    _f("stock", "stock_actual", INT, required=True, default=0),
    _f("min_stock", "stock_minimo", INT, required=True, default=5),
    _f("max_stock", "stock_maximo", INT, required=True, default=100),
    _f("reorder_point", "punto_reorden", INT, required=True, default=10),
    _f("unit_cost", "costo_unitario", MONEY, required=True),
    _f("price", "precio_venta", MONEY, required=True),
    _f("wholesale_price", "precio_venta_mayoreo", MONEY),
    _f("currency", "moneda", STR, default="GTQ"),
    _f("sales_month", "ventas_mes_actual", INT, default=0),
    _f("sales_prev_month", "ventas_mes_anterior", INT, default=0),
    _f("sales_quarter", "ventas_trimestre", INT, default=0),
    _f("sales_year", "ventas_año", INT, default=0),
    _f("last_purchase", "fecha_ultima_compra", DATE),
    _f("last_sale", "fecha_ultima_venta", DATE),
    _f("expires_on", "fecha_vencimiento", DATE),
    _f("created_at", "fecha_creacion", STAMP, default=NOW),
    _f("updated_at", "fecha_actualizacion", STAMP, default=NOW),
    _f("barcode", "codigo_barras", STR),
    _f("unit", "unidad_medida", STR, default="pieza"),
    _f("weight_kg", "peso_kg", T.DecimalType(8, 3)),
    _f("dimensions", "dimensiones", STR),
    _f("brand", "marca", STR),
    _f("model", "modelo", STR),
    _f("warranty_months", "garantia_meses", INT, default=0),
    _f("refrigerated", "requiere_refrigeracion", BOOL, default=False),
    _f("hazardous", "es_peligroso", BOOL, default=False),
    _f("active", "activo", BOOL, default=True),
), refs=(
    ("category_id", "categories"),
    ("supplier_id", "suppliers"),
    ("location_id", "locations"),
))

MOVEMENTS = Table("movements", "movimientos_inventario", "movement_id", (
    _f("movement_id", "movimiento_id", LONG, required=True),
    _f("product_id", "producto_id", LONG, required=True),
    _f("kind", "tipo_movimiento", STR, required=True),
    _f("quantity", "cantidad", INT, required=True),
    _f("unit_cost", "costo_unitario", MONEY),
    _f("price", "precio_venta", MONEY),
    _f("reason", "motivo", STR),
    _f("user", "usuario", STR),
    _f("moved_at", "fecha_movimiento", STAMP, default=NOW),
    _f("stock_before", "stock_anterior", INT),
    _f("stock_after", "stock_nuevo", INT),
    _f("document", "documento_referencia", STR),
), refs=(("product_id", "products"),))

ALERTS = Table("alerts", "alertas", "alert_id", (
    _f("alert_id", "alerta_id", LONG, required=True),
    _f("product_id", "producto_id", LONG, required=True),
    _f("kind", "tipo_alerta", STR, required=True),
    _f("message", "mensaje", STR, required=True),
    _f("priority", "prioridad", STR, default="MEDIA"),
    _f("status", "estado", STR, default="ACTIVA"),
    _f("raised_at", "fecha_generacion", STAMP, default=NOW),
    _f("resolved_at", "fecha_resolucion", STAMP),
    _f("assignee", "usuario_asignado", STR),
), refs=(("product_id", "products"),))

PURCHASES = Table("purchases", "ordenes_compra", "order_id", (
    _f("order_id", "orden_id", LONG, required=True),
    _f("supplier_id", "proveedor_id", LONG, required=True),
    _f("ordered_on", "fecha_orden", DATE, required=True),
    _f("expected_on", "fecha_esperada_entrega", DATE),
    _f("delivered_on", "fecha_entrega_real", DATE),
    _f("status", "estado", STR, default="PENDIENTE"),
    _f("total", "total_orden", T.DecimalType(12, 2)),
    _f("tax", "impuestos", MONEY),
    _f("discount", "descuento", MONEY, default="0.00"),
    _f("created_by", "usuario_creador", STR),
    _f("notes", "notas", STR),
), refs=(("supplier_id", "suppliers"),))

PURCHASE_LINES = Table("purchase_lines", "detalle_ordenes_compra", "line_id", (
    _f("line_id", "detalle_id", LONG, required=True),
    _f("order_id", "orden_id", LONG, required=True),
    _f("product_id", "producto_id", LONG, required=True),
    _f("ordered", "cantidad_ordenada", INT, required=True),
    _f("received", "cantidad_recibida", INT, default=0),
    _f("unit_price", "precio_unitario", MONEY, required=True),
    _f("subtotal", "subtotal", MONEY, required=True),
), refs=(("order_id", "purchases"), ("product_id", "products")))

ALL_TABLES = {t.name: t for t in (
    CATEGORIES, SUPPLIERS, LOCATIONS, PRODUCTS,
    MOVEMENTS, ALERTS, PURCHASES, PURCHASE_LINES,
)}

# The value sets of the enum-like columns.
VALUE_SETS = {
    ("movements", "kind"): ("ENTRADA", "SALIDA", "AJUSTE", "MERMA"),
    ("alerts", "kind"): ("STOCK_BAJO", "VENCIMIENTO", "SIN_MOVIMIENTO"),
    ("alerts", "priority"): ("ALTA", "MEDIA", "BAJA"),
    ("alerts", "status"): ("ACTIVA", "RESUELTA", "IGNORADA"),
    ("purchases", "status"): ("PENDIENTE", "ENVIADA", "RECIBIDA", "CANCELADA"),
}

# File names of a table directory, without extension.
FILE_NAMES = {
    "categories": "categorias",
    "suppliers": "proveedores",
    "locations": "ubicaciones",
    "products": "inventario_expandido",
    "alerts": "alertas_sample",
    "movements": "movimientos_inventario_sample",
}
