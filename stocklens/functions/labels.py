"""Labels, messages and thresholds that are part of results.

Everything here is a fixed value: result text and limits that users' existing
reports and filters rely on.
"""

# Stock state: out of stock, at or below minimum, at or below reorder point, rest.
STATE_PLAIN = ("SIN_STOCK", "CRITICO", "BAJO", "NORMAL")
STATE_ICON = ("🔴 SIN STOCK", "🟠 CRÍTICO", "🟡 BAJO", "🟢 NORMAL")

# The same without a state of its own for zero stock.
STATE3_PLAIN = ("CRÍTICO", "BAJO", "NORMAL")
STATE3_ICON = ("🔴 CRÍTICO", "🟡 BAJO", "🟢 NORMAL")

# Annual turnover: lower limit of each class, and the class without movement.
TURNOVER_YEAR = (
    (12, "🟢 EXCELENTE (>12x/año)"),
    (6, "🟡 BUENA (6-12x/año)"),
    (3, "🟠 REGULAR (3-6x/año)"),
)
TURNOVER_YEAR_SLOW = "🔴 LENTA (<3x/año)"
TURNOVER_YEAR_NONE = "⚫ SIN MOVIMIENTO"

# Months of stock: upper limit of each class, and the slow rest.
TURNOVER_MONTHS = (
    (1, "🟢 Excelente (<1 mes)"),
    (2, "🟡 Buena (1-2 meses)"),
    (3, "🟠 Regular (2-3 meses)"),
)
TURNOVER_MONTHS_SLOW = "🔴 Lenta (>3 meses)"

# Season class with its purchase advice.
SEASON_PEAK = ("PICO_ALTA", "Considerar aumentar stock")
SEASON_VALLEY = ("VALLE_BAJA", "Considerar reducir pedidos")
SEASON_NORMAL = ("NORMAL", "Mantener estrategia actual")

# Stock against the projection for next month.
FUTURE_STOCK = ("⚠️ RIESGO DESABASTO", "🟡 STOCK AJUSTADO", "🟢 STOCK SUFICIENTE")

# Stock against the model forecast.
STOCKOUT = ("ALTO", "MEDIO", "BAJO")

# ABC classes: report over all products, and report over a selection.
ABC_LIMITS = (80, 95)
ABC_FULL = ("A - VITAL (80% ingresos)", "B - IMPORTANTE (15% ingresos)", "C - NORMAL (5% ingresos)")
ABC_SELECTION = (
    "A - Vital (80% ingresos)",
    "B - Importante (15% ingresos)",
    "C - Normal (5% ingresos)",
)

# Alert kinds and priorities.
ALERT_REORDER = "ALERTA_REORDEN"
ALERT_IDLE = "ALERTA_SIN_MOVIMIENTO"
ALERT_LOW_STOCK = "STOCK_BAJO"
PRIORITIES = ("CRÍTICA", "ALTA", "MEDIA", "BAJA")
STATUS_ACTIVE = "ACTIVA"
STATUS_RESOLVED = "RESUELTA"
MESSAGE_REORDER = "Stock bajo: %s unidades (mínimo: %s)"
MESSAGE_IDLE = "Producto sin ventas por %s días"
MESSAGE_CROSSING = "Stock crítico: %s tiene solo %s unidades"

# Movement kinds.
KIND_IN, KIND_OUT, KIND_ADJUST, KIND_LOSS = "ENTRADA", "SALIDA", "AJUSTE", "MERMA"

# Selection words that mean "no filter".
ALL_CATEGORIES, ALL_SUPPLIERS = "Todas", "Todos"

NO_SALES = "Sin ventas"
NO_SALES_MONTHS = 999
SUMMARY_TITLE = "RESUMEN EJECUTIVO"
MONTHLY_TITLE = "COMPARACIÓN MENSUAL"

# Anomaly kinds.
ANOMALY_NONE = "Normal"
ANOMALY_PEAK = "Pico de Ventas"
ANOMALY_DROP = "Caída Drástica"
ANOMALY_OVERSTOCK = "Sobrestock"
ANOMALY_OTHER = "Patrón Irregular"
ANOMALY_QUINTILES = ("Muy Anómalo", "Anómalo", "Normal", "Típico", "Muy Típico")

# Cluster names.
CLUSTER_STARS = "Estrellas (Alta Venta, Alto Margen)"
CLUSTER_VOLUME = "Volumen (Alta Venta, Bajo Margen)"
CLUSTER_PREMIUM = "Premium (Baja Venta, Alto Margen)"
CLUSTER_SLOW = "Lento Movimiento"
CLUSTER_STANDARD = "Estándar"

# Urgent purchases: action, priority, deadline.
URGENT_PURCHASE = ("Compra Urgente", "ALTA", "7 días")

# Opportunity per kind of cluster: kind, description, action.
OPPORTUNITIES = {
    CLUSTER_STARS: (
        "Potenciar Éxitos",
        "Incrementar stock de productos estrella (Cluster: %s)",
        "Aumentar inventario y promoción",
    ),
    CLUSTER_SLOW: (
        "Optimizar Inventario",
        "Reducir stock de productos de lento movimiento (Cluster: %s)",
        "Liquidación o descuentos",
    ),
    CLUSTER_PREMIUM: (
        "Maximizar Margen",
        "Promocionar productos premium (Cluster: %s)",
        "Marketing dirigido",
    ),
}

# Insights: type, title, message, priority.
INSIGHT_CRITICAL = (
    "warning",
    "⚠️ Alto Porcentaje de Productos Críticos",
    "%s%% de productos en estado crítico. Revisar proceso de reabastecimiento.",
    "alta",
)
INSIGHT_LOW_MARGIN = (
    "warning",
    "📉 Margen Neto Bajo",
    "Margen neto actual: %s%%. Considerar optimización de precios o costos.",
    "media",
)
INSIGHT_HIGH_MARGIN = (
    "success",
    "💰 Excelente Rentabilidad",
    "Margen neto de %s%% indica operación muy rentable.",
    "info",
)
INSIGHT_LOW_TURNOVER = (
    "warning",
    "🔄 Baja Rotación de Inventario",
    "Rotación promedio baja indica posible sobrestock. "
    "Considerar estrategias de liquidación.",
    "media",
)
INSIGHT_NO_SALES = (
    "info",
    "📦 Productos Sin Movimiento",
    "%s productos sin ventas este mes. Revisar estrategia comercial.",
    "baja",
)
INSIGHT_GROWTH = (
    "success",
    "🚀 Productos con Alto Crecimiento",
    "%s productos con crecimiento >50%%. Oportunidad de incrementar stock.",
    "info",
)
