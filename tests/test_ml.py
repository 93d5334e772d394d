import numpy as np
import pytest
from pyspark.sql import functions as F

from stocklens.functions import labels as L
from stocklens.ml import actions, anomaly, cluster, features, forecast

AS_OF = "2024-03-01"


@pytest.fixture(scope="module")
def products(spark):
    """200 products whose sales follow the previous month, and 8 odd ones."""
    i = F.col("product_id")
    prev = (i * 37 % 50 + 5).cast("int")
    odd = i % 25 == 3
    df = spark.range(1, 201).withColumnRenamed("id", "product_id").select(
        "product_id",
        F.concat(F.lit("p"), i).alias("name"),
        (i % 4).cast("int").alias("category_id"),
        (i % 7).alias("supplier_id"),
        F.when(i % 2 == 0, "x").otherwise("y").alias("category"),
        F.when(odd, 900).otherwise(prev + i % 9).cast("int").alias("stock"),
        F.when(odd, prev * 40).otherwise(prev + i % 3).cast("int").alias("sales_month"),
        prev.alias("sales_prev_month"),
        (prev * 3).alias("sales_quarter"),
        (prev * 11).alias("sales_year"),
        (F.lit(5) + i % 10).cast("decimal(10,2)").alias("unit_cost"),
        (F.lit(9) + i % 13).cast("decimal(10,2)").alias("price"),
        F.date_sub(F.lit(AS_OF).cast("date"), (i % 80).cast("int")).alias("last_sale"),
    )
    return df.cache()


def test_features(products):
    row = features.build_features(products, AS_OF).filter("product_id = 1").first()
    assert row.price_ratio == pytest.approx(10 / 6)
    assert (row.category_code, row.supplier_code, row.days_since_sale) == (1, 1, 1)
    assert row.seasonality == pytest.approx(1.0)
    assert row.turnover_year == pytest.approx(12 * row.sales_month / row.stock)


def test_missing_features_are_zero(spark):
    df = spark.createDataFrame([(None, 2.0)], "a double, b double")
    assert list(features.assembled(df, ("a", "b")).first().features) == [0.0, 2.0]


def test_forecast(products):
    result = forecast.forecast_demand(products, AS_OF, trees=20, depth=6)
    rows = result.rows.collect()
    m = result.metrics.first()
    assert len(rows) == m.products == 200
    assert all(r.forecast >= 0 for r in rows) and 0 <= m.mae <= m.rmse
    order = [list(L.STOCKOUT).index(r.risk) for r in rows]
    assert order == sorted(order)
    for r in rows[:20]:
        assert r.suggested_purchase == max(0, round((r.forecast * 12 - r.stock * 10) / 10))
    weights = forecast.feature_importance(result, products.sparkSession).collect()
    assert sum(w.importance for w in weights) == pytest.approx(1.0)
    assert [w.importance for w in weights] == sorted((w.importance for w in weights), reverse=True)
    assert {w.feature for w in weights} == set(features.DEFAULT_FEATURES)
    urgent = actions.critical_actions(result.rows).collect()
    assert len(urgent) == sum(r.risk == "ALTO" for r in rows)


def test_all_features_repeat_the_label(products):
    """With the label among the features the fit is close to perfect."""
    result = forecast.forecast_demand(
        products.filter("product_id % 25 <> 3"), AS_OF, feature_cols=features.DEMAND_FEATURES,
        trees=20,
    )
    assert result.metrics.first().mae < 1.0


def test_little_history_uses_two_months(products):
    few = products.filter("product_id < 8")
    result = forecast.forecast_demand(few, AS_OF, horizon_days=60)
    assert result.model is None
    got = {r.product_id: r.forecast for r in result.rows.collect()}
    base = few.filter("product_id = 1").first()
    assert got[1] == base.sales_month + base.sales_prev_month
    assert forecast.feature_importance(result, products.sparkSession).count() == 0
    assert result.metrics.first().confidence == 50.0


def test_split_does_not_depend_on_partitions(products):
    one = products.repartition(1).filter(forecast.in_training()).select("product_id")
    many = products.repartition(9).filter(forecast.in_training()).select("product_id")
    assert sorted(one.collect()) == sorted(many.collect())


def test_scenarios(products):
    rows, metrics = forecast.simulate_scenarios(
        products, {"base": {}, "double": {"demand_multiplier": 2.0}, "dear": {"price_change": 0.2}},
        AS_OF, trees=10, depth=5,
    )
    total = {r.scenario: r.s for r in rows.groupBy("scenario").agg(F.sum("forecast").alias("s")).collect()}
    assert total["double"] == pytest.approx(2 * total["base"], rel=0.05)
    assert total["dear"] == pytest.approx(total["base"], rel=0.1)
    assert metrics.count() == 3


def test_expected_path():
    assert list(anomaly.expected_path(np.array([1, 2]))) == [0.0, 1.0]
    assert float(anomaly.expected_path(256)) == pytest.approx(10.244, abs=0.01)


def test_outlier_has_the_lowest_score():
    rng = np.random.default_rng(0)
    rows = np.vstack([rng.normal(size=(255, 2)), [[9.0, 9.0]]])
    forest = [anomaly.grow_tree(rows, np.random.default_rng([1, i])) for i in range(50)]
    scores = anomaly.score_rows(rows, forest, 256)
    assert scores.argmin() == 255 and -1 < scores.min() < -0.6 and scores.max() < 0


def test_detect_anomalies(products):
    scored = anomaly.score_products(products, AS_OF, trees=40, size=64).cache()
    flagged = scored.filter("is_anomaly")
    assert flagged.count() == 20
    odd = scored.filter("product_id % 25 = 3")
    assert odd.filter("is_anomaly").count() == odd.count() == 8
    assert {r.quintile for r in scored.select("quintile").distinct().collect()} == set(L.ANOMALY_QUINTILES)
    assert scored.filter("NOT is_anomaly").select("kind").distinct().collect() == [(L.ANOMALY_NONE,)]
    found = anomaly.detect_anomalies(products, AS_OF, trees=40, size=64).collect()
    scores = [r.score for r in found]
    assert scores == sorted(scores) and all(r.is_anomaly for r in found)


def test_every_tree_gets_its_sample(products):
    for rows, trees, size in ((200, 5, 30), (200, 10, 50)):
        sampled = anomaly._samples(products, ["sales_month"], rows, trees, size)
        counts = {r.tree: r["count"] for r in sampled.groupBy("tree").count().collect()}
        assert counts == {t: size for t in range(trees)}


def test_clusters(products):
    result = cluster.cluster_products(products, AS_OF, k=3, starts=2)
    rows = result.rows.collect()
    stats = {s.cluster: s for s in result.stats.collect()}
    assert len(rows) == 200 and sum(s.products for s in stats.values()) == 200
    assert {r.cluster_name for r in rows} == {s.cluster_name for s in stats.values()}
    for c, s in stats.items():
        mean = np.mean([r.sales_month for r in rows if r.cluster == c])
        assert s.mean_sales == pytest.approx(mean, abs=0.01)


def test_best_start_wins(spark):
    """Two far groups are told apart, and no other start is cheaper."""
    rows = [(float(g * 50 + i % 5), float(i // 5), g) for g in (0, 1) for i in range(25)]
    df = features.assembled(
        spark.createDataFrame(rows, "a double, b double, g int"), ("a", "b"), out="scaled"
    ).cache()
    model = cluster.best_kmeans(df, 2, starts=3)
    pairs = model.transform(df).select("g", "prediction").distinct().collect()
    assert len(pairs) == 2 and len({p.prediction for p in pairs}) == 2
    assert model.summary.trainingCost <= cluster.best_kmeans(df, 2, starts=1).summary.trainingCost


def test_opportunities(spark):
    df = spark.createDataFrame(
        [(0, L.CLUSTER_STARS), (0, L.CLUSTER_STARS), (1, L.CLUSTER_STANDARD), (2, L.CLUSTER_SLOW)],
        "cluster int, cluster_name string",
    )
    found = actions.opportunities(df).collect()
    assert [(r.cluster, r.products, r.kind) for r in found] == [
        (0, 2, L.OPPORTUNITIES[L.CLUSTER_STARS][0]), (2, 1, L.OPPORTUNITIES[L.CLUSTER_SLOW][0])
    ]
    assert L.CLUSTER_STARS in found[0].description


def test_recommendations_hold_everything(products, monkeypatch):
    monkeypatch.setattr(actions, "forecast_demand", lambda df, d: forecast.forecast_demand(df, d, trees=5, depth=4))
    monkeypatch.setattr(actions, "cluster_products", lambda df, d: cluster.cluster_products(df, d, k=2, starts=1))
    monkeypatch.setattr(actions, "detect_anomalies", lambda df, d: anomaly.detect_anomalies(df, d, trees=5, size=32))
    out = actions.recommendations(products, AS_OF)
    assert all(out[name].count() > 0 for name in ("forecast", "forecast_metrics", "anomalies", "clusters", "cluster_stats"))
    assert {"critical_actions", "opportunities"} <= set(out)
