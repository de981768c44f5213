"""Edge cases: empty tables, a lone churner, the shortest admitted series."""

from pyspark.sql import functions as F

from rentscope.operators import churn, customers, forecast, metrics
from tests import fixtures


def test_empty_tables_give_one_global_row(spark):
    t = fixtures.tables(spark)
    empty = {k: (v.limit(0) if k in ("rental", "payment") else v) for k, v in t.items()}
    from rentscope.sources import domain
    data = domain.from_tables(empty)
    (kpi,) = metrics.kpi_summary(data).collect()
    assert kpi["total_customers"] == 0 and kpi["total_rentals"] == 0
    assert kpi["total_revenue"] is None and kpi["avg_spend_per_customer"] is None
    assert metrics.monthly_revenue(data).count() == 0
    assert customers.customer_summary(data).count() == 0
    (u,) = customers.customer_kpi(data, 1).collect()
    assert u["total_rentals"] == 0


def test_one_churner_in_twenty(spark):
    rows = [(i, f"c{i}", f"c{i}@x", 200 if i == 7 else 5 + i, 3 + i % 4, 100.0 + i, 10.0, 3.0, int(i == 7))
            for i in range(1, 21)]
    feats = spark.createDataFrame(rows, "customer_id long, name string, email string, recency_days long, "
                                        "frequency long, monetary double, avg_payment double, "
                                        "avg_duration double, is_churn int")
    result = churn.train_churn(feats, num_trees=10)
    scores = result.scores.collect()
    assert len(scores) == 20
    assert all(0.0 <= r["churn_probability"] <= 1.0 for r in scores)
    (rep,) = churn.churn_report(result).collect()
    assert rep["total_customers"] == 20


def test_three_month_series_has_no_r2(spark):
    s = spark.createDataFrame([("a", "2020-01", 1.0), ("a", "2020-02", 2.0), ("a", "2020-03", 4.0)],
                              "series_key string, month string, revenue double")
    rows = forecast.forecast_linear(s).filter(F.col("kind") == "forecast").orderBy("step").collect()
    assert len(rows) == 3 and rows[0]["status"] == "ok" and rows[0]["r_squared"] is None
    # one training row: the fit is its intercept, so every step predicts that month's revenue
    assert [r["value"] for r in rows] == [4.0, 4.0, 4.0]


def test_customer_pages_match_the_lookups(spark):
    from rentscope.sources import driver
    from tests.conftest import SF01
    data = driver.load(spark, SF01)
    (page,) = customers.customer_pages(data).filter(F.col("customer_id") == 42).collect()
    parts = customers.customer_detail(data, 42)
    (kpi,) = parts["kpi"].collect()
    assert page["kpi"].asDict() == kpi.asDict()
    assert [tuple(t) for t in page["timeline"]] == [
        (r["month_sort"], r["month"], r["rental_count"]) for r in parts["timeline"].collect()]
    assert [tuple(g) for g in page["genres"]] == [tuple(r) for r in parts["genres"].collect()]
    hist = [tuple(h) for h in page["history"]]
    assert len(hist) == parts["history"].count()
    assert [h[1] for h in hist] == sorted((h[1] for h in hist), reverse=True)   # newest first
