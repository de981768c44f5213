"""Original-schema tables through parquet, model persistence."""

import tempfile

from pyspark.sql import functions as F

from rentscope.operators import churn, forecast, metrics
from rentscope.sources import domain, driver, sinks
from tests import fixtures
from tests.conftest import SF01


def test_domain_tables_round_trip_through_parquet(spark):
    root = tempfile.mkdtemp(prefix="rentscope-domain-")
    for name, df in fixtures.tables(spark).items():
        sinks.write_parquet(df, f"{root}/{name}")
    from_files = domain.read_parquet_tables(spark, root)
    in_memory = fixtures.data(spark)
    assert metrics.kpi_summary(from_files).collect() == metrics.kpi_summary(in_memory).collect()
    assert metrics.store_summary(from_files).collect() == metrics.store_summary(in_memory).collect()


def test_month_partitioned_facts_prune_folders(spark):
    root = tempfile.mkdtemp(prefix="rentscope-facts-")
    data = driver.load(spark, SF01)
    sinks.write_facts_by_month(data.payment, f"{root}/payment", "payment_date")
    stored = spark.read.parquet(f"{root}/payment")
    q = stored.filter(F.col("month") == "1997-03")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert q.count() == data.payment.filter(F.date_format("payment_date", "yyyy-MM") == "1997-03").count()


def test_attention_models_are_stored_as_rows(spark):
    root = tempfile.mkdtemp(prefix="rentscope-models-")
    series = forecast.revenue_series(driver.load(spark, SF01), axis="payment", by="country")
    models = forecast.attention_models(series)
    sinks.write_parquet(models, f"{root}/attention")
    back = spark.read.parquet(f"{root}/attention")
    assert back.count() == 25
    row = back.filter(F.col("months") >= 5).first()
    assert len(row["coefficients"]) == 6 and row["scale"] > 0


def test_churn_model_save_load_and_rescore(spark):
    root = tempfile.mkdtemp(prefix="rentscope-churn-")
    feats = churn.churn_features(driver.load(spark, SF01), as_of="2001-09-01 00:00:00")
    result = churn.train_churn(feats, num_trees=10)
    churn.save_churn_model(result, f"{root}/model")
    again = churn.score_with(churn.load_churn_model(f"{root}/model"), feats)
    a = {r["customer_id"]: r["churn_probability"] for r in result.scores.collect()}
    b = {r["customer_id"]: r["churn_probability"] for r in again.collect()}
    assert a == b


def test_json_records_sink(spark):
    root = tempfile.mkdtemp(prefix="rentscope-json-")
    data = driver.load(spark, SF01)
    sinks.write_json(metrics.geo_top_n(data), f"{root}/geo")
    back = spark.read.json(f"{root}/geo")
    assert sorted(back.columns) == ["country", "customer_count"]
    assert back.count() == 15
