"""Churn model on the driver tables (sf0.01)."""

import pytest
from pyspark.sql import functions as F

from rentscope.operators import churn
from rentscope.sources import driver
from tests.conftest import SF01

AS_OF = "2001-09-01 00:00:00"


@pytest.fixture(scope="module")
def result(spark):
    feats = churn.churn_features(driver.load(spark, SF01), as_of=AS_OF)
    return churn.train_churn(feats, num_trees=30)


def test_scores_cover_every_customer(result):
    s = result.scores
    assert s.count() == 1500
    splits = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert set(splits) == {"train", "test"} and 0.1 < splits["test"] / 1500 < 0.3
    bad = s.filter((F.col("churn_probability") < 0) | (F.col("churn_probability") > 1)).count()
    assert bad == 0


def test_report_and_label_leak(result):
    (r,) = churn.churn_report(result).collect()
    assert r["total_customers"] == 1500
    assert r["predicted_churn"] + r["predicted_retain"] == 1500
    # The label is a threshold of recency_days, a feature: accuracy is near 1.
    assert r["accuracy"] > 0.9
    imp = result.feature_importance()
    assert set(imp) == set(churn.FEATURES) and max(imp, key=imp.get) == "recency_days"


def test_at_risk_top_list(result):
    top = churn.churn_at_risk(result).collect()
    assert 0 < len(top) <= 15
    probs = [r["churn_probability"] for r in top]
    assert probs == sorted(probs, reverse=True)


def test_split_is_exact_in_each_class(result):
    for churned in (0, 1):
        own = result.scores.filter(F.col("is_churn") == churned)
        assert own.filter(F.col("split") == "test").count() == int(own.count() * 0.2 + 0.5)


def test_single_class_guard(spark):
    feats = churn.churn_features(driver.load(spark, SF01), as_of=AS_OF).withColumn("is_churn", F.lit(1))
    result = churn.train_churn(feats, num_trees=5)
    assert result.status == "one_class" and result.model is None
    (r,) = churn.churn_report(result).collect()
    assert r["status"] == "one_class" and r["total_customers"] == 1500 and r["predicted_churn"] is None
    assert churn.churn_at_risk(result).count() == 0
