"""Forecasts: known values on a fixed series, guards, per-group independence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentscope.operators import forecast
from rentscope.sources import driver
from tests.conftest import SF01


@pytest.fixture(scope="module")
def order_series(spark):
    """Monthly sum of order totals (as cents-exact decimals) on sf0.01: 80 months."""
    o = driver.read_table(spark, SF01, "orders")
    return (
        o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"))
        .agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(12,2)")), 2).cast("double").alias("revenue"))
        .withColumn("series_key", F.lit("all"))
    )


def _by_kind(df):
    out = {}
    for r in df.orderBy("kind", "step").collect():
        out.setdefault(r["kind"], []).append(r)
    return out


def test_reference_mode_repeats_last_three_months(order_series):
    got = _by_kind(forecast.forecast_linear(order_series, horizon=6))
    preds = [r["value"] for r in got["forecast"]]
    assert preds == [46217098.00, 53657147.71, 702947.99] * 2
    assert got["forecast"][0]["r_squared"] == 1.0
    assert len(got["historical"]) == 80


def test_lagged_mode_r2(order_series):
    got = _by_kind(forecast.forecast_linear(order_series, horizon=3, mode="lagged"))
    assert got["forecast"][0]["r_squared"] == pytest.approx(0.0282, abs=1e-4)


def test_attention_known_values(order_series):
    w = forecast.attention_weights()
    assert np.allclose(w, [0.28943311, 0.31987306, 0.39069383], atol=1e-8)
    got = _by_kind(forecast.forecast_attention(order_series))
    fc = got["forecast"]
    assert [r["value"] for r in fc] == [58810002.14, 44031324.19, 50142805.68]
    assert fc[0]["r_squared"] == pytest.approx(0.0254, abs=1e-4) and fc[0]["r2_label"] == "Fair"
    assert len(got["fitted"]) == 77 and got["fitted"][0]["step"] == 3


def _closed_form_attention(rev):
    """Weights and intercept of the ridge system with an unpenalised intercept column."""
    z = (rev - rev.mean()) / rev.std()
    w = np.array(forecast.attention_weights())
    x = np.array([list(z[i - 3:i] * w) + [z[i - 3:i].mean(), z[i - 3:i].std(), z[i - 1] - z[i - 3]]
                  for i in range(3, len(z))])
    xa = np.hstack([x, np.ones((len(x), 1))])
    pen = np.eye(xa.shape[1])
    pen[-1, -1] = 0.0
    return x, np.linalg.solve(xa.T @ xa + pen, xa.T @ z[3:])


def test_attention_matches_closed_form_ridge(order_series):
    rev = order_series.orderBy("month").toPandas()["revenue"].to_numpy()
    _, beta = _closed_form_attention(rev)
    model = forecast.attention_models(order_series).first()
    assert np.allclose(model["coefficients"], beta[:-1]) and model["intercept"] == pytest.approx(beta[-1])
    assert model["months"] == len(rev) and model["scale"] == pytest.approx(rev.std())


def test_spark_window_features_equal_numpy(order_series):
    """The Spark window columns give the same features as NumPy windows."""
    feats = forecast.attention_features(order_series).orderBy("month").toPandas()
    x, _ = _closed_form_attention(feats["revenue"].to_numpy())
    assert np.allclose(feats[list(forecast.ATTENTION_FEATURES)].iloc[3:].to_numpy(float), x, rtol=1e-9, atol=1e-12)
    lin = forecast.linear_features(order_series).orderBy("month").toPandas()
    s = lin["revenue"]
    assert np.allclose(lin["rolling_avg_3"].dropna(), s.rolling(3).mean().dropna(), rtol=1e-12)
    assert lin["month_idx"].tolist() == list(range(len(lin)))


@pytest.mark.parametrize("fit", [forecast.forecast_linear, forecast.forecast_attention])
def test_missing_month_comes_last(spark, fit):
    """A NULL month is the newest one in the lags, in the last value and in the report."""
    rows = [("a", f"2020-{i + 1:02d}", float(v)) for i, v in enumerate([10, 12, 9, 14, 13, 15, 11])]
    got = _by_kind(fit(spark.createDataFrame([("a", None, 5.0), *rows], "series_key string, month string, revenue double")))
    assert [r["month"] for r in got["historical"]] == [m for _, m, _ in rows] + [None]
    assert got["forecast"][0]["last_month_revenue"] == 5.0


def _series(spark, key, values):
    rows = [(key, f"2020-{i + 1:02d}", float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_key string, month string, revenue double")


def test_guards_and_degenerate_series(spark):
    two = _by_kind(forecast.forecast_linear(_series(spark, "a", [1, 2])))
    assert "forecast" not in two and two["historical"][0]["status"] == "too_few_rows"
    four = _by_kind(forecast.forecast_attention(_series(spark, "a", [1, 2, 3, 4])))
    assert four["historical"][0]["status"] == "too_few_rows"
    const = _by_kind(forecast.forecast_linear(_series(spark, "a", [5] * 6)))
    assert const["forecast"][0]["r_squared"] == 1.0 and [r["value"] for r in const["forecast"]] == [5.0] * 3
    zero_last = _by_kind(forecast.forecast_linear(_series(spark, "a", [3, 1, 4, 1, 5, 0])))
    assert zero_last["forecast"][0]["change_percent"] is None
    flat = _by_kind(forecast.forecast_attention(_series(spark, "a", [7] * 6)))
    assert all(r["value"] >= 0 for r in flat["forecast"])


def test_groups_are_fitted_independently(spark):
    a = [10, 12, 9, 14, 13, 15, 11, 16]
    b = [100, 90, 95, 80, 85, 70, 75, 60]
    both = _series(spark, "a", a).unionByName(_series(spark, "b", b))
    together = forecast.forecast_attention(both).filter(F.col("series_key") == "b")
    alone = forecast.forecast_attention(_series(spark, "b", b))
    key = ["kind", "step"]
    assert together.orderBy(*key).collect() == alone.orderBy(*key).collect()
