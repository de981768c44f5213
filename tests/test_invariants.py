"""Cross-operator invariants on the driver tables (sf0.01)."""

import pytest
from pyspark.sql import functions as F

from rentscope.functions import TUNED_THRESHOLDS
from rentscope.operators import catalog, customers, filters, forecast, metrics, rfm
from rentscope.sources import driver
from tests.conftest import SF01


@pytest.fixture(scope="module")
def data(spark):
    return driver.load(spark, SF01)


def total(df, col):
    return df.agg(F.sum(col)).first()[0]


def test_revenue_is_the_same_on_every_path(data):
    (kpi,) = metrics.kpi_summary(data).collect()
    assert round(total(metrics.monthly_revenue(data), "revenue"), 2) == kpi["total_revenue"]
    assert round(total(metrics.monthly_revenue_by_rental(data), "revenue"), 2) == kpi["total_revenue"]
    cum = metrics.cumulative_revenue(data).orderBy(F.col("month").desc()).first()
    assert cum["cumulative_revenue"] == kpi["total_revenue"]
    assert total(metrics.monthly_revenue_by_rental(data), "transactions") == kpi["total_rentals"]


def test_duration_bins_count_returned_rentals(data):
    returned = data.rental.filter(F.col("return_date").isNotNull()).count()
    assert total(metrics.duration_histogram(data), "rental_count") == returned
    assert total(metrics.duration_histogram(data, cap=360, bin_days=30), "rental_count") == returned


def test_segments_partition_customers(data):
    seg = rfm.rfm_segments(data, TUNED_THRESHOLDS)
    counts = {r["segment"]: r["count"] for r in seg.groupBy("segment").count().collect()}
    assert sum(counts.values()) == seg.count() == 1500
    assert counts == {"Champions": 65, "Loyal": 196, "At Risk": 249, "Lost": 990}
    region = rfm.rfm_by_region(data, TUNED_THRESHOLDS)
    assert total(region, "total_customers") == 1500
    assert total(region, "champions_count") == 65 and total(region, "loyal_count") == 65 + 196


def test_frequency_distribution_adds_up(data):
    freq = metrics.rental_frequency(data)
    assert total(freq, "customers") == data.rental.select("customer_id").distinct().count()
    assert total(freq.select((F.col("rental_count") * F.col("customers")).alias("n")), "n") == data.rental.count()


def test_history_views_agree(data):
    full = customers.customer_history_full(data)
    assert full.count() == data.rental_item.count()          # every line has one genre here
    assert total(full, "amount") == pytest.approx(total(customers.customer_spend(data), "total_revenue"))


def test_genre_counts_cover_rentals_with_items(data):
    with_items = data.rental_item.select("rental_id").distinct().count()
    assert total(catalog.genre_counts(data), "rental_count") >= with_items


def test_drop_incomplete_last_month(data):
    full = forecast.revenue_series(data, axis="rental")
    trimmed = forecast.revenue_series(data, axis="rental", drop_incomplete_last=True)
    assert full.count() == 80 and trimmed.count() == 79        # 2001-08 holds two orders of one day
    assert trimmed.agg(F.max("month")).first()[0] == "2001-07"


FILTERS = {
    "payment months": dict(months=("1997-01", "1999-12")),
    "rental months": dict(months=("1997-01", "1999-12"), axis="rental"),
    "segments": dict(segments=("Champions", "Loyal"), thresholds=TUNED_THRESHOLDS),
    "tier": dict(tiers=("tier_1",), cuts=(1_500_000, 3_000_000), months=("1996-03", "1998-02")),
    "top": dict(top_n=25, months=("1996-03", "1998-02"), axis="rental"),
}


@pytest.mark.parametrize("name", FILTERS)
def test_revenue_agrees_on_every_path_under_a_filter(data, name):
    cut = filters.with_filters(data, **FILTERS[name])
    (kpi,) = metrics.kpi_summary(cut).collect()
    expected = kpi["total_revenue"]
    assert expected > 0
    for df, col in (
        (metrics.monthly_revenue(cut), "revenue"), (metrics.monthly_revenue_payments(cut), "revenue"),
        (metrics.monthly_revenue_by_rental(cut), "revenue"), (metrics.store_summary(cut), "revenue"),
        (customers.customer_history_full(cut), "amount"), (customers.customer_spend(cut), "total_revenue"),
        (forecast.revenue_series(cut, axis="payment"), "revenue"),
    ):
        assert round(total(df, col), 2) == pytest.approx(expected, abs=0.05)
