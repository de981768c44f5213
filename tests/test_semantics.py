"""Semantics on hand-made rows (original schema through the domain adapter)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rentscope.functions import RfmThresholds
from rentscope.operators import catalog, churn, customers, filters, metrics, rfm
from rentscope.sources import domain, driver
from tests import fixtures
from tests.conftest import SF001

D = dt.date


@pytest.fixture(scope="module")
def data(spark):
    return fixtures.data(spark)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_kpi_payment_rows_and_distinct_rentals(data):
    (r,) = rows(metrics.kpi_summary(data))
    assert r == dict(total_customers=5, total_revenue=34.27, total_rentals=7,
                     avg_transaction=4.28, avg_spend_per_customer=6.85)


def test_monthly_revenue_by_payment_date(data):
    got = rows(metrics.monthly_revenue(data))
    assert [(r["month"], r["label"], r["revenue"], r["transactions"], r["active_customers"]) for r in got] == [
        ("2020-01", "Jan 2020", 2.03, 2, 1),
        ("2020-02", "Feb 2020", 7.0, 2, 2),
        ("2020-03", "Mar 2020", 8.0, 2, 1),
        ("2020-04", "Apr 2020", 17.24, 3, 2),   # the NULL-amount payment is a transaction
    ]


def test_customer_summary_weights_and_half_away_rounding(data):
    got = {r["customer_id"]: r for r in rows(customers.customer_summary(data))}
    assert list(got) == [4, 3, 1]               # revenue desc; c2 unreturned, c5 without geography
    assert got[1]["rental_count"] == 1 and got[1]["avg_payment"] == 1.34 and got[1]["avg_duration"] == 0.5
    assert got[3]["avg_duration"] == 12.1       # (11.6 + 12.5) / 2 = 12.05 -> 12.1
    assert got[4]["avg_payment"] == 9.99        # NULL amount ignored by the average
    assert got[4]["avg_duration"] == 20.5       # but its row still counts for duration
    assert got[3]["name"] == "Cy% Do_e" and got[3]["country"] == "Borduria"


def test_rfm_segments_default_rule(data):
    got = rows(rfm.rfm_segments(data))
    assert [r["customer_id"] for r in got] == [4, 3, 5, 2, 1]
    by = {r["customer_id"]: r for r in got}
    assert by[1]["recency_days"] == 111 and by[1]["segment"] == "At Risk"
    assert by[1]["last_rental"] == D(2020, 1, 10)   # the unpaid rental 2 does not count
    assert by[2]["recency_days"] == 85 and by[2]["name"] is None
    assert by[3]["recency_days"] == 59 and by[3]["segment"] == "Lost"   # recent but small: the gap
    assert by[4]["recency_days"] == 0 and by[5]["recency_days"] == 0    # dates, not hours


def test_rfm_limits_are_inclusive(data):
    t = RfmThresholds(champions_recency=0, champions_frequency=2, champions_monetary=9.99,
                      loyal_recency=60, loyal_frequency=2, loyal_monetary=100)
    by = {r["customer_id"]: r["segment"] for r in rows(rfm.rfm_segments(data, t))}
    assert by == {4: "Champions", 3: "Loyal", 5: "Lost", 2: "At Risk", 1: "At Risk"}
    region = rows(rfm.rfm_by_region(data, t))
    assert region == [dict(country="Borduria", loyal_count=2, champions_count=1, loyal_revenue=17.99,
                           total_customers=2)]
    assert rows(rfm.rfm_by_region(data)) == []     # HAVING drops countries without loyal customers


def test_genres_bridge_fan_out(data):
    assert [(r["genre"], r["rental_count"]) for r in rows(catalog.genre_counts(data))] == [
        ("Comedy", 6), ("Drama", 4), ("Horror", 2)]
    monthly = {(r["month"], r["genre"]): r["rental_count"] for r in rows(catalog.genre_monthly(data))}
    assert monthly == {("2020-01", "Comedy"): 2, ("2020-01", "Drama"): 1, ("2020-02", "Horror"): 1,
                       ("2020-03", "Comedy"): 2, ("2020-03", "Drama"): 1, ("2020-04", "Drama"): 2,
                       ("2020-04", "Comedy"): 2, ("2020-04", "Horror"): 1}


def test_geography_ties_broken_by_name(data):
    assert rows(metrics.geo_top_n(data, 1)) == [dict(country="Aland", customer_count=2)]


def test_duration_half_away_and_cap(data):
    got = {r["duration_days"]: r["rental_count"] for r in rows(metrics.duration_histogram(data))}
    assert got == {1: 3, 2: 1, 12: 3}


def test_store_summary(data):
    assert rows(metrics.store_summary(data)) == [
        dict(store_label="Store 1", unique_customers=4, rental_count=4, revenue=14.78),
        dict(store_label="Store 2", unique_customers=3, rental_count=3, revenue=19.49),
    ]


@pytest.mark.parametrize("q,expected", [
    ("LEE", [1]), ("%", [1, 3, 4]), ("y%", [3]), ("_e", [1, 3, 4]), ("nobody", []),
])
def test_search_case_insensitive_with_wildcards(data, q, expected):
    assert [r["customer_id"] for r in rows(customers.customer_search(data, q))] == expected


def test_search_rejects_empty(data):
    with pytest.raises(ValueError):
        customers.customer_search(data, "")


def test_customer_kpi_lookup_and_unknown(data):
    (r,) = rows(customers.customer_kpi(data, 4))
    assert r == dict(total_rentals=2, total_spent=9.99, avg_transaction=9.99,
                     first_rental=D(2020, 4, 1), last_rental=D(2020, 4, 30))
    (u,) = rows(customers.customer_kpi(data, 42))
    assert u["total_rentals"] == 0 and u["total_spent"] is None and u["first_rental"] is None


def test_customer_detail_parts(data):
    parts = customers.customer_detail(data, 1)
    assert rows(parts["timeline"]) == [dict(month="Jan 2020", month_sort=D(2020, 1, 1), rental_count=2)]
    assert rows(parts["genres"]) == [dict(genre="Comedy", rental_count=2), dict(genre="Drama", rental_count=1)]
    hist = rows(parts["history"])
    assert len(hist) == 6 and {h["rental_id"] for h in hist} == {1}        # unpaid rental 2 absent
    assert sorted(h["paid"] for h in hist) == [1.01, 1.01, 1.02, 1.02, 2.0, 2.0]
    full = rows(customers.customer_history_full(data, 1))
    assert len(full) == 7 and [f for f in full if f["film_title"] == "Beta"][0]["amount"] == 0.0


def test_history_top_k_is_newest_first(data):
    hist = rows(customers.customer_history(data, 4, n=1))
    assert len(hist) == 1 and hist[0]["rental_id"] == 7


def test_revenue_axes_and_cumulative(data):
    by_rental = [(r["month"], r["revenue"], r["transactions"]) for r in rows(metrics.monthly_revenue_by_rental(data))]
    assert by_rental == [("2020-01", 4.03, 1), ("2020-02", 5.0, 1), ("2020-03", 8.0, 2), ("2020-04", 17.24, 3)]
    cum = [r["cumulative_revenue"] for r in rows(metrics.cumulative_revenue(data))]
    assert cum == [2.03, 9.03, 17.03, 34.27]


def test_rental_frequency(data):
    assert rows(metrics.rental_frequency(data)) == [dict(rental_count=1, customers=2),
                                                    dict(rental_count=2, customers=3)]


def test_spending_tiers_cut_is_inclusive(data):
    got = rows(customers.spending_tiers(data, cuts=(5.0, 9.99), labels=("a", "b", "c")))
    assert got == [dict(tier="a", customers=1, revenue=4.03), dict(tier="b", customers=3, revenue=20.25),
                   dict(tier="c", customers=1, revenue=9.99)]


def test_month_filter_and_segment_filter(data):
    feb_mar = filters.restrict_months(data, "2020-02", "2020-03")
    assert [r["month"] for r in rows(metrics.monthly_revenue_payments(feb_mar))] == ["2020-02", "2020-03"]
    lost = filters.with_filters(data, segments=["Lost"])
    assert sorted(r["customer_id"] for r in rows(customers.customer_spend(lost))) == [3, 4, 5]


def test_churn_features_extend_unreturned_to_as_of(data):
    by = {r["customer_id"]: r for r in rows(churn.churn_features(data, as_of="2020-06-01 00:00:00"))}
    assert by[2]["avg_duration"] == 117.0 and by[2]["is_churn"] == 0
    assert by[1]["recency_days"] == 111 and by[1]["is_churn"] == 1 and by[1]["avg_duration"] == 0.5


def test_churn_guard_too_few_customers(data):
    result = churn.train_churn(churn.churn_features(data, as_of="2020-06-01 00:00:00"))
    assert result.status == "too_few_customers"
    (r,) = rows(churn.churn_report(result))
    assert r["status"] == "too_few_customers" and r["accuracy"] is None and r["imp_monetary"] is None


def _without_store(spark):
    t = fixtures.tables(spark)
    t["inventory"] = t["inventory"].withColumn("store_id", F.when(F.col("inventory_id") != 500, F.col("store_id")))
    return domain.from_tables(t)


def test_item_without_a_store_counts_everywhere_but_in_the_store_report(spark, data):
    bare = _without_store(spark)
    assert rows(catalog.genre_counts(bare)) == rows(catalog.genre_counts(data))
    assert customers.customer_history_full(bare).count() == customers.customer_history_full(data).count()
    assert [r["store_label"] for r in rows(metrics.store_summary(bare))] == ["Store 2"]


def test_items_of_missing_rentals_are_not_counted(spark):
    data = fixtures.data(spark)
    orphan = spark.createDataFrame([(999, 50, 1, None, None, False)], data.rental_item.schema)
    more = data.with_tables(rental_item=data.rental_item.unionByName(orphan))
    assert rows(catalog.genre_counts(more)) == rows(catalog.genre_counts(data))


@pytest.mark.parametrize("q, found", [(r"a\n", [1]), (r"y\%", [3]), (r"\_", [3]), ("\\", []), (r"n\\", [])])
def test_search_takes_a_backslash_as_an_escape(data, q, found):
    assert [r["customer_id"] for r in rows(customers.customer_search(data, q))] == found


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_large_amounts_and_many_payments_stay_exact(spark, ansi):
    """A price of 2,500,000 and a customer with 3e11 payment rows (already aggregated)."""
    from decimal import Decimal

    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        li = driver.read_table(spark, SF001, "lineitem").withColumn("l_extendedprice", F.lit(2_500_000.25))
        read = lambda name: li if name == "lineitem" else driver.read_table(spark, SF001, name)
        (kpi,) = rows(metrics.kpi_summary(driver.load_with(read)))
        assert kpi["total_revenue"] == 2_500_000.25 * li.count() and kpi["avg_transaction"] == 2_500_000.25

        data = fixtures.data(spark)
        n = 300_000_000_000
        paid = spark.createDataFrame(
            [(1, 1, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 6), Decimal(n) * 2, n, n)],
            "rental_id long, customer_id long, rental_date timestamp_ntz, return_date timestamp_ntz, "
            "paid decimal(22,2), n_rows long, n_amt long")
        big = data.with_tables(rental_paid=paid)
        assert rows(customers.customer_summary(big))[0]["avg_duration"] == 5.0
        assert rows(churn.churn_features(big, as_of="2020-06-01 00:00:00"))[0]["avg_duration"] == 5.0
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
