"""The registered queries: one callable (spark, sf_dir) -> DataFrame per
operator of the inventory, and the DuckDB oracle SQL for each that has one.

Every query reads the whole driver tables of ``sf_dir``; parameters are
the operator's own (top-n sizes, search text, thresholds).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentscope import oracle
from rentscope.functions import RfmThresholds, TUNED_THRESHOLDS
from rentscope.operators import catalog, churn, customers, filters, forecast, metrics, rfm, search
from rentscope.operators.forest import Forest
from rentscope.plans import cut_lineage
from rentscope.session import configure, ensure_checkpoint_dir
from rentscope.sources import driver

# Parameters of the registered queries.
SEARCH_Q = "ER#0000001"          # mixed case on purpose: the search is case-insensitive
SEARCH_RARE_Q = "oMer#000000042"   # three letters or more: found through trigrams
TOP_CUSTOMERS = 10
TIER_CUTS = (1_500_000, 3_000_000)
TIER_LABELS = ("1 low", "2 mid", "3 high")
CHURN_AS_OF = "2001-09-01 00:00:00"
FILTER_MONTHS = ("1997-01", "1999-12")
FILTER_SEGMENTS = ("Champions", "Loyal")
FILTER_TOP = 40
KNOWN, UNKNOWN = 7, -1
STRICT_THRESHOLDS = replace(TUNED_THRESHOLDS, champions_monetary=10**9, loyal_frequency=10**6, loyal_monetary=2_900_000)

Query = Callable[[SparkSession, str], DataFrame]


def _data(spark: SparkSession, sf_dir: str):
    configure(spark)
    return driver.load(spark, sf_dir)


def _on_data(fn) -> Query:
    return lambda spark, sf_dir: fn(_data(spark, sf_dir))


# The label is recency_days > 90, so the reference feature set leaks it; the
# variant without recency shows what the other features predict.
NO_RECENCY = tuple(f for f in churn.FEATURES if f != "recency_days")


def _of_segments(data):
    return filters.with_filters(data, FILTER_MONTHS, FILTER_SEGMENTS, TUNED_THRESHOLDS)


def _rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({name: F.round(name, n) for name, n in digits.items()})


# Fitted forests that come with the library: reports score with them, a fit is a batch of its own.
FOREST, FOREST_NO_RECENCY = Forest.stored("churn"), Forest.stored("churn_no_recency")


def _churn_result(data, forest: Forest = FOREST) -> churn.ChurnResult:
    return churn.score_churn(churn.churn_features(data, as_of=CHURN_AS_OF), forest)


def _churn_guards(data) -> DataFrame:
    features = churn.churn_features(data, as_of=CHURN_AS_OF)
    segments = rfm.rfm_segments(data, TUNED_THRESHOLDS).select("customer_id", "segment")
    return churn.churn_guards(features.join(data.customer_geo, "customer_id").join(segments, "customer_id"), ("country", "segment"))


def _refitted(data) -> DataFrame:
    features = cut_lineage(churn.churn_features(data, as_of=CHURN_AS_OF))
    return churn.churn_report(churn.score_churn(features, churn.fit_churn_forest(features)))


def _indexed_search(data) -> DataFrame:
    spark = data.customer.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/names-{uuid.uuid4().hex}"
    search.write_name_index(data, path)
    return search.indexed_search(data, search.read_name_index(spark, path), SEARCH_RARE_Q)


def _varied(data):
    """The rentals with unpaid lines (amounts of whole tens of cents) and with films of two genres (even numbers)."""
    unpaid = F.col("amount") * 10 == F.floor(F.col("amount") * 10)
    line = data.rental_line.withColumn("has_payment", ~unpaid).withColumn("amount", F.when(~unpaid, F.col("amount")))
    second = data.film.filter(F.col("film_id") % 2 == 0).select("film_id", F.lit("Even").alias("genre"))
    return data.with_tables(film_genre=data.film_genre.unionByName(second), rental_line=line)


QUERIES: dict[str, Query] = {
    # key figures and monthly revenue
    "kpi_summary": _on_data(metrics.kpi_summary),
    "monthly_revenue": _on_data(metrics.monthly_revenue),
    "monthly_revenue_by_rental": _on_data(metrics.monthly_revenue_by_rental),
    "monthly_revenue_payments": _on_data(metrics.monthly_revenue_payments),
    "cumulative_revenue": _on_data(metrics.cumulative_revenue),
    "cumulative_revenue_by_rental": _on_data(lambda d: metrics.cumulative_revenue(d, axis="rental")),
    # customers
    "customer_summary": _on_data(customers.customer_summary),
    "top_n_customers": _on_data(lambda d: customers.top_n_customers(d, TOP_CUSTOMERS)),
    "customer_spend": _on_data(customers.customer_spend),
    "rentals_vs_revenue": _on_data(customers.rentals_vs_revenue),
    "spending_tiers": _on_data(lambda d: customers.spending_tiers(d, TIER_CUTS, TIER_LABELS)),
    "rental_frequency": _on_data(metrics.rental_frequency),
    # RFM
    "rfm_segments": _on_data(rfm.rfm_segments),
    "rfm_segments_tuned": _on_data(lambda d: rfm.rfm_segments(d, TUNED_THRESHOLDS)),
    "rfm_by_region": _on_data(rfm.rfm_by_region),
    "rfm_by_region_tuned": _on_data(lambda d: rfm.rfm_by_region(d, TUNED_THRESHOLDS)),
    # catalogue, geography, durations, stores
    "genre_counts": _on_data(catalog.genre_counts),
    "genre_monthly": _on_data(catalog.genre_monthly),
    "geo_top_n": _on_data(metrics.geo_top_n),
    "duration_histogram": _on_data(metrics.duration_histogram),
    "duration_histogram_wide": _on_data(lambda d: metrics.duration_histogram(d, cap=360, bin_days=30)),
    "store_summary": _on_data(metrics.store_summary),
    # customer lookup (all-customer batch forms)
    "customer_search": _on_data(lambda d: customers.customer_search(d, SEARCH_Q)),
    "customer_search_indexed": _on_data(_indexed_search),
    "customer_kpi": _on_data(customers.customer_kpi),
    "customer_timeline": _on_data(customers.customer_timeline),
    "customer_top_genres": _on_data(customers.customer_top_genres),
    "customer_history": _on_data(customers.customer_history),
    "customer_history_full": _on_data(customers.customer_history_full),
    "customer_detail": _on_data(customers.customer_detail_batch),
    "customer_pages": _on_data(customers.customer_pages),
    "customer_pages_text": _on_data(customers.customer_pages_text),
    # lookups of one customer, known and unknown, and cuts that bite
    "customer_kpi_one": _on_data(lambda d: customers.customer_kpi(d, KNOWN)),
    "customer_kpi_unknown": _on_data(lambda d: customers.customer_kpi(d, UNKNOWN)),
    "customer_timeline_one": _on_data(lambda d: customers.customer_timeline(d, KNOWN)),
    "customer_top_genres_one": _on_data(lambda d: customers.customer_top_genres(d, KNOWN, n=3)),
    "customer_history_one": _on_data(lambda d: customers.customer_history(d, KNOWN, n=10)),
    "customer_history_full_one": _on_data(lambda d: customers.customer_history_full(d, KNOWN)),
    "customer_history_unknown": _on_data(lambda d: customers.customer_history(d, UNKNOWN)),
    "customer_top_genres_3": _on_data(lambda d: customers.customer_top_genres(d, n=3)),
    "customer_history_10": _on_data(lambda d: customers.customer_history(d, n=10)),
    "customer_history_varied": _on_data(lambda d: customers.customer_history(_varied(d), n=10)),
    "customer_history_full_varied": _on_data(lambda d: customers.customer_history_full(_varied(d))),
    "customer_top_genres_varied": _on_data(lambda d: customers.customer_top_genres(_varied(d), n=4)),
    "genre_counts_varied": _on_data(lambda d: catalog.genre_counts(_varied(d))),
    "rfm_by_region_strict": _on_data(lambda d: rfm.rfm_by_region(d, STRICT_THRESHOLDS)),
    # global filters in front of an operator
    "revenue_filtered": _on_data(lambda d: metrics.monthly_revenue_payments(_of_segments(d))),
    "kpi_filtered": _on_data(lambda d: metrics.kpi_summary(_of_segments(d))),
    "store_filtered": _on_data(lambda d: metrics.store_summary(filters.with_filters(
        d, FILTER_MONTHS, tiers=TIER_LABELS[1:2], cuts=TIER_CUTS, labels=TIER_LABELS))),
    "customer_summary_filtered": _on_data(lambda d: customers.customer_summary(filters.with_filters(
        d, FILTER_MONTHS, top_n=FILTER_TOP))),
    # forecasts
    "forecast_linear": _on_data(lambda d: forecast.forecast_linear(
        forecast.revenue_series(d, axis="rental"), horizon=3)),
    "forecast_linear_lagged": _on_data(lambda d: forecast.forecast_linear(
        forecast.revenue_series(d, axis="rental"), horizon=3, mode="lagged")),
    "forecast_linear_extended": _on_data(lambda d: forecast.forecast_linear(
        forecast.revenue_series(d, axis="payment"), horizon=6)),
    "forecast_by_country": _on_data(lambda d: forecast.forecast_linear(
        forecast.revenue_series(d, axis="rental", by="country"), horizon=3)),
    "linear_features": _on_data(lambda d: _rounded(forecast.linear_features(
        forecast.revenue_series(d, axis="rental")), {"rolling_avg_3": 4})),
    "attention_features": _on_data(lambda d: _rounded(forecast.attention_features(
        forecast.revenue_series(d, axis="payment")),
        {"mean": 4, "scale": 4, "z": 6, **dict.fromkeys(forecast.ATTENTION_FEATURES, 6)})),
    "forecast_attention": _on_data(lambda d: forecast.forecast_attention(
        forecast.revenue_series(d, axis="payment"))),
    "forecast_attention_by_country": _on_data(lambda d: forecast.forecast_attention(
        forecast.revenue_series(d, axis="payment", by="country"))),
    # churn
    "churn_features": _on_data(lambda d: churn.churn_features(d, as_of=CHURN_AS_OF)),
    "churn_split": _on_data(lambda d: churn.split_weights(churn.churn_features(d, as_of=CHURN_AS_OF))),
    "churn_scores": _on_data(lambda d: _churn_result(d).scores),
    "churn_report": _on_data(lambda d: churn.churn_report(_churn_result(d))),
    "churn_at_risk": _on_data(lambda d: churn.churn_at_risk(_churn_result(d))),
    "churn_report_no_recency": _on_data(lambda d: churn.churn_report(_churn_result(d, FOREST_NO_RECENCY))),
    "churn_report_refitted": _on_data(_refitted),
    "churn_scaled": _on_data(lambda d: _rounded(
        churn.scaled_features(churn.churn_features(d, as_of=CHURN_AS_OF)), {f"scaled_{c}": 6 for c in churn.FEATURES})),
    "churn_guards": _on_data(_churn_guards),
    "forecast_guards": _on_data(lambda d: forecast.series_guards(forecast.revenue_series(d, axis="rental", by="customer"))),
}


def _filter_end(month: str) -> str:
    y, m = (int(x) for x in month.split("-"))
    return f"{y + (m == 12):04d}-{m % 12 + 1:02d}-01 00:00:00"


_FILTER_SPAN = (f"{FILTER_MONTHS[0]}-01 00:00:00", _filter_end(FILTER_MONTHS[1]))

ORACLE: dict[str, str] = {
    "kpi_summary": oracle.kpi_sql(),
    "monthly_revenue": oracle.MONTHLY,
    "monthly_revenue_by_rental": oracle.BY_RENTAL,
    "monthly_revenue_payments": oracle.BY_PAYMENT,
    "cumulative_revenue": oracle.CUMULATIVE,
    "cumulative_revenue_by_rental": oracle.CUMULATIVE_BY_RENTAL,
    "customer_summary": oracle.customer_summary_sql(),
    "top_n_customers": oracle.top_customers_sql(TOP_CUSTOMERS),
    "customer_spend": oracle.CUSTOMER_SPEND,
    "rentals_vs_revenue": oracle.CORRELATION,
    "spending_tiers": oracle.tiers_sql(TIER_CUTS, TIER_LABELS),
    "rental_frequency": oracle.FREQUENCY,
    "rfm_segments": oracle.rfm_segments_sql(RfmThresholds()),
    "rfm_segments_tuned": oracle.rfm_segments_sql(TUNED_THRESHOLDS),
    "rfm_by_region": oracle.rfm_by_region_sql(RfmThresholds()),
    "rfm_by_region_tuned": oracle.rfm_by_region_sql(TUNED_THRESHOLDS),
    "genre_counts": oracle.GENRE,
    "genre_monthly": oracle.GENRE_MONTHLY,
    "geo_top_n": oracle.GEO,
    "duration_histogram": oracle.duration_sql(12),
    "duration_histogram_wide": oracle.duration_sql(360, 30),
    "store_summary": oracle.STORE,
    "customer_search": oracle.search_sql(SEARCH_Q),
    "customer_kpi": oracle.customer_kpi_sql(),
    "customer_timeline": oracle.TIMELINE,
    "customer_top_genres": oracle.top_genres_sql(),
    "customer_history": oracle.history_sql(),
    "customer_history_full": oracle.HISTORY_FULL,
    "customer_detail": oracle.customer_detail_sql(),
    "customer_pages_text": oracle.customer_pages_sql(),
    "customer_kpi_one": oracle.one_kpi_sql(KNOWN),
    "customer_kpi_unknown": oracle.one_kpi_sql(UNKNOWN),
    "customer_timeline_one": oracle.timeline_sql(KNOWN),
    "customer_top_genres_one": oracle.top_genres_sql(3, KNOWN),
    "customer_history_one": oracle.history_sql(10, KNOWN),
    "customer_history_full_one": oracle.history_full_sql(KNOWN),
    "customer_history_unknown": oracle.history_sql(100, UNKNOWN),
    "customer_top_genres_3": oracle.top_genres_sql(3),
    "customer_history_10": oracle.history_sql(10),
    "customer_search_indexed": oracle.search_sql(SEARCH_RARE_Q),
    "customer_history_varied": oracle.varied(oracle.history_sql(10)),
    "customer_history_full_varied": oracle.varied(oracle.HISTORY_FULL, unpaid=True),
    "customer_top_genres_varied": oracle.varied(oracle.top_genres_sql(4), unpaid=True),
    "genre_counts_varied": oracle.varied(oracle.GENRE, unpaid=True),
    "rfm_by_region_strict": oracle.rfm_by_region_sql(STRICT_THRESHOLDS),
    "revenue_filtered": oracle.filtered_revenue_sql(*_FILTER_SPAN, oracle.keep_segments(FILTER_SEGMENTS, TUNED_THRESHOLDS)),
    "kpi_filtered": oracle.filtered_kpi_sql(*_FILTER_SPAN, oracle.keep_segments(FILTER_SEGMENTS, TUNED_THRESHOLDS)),
    "store_filtered": oracle.filtered_store_sql(*_FILTER_SPAN, oracle.keep_tier(*TIER_CUTS)),
    "customer_summary_filtered": oracle.filtered_summary_sql(*_FILTER_SPAN, oracle.keep_top(FILTER_TOP)),
    "linear_features": oracle.linear_features_sql("rental"),
    "attention_features": oracle.attention_features_sql(),
    "forecast_linear_lagged": oracle.lagged_forecast_sql("rental", 3),
    "forecast_attention": oracle.attention_forecast_sql(),
    "forecast_attention_by_country": oracle.attention_forecast_sql(by_country=True),
    "churn_split": oracle.churn_split_sql(CHURN_AS_OF),
    "churn_features": oracle.churn_features_sql(CHURN_AS_OF),
    "churn_scores": oracle.churn_scores_sql(CHURN_AS_OF, FOREST),
    "churn_report": oracle.churn_report_sql(CHURN_AS_OF, FOREST),
    "churn_at_risk": oracle.churn_at_risk_sql(CHURN_AS_OF, FOREST),
    "churn_report_no_recency": oracle.churn_report_sql(CHURN_AS_OF, FOREST_NO_RECENCY),
    "churn_scaled": oracle.churn_scaled_sql(CHURN_AS_OF, churn.FEATURES),
    "churn_guards": oracle.churn_guards_sql(CHURN_AS_OF, TUNED_THRESHOLDS),
    "forecast_guards": oracle.series_guards_sql(),
    "forecast_linear": oracle.linear_forecast_sql("rental", 3),
    "forecast_linear_extended": oracle.linear_forecast_sql("payment", 6),
    "forecast_by_country": oracle.linear_forecast_sql("rental", 3, by_country=True),
}
