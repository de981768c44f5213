"""Global and monthly key figures, geography, durations, stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rentscope.functions import (
    duration_micros, money, month_key, month_label, month_start, round_ratio,
)
from rentscope.functions.calendar import MICROS_PER_DAY
from rentscope.model import RentalData
from rentscope.plans import customer_rollup, paid_rentals, payers


def kpi_summary(data: RentalData) -> DataFrame:
    """One row: total_customers, total_revenue, total_rentals, avg_transaction,
    avg_spend_per_customer over customers x rentals x payments (inner joins).

    Payments are reduced per rental, then per customer, and only then joined
    to the customer table (1:1), so no join repeats rows and no distinct
    count is needed.
    """
    per_customer = customer_rollup(paid_rentals(data))
    known = per_customer.join(data.customer.select("customer_id"), "customer_id", "left_semi")
    agg = known.agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("paid").alias("paid"),
        F.sum("rentals").alias("rentals"),
        F.sum("n_amt").alias("n_amt"),
    )
    return agg.select(
        F.col("customers").cast("long").alias("total_customers"),
        money("paid").alias("total_revenue"),
        F.coalesce(F.col("rentals"), F.lit(0)).cast("long").alias("total_rentals"),
        round_ratio("paid", "n_amt", 2).cast("double").alias("avg_transaction"),
        round_ratio("paid", "customers", 2).cast("double").alias("avg_spend_per_customer"),
    )


def monthly_revenue(data: RentalData) -> DataFrame:
    """Payments by payment month: month, label, revenue, transactions, active_customers."""
    return (
        payers(data).groupBy(month_start("payment_date").alias("m"))
        .agg(
            F.sum("amount").alias("revenue"),
            F.count(F.lit(1)).alias("transactions"),
            F.count_distinct("customer_id").alias("active_customers"),
        )
        .select(
            month_key("m").alias("month"), month_label("m").alias("label"), money("revenue").alias("revenue"),
            F.col("transactions").cast("long"), F.col("active_customers").cast("long"),
        )
        .orderBy(F.col("month").asc_nulls_last())
    )


def monthly_revenue_by_rental(data: RentalData) -> DataFrame:
    """Paid rentals by rental month: month, revenue, transactions (distinct rentals)."""
    paid = paid_rentals(data)
    return (
        paid.groupBy(month_start("rental_date").alias("m"))
        .agg(F.sum("paid").alias("revenue"), F.count(F.lit(1)).alias("transactions"))
        .select(month_key("m").alias("month"), money("revenue").alias("revenue"), F.col("transactions").cast("long"))
        .orderBy(F.col("month").asc_nulls_last())
    )


def monthly_revenue_payments(data: RentalData) -> DataFrame:
    """Payments by payment month: month, revenue, transactions (payment rows)."""
    return (
        data.payment.groupBy(month_start("payment_date").alias("m"))
        .agg(F.sum("amount").alias("revenue"), F.count(F.lit(1)).alias("transactions"))
        .select(month_key("m").alias("month"), money("revenue").alias("revenue"), F.col("transactions").cast("long"))
        .orderBy(F.col("month").asc_nulls_last())
    )


def cumulative_revenue(data: RentalData, axis: str = "payment") -> DataFrame:
    """month, revenue, cumulative_revenue (running total in month order).

    The running sum runs after aggregation, over one row per month, so the
    single window partition holds the calendar, not the data.
    """
    if axis == "payment":
        exact = data.payment.groupBy(month_start("payment_date").alias("m")).agg(F.sum("amount").alias("rev"))
    else:
        exact = (paid_rentals(data)
                 .groupBy(month_start("rental_date").alias("m")).agg(F.sum("paid").alias("rev")))
    w = Window.orderBy(F.col("m").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        exact.select(
            month_key("m").alias("month"),
            money("rev").alias("revenue"),
            money(F.sum("rev").over(w)).alias("cumulative_revenue"),
        )
        .orderBy(F.col("month").asc_nulls_last())
    )


def geo_top_n(data: RentalData, n: int = 15) -> DataFrame:
    """Countries with the most customers: country, customer_count (top n).

    Ties at the cut are broken by country name so the result is deterministic.
    """
    return (
        data.customer_geo.groupBy("country")
        .agg(F.count_distinct("customer_id").cast("long").alias("customer_count"))
        .orderBy(F.col("customer_count").desc(), F.col("country").asc_nulls_last())
        .limit(n)
    )


def duration_histogram(data: RentalData, cap: int = 12, bin_days: int = 1) -> DataFrame:
    """Returned rentals by whole days: duration_days, rental_count.

    Days are rounded half away from zero and capped at ``cap`` (the last bin
    holds everything at or above the cap); ``bin_days`` > 1 groups the days
    into wider bins labelled by their lower edge.
    """
    r = data.rental.filter(F.col("return_date").isNotNull())
    days = F.round(
        duration_micros("return_date", "rental_date").cast("decimal(20,0)")
        / F.lit(MICROS_PER_DAY).cast("decimal(12,0)"),
        0,
    ).cast("int")
    d = F.least(days, F.lit(cap))
    if bin_days > 1:
        d = (F.floor(d / bin_days) * bin_days).cast("int")
    return (
        r.groupBy(d.alias("duration_days"))
        .agg(F.count(F.lit(1)).cast("long").alias("rental_count"))
        .orderBy(F.col("duration_days").asc_nulls_last())
    )


def store_summary(data: RentalData) -> DataFrame:
    """store_label, unique_customers, rental_count, revenue per store (paid items)."""
    items = data.rental_item.filter(F.col("has_payment") & F.col("store_id").isNotNull()).select("rental_id", "store_id", "amount")
    # Join first, then reduce to one row per (store, rental): that grouping is
    # satisfied by the join's rental_id partitioning, so items shuffle once.
    joined = items.join(data.rental.select("rental_id", "customer_id"), "rental_id")
    per_store_rental = joined.groupBy("rental_id", "store_id", "customer_id").agg(F.sum("amount").alias("paid"))
    return (
        per_store_rental.groupBy("store_id")
        .agg(
            F.count_distinct("customer_id").cast("long").alias("unique_customers"),
            F.count(F.lit(1)).cast("long").alias("rental_count"),
            F.sum("paid").alias("paid"),
        )
        .orderBy(F.col("store_id").asc_nulls_last())
        .select(
            F.concat(F.lit("Store "), F.col("store_id").cast("string")).alias("store_label"),
            "unique_customers", "rental_count", money("paid").alias("revenue"),
        )
    )


def rental_frequency(data: RentalData) -> DataFrame:
    """Distribution of rentals per customer: rental_count, customers."""
    per_customer = data.rental.groupBy("customer_id").agg(F.count(F.lit(1)).alias("rental_count"))
    return (
        per_customer.groupBy(F.col("rental_count").cast("long").alias("rental_count"))
        .agg(F.count(F.lit(1)).cast("long").alias("customers"))
        .orderBy("rental_count")
    )


__all__ = [
    "kpi_summary", "monthly_revenue", "monthly_revenue_by_rental", "monthly_revenue_payments",
    "cumulative_revenue", "geo_top_n", "duration_histogram", "store_summary", "rental_frequency",
]
