"""Recency / frequency / monetary segmentation, overall and by country."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentscope.functions import RfmThresholds, SEGMENTS, as_date, days_between, money, segment_expr
from rentscope.model import RentalData
from rentscope.plans import customer_rollup, paid_rentals


def latest_rental_date(data: RentalData) -> Column:
    """Scalar subquery: the date of the latest rental in the whole table
    ("today" is the data's end, not the clock). Evaluated once per query."""
    return data.rental.select(F.max("rental_date").cast("date")).scalar()


def rfm_base(data: RentalData) -> DataFrame:
    """customer_id, last_rental (date), frequency, monetary (decimal, rounded),
    recency_days for every customer with at least one paid rental."""
    per_customer = customer_rollup(
        paid_rentals(data),
        F.max("rental_date").alias("last_ts"),
    )
    return per_customer.select(
        "customer_id",
        as_date("last_ts").alias("last_rental"),
        F.col("rentals").cast("long").alias("frequency"),
        F.round("paid", 2).alias("monetary"),
        days_between(latest_rental_date(data), as_date("last_ts")).cast("long").alias("recency_days"),
    )


def rfm_segments(data: RentalData, thresholds: RfmThresholds = RfmThresholds()) -> DataFrame:
    """customer_id, name, email, last_rental, frequency, monetary, recency_days,
    segment; largest spenders first."""
    base = rfm_base(data).join(data.customer.select("customer_id", "name", "email"), "customer_id")
    return (
        base.select(
            "customer_id", "name", "email", "last_rental", "frequency",
            money("monetary").alias("monetary"), "recency_days",
            segment_expr("recency_days", "frequency", "monetary", thresholds).alias("segment"),
        )
        .orderBy(F.col("monetary").desc_nulls_first(), F.col("customer_id"))
    )


def rfm_by_region(data: RentalData, thresholds: RfmThresholds = RfmThresholds()) -> DataFrame:
    """country, loyal_count, champions_count, loyal_revenue, total_customers
    for countries with at least one Loyal or Champions customer."""
    seg = rfm_base(data).join(data.customer_geo, "customer_id").withColumn(
        "segment", segment_expr("recency_days", "frequency", "monetary", thresholds)
    )
    loyal = F.col("segment").isin(SEGMENTS[0], SEGMENTS[1])
    agg = seg.groupBy("country").agg(
        F.count(F.when(loyal, 1)).cast("long").alias("loyal_count"),
        F.count(F.when(F.col("segment") == SEGMENTS[0], 1)).cast("long").alias("champions_count"),
        F.sum(F.when(loyal, F.col("monetary")).otherwise(F.lit(0))).alias("loyal_rev"),
        F.count(F.lit(1)).cast("long").alias("total_customers"),
    )
    return (
        agg.filter(F.col("loyal_count") > 0)
        .select("country", "loyal_count", "champions_count", money("loyal_rev").alias("loyal_revenue"),
                "total_customers")
        .orderBy(F.col("loyal_count").desc(), F.col("country").asc_nulls_last())
    )


def segment_customers(data: RentalData, segments, thresholds: RfmThresholds = RfmThresholds()) -> DataFrame:
    """customer_id of the customers in the given segments (for filters)."""
    base = rfm_base(data)
    return base.filter(
        segment_expr("recency_days", "frequency", "monetary", thresholds).isin(*segments)
    ).select("customer_id")
