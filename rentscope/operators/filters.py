"""Global filters composed in front of any operator: month range, customer
segment, spending tier and largest spenders. Each returns a restricted
``RentalData`` in which rentals, payments and items agree, so every revenue
figure under a filter is the same sum.

A filter is decided once: one pass over the payments gives every rental its
totals, of all payments and of those in the month range; customers are chosen
from those rows, and the rentals that stay are written as a table of keys with
their totals. Reports on rentals and paid rentals read that table alone;
payments and items are scanned once, cut by their date and by an exact semi-join
with the keys. The keys carry a comparison that Spark takes for selective, so
where the facts are large it puts a Bloom filter of the keys into their scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentscope.functions import RfmThresholds
from rentscope.model import RentalData
from rentscope.operators.customers import tier_of, top_n_customers
from rentscope.operators.rfm import segment_customers
from rentscope.plans import RENTAL_COLS, customer_rollup, paid_rentals, stored


def _month_bounds(start: str, end: str) -> tuple[dt.datetime, dt.datetime]:
    """'yyyy-MM' inclusive range -> [first instant, first instant after)."""
    y0, m0 = (int(x) for x in start.split("-"))
    y1, m1 = (int(x) for x in end.split("-"))
    return dt.datetime(y0, m0, 1), dt.datetime(y1 + (m1 == 12), m1 % 12 + 1, 1)


def _decided(data: RentalData, months: tuple[str, str] | None, axis: str,
             choose: Sequence[Callable[[RentalData], DataFrame]]) -> RentalData:
    """``data`` cut to the months and to the customers that every one of ``choose`` keeps.

    ``choose`` makes a DataFrame with customer_id, one row each, from all data.
    """
    if axis not in ("payment", "rental"):
        raise ValueError(f"unknown axis {axis!r}")

    def in_range(column: str) -> Column:
        lo, hi = (F.lit(t).cast("timestamp_ntz") for t in _month_bounds(*months))
        return (F.col(column) >= lo) & (F.col(column) < hi)

    by_payment = months is not None and axis == "payment"
    every = stored(data.payments_within(in_range if by_payment else lambda _: F.lit(True)), "rental-totals")
    whole = data.with_tables(rental_paid=every.filter("n_rows > 0").select(*RENTAL_COLS, "paid", "n_rows", "n_amt"))
    kept = [c(whole).select("customer_id") for c in choose]

    def of_customers(rows: DataFrame) -> DataFrame:
        for customers in kept:
            rows = rows.join(customers, "customer_id", "left_semi")
        return rows

    keys = of_customers(every)
    if months is not None:
        keys = keys.filter(F.col("n_rows_in") > 0 if by_payment else in_range("rental_date"))
    keys = keys.select(*RENTAL_COLS, F.col("paid_in").alias("paid"), F.col("n_rows_in").alias("n_rows"), F.col("n_amt_in").alias("n_amt"))
    # The comparison holds for every key; Spark makes Bloom filters of filtered tables only.
    keys = stored(keys, "rental-keys").filter(F.col("n_rows") >= 0)
    ids = keys.select("rental_id")
    payment, item = data.payment, data.rental_item
    if by_payment:
        payment, item = payment.filter(in_range("payment_date")), item.filter(F.col("has_payment") & in_range("payment_date"))
    tables = dict(rental=keys.select(*RENTAL_COLS), rental_paid=keys.filter("n_rows > 0"),
                  payment=payment.join(ids, "rental_id", "left_semi"), rental_item=item.join(ids, "rental_id", "left_semi"))
    if kept:
        tables |= dict(customer=of_customers(data.customer), customer_geo=of_customers(data.customer_geo))
    return data.with_tables(**tables)


def restrict_months(data: RentalData, start: str, end: str, axis: str = "payment") -> RentalData:
    """Keep what falls in the months ``start``..``end`` of one axis.

    axis 'payment': payments made then, the items they pay for, and the
    rentals that have one. axis 'rental': rentals rented then, with all their
    payments and items. The bounds are timestamp literals, so the comparison
    reaches the scan (or prunes the folders of month-partitioned facts).
    """
    return _decided(data, (start, end), axis, ())


def restrict_customers(data: RentalData, keep: DataFrame) -> RentalData:
    """Keep the customers of ``keep`` (customer_id, one row each) and their rentals.

    Customers meet the rentals, one row each; payments and items are then cut
    by rental, so no fact is shuffled by customer and a customer with a large
    share of the facts doesn't gather them in one task.
    """
    return _decided(data, None, "payment", [lambda _: keep])


def with_filters(data: RentalData, months: tuple[str, str] | None = None,
                 segments: Sequence[str] | None = None, thresholds: RfmThresholds = RfmThresholds(),
                 tiers: Sequence[str] | None = None, cuts: Sequence[float] = (100.0, 150.0),
                 labels: Sequence[str] | None = None, top_n: int | None = None,
                 axis: str = "payment") -> RentalData:
    """Apply the dashboard's global filters: RFM ``segments``, spending ``tiers``
    (as ``customers.spending_tiers`` names them) and the ``top_n`` largest
    spenders are decided on all data, then the month range is applied."""
    choose: list[Callable[[RentalData], DataFrame]] = []
    if segments:
        choose.append(lambda whole: segment_customers(whole, segments, thresholds))
    if tiers:
        choose.append(lambda whole: customer_rollup(paid_rentals(whole)).filter(
            tier_of(F.round("paid", 2), cuts, labels).isin(list(tiers))))
    if top_n is not None:
        choose.append(lambda whole: top_n_customers(whole, top_n))
    return _decided(data, months, axis, choose) if choose or months else data
