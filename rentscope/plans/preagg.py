"""Aggregate facts to the grain of the next join before joining.

``payment -> rental`` is n:1, so joining raw payments to rentals repeats a
rental once per payment and forces COUNT(DISTINCT rental_id). Reducing
payments to one row per rental first (sum, row count, non-null count) makes
every later join 1:1 and every later count a plain count. Averages are
carried as (sum, count) pairs and divided only at the end, so a
payment-weighted average stays payment-weighted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def payments_per_rental(payment: DataFrame) -> DataFrame:
    """rental_id, paid (sum of amount), n_rows (payment rows), n_amt (non-null amounts).

    Grouped with partial (map-side) aggregation, so a rental holding a large
    share of all payments is reduced inside each map task before the shuffle.
    """
    return payment.groupBy("rental_id").agg(
        F.sum("amount").alias("paid"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count("amount").alias("n_amt"),
    )


RENTAL_COLS = ("rental_id", "customer_id", "rental_date", "return_date")


def paid_rentals(data) -> DataFrame:
    """rental_id, customer_id, rental_date, return_date, paid, n_rows, n_amt:
    one row per rental with at least one payment (rental inner join payment,
    reduced to the rental grain). Filters on rental columns applied to the
    result are pushed below the join by Catalyst."""
    if data.rental_paid is not None:
        return data.rental_paid
    return data.rental.select(*RENTAL_COLS).join(payments_per_rental(data.payment), "rental_id")


def rental_lines(data) -> DataFrame:
    """rental_id, customer_id, rental_date, return_date, film_id, store_id, amount,
    has_payment: a row for each rented item and the payment made for it."""
    if data.rental_line is not None:
        return data.rental_line
    items = data.rental_item.select("rental_id", "film_id", "store_id", "amount", "has_payment")
    return items.join(data.rental.select(*RENTAL_COLS), "rental_id")


def payers(data) -> DataFrame:
    """customer_id, amount, payment_date of every payment."""
    source = data.payment if data.payer is None else data.payer
    return source.select("customer_id", "amount", "payment_date")


def films(data) -> DataFrame:
    """film_id, title, genre: a row for each genre of a film."""
    if data.film_dim is not None:
        return data.film_dim
    return data.film.select("film_id", "title").join(data.film_genre.select("film_id", "genre"), "film_id")


def customer_rollup(paid: DataFrame, *extra) -> DataFrame:
    """Per customer: rentals, paid, n_rows, n_amt (+ extra aggregate columns)."""
    return paid.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("rentals"),
        F.sum("paid").alias("paid"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_amt").alias("n_amt"),
        *extra,
    )
