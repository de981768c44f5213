"""The canonical rental data model every operator reads.

A source adapter (``rentscope.sources``) turns stored tables into this
shape; operators never see the stored layout. Columns:

* ``customer``     customer_id long, name string, email string, active int
* ``customer_geo`` customer_id long, country string
  (the customer -> address -> city -> country chain, inner-joined)
* ``rental``       rental_id long, customer_id long, rental_date timestamp_ntz,
  return_date timestamp_ntz (NULL while not returned)
* ``payment``      rental_id long, customer_id long, amount decimal(p,2) (p <= 12),
  payment_date timestamp_ntz
* ``rental_item``  rental_id long, film_id long, store_id long,
  amount decimal(p,2) NULL, payment_date timestamp_ntz NULL, has_payment boolean
  -- one row per rented item and the payment made for it (NULLs when the
  item has no payment, has_payment false); this keeps "the item a payment pays for" on one
  row, so item and payment roles are never joined against each other.
* ``film``         film_id long, title string
* ``film_genre``   film_id long, genre string (a film may have several)
* ``rental_paid``  optional: rental_id, customer_id, rental_date, return_date,
  paid decimal, n_rows long, n_amt long -- one row per rental with at least
  one payment row and its payment totals. An adapter that can produce it
  from one aggregation supplies it; otherwise it is derived from ``rental``
  and ``payment`` (``rentscope.plans.paid_rentals``).
* ``customer_dim`` optional: customer_id, name, email, active, country --
  customers with a country (``customer`` inner-joined with ``customer_geo``),
  for adapters that can read both from one scan.
* ``film_dim``     optional: film_id, title, genre -- ``film`` inner-joined with
  ``film_genre``, for adapters that can read both from one scan.
* ``rental_line``  optional: rental_id, customer_id, rental_date, return_date,
  film_id, store_id, amount, has_payment -- ``rental_item`` inner-joined with
  ``rental``, for adapters that can build it from one scan of the lines.
* ``payer``        optional: customer_id, amount, payment_date of every payment --
  for adapters in which a payment's customer lies in another table and
  ``payment`` joins it only where it is used.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Totals of a rental's payments: of all, then of those within a filter.
TOTALS = ("paid", "n_rows", "n_amt", "paid_in", "n_rows_in", "n_amt_in")


def payment_totals(amount: Column, within: Column) -> list[Column]:
    """Aggregates named TOTALS over payment rows."""
    inside = F.when(within, amount)
    return [F.sum(amount).alias("paid"), F.count(F.lit(1)).alias("n_rows"), F.count(amount).alias("n_amt"),
            F.sum(inside).alias("paid_in"), F.count(F.when(within, 1)).alias("n_rows_in"), F.count(inside).alias("n_amt_in")]


@dataclass(frozen=True)
class RentalData:
    customer: DataFrame
    customer_geo: DataFrame
    rental: DataFrame
    payment: DataFrame
    rental_item: DataFrame
    film: DataFrame
    film_genre: DataFrame
    rental_paid: DataFrame | None = None
    customer_dim: DataFrame | None = None
    film_dim: DataFrame | None = None
    rental_line: DataFrame | None = None
    payer: DataFrame | None = None

    def for_customer(self, customer_id: int) -> "RentalData":
        """The rows of one customer; facts are cut before they are aggregated."""
        own = F.col("customer_id") == F.lit(customer_id)
        rental = self.rental.filter(own)
        ids = rental.select("rental_id")
        return self.with_tables(
            customer=self.customer.filter(own), customer_geo=self.customer_geo.filter(own), rental=rental,
            payment=self.payment.join(ids, "rental_id", "left_semi"),
            rental_item=self.rental_item.join(ids, "rental_id", "left_semi"))

    def payments_within(self, within: Callable[[str], Column]) -> DataFrame:
        """Every rental with the totals of its payments, of all and of those ``within``.

        rental_id, customer_id, rental_date, return_date, and paid, n_rows, n_amt
        (0 rows for an unpaid rental) with paid_in, n_rows_in, n_amt_in.
        ``within`` makes a condition of the name of a payment's date column. One
        pass over the payments, reduced to a row a rental before the join.
        """
        totals = self.payment.groupBy("rental_id").agg(*payment_totals(F.col("amount"), within("payment_date")))
        rental = self.rental.select("rental_id", "customer_id", "rental_date", "return_date")
        return rental.join(totals, "rental_id", "left").fillna(0, [n for n in TOTALS if n.startswith("n_")])

    def with_tables(self, **tables: DataFrame) -> "RentalData":
        """Replace tables; a precomputed ``rental_paid`` is dropped when the
        rentals or payments it summarises change."""
        return replace(self, **_invalidate(tables))


def _invalidate(tables: dict) -> dict:
    tables = dict(tables)
    if ("rental" in tables or "payment" in tables) and "rental_paid" not in tables:
        tables["rental_paid"] = None
    if ("customer" in tables or "customer_geo" in tables) and "customer_dim" not in tables:
        tables["customer_dim"] = None
    if ("rental" in tables or "rental_item" in tables) and "rental_line" not in tables:
        tables["rental_line"] = None
    if "payment" in tables and "payer" not in tables:
        tables["payer"] = None
    if ("film" in tables or "film_genre" in tables) and "film_dim" not in tables:
        tables["film_dim"] = None
    return tables


TABLE_NAMES = tuple(f.name for f in fields(RentalData))


class LazyRentalData(RentalData):
    """``RentalData`` whose tables are built on first access.

    Building a DataFrame costs driver round trips (analysis of every select
    and join); a query touching two tables then builds two, not nine.
    """

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame | None]],
                 of_customer: Callable[[int], RentalData] | None = None,
                 payments_within: Callable[[Callable[[str], Column]], DataFrame] | None = None):
        object.__setattr__(self, "_builders", dict(builders))
        object.__setattr__(self, "_of_customer", of_customer)
        object.__setattr__(self, "_payments_within", payments_within)
        object.__setattr__(self, "_built", {})

    def __getattribute__(self, name):
        if name in TABLE_NAMES:
            built = object.__getattribute__(self, "_built")
            if name not in built:
                builder = object.__getattribute__(self, "_builders").get(name)
                built[name] = builder() if builder is not None else None
            return built[name]
        return object.__getattribute__(self, name)

    def for_customer(self, customer_id: int) -> RentalData:
        """As in ``RentalData``; from the stored tables if the adapter can."""
        return self._of_customer(customer_id) if self._of_customer else super().for_customer(customer_id)

    def payments_within(self, within: Callable[[str], Column]) -> DataFrame:
        """As in ``RentalData``; from one scan if the adapter can."""
        return self._payments_within(within) if self._payments_within else super().payments_within(within)

    def with_tables(self, **tables: DataFrame) -> "RentalData":
        builders = dict(object.__getattribute__(self, "_builders"))
        built = object.__getattribute__(self, "_built")
        for name, df in _invalidate(tables).items():
            builders[name] = (lambda df=df: df)
        new = LazyRentalData(builders)
        for name, df in built.items():       # keep what is already built and unchanged
            if name not in tables and name in builders and builders[name] is self._builders.get(name):
                object.__getattribute__(new, "_built")[name] = df
        return new
