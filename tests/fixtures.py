"""Hand-made rows in the original eleven-table schema, each aimed at one
semantic rule (payment fan-out, unpaid and unreturned rentals, rounding,
bridge fan-out, NULL names, wildcard search, RFM limits, month gaps)."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from rentscope.sources import domain

D = dt.datetime


def _df(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def tables(spark):
    customer = _df(spark, [
        (1, "Ann", "Lee", "ann@x", 1, 10),
        (2, "Bob", None, "bob@x", 1, 10),          # NULL last name -> NULL full name
        (3, "Cy%", "Do_e", "cy@x", 0, 11),          # wildcard characters in the name
        (4, "Dee", "Max", "dee@x", 1, 12),
        (5, "Eve", "Nix", "eve@x", 1, 99),          # address without city chain
    ], "customer_id long, first_name string, last_name string, email string, active int, address_id long")
    address = _df(spark, [(10, 100), (11, 101), (12, 101), (99, 999)], "address_id long, city_id long")
    city = _df(spark, [(100, 1000), (101, 1001)], "city_id long, country_id long")
    country = _df(spark, [(1000, "Aland"), (1001, "Borduria")], "country_id long, country string")
    rental = _df(spark, [
        # customer 1: rental 1 paid in three parts, returned after 0.5 days
        (1, 1, 500, D(2020, 1, 10), D(2020, 1, 10, 12)),
        # rental 2: no payment at all
        (2, 1, 501, D(2020, 1, 20), D(2020, 1, 21, 12)),
        # rental 3: not returned
        (3, 2, 502, D(2020, 2, 5), None),
        # durations 11.6, 12.5 and 40 days
        (4, 3, 500, D(2020, 3, 1), D(2020, 3, 12, 14, 24)),
        (5, 3, 501, D(2020, 3, 2), D(2020, 3, 14, 12)),
        (6, 4, 502, D(2020, 4, 1), D(2020, 5, 11)),
        # same day, different hours: recency counts dates
        (7, 4, 500, D(2020, 4, 30, 1), D(2020, 5, 1)),
        (8, 5, 500, D(2020, 4, 30, 23), D(2020, 5, 2)),
    ], "rental_id long, customer_id long, inventory_id long, rental_date timestamp_ntz, return_date timestamp_ntz")
    payment = _df(spark, [
        (1, 1, Decimal("1.01"), D(2020, 1, 10)),
        (1, 1, Decimal("1.02"), D(2020, 1, 11)),
        (1, 1, Decimal("2.00"), D(2020, 2, 1)),      # paid in a later month
        (3, 2, Decimal("5.00"), D(2020, 2, 5)),
        (4, 3, Decimal("3.50"), D(2020, 3, 1)),
        (5, 3, Decimal("4.50"), D(2020, 3, 2)),
        (6, 4, Decimal("9.99"), D(2020, 4, 1)),
        (7, 4, None, D(2020, 4, 30)),                # NULL amount
        (8, 5, Decimal("7.25"), D(2020, 4, 30)),
    ], "rental_id long, customer_id long, amount decimal(12,2), payment_date timestamp_ntz")
    inventory = _df(spark, [(500, 50, 1), (501, 51, 2), (502, 52, 2)],
                    "inventory_id long, film_id long, store_id long")
    store = _df(spark, [(1,), (2,)], "store_id long")
    film = _df(spark, [(50, "Alpha"), (51, "Beta"), (52, "Gamma")], "film_id long, title string")
    film_category = _df(spark, [(50, 1), (50, 2), (51, 2), (52, 3)], "film_id long, category_id long")
    category = _df(spark, [(1, "Drama"), (2, "Comedy"), (3, "Horror")], "category_id long, name string")
    return dict(customer=customer, address=address, city=city, country=country, rental=rental,
                payment=payment, inventory=inventory, store=store, film=film,
                film_category=film_category, category=category)


def data(spark):
    return domain.from_tables(tables(spark))
