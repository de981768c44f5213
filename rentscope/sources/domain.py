"""Adapter from the original rental schema (eleven tables) to ``RentalData``.

Input tables and columns (Spark types in brackets):

  customer(customer_id, first_name, last_name, email, active, address_id)
  address(address_id, city_id)  city(city_id, country_id)  country(country_id, country)
  rental(rental_id, customer_id, inventory_id, rental_date, return_date)
  payment(rental_id, customer_id, amount decimal(12,2), payment_date)
  inventory(inventory_id, film_id, store_id)  store(store_id)
  film(film_id, title)  film_category(film_id, category_id)  category(category_id, name)

The tables come from parquet folders (``read_parquet_tables``), a JDBC
database (``read_jdbc_tables``) or ready DataFrames (``from_tables``).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentscope.model import RentalData

DOMAIN_TABLES = (
    "customer", "address", "city", "country", "rental", "payment",
    "inventory", "store", "film", "film_category", "category",
)


def full_name(first: str = "first_name", last: str = "last_name"):
    """``first || ' ' || last``; NULL when either part is NULL."""
    return F.concat(F.col(first), F.lit(" "), F.col(last))


def from_tables(t: Mapping[str, DataFrame]) -> RentalData:
    customer = t["customer"].select(
        F.col("customer_id").cast("long"),
        full_name().alias("name"),
        "email",
        F.col("active").cast("int"),
    )
    chain = (
        t["customer"].select("customer_id", "address_id", "first_name", "last_name", "email", "active")
        .join(t["address"].select("address_id", "city_id"), "address_id")
        .join(t["city"].select("city_id", "country_id"), "city_id")
        .join(t["country"].select("country_id", "country"), "country_id")
    )
    geo = chain.select(F.col("customer_id").cast("long"), "country")
    # Customers with their country from the same chain (one customer scan).
    customer_dim = chain.select(
        F.col("customer_id").cast("long"), full_name().alias("name"), "email",
        F.col("active").cast("int"), "country",
    )
    rental = t["rental"].select(
        F.col("rental_id").cast("long"), F.col("customer_id").cast("long"),
        "rental_date", "return_date",
    )
    payment = t["payment"].select(
        F.col("rental_id").cast("long"), F.col("customer_id").cast("long"),
        F.col("amount").cast("decimal(12,2)"), "payment_date",
    )
    # One rented item per rental; its payments are attached to it (left
    # join: an unpaid rental keeps its item with NULL amount).
    item = (
        t["rental"].select("rental_id", "inventory_id")
        .join(t["inventory"].select("inventory_id", "film_id", "store_id"), "inventory_id")
        # Only the store report needs an existing store; an item without one has none here.
        .join(t["store"].select(F.col("store_id").alias("_store")), F.col("store_id") == F.col("_store"), "left")
        .select("rental_id", "film_id", F.col("_store").alias("store_id"))
    )
    paid = t["payment"].select("rental_id", "amount", "payment_date", F.lit(True).alias("paid_flag"))
    rental_item = item.join(paid, "rental_id", "left").select(
        F.col("rental_id").cast("long"), F.col("film_id").cast("long"),
        F.col("store_id").cast("long"), F.col("amount").cast("decimal(12,2)"), "payment_date",
        F.coalesce(F.col("paid_flag"), F.lit(False)).alias("has_payment"),
    )
    film = t["film"].select(F.col("film_id").cast("long"), "title")
    film_genre = (
        t["film_category"].select("film_id", "category_id")
        .join(t["category"].select("category_id", F.col("name").alias("genre")), "category_id")
        .select(F.col("film_id").cast("long"), "genre")
    )
    return RentalData(customer, geo, rental, payment, rental_item, film, film_genre,
                      customer_dim=customer_dim)


def read_parquet_tables(spark: SparkSession, root: str) -> RentalData:
    root = root.rstrip("/")
    return from_tables({name: spark.read.parquet(f"{root}/{name}") for name in DOMAIN_TABLES})


def read_jdbc_tables(spark: SparkSession, url: str, properties: Mapping[str, str],
                     partitioning: Mapping[str, tuple[str, int, int, int]] | None = None) -> RentalData:
    """Read the eleven tables from a JDBC database.

    ``partitioning`` maps a table to (column, lower, upper, numPartitions)
    so the large facts (rental, payment) are read by many tasks in parallel.
    """
    partitioning = partitioning or {}
    tables = {}
    for name in DOMAIN_TABLES:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
        for key, value in properties.items():
            reader = reader.option(key, value)
        if name in partitioning:
            column, lower, upper, parts = partitioning[name]
            reader = (reader.option("partitionColumn", column).option("lowerBound", lower)
                      .option("upperBound", upper).option("numPartitions", parts))
        tables[name] = reader.load()
    return from_tables(tables)
