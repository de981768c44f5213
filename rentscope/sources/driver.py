"""Adapter from the TPC-H-like driver tables to ``RentalData``.

Mapping (fixed; the oracle SQL in ``rentscope.oracle`` spells out the same):

* customer: c_custkey -> customer_id, c_name -> name,
  email = lower(c_name) || '@example.com', active = (c_acctbal >= 0)
* customer_geo: customer joined to nation, n_name -> country
* rental: orders; o_orderkey -> rental_id, o_custkey -> customer_id,
  o_orderdate -> rental_date; return_date = latest l_shipdate of the order,
  NULL when the order has no line or that date is before the order date
* payment: one per lineitem; amount = l_extendedprice as decimal(12,2),
  payment_date = l_shipdate, customer from the order (left join on the
  order key, removed by the optimizer when no customer is read)
* rental_item: the same lineitem row; l_partkey -> film_id,
  l_suppkey -> store_id, with its amount and date
* film / film_genre / film_dim: part; p_name -> title, p_type -> genre
* rental_line: lineitem joined to its rental (order and latest ship date)
* payer: lineitem joined to its order, where a payment's customer is needed
* rental_paid: orders joined to one aggregate of their lines (return date
  and payment totals from the same scan)

Every reader selects only the columns it maps, so scans are pruned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentscope.model import TOTALS, LazyRentalData, RentalData, payment_totals
from rentscope.session import fit_shuffles

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

# Declared schemas: reading with them skips schema inference (a file-footer
# job per read, which on thousands of files is a noticeable fixed cost).
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                 "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                 "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
}

# The type of an amount, as in the original schema; sums are decimal(22,2).
MONEY = "decimal(12,2)"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class _Reader:
    """Reads every driver table at most once per ``load``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.cache = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self.cache:
            self.cache[name] = read_table(self.spark, self.sf_dir, name)
        return self.cache[name]


def _customer(read):
    c = read("customer")
    return c.select(
        F.col("c_custkey").cast("long").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.when(F.col("c_acctbal") >= 0, 1).otherwise(0).cast("int").alias("active"),
    )


def _customer_dim(read):
    """Customers with their country from one customer scan."""
    c = read("customer")
    n = read("nation").select("n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").cast("long").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.when(F.col("c_acctbal") >= 0, 1).otherwise(0).cast("int").alias("active"),
        F.col("n_name").alias("country"),
    )


def _customer_geo(read):
    c = read("customer").select("c_custkey", "c_nationkey")
    # No hint: the planner broadcasts nation only because its size estimate
    # is under spark.sql.autoBroadcastJoinThreshold (AQE re-checks at runtime).
    n = read("nation").select("n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.col("c_custkey").cast("long").alias("customer_id"),
        F.col("n_name").alias("country"),
    )


def _order_lines(read):
    """One row per order key: latest ship date and the payment totals of its
    lines (partial aggregation before the shuffle). Rentals take the return
    date from it and paid rentals the totals, so operators that need both
    scan and shuffle lineitem once."""
    amount = F.col("l_extendedprice").cast(MONEY)
    return read("lineitem").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("last_ship"),
        F.sum(amount).alias("paid"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count(amount).alias("n_amt"),
    )


def _rental_cols():
    return [
        F.col("o_orderkey").cast("long").alias("rental_id"),
        F.col("o_custkey").cast("long").alias("customer_id"),
        F.col("o_orderdate").alias("rental_date"),
        F.when(F.col("last_ship") >= F.col("o_orderdate"), F.col("last_ship")).alias("return_date"),
    ]


def _rental(read):
    o = read("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = _order_lines(read)
    # Left join to a key-unique aggregate: removed when return_date is unused.
    return o.join(lines, o.o_orderkey == lines.l_orderkey, "left").select(*_rental_cols())


def _rental_paid(read):
    o = read("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = _order_lines(read)
    return o.join(lines, o.o_orderkey == lines.l_orderkey).select(
        *_rental_cols(), "paid", F.col("n_rows").cast("long"), F.col("n_amt").cast("long"))


def _payments_within(read, within):
    """``RentalData.payments_within`` from one scan of the lines: return date and payment totals together."""
    o = read("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = read("lineitem").groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("last_ship"), *payment_totals(F.col("l_extendedprice").cast(MONEY), within("l_shipdate")))
    rows = o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
    return rows.select(*_rental_cols(), *TOTALS).fillna(0, [n for n in TOTALS if n.startswith("n_")])


def _orders_by_key(read):
    """One row per order key (the orders primary key). A left join to it is
    provably 1:1, so Catalyst removes the join when no order column is used
    (revenue by payment month then scans lineitem alone)."""
    o = read("orders")
    return o.groupBy("o_orderkey").agg(F.max("o_custkey").alias("o_custkey"))


def _payer(read):
    """Payments with the customer who pays, for reports that need both: lines meet their order, neither is reduced first."""
    o = read("orders").select("o_orderkey", "o_custkey")
    li = read("lineitem").select("l_orderkey", "l_extendedprice", "l_shipdate")
    return li.join(o, li.l_orderkey == o.o_orderkey, "left").select(
        F.col("o_custkey").cast("long").alias("customer_id"),
        F.col("l_extendedprice").cast(MONEY).alias("amount"),
        F.col("l_shipdate").alias("payment_date"),
    )


def _payment(read):
    li = read("lineitem").select("l_orderkey", "l_extendedprice", "l_shipdate")
    o = _orders_by_key(read)
    return li.join(o, li.l_orderkey == o.o_orderkey, "left").select(
        F.col("l_orderkey").cast("long").alias("rental_id"),
        F.col("o_custkey").cast("long").alias("customer_id"),
        F.col("l_extendedprice").cast(MONEY).alias("amount"),
        F.col("l_shipdate").alias("payment_date"),
    )


def _rental_item(read):
    li = read("lineitem")
    return li.select(
        F.col("l_orderkey").cast("long").alias("rental_id"),
        F.col("l_partkey").cast("long").alias("film_id"),
        F.col("l_suppkey").cast("long").alias("store_id"),
        F.col("l_extendedprice").cast(MONEY).alias("amount"),
        F.col("l_shipdate").alias("payment_date"),
        F.lit(True).alias("has_payment"),
    )


def _film(read):
    p = read("part")
    return p.select(F.col("p_partkey").cast("long").alias("film_id"), F.col("p_name").alias("title"))


def _film_genre(read):
    p = read("part")
    return p.select(F.col("p_partkey").cast("long").alias("film_id"), F.col("p_type").alias("genre"))


def _film_dim(read):
    p = read("part")
    return p.select(F.col("p_partkey").cast("long").alias("film_id"),
                    F.col("p_name").alias("title"), F.col("p_type").alias("genre"))


def _rental_line(read):
    """Lines meet their rental in a shuffle of their own, which is split at run
    time where one order has very many lines: the latest ship date comes from a
    partial aggregate of two columns, not from a window over the order's lines.
    Without a use of the return date that aggregate and its scan are dropped."""
    o = read("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = read("lineitem")
    last = li.groupBy(F.bitwise_not("l_orderkey").alias("last_key")).agg(F.max("l_shipdate").alias("last_ship"))
    # Spark splits a hot key of a join only if both sides come straight from a
    # shuffle by it. Orders meet their dates by the complement of the key, so
    # that what comes of it isn't taken for dealt by the key already.
    rental = o.join(last, F.bitwise_not("o_orderkey") == F.col("last_key"), "left").drop("last_key")
    lines = li.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice")
    return lines.join(rental, lines.l_orderkey == rental.o_orderkey).select(
        *_rental_cols(),
        F.col("l_partkey").cast("long").alias("film_id"),
        F.col("l_suppkey").cast("long").alias("store_id"),
        F.col("l_extendedprice").cast(MONEY).alias("amount"),
        F.lit(True).alias("has_payment"),
    )


def _of_customer(read, customer_id: int):
    """A reader of the rows that belong to one customer: orders are filtered
    where they are read and lines are semi-joined to them before anything else."""

    def only(name: str) -> DataFrame:
        if name == "customer":
            return read(name).filter(F.col("c_custkey") == F.lit(customer_id))
        if name == "orders":
            return read(name).filter(F.col("o_custkey") == F.lit(customer_id))
        if name == "lineitem":
            own = only("orders").select("o_orderkey")
            return read(name).join(own, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
        return read(name)

    return only


def load(spark: SparkSession, sf_dir: str) -> RentalData:
    """``RentalData`` over the driver parquet in ``sf_dir``; each table is
    built on first use (and every parquet file is read at most once). Shuffles
    are fitted to the number of lines, which Spark takes from the footers."""
    read = _Reader(spark, sf_dir)
    fit_shuffles(spark, read("lineitem").count())
    return load_with(read)


def load_with(read) -> RentalData:
    """``RentalData`` from any reader ``name -> DataFrame`` of the driver
    tables (parquet files, or catalog tables such as the bucketed layout of
    ``rentscope.sources.layout``)."""
    builders = {
        "customer": _customer, "customer_geo": _customer_geo, "rental": _rental,
        "payment": _payment, "rental_item": _rental_item, "film": _film,
        "film_genre": _film_genre, "rental_paid": _rental_paid, "customer_dim": _customer_dim,
        "film_dim": _film_dim, "rental_line": _rental_line, "payer": _payer,
    }
    return LazyRentalData({name: (lambda fn=fn: fn(read)) for name, fn in builders.items()},
                          lambda customer_id: load_with(_of_customer(read, customer_id)),
                          lambda within: _payments_within(read, within))
