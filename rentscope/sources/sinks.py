"""Result sinks.

The reference returned JSON records; here every result is a DataFrame and
is written by Spark tasks, never gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, one record per row (the reference's response rows)."""
    df.write.mode(mode).json(path)


def write_facts_by_month(df: DataFrame, path: str, date_col: str, mode: str = "overwrite") -> None:
    """Store a fact table partitioned by calendar month of ``date_col``.

    Month filters (``rentscope.operators.filters``) then prune whole
    folders instead of scanning every file.
    """
    from pyspark.sql import functions as F

    (df.withColumn("month", F.date_format(F.col(date_col), "yyyy-MM"))
       .write.mode(mode).partitionBy("month").parquet(path))


def write_serving_table(df: DataFrame, database: str, name: str, root: str,
                        key: str = "customer_id", buckets: int = 64) -> str:
    """Store an all-customer result (a batch form of a customer page) as a
    catalog table bucketed and sorted by ``key`` under ``root`` (a shared
    folder). A lookup ``key = value`` on it reads one bucket (bucket pruning)
    instead of scanning and joining the facts."""
    root = root.rstrip("/")
    df.sparkSession.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{root}/_{database}.db'")
    table = f"{database}.{name}"
    (df.write.mode("overwrite").format("parquet").option("path", f"{root}/{name}")
       .bucketBy(buckets, key).sortBy(key).saveAsTable(table))
    return table


def lookup(spark, table: str, value, key: str = "customer_id") -> DataFrame:
    """Rows of a serving table for one key value."""
    from pyspark.sql import functions as F

    return spark.table(table).filter(F.col(key) == F.lit(value))
