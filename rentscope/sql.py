"""SQL access to the rental model: temp views plus named parameters.

    register_views(data)
    run(spark, "SELECT ... FROM rental r JOIN payment p USING (rental_id) "
               "WHERE r.customer_id = :cid", cid=42)

Parameters are bound by Spark (``spark.sql(text, args=...)``), never
formatted into the text.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from rentscope.model import RentalData


def register_views(data: RentalData, prefix: str = "") -> list[str]:
    """Register every table of ``data`` (optional ones when present) as a
    temp view named ``prefix + field``; returns the view names."""
    names = []
    for f in fields(data):
        df = getattr(data, f.name)
        if df is not None:
            df.createOrReplaceTempView(prefix + f.name)
            names.append(prefix + f.name)
    return names


def run(spark: SparkSession, text: str, **params) -> DataFrame:
    return spark.sql(text, args=params or None)
