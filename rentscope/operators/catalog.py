"""Genre reports: rentals per genre, overall and by rental month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentscope.functions import month_key, month_label, month_start
from rentscope.model import RentalData
from rentscope.plans import rental_lines


def rental_genres(data: RentalData, *columns: str) -> DataFrame:
    """Distinct (rental_id, genre) pairs, with ``columns`` of the rental: the
    item -> film -> genre bridge over items of existing rentals.

    A film in two genres counts its rental in both. The film table itself is
    not joined: it only carries the title.
    """
    lines = rental_lines(data).select("rental_id", *columns, "film_id")
    return lines.join(data.film_genre.select("film_id", "genre"), "film_id").select("rental_id", *columns, "genre").distinct()


def genre_counts(data: RentalData) -> DataFrame:
    """genre, rental_count (distinct rentals), most rented first."""
    return (
        rental_genres(data).groupBy("genre")
        .agg(F.count(F.lit(1)).cast("long").alias("rental_count"))
        .orderBy(F.col("rental_count").desc(), F.col("genre").asc_nulls_last())
    )


def genre_monthly(data: RentalData) -> DataFrame:
    """month, label, genre, rental_count by rental month."""
    pairs = rental_genres(data, "rental_date")
    return (
        pairs.groupBy(month_start("rental_date").alias("m"), "genre")
        .agg(F.count(F.lit(1)).cast("long").alias("rental_count"))
        .select(month_key("m").alias("month"), month_label("m").alias("label"), "genre", "rental_count")
        .orderBy(F.col("month").asc_nulls_last(), F.col("rental_count").desc(), F.col("genre").asc_nulls_last())
    )
