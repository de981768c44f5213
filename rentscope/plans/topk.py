"""Exact top-k per group that survives one group holding most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], k: int,
                    salt_cols: Sequence[str], salt_buckets: int = 32, rank_col: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows of every group under ``order`` (a total order).

    A first phase ranks rows inside (group, hash(salt_cols) % salt_buckets),
    which spreads a hot group over ``salt_buckets`` tasks and leaves at most
    ``k`` of a bucket; the second ranks at most ``k * salt_buckets`` rows of a
    group. For small ``k`` Spark also drops rows before either shuffle.
    """
    group_cols = list(group_cols)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(salt_buckets))
    within = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    first = df.withColumn("_salt", salt).withColumn(rank_col, F.row_number().over(within))
    first = first.filter(F.col(rank_col) <= k).drop("_salt", rank_col)
    final = Window.partitionBy(*group_cols).orderBy(*order)
    return first.withColumn(rank_col, F.row_number().over(final)).filter(F.col(rank_col) <= k)
