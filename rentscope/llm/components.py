"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentscope.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) of every node of ``edges`` (x, y).

    Alternating stars: each node's larger neighbours move to its smallest one,
    then its smaller neighbours do. The edges end as one star a component after
    a number of rounds logarithmic in its size; each round is a written table.
    Hubs are met by partial minima and by joins that Spark can split.
    """
    edges = written(edges.where("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
        large = both.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        large = written(large, "edges")
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        moved = large.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y")
        edges = written(moved.unionByName(least.select("x", F.col("m").alias("y"))).distinct(), "edges")
        last, state = state, _state(edges)
        if state == last:
            break
    roots = edges.select(F.col("y").alias("node"), F.col("y").alias("label")).distinct()
    return written(edges.select(F.col("x").alias("node"), F.col("y").alias("label")).unionByName(roots), "labels")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y"))).first())
