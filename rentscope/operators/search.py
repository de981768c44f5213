"""Search by a part of the name through a table of trigrams.

``write_name_index`` stores which customers have which three letters in a row,
in folders by the trigram's checksum. A search reads the folders of its rarest
trigrams, intersects their customers, and checks those by the exact comparison
of ``customers.customer_search``. What has no trigram to look up is scanned.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rentscope.model import RentalData
from rentscope.operators.customers import customer_search

#: Letters of a gram; folders; grams looked up at most; share of the customers from which on a gram tells too little.
GRAM, FOLDERS, LOOKED_UP, TOO_COMMON = 3, 64, 4, 0.2

#: Names that a task takes the grams of when an index is written.
NAMES_A_TASK = 50_000


@dataclass(frozen=True)
class NameIndex:
    postings: DataFrame    # gram, customer_id, folder (partition column)
    grams: DataFrame       # gram, customers, folder (partition column)
    customers: int         # how many have a name


def _folder(gram: str) -> int:
    return zlib.crc32(gram.encode()) % FOLDERS


def write_name_index(data: RentalData, path: str) -> None:
    """Write the trigrams of every customer's lower-cased name below ``path``.

    A null name and one of fewer than three letters have none. Postings are
    written by folder, each sorted by gram, so a lookup reads the row groups of
    its gram; a common gram's postings spread over the tasks that wrote them.
    """
    names = data.customer.select("customer_id", F.lower("name").alias("name")).filter(F.col("name").isNotNull())
    starts = F.sequence(F.lit(1), F.length("name") - (GRAM - 1))
    own = F.when(F.length("name") >= GRAM, F.array_distinct(F.transform(starts, lambda k: F.substring("name", k, F.lit(GRAM)))))
    folder = F.pmod(F.crc32("gram"), F.lit(FOLDERS)).cast("int")
    # A name has many grams: however few tasks read the customers, each takes the grams of NAMES_A_TASK names or so.
    names = names.repartition(max(1, math.ceil(names.count() / NAMES_A_TASK)), "customer_id", "name")
    rows = names.select("customer_id", F.explode(own).alias("gram")).distinct().withColumn("folder", folder)
    root = path.rstrip("/")
    # Dealt by folder and customer: no folder's rows, nor a common gram's, meet in one task.
    spread = F.pmod(F.xxhash64("customer_id"), F.lit(8))
    rows.repartition("folder", spread).sortWithinPartitions("folder", "gram", "customer_id").write.partitionBy("folder").parquet(f"{root}/postings")
    written = data.customer.sparkSession.read.schema("customer_id long, gram string, folder int").parquet(f"{root}/postings")
    grams = written.groupBy("gram", "folder").agg(F.count(F.lit(1)).alias("customers"))
    grams.repartition("folder").sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(f"{root}/grams")
    names.agg(F.count(F.lit(1)).alias("customers")).write.parquet(f"{root}/customers")


def read_name_index(spark: SparkSession, path: str) -> NameIndex:
    root = path.rstrip("/")
    counted = spark.read.schema("customers long").parquet(f"{root}/customers").first()
    return NameIndex(
        spark.read.schema("customer_id long, gram string, folder int").parquet(f"{root}/postings"),
        spark.read.schema("gram string, customers long, folder int").parquet(f"{root}/grams"), counted["customers"])


def _looked_up(index: NameIndex, q: str) -> list[str] | None:
    """The rarest grams of ``q``; None where the index can't help: wildcards, too few letters, common grams only."""
    if any(c in q for c in "%_\\"):
        return None
    spark = index.grams.sparkSession
    lowered = spark.range(1).select(F.lower(F.lit(q)).alias("q")).first()["q"]
    own = sorted({lowered[k : k + GRAM] for k in range(len(lowered) - GRAM + 1)})
    if not own:
        return None
    folders = sorted({_folder(g) for g in own})
    found = index.grams.filter(F.col("folder").isin(folders) & F.col("gram").isin(own)).collect()
    if len(found) < len(own):
        return [g for g in own if g not in {r["gram"] for r in found}][:1]  # nobody has it
    rare = sorted((r["customers"], r["gram"]) for r in found)[:LOOKED_UP]
    return None if rare[0][0] > TOO_COMMON * index.customers else [g for _, g in rare]


def indexed_search(data: RentalData, index: NameIndex, q: str, limit: int = 20) -> DataFrame:
    """As ``customer_search(data, q, limit)``: the same rows, from the customers that have the rarest grams of ``q``."""
    if not q:
        raise ValueError("q must not be empty")
    grams = _looked_up(index, q)
    if grams is None:
        return customer_search(data, q, limit)
    folders = sorted({_folder(g) for g in grams})
    hits = index.postings.filter(F.col("folder").isin(folders) & F.col("gram").isin(grams))
    if len(grams) > 1:
        hits = hits.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams))
    ids = hits.select("customer_id")
    cut = data.with_tables(customer=data.customer.join(ids, "customer_id", "left_semi"),
                           customer_geo=data.customer_geo.join(ids, "customer_id", "left_semi"))
    return customer_search(cut, q, limit)
