"""Search through trigrams against the scan."""

import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from rentscope.operators import search
from rentscope.operators.customers import customer_search
from rentscope.plans import cut_lineage
from rentscope.sources import driver
from tests.conftest import SF01

NAMES = ["Anna Bell", "ANNABEL", "annab", "an", "", None, "Zoë Čapek", "Straße 9", "100% sure_thing", "back\\slash", "İstanbul", "x" * 300, "aaa", "aaaa", "anna bell"]


@pytest.fixture(scope="module")
def named(spark):
    """Customers with odd names among common ones, and their index."""
    rnd = random.Random(2)
    names = NAMES + [f"{rnd.choice(['Maria', 'Mario', 'Mara'])} {rnd.choice(['Silva', 'Sosa', 'Saab'])} {k}" for k in range(300)]
    data = driver.load(spark, SF01)
    numbered = spark.createDataFrame([(k + 1, n) for k, n in enumerate(names)], "customer_id long, new string")
    customer = data.customer.join(numbered, "customer_id").withColumn("name", F.col("new")).drop("new")
    data = data.with_tables(customer=cut_lineage(customer))
    path = tempfile.mkdtemp(prefix="rentscope-names-") + "/index"
    search.write_name_index(data, path)
    return data, search.read_name_index(spark, path)


PATTERNS = ["ann", "ANNAB", "bell", "a b", "aaa", "aaaa", "aaaaa", "zoë", "ČAP", "raße", "ure", "sure_", "100%", "k\\s", "an", "x", "İst", "maria s", "ia Sosa 1", "saab 29", "qqq", "mar", "Mari", "x" * 200]


@pytest.mark.parametrize("q", PATTERNS)
def test_equal_to_the_scan(named, q):
    data, index = named
    assert search.indexed_search(data, index, q, 1000).collect() == customer_search(data, q, 1000).collect()


def test_every_part_of_some_names(named):
    data, index = named
    for name in ("Zoë Čapek", "Maria Sosa", "annabel"):
        for k in range(0, len(name) - 3, 2):
            q = name[k : k + 4]
            assert search.indexed_search(data, index, q, 50).collect() == customer_search(data, q, 50).collect()


def test_what_is_looked_up(named):
    _, index = named
    assert search._looked_up(index, "an") is None and search._looked_up(index, "a%nna") is None
    assert search._looked_up(index, "maria") is None  # a third of all names
    (gram,) = search._looked_up(index, "qqq sosa")  # one that nobody has is enough
    assert index.grams.filter(F.col("gram") == gram).count() == 0
    assert len(search._looked_up(index, "anna bell street")) <= search.LOOKED_UP


def test_lookups_prune_folders(named):
    data, index = named
    plan = search.indexed_search(data, index, "annab")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*folder#", plan) and re.search(r"PushedFilters: \[[^\]]*gram", plan), plan
    one = index.postings.filter((F.col("folder") == search._folder("nab")) & (F.col("gram") == "nab"))
    files = one.select("_metadata.file_path").distinct().count()
    assert 0 < files < index.postings.select("_metadata.file_path").distinct().count()


def test_grams_of_a_name_are_its_substrings(named):
    data, index = named
    own = {}
    for r in data.customer.select("customer_id", F.lower("name").alias("n")).collect():
        if r["n"] is not None:
            for k in range(len(r["n"]) - 2):
                own.setdefault(r["n"][k : k + 3], set()).add(r["customer_id"])
    got = {}
    for r in index.postings.collect():
        assert r["folder"] == search._folder(r["gram"])
        got.setdefault(r["gram"], []).append(r["customer_id"])
    assert {g: sorted(ids) for g, ids in own.items()} == {g: sorted(ids) for g, ids in got.items()}
    assert {r["gram"]: r["customers"] for r in index.grams.collect()} == {g: len(ids) for g, ids in own.items()}


def test_empty_pattern_and_empty_table(spark, named):
    data, index = named
    with pytest.raises(ValueError):
        search.indexed_search(data, index, "")
    none = data.with_tables(customer=data.customer.filter("false"))
    path = tempfile.mkdtemp(prefix="rentscope-nobody-") + "/index"
    search.write_name_index(none, path)
    assert search.indexed_search(none, search.read_name_index(spark, path), "anna").count() == 0


def test_index_makes_the_grams_of_some_names_a_task(spark, monkeypatch):
    """One file of customers is dealt before its grams are made: no task holds them all; repeated and null ids keep theirs."""
    monkeypatch.setattr(search, "NAMES_A_TASK", 200, raising=False)
    rows = [(k % 900 if k % 7 else None, f"Name {k % 950:05d}") for k in range(1000)]
    customer = spark.createDataFrame(rows, "customer_id long, name string").coalesce(1)
    frame, made = type(customer), []
    distinct = frame.distinct
    monkeypatch.setattr(frame, "distinct", lambda df: made.append(df) or distinct(df))
    path = tempfile.mkdtemp(prefix="rentscope-names-") + "/index"
    search.write_name_index(driver.load(spark, SF01).with_tables(customer=customer), path)
    tasks = [r["count"] for r in made[0].groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) < sum(tasks) / 2
    index = search.read_name_index(spark, path)
    got = [tuple(r) for r in index.postings.select("customer_id", "gram").collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, n.lower()[k : k + 3]) for i, n in rows for k in range(len(n) - 2)}
    assert index.customers == 1000
