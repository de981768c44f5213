"""Physical plans: pruning, pushdown, no cartesian products, exact top-k."""

import contextlib
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from rentscope import session
from rentscope.operators import customers, filters, metrics
from rentscope.plans import stored, top_k_per_group
from rentscope.registry import QUERIES
from rentscope.sources import driver
from tests.conftest import SF001, SF01


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("churn_")])
def test_no_cartesian_or_nested_loop(spark, name):
    p = plan(QUERIES[name](spark, SF001))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_payment_month_revenue_scans_lineitem_only(spark):
    p = plan(metrics.monthly_revenue_payments(driver.load(spark, SF001)))
    assert "orders.parquet" not in p      # the customer join is removed: no order column is used
    assert "ReadSchema: struct<l_extendedprice:double,l_shipdate:timestamp_ntz>" in p


def test_customer_lookup_pushes_filter_into_scan(spark):
    p = plan(customers.customer_kpi(driver.load(spark, SF001), 7))
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,7)" in p


def test_top_k_exact_with_one_hot_group(spark):
    rnd = random.Random(7)
    rows = [(0 if i % 3 == 0 else rnd.randint(1, 50), i, rnd.randint(0, 10_000)) for i in range(6000)]
    df = spark.createDataFrame(rows, "g long, id long, v long")
    got = top_k_per_group(df, ["g"], [F.col("v").desc(), F.col("id")], 5, salt_cols=["id"], salt_buckets=8)
    got = sorted((r["g"], r["id"], r["rank"]) for r in got.collect())
    expect = []
    for g in sorted({r[0] for r in rows}):
        grp = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))[:5]
        expect += [(g, r[1], i + 1) for i, r in enumerate(grp)]
    assert got == sorted(expect)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["customer_id", "name", "email", "last_rental", "frequency", "monetary",
                          "recency_days", "segment"]


def _children(node):
    seq = node.children()
    return [seq.apply(i) for i in range(seq.size())]


def _raw_fact_shuffles(node, key):
    """Exchanges hash-partitioning on ``key`` whose input reads a fact table
    (orders / lineitem) without being reduced first."""
    bad = []
    if node.nodeName() == "Exchange" and re.fullmatch(rf"hashpartitioning\({key}#\d+L?, \d+\)",
                                                      node.outputPartitioning().toString()):
        (child,) = _children(node)
        while child.nodeName().startswith("WholeStageCodegen") or child.nodeName() == "InputAdapter":
            (child,) = _children(child)
        reads_facts = any(t in child.treeString() for t in ("orders.parquet", "lineitem.parquet"))
        reduced = child.nodeName() in ("HashAggregate", "ObjectHashAggregate", "SortAggregate", "WindowGroupLimit")
        if reads_facts and not reduced:
            bad.append(child.nodeName())
    for c in _children(node):
        bad += _raw_fact_shuffles(c, key)
    return bad


@pytest.mark.parametrize("name", [
    "kpi_summary", "customer_summary", "customer_spend", "rfm_segments", "rfm_by_region",
    "churn_features", "customer_kpi", "customer_timeline", "customer_top_genres", "customer_history",
    "top_n_customers", "spending_tiers", "monthly_revenue", "forecast_by_country", "store_summary",
    "revenue_filtered",
])
def test_customer_shuffles_carry_reduced_rows(spark, name):
    """A customer holding a third of all rows must not be shuffled row by row:
    facts cross the network by customer only after partial aggregation (or
    a partial top-k), so a hot key is already one row per map task."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")        # inspect the static plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if every table were large
    try:
        plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan()
        assert _raw_fact_shuffles(plan, "customer_id") == []
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_customer_lookup_cuts_lines_before_it_aggregates(spark):
    """For one id, lines meet the customer's orders before any aggregate or film."""
    data = driver.load(spark, SF001)
    for df in (customers.customer_kpi(data, 7), customers.customer_top_genres(data, 7), customers.customer_history(data, 7)):
        text = plan(df)
        scan = text.index("lineitem.parquet")
        above = text[:scan].splitlines()[-12:]
        assert any("LeftSemi" in line for line in above) or "LeftSemi" in text
        assert text.count("LeftSemi") >= text.count("lineitem.parquet")


DATES_ONLY = "ReadSchema: struct<l_orderkey:bigint,l_shipdate:timestamp_ntz>"


@pytest.mark.parametrize("name", ["customer_history", "customer_history_full", "customer_top_genres", "genre_monthly", "customer_detail"])
def test_pages_scan_lines_and_films_once(spark, name):
    """One scan of the lines; histories take return dates from a partial aggregate of two columns besides."""
    text = plan(QUERIES[name](spark, SF001))
    assert text.count("lineitem.parquet") - text.count(DATES_ONLY) == 1 and text.count("part.parquet") == 1
    assert text.count(DATES_ONLY) == ("history" in name)


def test_nested_pages_come_from_one_pass(spark, monkeypatch):
    made = []
    monkeypatch.setattr(customers, "stored", lambda df, name: made.append(plan(df)) or stored(df, name))
    left = plan(customers.customer_pages(driver.load(spark, SF001)))
    (text,) = made
    assert text.count("lineitem.parquet") - text.count(DATES_ONLY) == 1 and text.count("part.parquet") == 1
    assert "lineitem.parquet" not in left and "part.parquet" not in left


def test_monthly_revenue_reads_orders_as_they_are(spark):
    """Orders meet the payments without an aggregate by their own key."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("monthly_revenue", "forecast_attention_by_country"):
            text = plan(QUERIES[name](spark, SF001))
            assert "orders.parquet" in text and "keys=[o_orderkey" not in text
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def _final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@contextlib.contextmanager
def as_if_large(spark):
    """Settings under which tables of a few thousand rows are shuffled and split like large ones."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.coalescePartitions.enabled": "false",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key in settings:
            spark.conf.unset(key)


@pytest.mark.parametrize("report", [customers.customer_history, customers.customer_history_full, customers.customer_top_genres])
def test_hot_film_is_split(spark, report):
    """A film with a third of all lines: the join with films is split at run time."""
    data = driver.load(spark, SF01)
    line = data.rental_line
    hot = line.withColumn("film_id", F.when(F.pmod(F.xxhash64("rental_id", "amount"), F.lit(3)) == 0, 1).otherwise(F.col("film_id")))
    with as_if_large(spark):
        assert "skew=true" in _final_plan(report(data.with_tables(rental_line=hot)))


def _with_hot_order(spark):
    """The driver tables, a third of all lines of order 7."""
    def read(name):
        df = driver.read_table(spark, SF01, name)
        if name != "lineitem":
            return df
        third = F.pmod(F.xxhash64("l_orderkey", "l_partkey", "l_suppkey"), F.lit(3)) == 0
        return df.withColumn("l_orderkey", F.when(third, 7).otherwise(F.col("l_orderkey"))).repartition(8)

    return driver.load_with(read)


@pytest.mark.parametrize("report", [customers.customer_history, customers.customer_history_full])
def test_hot_order_is_split(spark, report):
    """An order with a third of all lines: its lines meet the rental in several tasks, and no window gathers them."""
    with as_if_large(spark):
        text = _final_plan(report(_with_hot_order(spark)))
    order_joins = [line for line in text.splitlines() if "SortMergeJoin" in line and "l_orderkey" in line and "o_orderkey" in line]
    assert any("skew=true" in line for line in order_joins)
    assert not re.search(r"windowspecdefinition\(l_orderkey", text)


def test_hot_order_has_the_latest_date_of_all_its_lines(spark):
    data = _with_hot_order(spark)
    lines = data.rental_line.filter("rental_id = 7")
    (want,) = driver.read_table(spark, SF01, "lineitem").filter(
        "pmod(xxhash64(l_orderkey, l_partkey, l_suppkey), 3) = 0 or l_orderkey = 7").agg(F.max("l_shipdate")).first()
    got = [r["return_date"] for r in lines.select("return_date").distinct().collect()]
    assert got == [want] and lines.count() > 15_000


@pytest.mark.parametrize("name, scans", [
    ("kpi_filtered", 0), ("customer_summary_filtered", 0), ("revenue_filtered", 1), ("store_filtered", 1)])
def test_filtered_reports_scan_lines_once(spark, name, scans):
    """What is left after the keys are written: reports on paid rentals read the keys alone, others the lines once."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(QUERIES[name](spark, SF001))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert text.count("lineitem.parquet") == scans and "rental-keys" in text


def test_filter_keys_come_from_one_scan_of_the_lines(spark, monkeypatch):
    made = []
    monkeypatch.setattr(filters, "stored", lambda df, name: made.append((name, plan(df))) or stored(df, name))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        filters.with_filters(driver.load(spark, SF001), ("1997-01", "1999-12"), ["Champions", "Lost"], tiers=["tier_1", "tier_2"], top_n=50)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert [(name, text.count("lineitem.parquet")) for name, text in made] == [("rental-totals", 1), ("rental-keys", 0)]


def test_filter_keys_reach_the_scan_of_large_facts_as_a_bloom_filter(spark):
    settings = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
                "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        data = filters.with_filters(driver.load(spark, SF001), segments=["Lost"])
        for df in (data.payment, data.rental_item):
            text = df._jdf.queryExecution().optimizedPlan().toString()
            assert "might_contain" in text and "LeftSemi" in text
    finally:
        for key in settings:
            spark.conf.unset(key)


FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


@pytest.fixture
def few_rows_a_partition(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_PARTITION", 3000, raising=False)
    yield
    for key in (FIRST_PARTITIONS, "rentscope.fittedPartitions"):
        spark.conf.unset(key)


@pytest.mark.parametrize("name", ["store_summary", "customer_top_genres_varied", "customer_top_genres", "customer_top_genres_3", "customer_detail"])
def test_more_lines_give_more_tasks(spark, few_rows_a_partition, monkeypatch, name):
    """60,000 lines, 3,000 a partition: the shuffles start from 20 partitions, and the rows are those that 8 give."""
    query = QUERIES[name](spark, SF01)
    assert set(re.findall(r"hashpartitioning\([^)]*, (\d+)\)", plan(query))) == {"20"}
    got = query.collect()
    for key in (FIRST_PARTITIONS, "rentscope.fittedPartitions"):
        spark.conf.unset(key)
    monkeypatch.setattr(session, "ROWS_A_PARTITION", 10**9, raising=False)
    assert sorted(got, key=str) == sorted(QUERIES[name](spark, SF01).collect(), key=str)


def test_first_partitions_grow_and_leave_what_the_session_has(spark, few_rows_a_partition):
    assert spark.conf.get(FIRST_PARTITIONS, None) is None
    session.fit_shuffles(spark, 24_000)  # eight, as spark.sql.shuffle.partitions
    assert spark.conf.get(FIRST_PARTITIONS, None) is None
    session.fit_shuffles(spark, 30_001)
    assert spark.conf.get(FIRST_PARTITIONS) == "11"
    session.fit_shuffles(spark, 100)
    assert spark.conf.get(FIRST_PARTITIONS) == "11"
    spark.conf.set(FIRST_PARTITIONS, "9")
    session.fit_shuffles(spark, 90_000)
    assert spark.conf.get(FIRST_PARTITIONS) == "9"


UNUSED_COLUMNS = ("l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                  "o_orderstatus", "o_totalprice", "o_orderpriority", "c_mktsegment",
                  "p_brand", "p_size", "p_retailprice", "s_name", "s_acctbal", "n_regionkey")


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith("churn_")])
def test_scans_read_only_mapped_columns(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")   # full ReadSchema text
    try:
        plan = QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and len(schemas) == plan.count("FileScan parquet")
    assert not [c for s in schemas for c in UNUSED_COLUMNS if f"{c}:" in s]
