"""Bucketed layout: same results, no shuffle for the per-order work."""

import tempfile

from rentscope.operators import customers, metrics
from rentscope.sources import driver, layout
from tests.conftest import SF01


def test_bucketed_layout_removes_order_key_shuffles(spark):
    root = tempfile.mkdtemp(prefix="rentscope-layout-")
    layout.write_bucketed_layout(spark, SF01, "rentscope_bkt", root, buckets=8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # plan as if every table were large
    try:
        data = layout.load_bucketed(spark, "rentscope_bkt")
        summary = customers.customer_summary(data)
        plan = summary._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(l_orderkey" not in plan and "hashpartitioning(o_orderkey" not in plan
        plain = customers.customer_summary(driver.load(spark, SF01))
        assert sorted(summary.collect()) == sorted(plain.collect())
        assert metrics.kpi_summary(data).collect() == metrics.kpi_summary(driver.load(spark, SF01)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _scan_rows(df):
    """Rows the file scan produced (after file pruning, before the filter)."""
    df.collect()
    total, stack = 0, [df._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        if "Scan" in node.nodeName():
            total += node.metrics().apply("numOutputRows").value()
        kids = node.children()
        stack += [kids.apply(i) for i in range(kids.size())]
    return total


def test_serving_table_lookup_reads_one_bucket(spark):
    from rentscope.sources import sinks
    root = tempfile.mkdtemp(prefix="rentscope-serving-")
    data = driver.load(spark, SF01)
    table = sinks.write_serving_table(customers.customer_history(data), "rentscope_srv", "history", root,
                                      buckets=16)
    got = sinks.lookup(spark, table, 42)
    # Bucket pruning: only the file of customer 42's bucket is read.
    assert _scan_rows(got) < _scan_rows(spark.table(table)) / 8
    direct = customers.customer_history(data, 42)
    key = lambda r: (r["rental_id"], r["film_title"], r["genre"], r["paid"])
    assert sorted(got.drop("customer_id").collect(), key=key) == sorted(direct.collect(), key=key)
