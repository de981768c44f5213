"""The streamed monthly revenue equals the batch operator after every batch."""

import tempfile

from pyspark.sql import functions as F

from rentscope.operators import metrics
from rentscope.sources import driver
from rentscope.streaming import read_monthly_revenue, start_monthly_revenue
from tests.conftest import SF001


def _rows(df):
    return sorted(tuple(r) for r in df.select("month", "revenue", "transactions").collect())


def test_stream_matches_batch_over_two_arrivals(spark):
    root = tempfile.mkdtemp(prefix="rentscope-stream-")
    source, target, ckpt = f"{root}/in", f"{root}/out", f"{root}/ckpt"
    data = driver.load(spark, SF001)
    payments = data.payment
    early = payments.filter(F.col("payment_date") < F.lit("1998-01-01").cast("timestamp_ntz"))
    late = payments.filter(F.col("payment_date") >= F.lit("1998-01-01").cast("timestamp_ntz"))

    early.write.mode("append").parquet(source)
    start_monthly_revenue(spark, source, target, ckpt).awaitTermination()
    assert _rows(read_monthly_revenue(spark, target)) == _rows(metrics.monthly_revenue_payments(
        data.with_tables(payment=early)))

    late.write.mode("append").parquet(source)
    start_monthly_revenue(spark, source, target, ckpt).awaitTermination()
    assert _rows(read_monthly_revenue(spark, target)) == _rows(metrics.monthly_revenue_payments(data))


def test_late_payments_update_earlier_months(spark):
    root = tempfile.mkdtemp(prefix="rentscope-stream-late-")
    source, target, ckpt = f"{root}/in", f"{root}/out", f"{root}/ckpt"
    data = driver.load(spark, SF001)
    first = data.payment.filter(F.dayofmonth("payment_date") < 15)
    later = data.payment.filter(F.dayofmonth("payment_date") >= 15)   # same months, arriving late

    first.write.mode("append").parquet(source)
    start_monthly_revenue(spark, source, target, ckpt).awaitTermination()
    later.write.mode("append").parquet(source)
    start_monthly_revenue(spark, source, target, ckpt).awaitTermination()
    assert _rows(read_monthly_revenue(spark, target)) == _rows(metrics.monthly_revenue_payments(data))
