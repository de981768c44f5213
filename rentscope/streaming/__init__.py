"""Structured Streaming jobs."""

from rentscope.streaming.monthly import (
    monthly_revenue_updates, payment_stream, read_monthly_revenue, start_monthly_revenue,
)

__all__ = ["monthly_revenue_updates", "payment_stream", "read_monthly_revenue", "start_monthly_revenue"]
