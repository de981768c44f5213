"""The analytics operators: each takes ``RentalData`` (and parameters) and
returns a DataFrame computed by Spark."""

from rentscope.operators import catalog, churn, customers, filters, forecast, metrics, rfm

__all__ = ["catalog", "churn", "customers", "filters", "forecast", "metrics", "rfm"]
