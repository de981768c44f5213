"""Column expressions shared by the operators (all built-in Spark functions)."""

from rentscope.functions.calendar import (
    as_date, days_between, duration_micros, month_key, month_label, month_start,
)
from rentscope.functions.numeric import money, ratio, round_ratio, row_micros
from rentscope.functions.segments import RfmThresholds, SEGMENTS, segment_expr, TUNED_THRESHOLDS

__all__ = [
    "as_date", "days_between", "duration_micros", "month_key", "month_label", "month_start",
    "money", "ratio", "round_ratio", "row_micros",
    "RfmThresholds", "SEGMENTS", "segment_expr", "TUNED_THRESHOLDS",
]
