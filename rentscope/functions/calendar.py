"""Month keys, labels and day arithmetic on TIMESTAMP_NTZ columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def month_key(col) -> Column:
    """'yyyy-MM' of the month the timestamp falls in."""
    return F.date_format(_c(col), "yyyy-MM")


def month_label(col) -> Column:
    """'Mon yyyy' (English month abbreviation), e.g. 'Mar 1997'."""
    return F.date_format(_c(col), "MMM yyyy")


def month_start(col) -> Column:
    """First day of the month as DATE (a zone-free month sort key)."""
    return F.trunc(_c(col).cast("date"), "MM")


def as_date(col) -> Column:
    return _c(col).cast("date")


def duration_micros(end, start) -> Column:
    """end - start in microseconds (the interval's epoch, exactly)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def days_between(end_date, start_date) -> Column:
    """Whole days between two dates (date - date)."""
    return F.datediff(_c(end_date), _c(start_date))
