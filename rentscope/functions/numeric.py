"""Exact money arithmetic.

Sums stay DECIMAL; averages are ratios of exact sums and counts rounded
half away from zero (numeric rounding), then exposed as DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rentscope.functions.calendar import MICROS_PER_DAY


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ratio(num, den, num_type: str = "decimal(28,2)") -> Column:
    """num / den as DECIMAL with at least 10 fractional digits; NULL when
    den is 0 or NULL (instead of an ANSI division error)."""
    return F.try_divide(_c(num).cast(num_type), _c(den).cast("decimal(38,0)"))


def round_ratio(num, den, digits: int, num_type: str = "decimal(28,2)") -> Column:
    return F.round(ratio(num, den, num_type), digits)


def money(col, digits: int = 2) -> Column:
    """Round a DECIMAL half away from zero and expose it as DOUBLE."""
    return F.round(_c(col), digits).cast("double")


def row_micros(n_rows) -> Column:
    """Microseconds of ``n_rows`` days as DECIMAL, which holds any number of rows."""
    return _c(n_rows).cast("decimal(20,0)") * F.lit(MICROS_PER_DAY).cast("decimal(11,0)")
