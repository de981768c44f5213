"""RFM segment rule."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Segment names in rule order.
SEGMENTS = ("Champions", "Loyal", "At Risk", "Lost")


@dataclass(frozen=True)
class RfmThresholds:
    """Limits of the segment rule (defaults are the reference's fixed values).

    Champions: recency <= champions_recency and frequency >= champions_frequency
               and monetary >= champions_monetary
    Loyal:     recency <= loyal_recency and (frequency >= loyal_frequency
               or monetary >= loyal_monetary)
    At Risk:   at_risk_from <= recency <= at_risk_to
    Lost:      everything else (including recent but small customers)
    """

    champions_recency: int = 30
    champions_frequency: int = 30
    champions_monetary: float = 150
    loyal_recency: int = 60
    loyal_frequency: int = 20
    loyal_monetary: float = 100
    at_risk_from: int = 61
    at_risk_to: int = 120


# Limits scaled to the driver tables (order totals are in the millions and a
# customer has at most ~25 orders), so that every segment is populated.
TUNED_THRESHOLDS = RfmThresholds(
    champions_recency=30, champions_frequency=12, champions_monetary=2_000_000,
    loyal_recency=60, loyal_frequency=10, loyal_monetary=1_800_000,
    at_risk_from=61, at_risk_to=120,
)


def segment_expr(recency, frequency, monetary, t: RfmThresholds = RfmThresholds()) -> Column:
    r = F.col(recency) if isinstance(recency, str) else recency
    f = F.col(frequency) if isinstance(frequency, str) else frequency
    m = F.col(monetary) if isinstance(monetary, str) else monetary
    return (
        F.when((r <= t.champions_recency) & (f >= t.champions_frequency) & (m >= t.champions_monetary), SEGMENTS[0])
        .when((r <= t.loyal_recency) & ((f >= t.loyal_frequency) | (m >= t.loyal_monetary)), SEGMENTS[1])
        .when(r.between(t.at_risk_from, t.at_risk_to), SEGMENTS[2])
        .otherwise(SEGMENTS[3])
    )
