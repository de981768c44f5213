"""Monthly revenue forecasts fitted per series.

Payments become monthly revenue per series by a Spark aggregation, and the
features are window columns partitioned by series. A series is then a row with
arrays of at most some hundred months; one pandas UDF solves the least squares
of each row. Everything after the solution is columns again: fitted values, R2,
the recursion (a fold over the steps), rounding, labels and status.

Two models, each a list of features of the last three values:

* linear: month number, the last two values and the mean of three, by ordinary
  least squares (smallest solution if rank-deficient). ``mode='reference'``
  takes the mean over the month itself and the two before, so it holds the
  target; ``mode='lagged'`` takes the three months before.
* attention: z-scores weighted by a fixed softmax over the three positions, and
  their mean, population deviation and change, by ridge regression with a free
  intercept; forecasts are scaled back and at least 0.

Months are in calendar order with a missing month (NULL) last.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F, types as T

from rentscope.functions import money, month_key, month_start
from rentscope.model import RentalData
from rentscope.plans import paid_rentals, payers

# The solver runs in executor Python workers; shipped by value, it needs numpy
# and pandas there but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Positional attention scores of the 3-month window (oldest first).
POSITION_SCORES = (0.2, 0.3, 0.5)
WINDOW = 3
# Least R2 of the labels, best first, and the label below.
LABELS = ((0.9, "Excellent"), (0.7, "Good"))
LAST_LABEL = "Fair"


# -- series ---------------------------------------------------------------

def revenue_series(data: RentalData, axis: str = "payment", by: str | None = None,
                   drop_incomplete_last: bool = False) -> DataFrame:
    """series_key, month ('yyyy-MM'), revenue (rounded to cents) per series.

    axis 'payment': payments by payment month; 'rental': paid rentals by
    rental month. ``by`` = None (one global series, key 'all'), 'country' or 'customer'.
    ``drop_incomplete_last`` leaves out the data's last month unless the data
    reaches that month's last day (the original treats a partial last month
    as a full one).
    """
    if axis == "payment":
        src, date_col = data.payment, "payment_date"
        facts = (src if by is None else payers(data)).select(*["customer_id"] * (by is not None), month_start(date_col).alias("month"), F.col("amount").alias("amt"))
    elif axis == "rental":
        src, date_col = data.rental, "rental_date"
        facts = paid_rentals(data).select(
            "customer_id", month_start(date_col).alias("month"), F.col("paid").alias("amt"))
    else:
        raise ValueError(f"unknown axis {axis!r}")
    if drop_incomplete_last:
        latest = src.select(F.max(F.col(date_col).cast("date"))).scalar()
        complete = (F.col("month") < F.trunc(latest, "MM")) | (F.last_day(latest) == latest)
        facts = facts.filter(complete)
    if by is None:
        keyed = facts.withColumn("series_key", F.lit("all"))
    elif by == "customer":
        keyed = facts.withColumn("series_key", F.col("customer_id").cast("string"))
    elif by == "country":
        # Reduce to (customer, month) before meeting the customer table.
        per_cm = facts.groupBy("customer_id", "month").agg(F.sum("amt").alias("amt"))
        keyed = per_cm.join(data.customer_geo, "customer_id").withColumnRenamed("country", "series_key")
    else:
        raise ValueError(f"unknown series dimension {by!r}")
    return (
        keyed.groupBy("series_key", "month").agg(F.sum("amt").alias("rev"))
        .select("series_key", month_key("month").alias("month"), money("rev").alias("revenue"))
    )


# -- features -------------------------------------------------------------

LINEAR_FEATURES = ("month_idx", "lag_1", "lag_2", "rolling_avg_3")
ATTENTION_FEATURES = ("att_1", "att_2", "att_3", "win_mean", "win_std", "win_trend")


def _in_order() -> Window:
    return Window.partitionBy("series_key").orderBy(F.col("month").asc_nulls_last())


def linear_features(series: DataFrame, mode: str = "reference") -> DataFrame:
    """series_key, month, revenue with month_idx (from 0), lag_1, lag_2 and
    rolling_avg_3 (NULL until three values are in its frame)."""
    ends = {"reference": 0, "lagged": -1}
    if mode not in ends:
        raise ValueError(f"unknown mode {mode!r}")
    months = _in_order()
    three = months.rowsBetween(ends[mode] - 2, ends[mode])
    return series.select(
        "series_key", "month", "revenue",
        (F.row_number().over(months) - 1).alias("month_idx"),
        F.lag("revenue", 1).over(months).alias("lag_1"),
        F.lag("revenue", 2).over(months).alias("lag_2"),
        F.when(F.count("revenue").over(three) == 3, F.avg("revenue").over(three)).alias("rolling_avg_3"),
    )


def attention_weights() -> list[float]:
    """The fixed softmax over the window's positions, oldest first."""
    total = math.fsum(math.exp(s) for s in POSITION_SCORES)
    return [math.exp(s) / total for s in POSITION_SCORES]


def _attention_vector(oldest: Column, middle: Column, newest: Column) -> list[Column]:
    """The six attention features of three values."""
    values = (oldest, middle, newest)
    mean = (oldest + middle + newest) / WINDOW
    spread = F.sqrt(sum((v - mean) * (v - mean) for v in values) / WINDOW)
    return [v * w for v, w in zip(values, attention_weights())] + [mean, spread, newest - oldest]


def attention_features(series: DataFrame) -> DataFrame:
    """series_key, month, revenue, month_idx, the scaling constants (deviation 0
    counts as 1), z and, from the fourth month on, the six features of the
    three z before it."""
    months, whole = _in_order(), Window.partitionBy("series_key")
    spread = F.stddev_pop("revenue").over(whole)
    scaled = series.select(
        "series_key", "month", "revenue", (F.row_number().over(months) - 1).alias("month_idx"),
        F.avg("revenue").over(whole).alias("mean"),
        F.when(spread > 0, spread).otherwise(1.0).alias("scale"),
    ).withColumn("z", (F.col("revenue") - F.col("mean")) / F.col("scale"))
    lagged = scaled.select("*", *[F.lag("z", WINDOW - k).over(months).alias(f"z{k}") for k in range(WINDOW)])
    vector = _attention_vector(*[F.col(f"z{k}") for k in range(WINDOW)])
    return lagged.select(*scaled.columns, *[F.when(F.col("z0").isNotNull(), c).alias(name) for c, name in zip(vector, ATTENTION_FEATURES)])


# -- fit ------------------------------------------------------------------

@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(x: pd.Series, y: pd.Series, penalty: pd.Series) -> pd.Series:
    """Intercept and coefficients of each row's system; NULL without equations.

    The penalty enters as one more equation for each coefficient, so ridge and
    ordinary least squares are the same centred problem.
    """

    def one(rows, target, alpha):
        if rows is None or not len(rows):
            return None
        a, b = np.array([list(r) for r in rows], float), np.array(target, float)
        middle, level = a.mean(axis=0), b.mean()
        extra = math.sqrt(alpha) * np.eye(a.shape[1])[: a.shape[1] if alpha else 0]
        found = np.linalg.lstsq(np.vstack([a - middle, extra]), np.append(b - level, np.zeros(len(extra))), rcond=None)[0]
        return [level - middle @ found, *found]

    return pd.Series([one(*row) for row in zip(x, y, penalty)])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def _predict(x: Column, solution: Column) -> Column:
    """Intercept plus the products of features and coefficients."""
    terms = F.zip_with(x, F.slice(solution, 2, F.size(solution) - 1), lambda v, c: v * c)
    return F.aggregate(terms, solution[0], lambda a, v: a + v)


def _fitted(features: DataFrame, names: tuple[str, ...], target: str, penalty: float, *constants: str) -> DataFrame:
    """A row a series: history and training rows in month order, solution,
    fitted values of the training rows and R2."""
    usable = F.lit(True)
    for name in names:
        usable &= F.col(name).isNotNull()
    row = F.struct(F.col("month_idx").alias("i"), "month", F.col("revenue").cast("double").alias("revenue"),
                   F.col(target).cast("double").alias("y"),
                   F.when(usable, F.array(*[F.col(n).cast("double") for n in names])).alias("x"))
    whole = features.groupBy("series_key").agg(
        F.sort_array(F.collect_list(row)).alias("history"), *[F.max(c).alias(c) for c in constants])
    whole = whole.withColumn("train", F.filter("history", lambda r: r["x"].isNotNull() & r["y"].isNotNull()))
    whole = whole.withColumn("y", F.transform("train", lambda r: r["y"]))
    whole = whole.withColumn("solution", _solve(F.transform("train", lambda r: r["x"]), F.col("y"), F.lit(penalty)))
    whole = whole.withColumn("fit", F.transform("train", lambda r: _predict(r["x"], F.col("solution"))))
    whole = whole.withColumn("level", F.try_divide(_total(F.col("y")), F.size("y")))
    missed = _total(F.zip_with("y", "fit", lambda y, f: (y - f) * (y - f)))
    spread = _total(F.transform("y", lambda y: (y - F.col("level")) * (y - F.col("level"))))
    r2 = F.when(F.size("y") < 2, None).when(spread > 0, 1 - F.try_divide(missed, spread)).when(missed == 0, 1.0).otherwise(0.0)
    return whole.withColumn("r2", r2)


def _steps(start: Column, horizon: int, features: Callable[[Column, Column], Column]) -> Column:
    """``horizon`` predictions, each from the last three values, known or predicted.

    ``features`` gives the feature array of the three values and the step.
    """
    first = F.struct(start.alias("last"), F.expr("cast(array() as array<double>)").alias("done"))

    def step(state: Column, k: Column) -> Column:
        value = F.array(_predict(features(state["last"], k), F.col("solution")))
        return F.struct(F.concat(F.slice(state["last"], 2, WINDOW - 1), value).alias("last"),
                        F.concat(state["done"], value).alias("done"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), first, step, lambda state: state["done"])


def _report(models: DataFrame, enough: Column, forecast: Column, fitted: Column | None,
            label: Column, last: Column, change: Column) -> DataFrame:
    """The rows of a report: historical, fitted and forecast values with their series' figures."""
    kind = "array<struct<kind:string,step:int,month:string,value:double>>"

    def entries(values: Column, name: str, entry) -> Column:
        return F.transform(values, lambda v, k: F.struct(F.lit(name).alias("kind"), *entry(v, k))).cast(kind)

    known = entries(F.col("history"), "historical", lambda r, k: (k, r["month"], r["revenue"]))
    ahead = entries(forecast, "forecast", lambda v, k: (k + 1, F.lit(None).cast("string"), v))
    parts = [known, *([entries(fitted, "fitted", lambda r, k: (r["i"], r["month"], r["value"]))] if fitted is not None else []), ahead]
    told = models.select(
        "series_key", F.explode(F.when(enough, F.concat(*parts)).otherwise(known)).alias("entry"),
        F.when(enough, F.round("r2", 4)).alias("r_squared"), F.when(enough, label).alias("r2_label"),
        F.when(enough, last).alias("last_month_revenue"), F.when(enough, F.round(forecast[0], 2)).alias("predicted_next_month"),
        F.when(enough, change).alias("change_percent"), F.when(enough, "ok").otherwise("too_few_rows").alias("status"))
    return told.select("series_key", "entry.kind", "entry.step", "entry.month", "entry.value", "r_squared", "r2_label",
                       "last_month_revenue", "predicted_next_month", "change_percent", "status")


def _last_values(column: str) -> Column:
    """The last three of the history's ``column``; fewer if it is shorter."""
    n = F.size("history")
    tail = F.slice("history", F.greatest(n - WINDOW + 1, F.lit(1)), WINDOW)
    return F.transform(tail, lambda r: r[column])


# -- models ---------------------------------------------------------------

def forecast_linear(series: DataFrame, horizon: int = 3, mode: str = "reference",
                    min_rows: int | None = None) -> DataFrame:
    """Every series of ``series`` (series_key, month, revenue): its months (kind
    'historical', step = month number) and ``horizon`` forecasts (kind
    'forecast', step from 1), each with r_squared, last_month_revenue,
    predicted_next_month, change_percent and status. A series of fewer than
    ``min_rows`` months, or without a complete row of features, has its months
    only, status 'too_few_rows'."""
    min_rows = min_rows if min_rows is not None else (3 if horizon <= 3 else 4)
    models = _fitted(linear_features(series, mode), LINEAR_FEATURES, "revenue", 0.0)
    enough = (F.size("history") >= min_rows) & F.col("solution").isNotNull()

    def features(last: Column, k: Column) -> Column:
        return F.array((F.size("history") + k - 1).cast("double"), F.get(last, 2), F.get(last, 1), _total(last) / WINDOW)

    models = models.withColumn("ahead", F.when(enough, _steps(_last_values("revenue"), horizon, features)))
    last = F.element_at("history", -1)["revenue"]
    change = F.round(F.try_divide(F.col("ahead")[0] - last, last) * 100, 1)
    return _report(models, enough, F.transform("ahead", lambda v: F.round(v, 2)), None,
                   F.lit(None).cast("string"), F.round(last, 2), change)


def forecast_attention(series: DataFrame, horizon: int = 3, alpha: float = 1.0, min_rows: int = 5) -> DataFrame:
    """As ``forecast_linear`` by the attention model, with rows of kind 'fitted'
    from the fourth month on and a label for R2; forecasts are 0 at least."""
    models = _fitted(attention_features(series), ATTENTION_FEATURES, "z", alpha, "mean", "scale")
    enough = (F.size("history") >= min_rows) & F.col("solution").isNotNull()

    def features(last: Column, k: Column) -> Column:
        return F.array(*_attention_vector(*[F.get(last, i) for i in range(WINDOW)]))

    def money_of(z: Column) -> Column:
        return z * F.col("scale") + F.col("mean")

    models = models.withColumn("ahead", F.when(enough, _steps(_last_values("y"), horizon, features)))
    ahead = F.transform("ahead", lambda z: F.round(F.greatest(F.lit(0.0), money_of(z)), 2))
    fitted = F.zip_with("train", "fit", lambda r, z: F.struct(r["i"].alias("i"), r["month"].alias("month"), F.round(money_of(z), 2).alias("value")))
    label = F.lit(LAST_LABEL)
    for least, name in reversed(LABELS):
        label = F.when(F.col("r2") >= least, name).otherwise(label)
    last = F.round(F.element_at("history", -1)["revenue"], 2)
    change = F.when(last == 0, 0.0).otherwise(F.round(F.try_divide(ahead[0] - last, last) * 100, 1))
    return _report(models, enough, ahead, fitted, F.when(F.col("r2").isNotNull(), label), last, change)


def series_guards(series: DataFrame, linear: int = 3, extended: int = 4, attention: int = 5) -> DataFrame:
    """series_key, months, and for each model 'ok' or 'too_few_rows': whether the
    series has the months that it needs at least."""
    months = series.groupBy("series_key").agg(F.count(F.lit(1)).alias("months"))

    def told(least: int, name: str) -> Column:
        return F.when(F.col("months") < least, "too_few_rows").otherwise("ok").alias(name)

    return months.select("series_key", "months", told(linear, "linear"), told(extended, "extended"), told(attention, "attention"))


def attention_models(series: DataFrame, alpha: float = 1.0, min_rows: int = 5) -> DataFrame:
    """series_key, months, mean, scale, intercept, coefficients, r_squared of the
    attention model of each series, to be stored with ``sources.sinks``; NULL
    figures below ``min_rows`` months."""
    models = _fitted(attention_features(series), ATTENTION_FEATURES, "z", alpha, "mean", "scale")
    enough = F.size("history") >= min_rows

    def told(value: Column, name: str) -> Column:
        return F.when(enough, value).alias(name)

    solution = F.col("solution")
    return models.select(
        "series_key", F.size("history").alias("months"), told(F.col("mean"), "mean"), told(F.col("scale"), "scale"),
        told(solution[0], "intercept"), told(F.slice(solution, 2, F.size(solution) - 1), "coefficients"),
        told(F.col("r2"), "r_squared"))
