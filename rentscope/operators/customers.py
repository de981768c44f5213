"""Customer reports: summary, search, detail (lookup and all-customer batch),
history, top spenders, rentals-vs-revenue, spending tiers.

A lookup by ``customer_id`` first cuts the facts to the customer's rentals
and then runs the same plan; the batch forms compute every customer in one
pass, for exports or a materialised serving table. Lookups are
ordered as the original pages; batch forms are not sorted globally (a
total sort of every customer's history would only add a range shuffle).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentscope.functions import (
    as_date, duration_micros, money, month_label, month_start, round_ratio, row_micros,
)
from rentscope.model import RentalData
from rentscope.operators.catalog import rental_genres
from rentscope.plans import customer_rollup, films, paid_rentals, rental_lines, stored, top_k_per_group


def _only(data: RentalData, customer_id: int | None) -> RentalData:
    return data if customer_id is None else data.for_customer(customer_id)


def _dims(data: RentalData) -> DataFrame:
    """customer_id, name, email, active, country (geo chain inner-joined)."""
    if data.customer_dim is not None:
        return data.customer_dim
    return data.customer.join(data.customer_geo, "customer_id")


# -- summary --------------------------------------------------------------

def customer_summary(data: RentalData) -> DataFrame:
    """customer_id, name, email, country, active, rental_count, total_revenue,
    avg_payment, avg_duration over returned, paid rentals; top revenue first.

    avg_duration is weighted by payment rows (a rental paid in three parts
    counts three times), as the joined-rows average of the reference.
    """
    paid = paid_rentals(data).filter(F.col("return_date").isNotNull()).withColumn(
        "dur_us", duration_micros("return_date", "rental_date")
    )
    per_customer = customer_rollup(
        paid, F.sum(F.col("dur_us").cast("decimal(28,0)") * F.col("n_rows")).alias("dur_us_w")
    )
    out = per_customer.join(_dims(data), "customer_id").select(
        "customer_id", "name", "email", "country", "active",
        F.col("rentals").cast("long").alias("rental_count"),
        money("paid").alias("total_revenue"),
        round_ratio("paid", "n_amt", 2).cast("double").alias("avg_payment"),
        round_ratio("dur_us_w", row_micros("n_rows"), 1, "decimal(28,0)")
        .cast("double").alias("avg_duration"),
    )
    return out.orderBy(F.col("total_revenue").desc_nulls_first(), F.col("customer_id"))


def top_n_customers(data: RentalData, n: int = 10) -> DataFrame:
    """customer_id, name, total_revenue of the n largest spenders (all paid rentals)."""
    per_customer = customer_rollup(paid_rentals(data))
    return (
        per_customer.join(data.customer.select("customer_id", "name"), "customer_id")
        .select("customer_id", "name", money("paid").alias("total_revenue"))
        .orderBy(F.col("total_revenue").desc_nulls_first(), F.col("customer_id"))
        .limit(n)
    )


def customer_spend(data: RentalData) -> DataFrame:
    """customer_id, rental_count, total_revenue per customer with paid rentals."""
    per_customer = customer_rollup(paid_rentals(data))
    return per_customer.join(data.customer.select("customer_id"), "customer_id", "left_semi").select(
        "customer_id", F.col("rentals").cast("long").alias("rental_count"),
        money("paid").alias("total_revenue"),
    )


def rentals_vs_revenue(data: RentalData) -> DataFrame:
    """One row: customers, correlation of rental_count and total_revenue
    (Pearson, 6 decimals). The per-customer points are ``customer_spend``."""
    pts = customer_spend(data)
    return pts.agg(
        F.count(F.lit(1)).cast("long").alias("customers"),
        F.round(F.corr(F.col("rental_count").cast("double"), F.col("total_revenue")), 6).alias("correlation"),
    )


def tier_of(spend: Column, cuts: Sequence[float], labels: Sequence[str] | None = None) -> Column:
    """The label of the tier that ``spend`` falls into; 'tier_0' and so on by default."""
    cuts = list(cuts)
    labels = list(labels) if labels else [f"tier_{i}" for i in range(len(cuts) + 1)]
    if len(labels) != len(cuts) + 1:
        raise ValueError("need one label more than cuts")
    tier = F.lit(labels[0])
    for cut, label in zip(cuts, labels[1:]):
        tier = F.when(spend >= F.lit(cut), F.lit(label)).otherwise(tier)
    return tier


def spending_tiers(data: RentalData, cuts: Sequence[float] = (100.0, 150.0),
                   labels: Sequence[str] | None = None) -> DataFrame:
    """tier, customers, revenue: customers bucketed by total spend.

    ``cuts`` are ascending lower edges of the tiers after the first; a
    customer spending exactly a cut value falls into the higher tier.
    """
    per_customer = customer_rollup(paid_rentals(data)).join(
        data.customer.select("customer_id"), "customer_id", "left_semi"
    )
    return (
        per_customer.groupBy(tier_of(F.round("paid", 2), cuts, labels).alias("tier"))
        .agg(F.count(F.lit(1)).cast("long").alias("customers"), F.sum("paid").alias("rev"), F.min("paid").alias("_least"))
        .orderBy(F.col("_least").asc_nulls_first(), "tier")
        .select("tier", "customers", money("rev").alias("revenue"))
    )


# -- search ---------------------------------------------------------------

def _like(q: str) -> str:
    """``q`` as a LIKE pattern: a backslash takes the next character as it is,
    which LIKE knows before ``%``, ``_`` and itself only; one at the end stands
    for itself."""
    out, escaped = [], False
    for c in q:
        if escaped:
            out.append("\\" + c if c in "%_\\" else c)
            escaped = False
        elif c == "\\":
            escaped = True
        else:
            out.append(c)
    return "".join(out) + ("\\\\" if escaped else "")


def customer_search(data: RentalData, q: str, limit: int = 20) -> DataFrame:
    """customer_id, name, email, country, active whose full name contains
    ``q`` (case-insensitive); ``%`` and ``_`` in q act as wildcards."""
    if not q:
        raise ValueError("q must not be empty")
    pattern = F.lower(F.lit(f"%{_like(q)}%"))
    return (
        _dims(data)
        .filter(F.like(F.lower(F.col("name")), pattern))
        .select("customer_id", "name", "email", "country", "active")
        .orderBy(F.col("name").asc_nulls_last(), F.col("customer_id"))
        .limit(limit)
    )


# -- customer detail ------------------------------------------------------

KPI_COLUMNS = ("total_rentals", "total_spent", "avg_transaction", "first_rental", "last_rental")


def _kpi_columns() -> list[Column]:
    """KPI_COLUMNS from rentals, paid, n_amt, first_ts, last_ts."""
    return [
        F.col("rentals").cast("long").alias("total_rentals"),
        money("paid").alias("total_spent"),
        round_ratio("paid", "n_amt", 2).cast("double").alias("avg_transaction"),
        as_date("first_ts").alias("first_rental"),
        as_date("last_ts").alias("last_rental"),
    ]


def customer_kpi(data: RentalData, customer_id: int | None = None) -> DataFrame:
    """total_rentals, total_spent, avg_transaction, first_rental, last_rental.

    With ``customer_id`` one row (also for an unknown id: counts 0, rest
    NULL); without, one row per customer with a paid rental.
    """
    paid = paid_rentals(_only(data, customer_id))
    aggs = [
        F.count(F.lit(1)).alias("rentals"), F.sum("paid").alias("paid"), F.sum("n_amt").alias("n_amt"),
        F.min("rental_date").alias("first_ts"), F.max("rental_date").alias("last_ts"),
    ]
    grouped = paid.agg(*aggs) if customer_id is not None else paid.groupBy("customer_id").agg(*aggs)
    key = [] if customer_id is not None else ["customer_id"]
    return grouped.select(*key, *_kpi_columns())


def customer_timeline(data: RentalData, customer_id: int | None = None) -> DataFrame:
    """[customer_id,] month ('Mon yyyy'), month_sort (first day), rental_count."""
    r = _only(data, customer_id).rental
    out = (
        r.groupBy("customer_id", month_start("rental_date").alias("month_sort"))
        .agg(F.count(F.lit(1)).cast("long").alias("rental_count"))  # one row per rental
        .select("customer_id", month_label("month_sort").alias("month"), "month_sort", "rental_count")
    )
    if customer_id is None:
        return out
    return out.orderBy(F.col("month_sort").asc_nulls_last()).drop("customer_id")


def _top_genres_ranked(data: RentalData, customer_id: int | None, n: int) -> DataFrame:
    pairs = rental_genres(_only(data, customer_id), "customer_id")
    counts = pairs.groupBy("customer_id", "genre").agg(F.count(F.lit(1)).cast("long").alias("rental_count"))
    return top_k_per_group(
        counts, ["customer_id"], [F.col("rental_count").desc(), F.col("genre").asc_nulls_last()], n,
        salt_cols=["genre"], rank_col="genre_rank",
    )


def customer_top_genres(data: RentalData, customer_id: int | None = None, n: int = 8) -> DataFrame:
    """[customer_id,] genre, rental_count: the customer's n most rented genres."""
    out = _top_genres_ranked(data, customer_id, n).select("customer_id", "genre", "rental_count")
    if customer_id is None:
        return out
    return out.orderBy(F.col("rental_count").desc(), F.col("genre").asc_nulls_last()).drop("customer_id")


def _history_rows(data: RentalData, customer_id: int | None, paid_only: bool) -> DataFrame:
    lines = rental_lines(_only(data, customer_id))
    if paid_only:
        lines = lines.filter(F.col("has_payment"))
    lines = lines.select("rental_id", "customer_id", "rental_date", "return_date", "film_id", "amount")
    return lines.join(films(data).withColumnRenamed("title", "film_title"), "film_id")


def _newest(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest of each customer's paid lines, with line_rank."""
    order = [
        F.col("rental_date").desc_nulls_first(), F.col("rental_id").desc(),
        F.col("film_title").asc_nulls_last(), F.col("genre").asc_nulls_last(), F.col("amount").desc_nulls_first(),
    ]
    top = top_k_per_group(rows, ["customer_id"], order, n, salt_cols=["rental_id"], rank_col="line_rank")
    return top.select(
        "customer_id", "line_rank", "rental_id", as_date("rental_date").alias("rental_date"),
        as_date("return_date").alias("return_date"), "film_title", "genre",
        F.col("amount").cast("double").alias("paid"),
    )


def customer_history(data: RentalData, customer_id: int | None = None, n: int = 100) -> DataFrame:
    """[customer_id,] rental_id, rental_date, return_date, film_title, genre, paid:
    the n newest paid rental lines of the customer (inner join with payment)."""
    out = _newest(_history_rows(data, customer_id, paid_only=True), n).drop("line_rank")
    if customer_id is None:
        return out
    return out.orderBy(F.col("rental_date").desc_nulls_first(), F.col("rental_id").desc()).drop("customer_id")


def customer_history_full(data: RentalData, customer_id: int | None = None) -> DataFrame:
    """[customer_id,] rental_date, return_date, film_title, genre, amount: every
    rental line, unpaid lines with amount 0 (left join with payment)."""
    rows = _history_rows(data, customer_id, paid_only=False)
    out = rows.select(
        "customer_id", as_date("rental_date").alias("rental_date"), as_date("return_date").alias("return_date"),
        "film_title", "genre", F.coalesce(F.col("amount"), F.lit(0).cast("decimal(12,2)")).cast("double").alias("amount"),
    )
    if customer_id is None:
        return out
    return out.orderBy(F.col("rental_date").desc_nulls_first()).drop("customer_id")


def customer_detail(data: RentalData, customer_id: int) -> dict[str, DataFrame]:
    """The four parts of one customer's page: kpi, timeline, genres, history."""
    return {
        "kpi": customer_kpi(data, customer_id),
        "timeline": customer_timeline(data, customer_id),
        "genres": customer_top_genres(data, customer_id),
        "history": customer_history(data, customer_id),
    }


def _page_rows(data: RentalData) -> DataFrame:
    """The rented items with what a page shows of them, a row each: customer_id, rental_id, rental_date,
    return_date, amount, has_payment and ``shown`` (title and genre, once for each genre of the film)."""
    shown = films(data).groupBy("film_id").agg(F.collect_list(F.struct("title", "genre")).alias("shown"))
    return rental_lines(data).join(shown, "film_id", "left").select(
        "customer_id", "rental_id", "rental_date", "return_date", "amount", "has_payment", "shown")


def _page_figures(data: RentalData, rows: DataFrame, genres: int) -> DataFrame:
    """The kpi columns of every customer with a paid rental, with top (the ``genres``
    most rented, best first, and their rentals) and n_paid_lines.

    Rows are reduced to a rental, then to a customer and genre, then to a
    customer, by partial aggregates each time; a rental's own figures travel on
    its first genre. What is ordered is an array of one customer's genres.
    """
    paid = F.col("has_payment")
    rentals = rows.groupBy("customer_id", "rental_id", "rental_date").agg(
        F.sum(F.when(paid, F.col("amount"))).alias("paid"), F.count(F.when(paid, F.col("amount"))).alias("n_amt"),
        F.count_if(paid).alias("n_pay"), F.sum(F.when(paid, F.coalesce(F.size("shown"), F.lit(0)))).alias("n_lines"),
        F.array_distinct(F.flatten(F.collect_set(F.transform("shown", lambda s: s["genre"])))).alias("genres"))
    spread = rentals.select("*", F.posexplode_outer("genres").alias("place", "genre"))
    own = F.coalesce(F.col("place"), F.lit(0)) == 0
    counted = F.when(F.col("n_pay") > 0, F.col("rental_date"))
    by_genre = spread.groupBy("customer_id", F.col("place").isNotNull().alias("named"), "genre").agg(
        F.count(F.lit(1)).cast("long").alias("rental_count"), F.count_if(own & (F.col("n_pay") > 0)).alias("rentals"),
        F.sum(F.when(own, F.col("paid"))).alias("paid"), F.sum(F.when(own, F.col("n_amt"))).alias("n_amt"),
        F.sum(F.when(own, F.col("n_lines"))).alias("n_lines"), F.min(counted).alias("first_ts"), F.max(counted).alias("last_ts"))
    entry = F.struct((-F.col("rental_count")).alias("less"), F.col("genre").isNull().alias("unnamed"), "genre")
    places = F.slice(F.array_sort(F.collect_list(F.when(F.col("named"), entry))), 1, genres)
    out = by_genre.groupBy("customer_id").agg(
        F.sum("rentals").alias("rentals"), F.sum("paid").alias("paid"), F.sum("n_amt").alias("n_amt"),
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n_lines").alias("n_paid_lines"),
        F.transform(places, lambda e: F.struct(e["genre"].alias("genre"), (-e["less"]).alias("rental_count"))).alias("top"))
    top = F.when(F.size("top") > 0, F.col("top")).alias("top")
    if data.rental_line is None:  # items needn't hold every payment there
        return customer_kpi(data).join(out.select("customer_id", top, "n_paid_lines"), "customer_id", "left")
    return out.filter("rentals > 0").select("customer_id", *_kpi_columns(), top, "n_paid_lines")


def customer_detail_batch(data: RentalData, genres: int = 8, history: int = 100) -> DataFrame:
    """One row per customer with a paid rental: the kpi columns plus
    timeline_months, top_genres (comma-joined in rank order) and history_rows.

    Figures, genres and history come from one pass over lines and films; each
    part is bounded per customer (months of the calendar, ``genres``,
    ``history``) before the 1:1 join.
    """
    timeline = customer_timeline(data).groupBy("customer_id").agg(
        F.count(F.lit(1)).cast("long").alias("timeline_months"))
    figures = _page_figures(data, _page_rows(data), genres).withColumns({
        "top_genres": F.array_join(F.transform("top", lambda e: e["genre"]), ","),
        # The page shows at most ``history`` lines: count them without ranking.
        "history_rows": F.when(F.col("n_paid_lines") > 0, F.least("n_paid_lines", F.lit(history)).cast("long"))})
    out = figures.drop("top", "n_paid_lines").join(timeline, "customer_id", "left")
    return out.select("customer_id", *KPI_COLUMNS, "timeline_months", "top_genres", "history_rows")


def customer_pages(data: RentalData, genres: int = 8, history: int = 100) -> DataFrame:
    """One row per customer with a paid rental, shaped like the original page:
    customer_id, kpi struct, timeline (months in order), genres (top ``genres``
    by rentals) and history (newest ``history`` paid lines) as arrays of
    structs. Every array is bounded (calendar months, ``genres``,
    ``history``) before it is collected, and ordered by an explicit rank.

    Lines meet their rental and film once; those rows are written, and both
    the figures and the history are read from there.
    """
    rows = stored(_page_rows(data), "page-rows")
    figures = _page_figures(data, rows, genres).select("customer_id", F.struct(*KPI_COLUMNS).alias("kpi"), F.col("top").alias("genres"))
    timeline = customer_timeline(data).groupBy("customer_id").agg(
        F.array_sort(F.collect_list(F.struct("month_sort", "month", "rental_count"))).alias("timeline"))
    shown = rows.filter("has_payment").select("customer_id", "rental_id", "rental_date", "return_date", "amount", F.inline("shown"))
    lines = _newest(shown.withColumnRenamed("title", "film_title"), history).groupBy("customer_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(
                "line_rank", "rental_id", "rental_date", "return_date", "film_title", "genre", "paid"))),
            lambda h: F.struct(*[h[c].alias(c) for c in
                                 ("rental_id", "rental_date", "return_date", "film_title", "genre", "paid")]),
        ).alias("history"))
    out = figures.join(timeline, "customer_id", "left").join(lines, "customer_id", "left")
    return out.select("customer_id", "kpi", "timeline", "genres", "history")


def customer_pages_text(data: RentalData, genres: int = 8, history: int = 100) -> DataFrame:
    """``customer_pages`` as text: customer_id, kpi, timeline, genres and history,
    fields joined by '|' and entries by ';' in the page's order, money in
    cents, missing fields left out."""

    def line(entry: Column, *fields: str) -> Column:
        return F.concat_ws("|", *[entry[f].cast("string") if isinstance(f, str) else f(entry) for f in fields])

    def cents(name: str):
        return lambda entry: F.round(entry[name] * 100).cast("long").cast("string")

    def entries(column: str, *fields) -> Column:
        return F.array_join(F.transform(column, lambda e: line(e, *fields)), ";").alias(column)

    return customer_pages(data, genres, history).select(
        "customer_id",
        line(F.col("kpi"), "total_rentals", cents("total_spent"), cents("avg_transaction"), "first_rental", "last_rental").alias("kpi"),
        entries("timeline", "month_sort", "month", "rental_count"),
        entries("genres", "genre", "rental_count"),
        entries("history", "rental_id", "rental_date", "return_date", "film_title", "genre", cents("paid")),
    )
