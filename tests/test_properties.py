"""Random original-schema tables: the pre-aggregated Spark plans equal a plain
Python evaluation of the joined rows (payment fan-out, NULL amounts,
unreturned and unpaid rentals, several stores, RFM recency against the
whole rental table)."""

import datetime as dt
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rentscope.functions import RfmThresholds
from rentscope.operators import customers, metrics, rfm
from rentscope.sources import domain


def q2(x):
    return float(Decimal(x).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP))


def q1(x):
    return float(Decimal(x).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP))


rental_st = st.tuples(
    st.integers(1, 6),                       # customer
    st.integers(0, 2),                       # inventory
    st.integers(0, 400),                     # rental day offset
    st.one_of(st.none(), st.integers(0, 600)),  # hours until return (None: not returned)
    st.lists(st.one_of(st.none(), st.integers(0, 999)), max_size=3),  # payments in cents
)


def build(spark, rentals):
    base = dt.datetime(2021, 1, 1)
    cust = [(c, f"F{c}", f"L{c}", f"c{c}@x", 1, 10 + c % 2) for c in range(1, 7)]
    rows, pays = [], []
    for i, (c, inv, day, hours, cents) in enumerate(rentals, start=1):
        start = base + dt.timedelta(days=day, hours=i % 5)
        ret = None if hours is None else start + dt.timedelta(hours=hours)
        rows.append((i, c, inv, start, ret))
        for k, amt in enumerate(cents):
            pays.append((i, c, None if amt is None else Decimal(amt) / 100, start + dt.timedelta(days=k * 20)))
    t = dict(
        customer=spark.createDataFrame(cust, "customer_id long, first_name string, last_name string, email string, active int, address_id long"),
        address=spark.createDataFrame([(10, 1), (11, 2)], "address_id long, city_id long"),
        city=spark.createDataFrame([(1, 1), (2, 2)], "city_id long, country_id long"),
        country=spark.createDataFrame([(1, "A"), (2, "B")], "country_id long, country string"),
        rental=spark.createDataFrame(rows, "rental_id long, customer_id long, inventory_id long, rental_date timestamp_ntz, return_date timestamp_ntz"),
        payment=spark.createDataFrame(pays, "rental_id long, customer_id long, amount decimal(12,2), payment_date timestamp_ntz"),
        inventory=spark.createDataFrame([(0, 100, 1), (1, 101, 2), (2, 100, 2)], "inventory_id long, film_id long, store_id long"),
        store=spark.createDataFrame([(1,), (2,)], "store_id long"),
        film=spark.createDataFrame([(100, "X"), (101, "Y")], "film_id long, title string"),
        film_category=spark.createDataFrame([(100, 1), (101, 1)], "film_id long, category_id long"),
        category=spark.createDataFrame([(1, "G")], "category_id long, name string"),
    )
    return domain.from_tables(t), rows, pays


def joined(rows, pays):
    """customer x rental x payment rows as the reference's inner joins give them."""
    by_rental = {r[0]: r for r in rows}
    return [(by_rental[p[0]], p) for p in pays]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(rental_st, min_size=1, max_size=12))
def test_preaggregated_plans_match_joined_rows(spark, rentals):
    data, rows, pays = build(spark, rentals)
    j = joined(rows, pays)

    (kpi,) = metrics.kpi_summary(data).collect()
    amounts = [p[2] for _, p in j if p[2] is not None]
    custs = {r[1] for r, _ in j}
    assert kpi["total_customers"] == len(custs)
    assert kpi["total_rentals"] == len({r[0] for r, _ in j})
    assert kpi["total_revenue"] == (q2(sum(amounts)) if amounts else None)
    assert kpi["avg_transaction"] == (q2(sum(amounts) / len(amounts)) if amounts else None)

    expect = defaultdict(lambda: dict(rentals=set(), amts=[], durs=[]))
    for r, p in j:
        if r[4] is None:
            continue
        e = expect[r[1]]
        e["rentals"].add(r[0])
        if p[2] is not None:
            e["amts"].append(p[2])
        e["durs"].append(Decimal(int((r[4] - r[3]).total_seconds())) / 86400)
    got = {x["customer_id"]: x for x in customers.customer_summary(data).collect()}
    assert set(got) == set(expect)
    for c, e in expect.items():
        g = got[c]
        assert g["rental_count"] == len(e["rentals"])
        assert g["total_revenue"] == (q2(sum(e["amts"])) if e["amts"] else None)
        assert g["avg_payment"] == (q2(sum(e["amts"]) / len(e["amts"])) if e["amts"] else None)
        assert g["avg_duration"] == q1(sum(e["durs"]) / len(e["durs"]))

    stores = defaultdict(lambda: dict(c=set(), r=set(), amt=[]))
    inv_store = {0: 1, 1: 2, 2: 2}
    for r, p in j:
        s = stores[inv_store[r[2]]]
        s["c"].add(r[1]); s["r"].add(r[0])
        if p[2] is not None:
            s["amt"].append(p[2])
    got_st = {x["store_label"]: x for x in metrics.store_summary(data).collect()}
    assert set(got_st) == {f"Store {k}" for k in stores}
    for k, s in stores.items():
        g = got_st[f"Store {k}"]
        assert (g["unique_customers"], g["rental_count"]) == (len(s["c"]), len(s["r"]))
        assert g["revenue"] == (q2(sum(s["amt"])) if s["amt"] else None)

    # RFM: recency against the latest rental of the whole table (paid or not),
    # frequency and monetary over the joined (paid) rows.
    latest = max(r[3] for r in rows).date()
    per = defaultdict(lambda: dict(last=None, rentals=set(), amts=[]))
    for r, p in j:
        e = per[r[1]]
        e["rentals"].add(r[0])
        e["last"] = max(e["last"] or r[3], r[3])
        if p[2] is not None:
            e["amts"].append(p[2])
    got_rfm = {x["customer_id"]: x for x in rfm.rfm_segments(data).collect()}
    assert set(got_rfm) == set(per)
    t = RfmThresholds()
    for c, e in per.items():
        g = got_rfm[c]
        monetary = q2(sum(e["amts"])) if e["amts"] else None
        recency = (latest - e["last"].date()).days
        assert (g["frequency"], g["monetary"], g["recency_days"]) == (len(e["rentals"]), monetary, recency)
        assert g["last_rental"] == e["last"].date()
        if monetary is not None:
            m, f = monetary, len(e["rentals"])
            expect_seg = ("Champions" if recency <= t.champions_recency and f >= t.champions_frequency
                          and m >= t.champions_monetary
                          else "Loyal" if recency <= t.loyal_recency and (f >= t.loyal_frequency
                                                                          or m >= t.loyal_monetary)
                          else "At Risk" if t.at_risk_from <= recency <= t.at_risk_to else "Lost")
            assert g["segment"] == expect_seg
