"""SQL over the registered model views with bound parameters."""

from rentscope import sql
from tests import fixtures


def test_views_and_named_parameters(spark):
    names = sql.register_views(fixtures.data(spark), prefix="fx_")
    assert "fx_rental" in names and "fx_payment" in names
    late = sql.run(spark, """
        SELECT film_id, count(*) AS n, max(payment_date) AS newest
        FROM fx_rental_item WHERE has_payment AND amount >= :least GROUP BY film_id ORDER BY film_id""", least=4.5)
    assert [(r["film_id"], r["n"]) for r in late.collect()] == [(50, 1), (51, 1), (52, 2)]
    started = sql.run(spark, "SELECT name FROM fx_customer WHERE startswith(name, :p) AND active = :on", p="D", on=1)
    assert [r["name"] for r in started.collect()] == ["Dee Max"]
