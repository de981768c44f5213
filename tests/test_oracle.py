"""Every registered query against its DuckDB oracle on sf0.01 (the driver's
correctness gate: row count, column names, order-insensitive values)."""

import pytest

import __spark_entry__ as E
from rentscope.registry import ORACLE, QUERIES
from scripts.check_oracle import canon, duck
from tests.conftest import SF01


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_every_query_is_registered_with_oracle_or_model():
    assert set(E.oracle_sql()) <= set(E.queries())
    # What fits a forest anew has no SQL; the nested pages have theirs as text.
    assert set(QUERIES) - set(ORACLE) == {"churn_report_refitted", "customer_pages"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF01)
    rows, cols = [tuple(r) for r in df.collect()], df.columns
    res = con.execute(ORACLE[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(cols) == sorted(ocols)
    rel = con.sql(ORACLE[name])
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
    assert spark_types == duck_types
    assert len(rows) == len(orows)
    assert canon(rows, cols) == canon(orows, ocols)
