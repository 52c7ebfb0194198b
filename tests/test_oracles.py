"""Every registered query of the analytics families against its SQL, on the small tables."""

import pytest
from conftest import DATA, rows_of

from tracewright import plans

QUERIES, ORACLES = plans.queries(), plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, DATA)
    cols, got = rows_of(df)
    if name not in ORACLES:
        assert len(cols) > 1
        return
    rel = oracle.sql(ORACLES[name])
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    value = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    want = sorted((tuple(value(r[i]) for i in order) for r in rel.fetchall()), key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert cols == sorted(rel.columns)
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
