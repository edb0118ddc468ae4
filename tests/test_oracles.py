"""Every query of the core that has SQL gives the rows that DuckDB gives."""

import os

import pytest

from oracle_check import connect, norm
from stratalode.core import queries as core
from stratalode.plans import queries as plans

ALL = {**core.QUERIES, **plans.QUERIES}
SQL = {**core.ORACLES, **plans.ORACLES}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, con, name):
    got, want = ALL[name](spark, data).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


# What the data do not hold; fixtures test these.
NOTHING_THERE = {"k10_python_checks", "k15_patterns"}


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(spark, data, name):
    larger = os.path.join(os.path.dirname(data.rstrip("/")), "sf0.01")  # the smallest tables lack some kinds of rows
    rows = ALL[name](spark, larger if os.path.isdir(larger) else data).collect()
    assert bool(rows) != (name in NOTHING_THERE)
    assert all(any(v is not None for v in r) for r in rows)


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
