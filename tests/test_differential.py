"""Every registered query against its DuckDB oracle (the driver's gate), at
sf0.001 here; tools/oracle_check.py runs the same comparison at sf0.01."""

import pytest

from conftest import SF_SMALL

import __spark_entry__ as E
from auric.plans.registry import load_all
from tools.oracle_check import duck, frame_digest

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_ledger_query_has_an_oracle():
    assert set(load_all()) <= set(ORACLES) <= set(QUERIES)


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 25
    assert df.columns[:2] == ["tenant_id", "company_name"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = con.execute(ORACLES[name]).df()
    assert frame_digest(got) == frame_digest(want)
