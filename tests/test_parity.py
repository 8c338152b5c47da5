"""Registered queries against DuckDB. All of them with DAYLOOM_FULL=1, else every fourth and those over several sites."""

import os

import pytest

import parity
from dayloom import plans
from dayloom.plans import registry

plans.load_all()
FOLDER = os.environ.get("DAYLOOM_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(registry.QUERIES)
CHOSEN = NAMES if os.environ.get("DAYLOOM_FULL") else sorted({*NAMES[::4], *(n for n in NAMES if n.endswith("_sites"))})


@pytest.fixture(scope="module")
def con():
    return parity.duck(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, con, name):
    ok, _, message = parity.compare(spark, con, FOLDER, registry.QUERIES[name], registry.SQL.get(name))
    assert ok, message


def test_entry_contract(spark):
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 240
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
