"""All named queries of the library against DuckDB, on the smallest tables; tools/check_queries.py takes any folder."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
import check_queries  # noqa: E402
from tabscope import catalog  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
catalog.load()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="benchmark tables are not here")


@pytest.fixture(scope="module")
def con():
    return check_queries.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, con, name):
    ok, message, _ = check_queries.compare(spark, con, FOLDER, name, catalog.QUERIES[name], catalog.ORACLES.get(name))
    assert ok, message


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 11
