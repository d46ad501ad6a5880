"""Every registered query against its SQL on DuckDB, and the driver contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from check_oracles import compare

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, sf_dir, name):
    result = compare(spark, name, QUERIES[name], ORACLES.get(name), sf_dir)
    assert not result.startswith("FAIL"), result


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r.destination_id for r in rows} == {"todos", "compras"}
