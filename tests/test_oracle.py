"""Every registered query against its independent DuckDB statement at sf0.01."""

from __future__ import annotations

import pytest

from conftest import SF01
from marketlens.plans.registry import ORACLE_SQL, QUERIES
from oracle_compare import compare


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, duck01, name):
    res = compare(spark, duck01, name, QUERIES[name], ORACLE_SQL[name], SF01)
    assert res["ok"], res


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)
