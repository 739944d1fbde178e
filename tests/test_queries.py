"""Every registered query runs; those with SQL give the rows that DuckDB gives."""

import os

import pytest

from dossier.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import canonical, duck_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE_SQL:
        columns, expected = duck_rows(SF, ORACLE_SQL[name])
        assert sorted(df.columns) == columns
        assert len(rows) == len(expected)
        assert rows == expected
    else:
        assert rows
