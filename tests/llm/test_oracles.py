"""The queries that SQL can express give the rows that DuckDB gives."""

import pytest

from dossier.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import canonical, duck_rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    df = QUERIES[name](spark, SF)
    columns, expected = duck_rows(SF, ORACLE_SQL[name])
    rows = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == columns and len(rows) == len(expected)
    assert rows == expected
