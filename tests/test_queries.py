"""Every query that has SQL gives the rows that DuckDB gives."""

import pytest

from tallyframe.plans import queries as Q
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = Q.QUERIES[name](spark, sf_dir)
    if name in Q.ORACLES:
        same_rows(df, duck.execute(Q.ORACLES[name]).df())
    else:
        assert df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(Q.ORACLES) <= set(Q.QUERIES)
