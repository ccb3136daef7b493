import pytest

from tests.compare import both
from vocalith.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(name, spark, sf):
    got, want = both(spark, sf, name, QUERIES, ORACLE_SQL)
    assert len(got) == len(want)
    assert got == want
