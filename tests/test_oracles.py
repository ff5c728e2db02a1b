"""Every core query against its SQL on the smallest tables; those without SQL must run."""

import pytest

from cinelode.plans import registry
from helpers import duck, duck_rows, rows

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, name):
    got = registry.queries()[name](spark, data)
    if name not in SQL:
        got.count()
        return
    assert rows(got) == duck_rows(duck(data), SQL[name])
