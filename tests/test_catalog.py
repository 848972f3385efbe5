import pytest

from findloom import catalog
from tests.conftest import DATA, rows_of, rows_of_sql

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, duck):
    got = rows_of(catalog.queries()[name](spark, DATA))
    if name in SQL:
        assert got == rows_of_sql(duck, SQL[name])
    else:
        assert got
