"""Every query of the reference's operators against its SQL on the smallest tables."""

import pytest

from corvane.plans import catalog
from tests.conftest import DATA
from tests.helpers import duck_rows, spark_rows

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = spark_rows(catalog.queries()[name](spark, DATA))
    if name in SQL:
        assert got == duck_rows(duck, SQL[name])
    else:
        assert got[0] and got[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
