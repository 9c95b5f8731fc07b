"""Every core query against its SQL on the smallest tables; those without SQL must give rows of a stable schema."""

import pytest
from helpers import DATA, rows_of, rows_of_sql

from vocalith.plans import catalog

SLOW = {"ml12_classifiers"}


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, duck, name):
    assert rows_of(catalog.QUERIES[name](spark, DATA)) == rows_of_sql(duck, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL) - SLOW))
def test_gives_rows(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    assert df.columns == list(dict.fromkeys(df.columns))
    assert df.count() > 0
