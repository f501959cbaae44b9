"""Each registered query of the engine against its SQL."""

import pytest
from oracle import of_spark, of_sql

from corpusloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert of_spark(catalogue.QUERIES[name](spark, sf)) == of_sql(catalogue.SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL) - {"edge_thinning"}))
def test_query_without_sql_has_rows(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
