import pytest
from conftest import SF, same_rows

from agendum.plans import catalogue, records  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, duck, name):
    same_rows(catalogue.QUERIES[name](spark, SF), duck, catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert "extract_items" in entry.queries()
    assert entry.entry(spark).columns
