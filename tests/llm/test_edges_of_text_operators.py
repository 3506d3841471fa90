import pytest

from lotwise.llm import queries
from test_edges import empty_tables, null_tables  # noqa: F401  (fixtures)

SLOW = ("p3_main_text", "p10_found", "p10_rates", "p9_shares")  # the same operators as others of the list


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in SLOW])
def test_empty_tables(spark, empty_tables, name):  # noqa: F811
    assert queries.queries()[name](spark, empty_tables).count() >= 0


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in SLOW])
def test_null_columns_and_repeated_rows(spark, null_tables, name):  # noqa: F811
    assert queries.queries()[name](spark, null_tables).count() >= 0
