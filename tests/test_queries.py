"""A quick pass over a few registered queries against their SQL twins."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = ("flagship", "re_violations", "ex_all", "fv_view_merge", "an_officers", "code_verify")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    assert compare(spark, duck(SF), entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
