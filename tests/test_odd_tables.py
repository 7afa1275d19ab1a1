import os

import odd_tables
import pytest

from ruamesh.plans import problems

pytestmark = pytest.mark.skipif(not os.path.isdir(odd_tables.DATA), reason="needs the test tables")


@pytest.fixture(scope="module", params=["empty", "nulls", "clashes"])
def odd(spark, tmp_path_factory, request):
    return request.param, odd_tables.write(spark, tmp_path_factory.mktemp(request.param), request.param)


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p4_found", "p4_profile", "p6_found"])
def test_queries_on_odd_tables(spark, odd, name):
    kind, folder = odd
    rows = problems.QUERIES[name](spark, folder).collect()
    assert len(rows) == len(set(rows))
    if kind == "empty":
        assert rows == []
    if kind == "clashes":
        assert set(rows) == set(problems.QUERIES[name](spark, odd_tables.DATA).collect())
