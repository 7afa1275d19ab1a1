import os

import odd_tables
import pytest

from ruamesh.llm import queries

pytestmark = pytest.mark.skipif(not os.path.isdir(odd_tables.DATA), reason="needs the test tables")


@pytest.fixture(scope="module", params=["empty", "nulls", "clashes"])
def odd(spark, tmp_path_factory, request):
    return request.param, odd_tables.write(spark, tmp_path_factory.mktemp(request.param), request.param)


@pytest.mark.parametrize("name", ["p5_found", "p7_ids", "p8_found", "p9_found"])
def test_queries_on_odd_tables(spark, odd, name):
    kind, folder = odd
    rows = [str(r) for r in queries.QUERIES[name](spark, folder).collect()]
    if kind == "empty":
        assert rows == []
    if kind == "clashes":
        assert sorted(rows) == sorted(str(r) for r in queries.QUERIES[name](spark, odd_tables.DATA).collect())
