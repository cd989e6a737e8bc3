import os

import pytest
from compare import compare, connect

from contrail import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_sql(spark, duck, name):
    assert compare(spark, duck, SF, catalog.queries()[name], catalog.oracle_sql()[name]) is None
