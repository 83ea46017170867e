"""Every query on training data that has SQL gives the rows of that SQL on the smallest tables."""

import pytest

from compare import assert_same
from tidemill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name], SF)
