"""Queries of the training-data operators that SQL can express."""

import pytest

from reelquery.llm.queries import ORACLE, QUERIES
from tests.test_oracle import same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    same(spark, name, QUERIES[name], ORACLE[name])
