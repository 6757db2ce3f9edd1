from __future__ import annotations

import pytest

from listwright.llm.registry import ORACLE_SQL, QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, folder, name):
    same(spark, QUERIES[name], ORACLE_SQL[name], folder)
