from __future__ import annotations

import pytest

from attesto.plans.catalogue import ORACLE_SQL, QUERIES
from tests.compare import same

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(spark, FOLDER, QUERIES[name], ORACLE_SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
