"""Every query over the smallest tables, against its SQL where it has one."""

from __future__ import annotations

import pytest

from tests.comparing import same
from tests.conftest import SMALL
from velarium.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    same(QUERIES[name](spark, SMALL), duck.sql(ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, name):
    # the smallest tables hold no walk: their part of the graph has no edge
    folder = SMALL.replace("0.001", "0.01") if name in ("random_walks", "node_embeddings") else SMALL
    assert QUERIES[name](spark, folder).collect()


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
