"""Queries of the retrieval, graph and store operators over the test tables, each beside its SQL."""

from velarium.queries import graph, kg, records, relational, search, streams, temporal

QUERIES = search.QUERIES | temporal.QUERIES | graph.QUERIES | relational.QUERIES | streams.QUERIES | kg.QUERIES | records.QUERIES
ORACLE_SQL = search.ORACLE_SQL | temporal.ORACLE_SQL | graph.ORACLE_SQL | relational.ORACLE_SQL | streams.ORACLE_SQL | kg.ORACLE_SQL | records.ORACLE_SQL
