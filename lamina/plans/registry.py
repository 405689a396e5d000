"""All queries of the library, and their SQL."""

from lamina.plans import kernel_queries, lane_queries, register_queries

QUERIES = kernel_queries.QUERIES | lane_queries.QUERIES | register_queries.QUERIES
ORACLE_SQL = kernel_queries.ORACLE_SQL | lane_queries.ORACLE_SQL | register_queries.ORACLE_SQL
