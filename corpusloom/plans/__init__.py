"""Queries by name and, where SQL can express them, their SQL for DuckDB."""

from corpusloom.plans import documents, graphs, results

ALL_QUERIES, ALL_ORACLE = {}, {}
for _module in (documents, graphs, results):
    ALL_QUERIES |= _module.QUERIES
    ALL_ORACLE |= _module.ORACLE
