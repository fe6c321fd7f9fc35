"""Queries over the shared tables, one or more per operator, each with the SQL that says the same.

The tables' prose has few of the structures that the rules look for, so most queries put them in
first. What is put in is a piece of SQL that Spark and DuckDB read alike; the rule itself is then
written once with the operators and once in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    from lectern.queries import catalog, library, media, records, remote, runs, script, text

    return {k: q for m in (text, script, media, catalog, library, records, runs, remote) for k, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from lectern.queries import catalog, library, media, records, remote, runs, script, text

    return {k: sql for m in (text, script, media, catalog, library, records, runs, remote) for k, (_, sql) in m.QUERIES.items() if sql}
