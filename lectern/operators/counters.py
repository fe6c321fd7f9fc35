"""Counts taken while rows go by: no second pass over them, no shuffle.

``observe`` lets a query carry aggregates of the rows that pass a point of its plan. What is counted
is known when the query that uses the rows has run. A task that is run again isn't counted twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Why a rewrite is taken or not, as the guard says.
REASONS = ("accepted", "blank", "error", "empty", "preamble", "drift")


def by_value(df: DataFrame, column: Column, values: tuple[str, ...], name: str) -> tuple[DataFrame, Observation]:
    """``df``, and an observation of how many of its rows have each of ``values``, and any other (``other``)."""
    seen = Observation(name)
    known = column.isin(*values)
    return df.observe(seen, *[F.count_if(column == v).alias(v) for v in values], F.count_if(~F.coalesce(known, F.lit(False))).alias("other")), seen


def attempts(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` (attempts with error), and an observation of how many were made and how many failed."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("made"), F.count("error").alias("failed")), seen
