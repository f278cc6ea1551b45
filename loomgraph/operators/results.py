"""RETURN helpers for what plain DataFrame calls don't say as shortly.

Filters, DISTINCT, ORDER BY, SKIP, LIMIT, UNION and WITH are ``where``, ``distinct``,
``orderBy``, ``offset``, ``limit``, ``union`` and further calls on the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import TASK_ROWS


def count_of(name: str) -> Column:
    """count(n): rows where the variable is bound (OPTIONAL MATCH leaves nulls)."""
    return F.count(F.col(name))


def collect_of(item: str | Column) -> Column:
    """collect(x): the non-null values, as a bag in ascending order."""
    return F.sort_array(F.collect_list(item))


def group_by_nodes(df: DataFrame, names: list[str], *aggregates: Column) -> DataFrame:
    """Grouping by whole nodes: shuffled by their ids alone, columns carried along."""
    keys = [F.col(f"{n}.id").alias(f"_{n}") for n in names]
    found = df.groupBy(*keys).agg(*[F.first(n).alias(n) for n in names], *aggregates)
    return found.drop(*[f"_{n}" for n in names])


def counted_by(df: DataFrame, rows: int, spread: str, *others: str, to: str = "n") -> DataFrame:
    """Rows for each value of ``spread`` and ``others``, of a frame of about ``rows`` rows
    with nearly as many groups.

    Rows are dealt by ``spread`` alone into tasks of ``TASK_ROWS``, so what a task holds
    doesn't grow with the data; the frame's exchange is the only one."""
    parts = max(1, -(-rows // TASK_ROWS))
    return df.repartition(parts, spread).groupBy(spread, *others).agg(F.count("*").alias(to))


def returning(df: DataFrame, *items: Column | str, aggregates: Sequence[Column] = (), distinct: bool = False, order_by: Sequence[Column] = (), skip: int = 0, limit: int | None = None) -> DataFrame:
    """RETURN [DISTINCT] items, aggregates [ORDER BY ...] [SKIP n] [LIMIT m].

    With aggregates the items are the grouping keys.  ``order_by`` names returned columns
    or, without DISTINCT and aggregates, variables that aren't returned.  Null keys group
    together; without keys there is one row, even of an empty match."""
    columns = [F.col(i) if isinstance(i, str) else i for i in items]
    if aggregates:
        out = df.groupBy(*columns).agg(*aggregates)
    elif distinct:
        out = df.select(*columns).distinct()
    else:
        out, order_by = (df.orderBy(*order_by) if order_by else df).select(*columns), ()
    out = out.orderBy(*order_by) if order_by else out
    out = out.offset(skip) if skip else out
    return out if limit is None else out.limit(limit)


def union_all(*parts: DataFrame) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def union(*parts: DataFrame) -> DataFrame:
    """UNION: UNION ALL without repeats."""
    return union_all(*parts).distinct()
