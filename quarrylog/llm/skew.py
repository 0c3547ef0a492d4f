"""Joins of rows with grouped tables, where a few groups may hold most of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group with more than one part in so many of all rows is sent to every task; there are fewer of them than this.
PARTS = 512


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str = "size", total: int | None = None) -> DataFrame:
    """rows joined with groups by keys (non-null, one row for each key in groups); column ``size``, the group's rows, goes.

    Groups of more than 1 / PARTS of the rows, of which there are fewer than
    PARTS whatever the table's size, are broadcast, so that their rows stay where
    they are; all others meet by a shuffle on the keys. total: the rows of all groups.
    """
    if total is None:
        total = groups.agg(F.sum(size)).first()[0] or 0
    large = groups.where(F.col(size) * PARTS > total).drop(size)
    small = groups.where(F.col(size) * PARTS <= total).drop(size)
    there = F.broadcast(large)
    near = rows.join(there, keys)
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti")
    return near.unionByName(rest.join(small.hint("merge"), keys))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
