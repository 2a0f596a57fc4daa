"""Joins with a table of unique keys that gather the rows of no key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many of all rows is frequent; at most so many keys are, whatever the input.
SHARES = 20_000


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with table, which has each key of `on` once and says in `weight` how many of the `total` rows have it.

    The frequent keys, a bounded number, are broadcast, so that no task gathers the rows of one; the others are shuffled.
    `weight` is not returned; how: inner or left.
    """
    often = F.col(weight) > total // SHARES + 100
    hot, rest = F.broadcast(table.filter(often).drop(weight)), table.filter(~often).drop(weight)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(rest, on, how))
