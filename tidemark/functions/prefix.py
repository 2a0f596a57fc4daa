"""Exact ranks and running sums over a whole table without one task that sees every row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Low bits of monotonically_increasing_id(): a row's place in its partition.
_PLACE = (1 << 33) - 1


def with_rank(df: DataFrame, order: list[Column], name: str, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """df with the rank of each row, from 0, in the given total order.

    The rows are range-partitioned and sorted, numbered within their partitions and kept by `keep` (sampling
    again would move the borders); only one count per partition meets in a single task. Rows that tie in
    `order` get different ranks in no set order, so the order should be total. Descending numbers: negate them.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    placed = df.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    kept = keep(placed.drop(*keys).withColumns({"_part": F.shiftright(at, 33).cast("int"), "_place": at.bitwiseAND(F.lit(_PLACE))}), name)
    starts = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return kept.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def with_running_sum(df: DataFrame, order: list[Column], value: str | list[str], name: str | list[str], keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """df with the sum of `value` over all rows before each row in the given total order; kept as with_rank keeps it.

    Several values are summed over one sort, each into the name at its place. The kept frame stays as it is in `_part`: equal for
    the rows of one range, ascending with the order.
    """
    values, names = ([x] if isinstance(x, str) else list(x) for x in (value, name))
    keys = [f"_k{i}" for i in range(len(order))]
    placed = df.withColumns(dict(zip(keys, order, strict=True))).repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    kept = keep(placed.drop(*keys).withColumns({"_part": F.shiftright(at, 33).cast("int"), "_place": at.bitwiseAND(F.lit(_PLACE))}), names[0])
    starts = kept.groupBy("_part").agg(*[F.sum(v).alias(f"_sum{i}") for i, v in enumerate(values)])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_part", *[F.coalesce(F.sum(f"_sum{i}").over(before), F.lit(0)).alias(f"_start{i}") for i in range(len(values))])
    inside = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    summed = kept.withColumns({f"_inside{i}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for i, v in enumerate(values)})
    out = summed.join(F.broadcast(starts), "_part").withColumns({n: F.col(f"_start{i}") + F.col(f"_inside{i}") for i, n in enumerate(names)})
    return out.drop("_place", *[f"_start{i}" for i in range(len(values))], *[f"_inside{i}" for i in range(len(values))])
