"""Exact quantiles of many columns by bracketed selection: the input is passed over twice and never sorted."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.prefix import with_running_sum
from tidemark.sources.scratch import materialise

#: Positions that a sketch is asked for, and the accuracy of its ranks (one in so many values).
GRID, ACCURACY = 1000, 10_000
#: Distinct values in brackets that the driver may take; more are ranked by Spark.
TAKEN = 200_000
EVERY = (-math.inf, math.inf)


def stacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value): the columns as doubles under each other, NaN as null."""
    number = lambda c: F.col(c).cast("double")
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.when(~F.isnan(number(c)), number(c)).alias("value")) for c in columns])))


def _sketches(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, list[float]]]:
    """For each column with values how many, and GRID + 1 values of evenly spaced approximate ranks; one aggregate."""
    at = f"array({', '.join(f'{i / GRID!r}D' for i in range(GRID + 1))})"  # one expression, as a thousand literals cost a call each
    rows = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    told = rows.agg(*[F.expr(f"struct(count(c{i}) AS n, percentile_approx(c{i}, {at}, {ACCURACY}) AS grid)").alias(f"c{i}") for i in range(len(columns))]).first()
    return {c: (told[i]["n"], told[i]["grid"]) for i, c in enumerate(columns) if told[i]["n"]}


def brackets(n: int, grid: list[float], at: list[float], slack: float = 2 / ACCURACY) -> list[tuple[float, float]]:
    """Disjoint ascending ranges of values that hold the values at the places of each quantile, if the grid's ranks are right within `slack`."""
    found: list[tuple[float, float]] = []
    for q in sorted(at):
        place = (n - 1) * q
        low = max(0, math.floor((math.floor(place) / n - slack) * GRID) - 1)
        high = min(GRID, math.ceil(((math.ceil(place) + 1) / n + slack) * GRID) + 1)
        low_value, high_value = (-math.inf if low == 0 else grid[low]), (math.inf if high == GRID else grid[high])
        if found and low_value <= found[-1][1]:
            found[-1] = (found[-1][0], max(found[-1][1], high_value))
        else:
            found.append((low_value, high_value))
    return found


def _kept(df: DataFrame, ranges: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """(feature, part, value, n): how many values lie in each gap (part even, value null), and each value in a range (part odd) with its count."""
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame([(c, [a for a, _ in r], [b for _, b in r]) for c, r in ranges.items()], "feature string, lows array<double>, highs array<double>"))  # a row for each column
    rows = stacked(df, list(ranges)).filter("value IS NOT NULL").join(table, "feature")
    lows, highs = F.size(F.filter("lows", lambda x: x <= F.col("value"))), F.size(F.filter("highs", lambda x: x < F.col("value")))
    rows = rows.select("feature", (lows + highs).alias("part"), "value")
    return rows.groupBy("feature", "part", F.when(F.col("part") % 2 == 1, F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(df: DataFrame, columns: list[str], at: list[float]) -> dict[str, list[float] | None]:
    """For each column the quantiles `at`, with linear interpolation between neighbouring values; None for one without values.

    One pass makes mergeable sketches, whose ranks bracket each quantile. A second counts the values between the brackets and
    keeps those inside with their counts, a few thousandths of the distinct values for each quantile. The values at the asked places are read off the
    kept ones: on the driver while they are few, else by range-partitioned running sums. A bracket that misses its
    place would show in the counts; its column is then taken again with all its values inside.
    """
    sketches = _sketches(df, columns)
    ranges = {c: brackets(n, grid, at) for c, (n, grid) in sketches.items()}
    found: dict[str, dict[int, float]] = {}
    share = 2 * (2 / ACCURACY) + 4 / GRID  # of a column's values in a bracket, at most
    while ranges:
        most = sum(min(1.0, share * len(at)) * sketches[c][0] if r[0] != EVERY else sketches[c][0] for c, r in ranges.items())
        kept = _kept(df, ranges)
        found |= _placed(kept if most <= TAKEN else materialise(kept, "quantiles-kept"), {c: (sketches[c][0], at) for c in ranges}, most <= TAKEN)
        ranges = {c: [EVERY] for c in ranges if c not in found}
    out: dict[str, list[float] | None] = dict.fromkeys(columns)
    for c, values in found.items():
        places = [(sketches[c][0] - 1) * q for q in at]
        ends = [(values[math.floor(p)], values[math.ceil(p)], p - math.floor(p)) for p in places]
        out[c] = [low if low == high else (1 - part) * low + part * high for low, high, part in ends]
    return out


def _wanted(n: int, at: list[float]) -> list[int]:
    return sorted({i for q in at for i in (math.floor((n - 1) * q), math.ceil((n - 1) * q))})


def _placed(kept: DataFrame, asked: dict[str, tuple[int, list[float]]], few: bool) -> dict[str, dict[int, float]]:
    """The values at the asked places of each column; columns of which a place lies in a gap are left out."""
    if few:
        rows = sorted(((r.feature, r.part, -math.inf if r.value is None else r.value, r.n) for r in kept.collect()), key=lambda r: r[:3])
        found, before, last = {c: {} for c in asked}, 0, None
        wanted = {c: _wanted(*a) for c, a in asked.items()}
        for c, part, value, n in rows:
            before, last = (before, last) if c == last else (0, c)
            for i in wanted[c]:
                if before <= i < before + n and part % 2:
                    found[c][i] = value
            before += n
    else:
        ranked = with_running_sum(kept.withColumn("order", F.coalesce("value", F.lit(-math.inf))), [F.col("feature"), F.col("part"), F.col("order")], "n", "before", materialise)
        starts = {r.feature: r.start for r in ranked.groupBy("feature").agg(F.min("before").alias("start")).collect()}  # a row for each column
        wanted = {c: _wanted(*a) for c, a in asked.items()}
        table = F.broadcast(kept.sparkSession.createDataFrame([(c, [starts[c] + i for i in w]) for c, w in wanted.items()], "feature string, places array<long>"))
        here = F.filter("places", lambda i: (i >= F.col("before")) & (i < F.col("before") + F.col("n")))
        told = ranked.filter("part % 2 = 1").join(table, "feature").select("feature", "value", F.explode(here).alias("place")).collect()  # two for each quantile and column
        found = {c: {} for c in asked}
        for r in told:
            found[r.feature][r.place - starts[r.feature]] = r.value
    return {c: f for c, f in found.items() if len(f) == len(wanted[c])}
