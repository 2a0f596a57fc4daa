"""Distribution drift and training support: population stability indices and support breaches."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.quantiles import exact_quantiles

MISSING = "__missing__"


def _long(df: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """(feature, value): the columns stacked, with NaN as null."""
    pick = [F.struct(F.lit(c).alias("feature"), (F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) if kind == "double" else F.col(c).cast("string")).alias("value")) for c in columns]
    return df.select(F.inline(F.array(*pick)))


def psi_edges(reference: DataFrame, columns: list[str], bins: int = 10, accuracy: int | None = None) -> dict[str, list[float]]:
    """The inner bin edges of each column: its distinct reference quantiles k / bins for k from 1 to bins - 1.

    The quantiles are exact and found by distributed ranks; with `accuracy` one aggregate gives approximate ones.
    The first and last positions are dropped before values are made unique, so that mass at a column's ends keeps its edge.
    A constant column gets one edge just above its value. A column that is missing throughout, or infinite, is an error.
    """
    at = [k / bins for k in range(bins + 1)]
    if accuracy is None:
        found = exact_quantiles(reference, columns, at)
    else:
        num = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        found = reference.agg(*[F.percentile_approx(num(c), at, accuracy).alias(c) for c in columns]).first().asDict()
    edges = {}
    for c in columns:
        if found[c] is None or any(math.isinf(v) for v in found[c]):
            raise ValueError(f"{c}: the reference is missing throughout or holds infinities")
        edges[c] = [math.nextafter(found[c][0], math.inf)] if found[c][0] == found[c][-1] else sorted(set(found[c][1:-1]))
    return edges


def _index(counts: DataFrame, epsilon: float) -> DataFrame:
    """feature, psi from (feature, bin, ref, cur): epsilon is added to counts, which are then made shares."""
    every = Window.partitionBy("feature")
    share = lambda c: (F.col(c) + epsilon) / F.sum(F.col(c) + epsilon).over(every)
    rows = counts.select("feature", share("ref").alias("r"), share("cur").alias("c"))
    return rows.groupBy("feature").agg(F.greatest(F.sum((F.col("c") - F.col("r")) * F.ln(F.col("c") / F.col("r"))), F.lit(0.0)).alias("psi"))


def numeric_bins(reference: DataFrame, current: DataFrame, columns: list[str], bins: int = 10, accuracy: int | None = None) -> DataFrame:
    """feature, bin, ref, cur: counts of both sides in half-open bins [edge, next); missing values are one more bin."""
    edges = psi_edges(reference, columns, bins, accuracy)
    spark = reference.sparkSession
    table = F.broadcast(spark.createDataFrame([(c, e) for c, e in edges.items()], "feature string, edges array<double>"))  # a row for each column
    stacked = _long(reference, columns, "double").withColumn("side", F.lit("ref")).unionByName(_long(current, columns, "double").withColumn("side", F.lit("cur")))
    placed = stacked.join(table, "feature")
    bin_of = F.when(F.col("value").isNull(), F.size("edges") + 1).otherwise(F.size(F.filter("edges", lambda e: e <= F.col("value"))))
    counts = placed.groupBy("feature", bin_of.alias("bin")).agg(F.count_if(F.col("side") == "ref").alias("ref"), F.count_if(F.col("side") == "cur").alias("cur"))
    grid = table.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges") + 1)).alias("bin"))
    return grid.join(counts, ["feature", "bin"], "left").na.fill(0, ["ref", "cur"])


def numeric_psi(reference: DataFrame, current: DataFrame, columns: list[str], bins: int = 10, epsilon: float = 1e-6, accuracy: int | None = None) -> DataFrame:
    """feature, psi of every column in one pass over each side."""
    return _index(numeric_bins(reference, current, columns, bins, accuracy), epsilon)


def categorical_psi(reference: DataFrame, current: DataFrame, columns: list[str], epsilon: float = 1e-6) -> DataFrame:
    """feature, psi, unseen_rate (current rows in categories that the reference lacks); missing is a category of its own.

    A blank category is an error.
    """
    stacked = _long(reference, columns, "string").withColumn("side", F.lit("ref")).unionByName(_long(current, columns, "string").withColumn("side", F.lit("cur")))
    value = F.coalesce("value", F.lit(MISSING))
    sound = F.when(F.trim(value) == "", F.raise_error(F.lit("a category is blank")).cast("string")).otherwise(value)
    counts = stacked.groupBy("feature", sound.alias("bin")).agg(F.count_if(F.col("side") == "ref").alias("ref"), F.count_if(F.col("side") == "cur").alias("cur"))
    unseen = counts.groupBy("feature").agg(F.try_divide(F.sum(F.when(F.col("ref") == 0, F.col("cur")).otherwise(0)).cast("double"), F.sum("cur").cast("double")).alias("unseen_rate"))
    return _index(counts, epsilon).join(unseen, "feature")


def unexpected_rates(current: DataFrame, domains: dict[str, list[str]]) -> DataFrame:
    """feature, unexpected_rate: rows outside the approved domain over all rows; nulls count below the line only."""
    rates = [F.avg(F.coalesce(~F.col(c).isin(allowed), F.lit(False)).cast("int")).alias(c) for c, allowed in domains.items()]
    return current.agg(*rates).unpivot([], list(domains), "feature", "unexpected_rate")


def support_breaches(train: DataFrame, scoring: DataFrame, columns: list[str]) -> DataFrame:
    """feature, breaches (scoring rows above the training maximum), train_max, scoring_max."""
    top = train.agg(*[F.max(F.col(c).cast("double")).alias(f"top_{c}") for c in columns])
    wide = scoring.crossJoin(F.broadcast(top)).agg(*[F.struct(F.count_if(F.col(c) > F.col(f"top_{c}")).alias("breaches"), F.max(f"top_{c}").alias("train_max"), F.max(F.col(c).cast("double")).alias("scoring_max")).alias(c) for c in columns])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.breaches"), F.col(f"{c}.train_max"), F.col(f"{c}.scoring_max")) for c in columns])))
