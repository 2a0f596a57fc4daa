"""Evaluation of scored rows: threshold sweeps, calibration, ranking quality, and threshold choice.

Inputs have key, p (probability, double) and y (boolean label). Rows whose p or y is null take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.prefix import with_rank, with_running_sum
from tidemark.sources.scratch import materialise

STEPS = 1000  # thresholds are i / STEPS


def safe_divide(a: Column, b: Column, zero_division: float | None = None) -> Column:
    """a / b as double; where b is zero, null or the given value. The two conventions are never mixed in one result."""
    out = F.try_divide(a.cast("double"), b.cast("double"))
    return out if zero_division is None else F.coalesce(out, F.lit(float(zero_division)))


def usable(preds: DataFrame) -> DataFrame:
    """The rows with a probability and a label; a label that is text is read as boolean, and other text is no label."""
    if dict(preds.dtypes)["y"] == "string":
        preds = preds.withColumn("y", F.col("y").try_cast("boolean"))
    return preds.filter(F.col("p").isNotNull() & ~F.isnan("p") & F.col("y").isNotNull())


def confusion_rates(df: DataFrame, zero_division: float | None = None) -> DataFrame:
    """df (tp, fp, tn, fn) with predicted positives, precision, recall, specificity, accuracy and F1."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    d = lambda a, b: safe_divide(a, b, zero_division)
    return df.withColumns({"predicted_positive": tp + fp, "precision": d(tp, tp + fp), "recall": d(tp, tp + fn), "specificity": d(tn, tn + fp), "accuracy": d(tp + tn, tp + fp + tn + fn), "f1": d(2 * tp, 2 * tp + fp + fn)})


def threshold_sweep(preds: DataFrame, zero_division: float | None = None) -> DataFrame:
    """Confusion counts and rates at every threshold i / 1000 (p >= threshold).

    Each row falls into the highest threshold it reaches; the counts of at most 1,002 buckets are then summed from
    above, so the rows are read once instead of once for each threshold.
    """
    rough = F.least(F.greatest(F.floor(F.col("p") * STEPS), F.lit(-1)), F.lit(STEPS)).cast("int")
    reach = lambda i: i.cast("double") / F.lit(float(STEPS)) <= F.col("p")
    bucket = F.when((rough < STEPS) & reach(rough + 1), rough + 1).when((rough >= 0) & ~reach(rough), rough - 1).otherwise(rough)
    counts = usable(preds).groupBy(bucket.alias("step")).agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    grid = preds.sparkSession.range(-1, STEPS + 1).select(F.col("id").cast("int").alias("step"))
    above = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    rows = grid.join(counts, "step", "left").na.fill(0, ["pos", "neg"])
    tp, fp = F.sum("pos").over(above), F.sum("neg").over(above)
    rows = rows.select("step", tp.alias("tp"), fp.alias("fp"), (F.sum("neg").over(every) - fp).alias("tn"), (F.sum("pos").over(every) - tp).alias("fn")).filter("step >= 0")
    return confusion_rates(rows.select((F.col("step").cast("double") / F.lit(float(STEPS))).alias("threshold"), "tp", "fp", "tn", "fn"), zero_division)


def ntile(df: DataFrame, tiles: int, order: list[Column], name: str) -> DataFrame:
    """df with NTILE over all rows in a total order, from distributed ranks instead of a window in one task."""
    ranked = with_rank(df, order, "_rank", materialise)
    n = ranked.count()
    q, r = divmod(n, tiles)
    at = F.col("_rank")
    rest = F.floor((at - r * (q + 1)) / F.lit(max(1, q))) + r + 1
    return ranked.withColumn(name, F.when(at < r * (q + 1), F.floor(at / F.lit(q + 1)) + 1).otherwise(rest).cast("int")).drop("_rank")


def _bins(df: DataFrame, name: str) -> DataFrame:
    rows = df.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("min_p"), F.max("p").alias("max_p"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("int")).alias("observed_rate"))
    gap = F.col("mean_p") - F.col("observed_rate")
    return rows.withColumn("gap", gap).withColumn("abs_gap", F.abs(gap))


def calibration_ntile(preds: DataFrame, tiles: int = 10) -> DataFrame:
    """Equal-count bins by ascending p, ties by key."""
    return _bins(ntile(usable(preds), tiles, [F.col("p"), F.col("key")], "decile"), "decile")


def calibration_width(preds: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins; empty ones are absent."""
    return _bins(usable(preds).withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")), "bin")


def calibration_error(bins: DataFrame) -> DataFrame:
    """ece (gaps weighted by the bins' rows) and the largest gap."""
    return bins.agg(safe_divide(F.sum(F.col("n") * F.col("abs_gap")), F.sum("n")).alias("ece"), F.max("abs_gap").alias("max_gap"))


def top_fraction(preds: DataFrame, fraction: float = 0.10) -> DataFrame:
    """One row: recall, precision and lift of the ceil(fraction n) highest scores, ties by key; at least one row is chosen."""
    import math

    rows = usable(preds)
    n, positives = rows.agg(F.count(F.lit(1)), F.count_if("y")).first()
    k = max(1, math.ceil(fraction * n))
    ranked = with_rank(rows, [-F.col("p"), F.col("key")], "_rank", materialise)
    top = ranked.filter(F.col("_rank") < k).agg(F.count(F.lit(1)).alias("selected"), F.count_if("y").alias("hits"))
    precision = safe_divide(F.col("hits"), F.col("selected"))
    base = F.lit(positives / n if n else None).cast("double")
    return top.select("selected", "hits", safe_divide(F.col("hits"), F.lit(positives)).alias("recall"), precision.alias("precision"), F.try_divide(precision, base).alias("lift"))


def select_threshold(sweep: DataFrame) -> DataFrame:
    """The sweep's row of largest F1, then largest recall, then lowest threshold."""
    return sweep.orderBy(F.desc_nulls_last("f1"), F.desc_nulls_last("recall"), "threshold").limit(1)


def grid_pr_auc(sweep: DataFrame) -> DataFrame:
    """Trapezoids between neighbouring thresholds from the highest down; a missing precision counts as 1."""
    precision = F.coalesce("precision", F.lit(1.0))
    down = Window.orderBy(F.desc("threshold"))
    step = (F.col("recall") - F.lag("recall").over(down)) * (precision + F.lag(precision).over(down)) / 2
    return sweep.select(step.alias("area")).agg(F.sum("area").alias("grid_pr_auc"))


def ranking_quality(preds: DataFrame) -> DataFrame:
    """One row: roc_auc (ties count half), pr_auc (trapezoids over every distinct score and the end point) and average precision.

    Rows are grouped by score; running sums over the sorted distinct scores are distributed.
    """
    scores = usable(preds).groupBy("p").agg(F.count_if("y").alias("pos"), F.count_if(~F.col("y")).alias("neg"))
    below = with_running_sum(scores, [F.col("p")], ["pos", "neg"], ["pos_below", "neg_below"], materialise).drop("_part")
    totals = below.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    rows = below.crossJoin(F.broadcast(totals))
    tp, fp = F.col("all_pos") - F.col("pos_below"), F.col("all_neg") - F.col("neg_below")
    here, recall_step = safe_divide(tp, tp + fp), safe_divide(F.col("pos"), F.col("all_pos"))
    prior_tp, prior_fp = tp - F.col("pos"), fp - F.col("neg")
    prior = F.when(prior_tp + prior_fp == 0, F.lit(1.0)).otherwise(safe_divide(prior_tp, prior_tp + prior_fp))
    pairs = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return rows.agg(
        safe_divide(pairs, F.max(F.col("all_pos") * F.col("all_neg"))).alias("roc_auc"),
        F.sum(recall_step * (here + prior) / 2).alias("pr_auc"),
        F.sum(recall_step * here).alias("average_precision"),
    )


def standard_at(preds: DataFrame, threshold: float) -> DataFrame:
    """One row: macro precision, recall and F1 over both classes, and accuracy, at a threshold; 0 where nothing is predicted."""
    hit = F.col("p") >= F.lit(float(threshold))
    y = F.col("y")
    c = usable(preds).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & ~y).alias("tn"), F.count_if(~hit & y).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    d = lambda a, b: safe_divide(a, b, 0.0)
    return c.select(
        "tp", "fp", "tn", "fn",
        ((d(tp, tp + fp) + d(tn, tn + fn)) / 2).alias("macro_precision"),
        ((d(tp, tp + fn) + d(tn, tn + fp)) / 2).alias("macro_recall"),
        ((d(2 * tp, 2 * tp + fp + fn) + d(2 * tn, 2 * tn + fp + fn)) / 2).alias("macro_f1"),
        d(tp + tn, tp + fp + tn + fn).alias("accuracy"),
    )


def evaluate_binary(preds: DataFrame, threshold: float, epsilon: float = 1e-15) -> DataFrame:
    """One wide row with every measure; the parts are one-row frames."""
    p, y = F.col("p"), F.col("y")
    clipped = F.least(F.greatest(p, F.lit(epsilon)), F.lit(1 - epsilon))
    loss = -F.ln(F.when(y, clipped).otherwise(1 - clipped))
    plain = usable(preds).agg(F.count(F.lit(1)).alias("n"), F.avg(y.cast("int")).alias("base_rate"), F.avg("p").alias("mean_p"), F.avg(F.pow(p - y.cast("double"), 2.0)).alias("brier"), F.avg(loss).alias("log_loss"))
    top = top_fraction(preds).select(F.col("recall").alias("top_recall"), F.col("precision").alias("top_precision"), F.col("lift").alias("top_lift"))
    parts = [plain, ranking_quality(preds), grid_pr_auc(threshold_sweep(preds)), top, calibration_error(calibration_width(preds)), standard_at(preds, threshold)]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)


def compare_models(named: dict[str, DataFrame]) -> DataFrame:
    """A row of measures for each model, by name."""
    return reduce(DataFrame.unionByName, [df.withColumn("model_name", F.lit(n)) for n, df in named.items()])
