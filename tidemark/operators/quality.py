"""Data-quality suites: many rules in one aggregate pass, as a long table of checks; and panel profiles."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators.activate import CATEGORIES, REASONS


@dataclass(frozen=True)
class Rule:
    """An aggregate that must lie in [low, high]; equal bounds state one expected value."""

    name: str
    observed: Column
    low: float
    high: float


def none(name: str, bad: Column) -> Rule:
    """No row may meet `bad`; a null counts as no."""
    return Rule(name, F.count_if(bad), 0, 0)


def run_checks(df: DataFrame, rules: list[Rule], strict: bool = False) -> DataFrame:
    """check_name, observed, low, high, passed: every rule from one pass over df. strict: a failure is an error when rows are read."""
    wide = df.agg(*[r.observed.cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    rows = wide.select(F.inline(F.array(*[F.struct(F.lit(r.name).alias("check_name"), F.col(f"r{i}").alias("observed"), F.lit(float(r.low)).alias("low"), F.lit(float(r.high)).alias("high")) for i, r in enumerate(rules)])))
    passed = F.coalesce(F.col("observed").between(F.col("low"), F.col("high")), F.lit(False))
    if strict:
        passed = F.when(passed, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("failed: "), "check_name")).cast("boolean"))
    return rows.withColumn("passed", passed)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row, `duplicates`: rows beyond the first of each key tuple."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))


def panel_rules(domains: dict[str, list[str]] | None = None, outlier_above: float = 20000, max_delay: int = 3) -> list[Rule]:
    """Rules of the daily panel: flags that agree with their columns, arrivals, delays, closed domains."""
    rules = [
        Rule("rows", F.count(F.lit(1)), 1, float("inf")),
        none("null_keys", F.col("entity_id").isNull() | F.col("activity_date").isNull()),
        none("missing_flag_disagrees", ~F.col("is_missing").eqNullSafe(F.col("purchase_amount").isNull())),
        none("outlier_flag_disagrees", ~F.col("is_outlier").eqNullSafe(F.col("amount") > outlier_above)),
        none("late_flag_disagrees", ~F.col("is_late").eqNullSafe(F.col("delay_days") > 0)),
        none("delay_out_of_range", ~F.col("delay_days").between(0, max_delay)),
        none("arrival_differs", ~F.col("available_date").eqNullSafe(F.date_add("activity_date", F.col("delay_days").cast("int")))),
        none("negative_amount", F.col("amount") < 0),
        none("goal_missing", F.col("goal").isNull()),
        Rule("late_rate", F.avg(F.col("is_late").cast("int")), 0.0, 1.0),
    ]
    return rules + [none(f"{c}_outside_domain", ~F.col(c).isin(allowed)) for c, allowed in (domains or {}).items()]


def label_rules(horizon: int = 7) -> list[Rule]:
    """Rules on labels; needs rows_after (rows that follow in the entity): null exactly in the last `horizon` rows, and consistent."""
    last = F.col("rows_after") < horizon
    return [
        none("label_in_last_days", last & F.col("will_miss").isNotNull()),
        none("label_missing_earlier", ~last & F.col("will_miss").isNull()),
        none("label_disagrees", F.col("will_miss").eqNullSafe(F.col("goal_met")) & F.col("will_miss").isNotNull()),
        none("goal_met_disagrees", (F.col("future_amount") >= F.col("goal")) != F.col("goal_met")),
    ]


def with_rows_after(panel: DataFrame) -> DataFrame:
    """panel with rows_after: the rows of the entity that follow."""
    back = Window.partitionBy("entity_id").orderBy(F.desc("activity_date"))
    return panel.withColumn("rows_after", F.row_number().over(back) - 1)


def feature_rules(history: int, least_days: int, trends: dict[str, tuple[str, str]], rates: list[str]) -> list[Rule]:
    """Rules of as-of features: window bounds, no future and no unavailable row, coverage, rates in [0, 1], trend identities."""
    rules = [
        none("window_start_differs", F.col("window_start") != F.date_sub("prediction_date", history)),
        none("window_end_differs", F.col("window_end") != F.date_sub("prediction_date", 1)),
        none("future_activity", F.col("max_activity_date") >= F.col("prediction_date")),
        none("unavailable_record", F.col("max_available_date") > F.col("prediction_date")),
        none("coverage_differs", F.col("available_days") + F.col("unavailable_days") != history),
        none("too_few_days", F.col("available_days") < least_days),
    ]
    rules += [none(f"{r}_out_of_range", ~F.col(r).between(0.0, 1.0)) for r in rates]
    return rules + [none(f"{t}_differs", F.abs(F.col(t) - (F.col(a) - F.col(b))) > 1e-9) for t, (a, b) in trends.items()]


def split_rules(ranges: dict[str, tuple[str, str]], unlabelled: str = "scoring") -> list[Rule]:
    """Rules of a chronological split: every split present, inside its dates, in order and apart, labelled unless it is to be scored."""
    rules, s, date = [], F.col("dataset_split"), F.col("prediction_date")
    for split, (a, b) in ranges.items():
        rules += [
            Rule(f"{split}_rows", F.count_if(s == split), 1, float("inf")),
            none(f"{split}_outside_dates", (s == split) & ~date.between(F.lit(a).cast("date"), F.lit(b).cast("date"))),
            none(f"{split}_labels", (s == split) & (F.col("will_miss").isNotNull() if split == unlabelled else F.col("will_miss").isNull())),
        ]
    names = list(ranges)
    for one, two in zip(names, names[1:], strict=False):
        gap = F.datediff(F.min(F.when(s == two, date)), F.max(F.when(s == one, date)))
        rules.append(Rule(f"{one}_before_{two}", gap, 1, float("inf")))
    return rules


def prediction_rules(threshold: float) -> list[Rule]:
    """Rules of scored rows: probabilities in range, flags that agree, one threshold, and scores that differ."""
    p = F.col("probability")
    return [
        none("null_probability", p.isNull()), none("probability_out_of_range", ~p.between(0.0, 1.0)), none("flag_disagrees", ~F.col("is_high").eqNullSafe(p >= threshold)),
        none("threshold_differs", F.col("threshold") != threshold), Rule("distinct_probabilities", F.approx_count_distinct(p), 2, float("inf")), Rule("models", F.count_distinct("model_name"), 1, 1),
    ]


def evaluation_rules() -> list[Rule]:
    """Rules of an evaluation row: its confusion counts add up, measures are in range, PR-AUC beats the base rate, calibration holds."""
    inside = [none(f"{c}_out_of_range", ~F.col(c).between(0.0, 1.0)) for c in ("base_rate", "mean_p", "brier", "roc_auc", "pr_auc", "average_precision", "ece", "macro_f1", "accuracy")]
    return [none("confusion_total_differs", F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn") != F.col("n")), none("pr_auc_below_base_rate", F.col("pr_auc") <= F.col("base_rate")), none("lift_not_above_one", F.col("top_lift") <= 1), none("ece_above_limit", F.col("ece") > 0.10), *inside]


def decision_rules(capacity: int) -> list[Rule]:
    """Rules of decisions: allowed codes that fit, rank and category on selected rows alone, ranks 1 to n, one policy, model, threshold and time."""
    chosen, rank = F.col("outcome") == "selected_for_review", F.col("priority_rank")
    fits = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return [
        none("unknown_reason", ~F.col("reason").isin(*REASONS)), none("reason_outcome_mismatch", fits[F.col("reason")] != F.col("outcome")),
        none("rank_misplaced", chosen != rank.isNotNull()), none("category_misplaced", chosen != F.col("category").isNotNull()), none("unknown_category", ~F.col("category").isin(*CATEGORIES)),
        Rule("selected", F.count_if(chosen), 0, capacity), Rule("rank_gap", F.coalesce(F.max(rank), F.lit(0)) - F.count_distinct(rank), 0, 0), Rule("first_rank", F.coalesce(F.min(rank), F.lit(1)), 1, 1),
        *[Rule(f"{c}_values", F.count_distinct(c), 1, 1) for c in ("policy_id", "model_name", "threshold", "decided_at")],
    ]


def view_rules(share: str | None = None, groups: int | None = None) -> list[Rule]:
    """Rules of an aggregate view: rows, validity, governance columns; shares that sum to 1 in each of `groups` groups."""
    rules = [Rule("rows", F.count(F.lit(1)), 1, float("inf")), none("invalid_rows", ~F.col("is_valid").eqNullSafe(True)), none("metadata_missing", F.col("data_status").isNull() | F.col("intended_use").isNull())]
    return rules + ([Rule("share_total", F.sum(share) / groups, 1 - 1e-9, 1 + 1e-9)] if share else [])


def suite_rules(rows: int, total: tuple[Column, float] | None = None, share: tuple[str, int] | None = None, codes: tuple[str, list[str]] | None = None) -> list[Rule]:
    """Rules of a governed view against its source: how many rows it has, a total that reconciles, shares that sum to 1 in each of so many
    groups, codes that are all there and no others; and rows that are valid and carry their metadata."""
    rules = [Rule("rows", F.count(F.lit(1)), rows, rows), none("invalid_rows", ~F.col("is_valid").eqNullSafe(True)), none("reasons", F.col("invalid_reason").isNotNull())]
    rules += [none("metadata_missing", F.col("data_status").isNull() | F.col("intended_use").isNull() | F.col("contains_identifiers").isNull())]
    rules += [Rule("total", F.coalesce(total[0], F.lit(0)), total[1], total[1])] if total else []
    rules += [Rule("share_total", F.round(F.sum(share[0]) / share[1], 9), 1 - 1e-9, 1 + 1e-9)] if share else []
    if codes:
        rules += [none("unknown_code", ~F.col(codes[0]).isin(codes[1])), Rule("codes", F.count_distinct(codes[0]), len(codes[1]), len(codes[1]))]
    return rules


def empty_state_rules() -> list[Rule]:
    """Rules of a view over no runs: one row, which says so and holds nothing else."""
    return [Rule("rows", F.count(F.lit(1)), 1, 1), none("not_empty_state", ~F.col("view_state").eqNullSafe("no_activation_runs")), none("fabricated", F.col("run_id").isNotNull())]


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, missing_rate, one pass."""
    return df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns]).unpivot([], columns, "column_name", "missing_rate")


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n, mean, std, min, p1, p50, p99, max: one pass, and exact quantiles from distributed ranks."""
    told = exact_quantiles(df, columns, [0.01, 0.5, 0.99])
    one = lambda c: F.struct(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max")).alias(c)
    wide = df.agg(*[one(c) for c in columns])
    quantiles = lambda c: [F.lit(v).cast("double").alias(n) for n, v in zip(("p1", "p50", "p99"), told[c] or [None] * 3, strict=True)]
    rows = [F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}.{m}").alias(m) for m in ("n", "mean", "std", "min")], *quantiles(c), F.col(f"{c}.max").alias("max")) for c in columns]
    return wide.select(F.inline(F.array(*rows)))


def category_shares(df: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """column_name, value, entities, share: each category's share of the distinct entities that have a value."""
    stacked = df.select(entity, F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]))).distinct()
    counts = stacked.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("entities"))
    return counts.withColumn("share", F.col("entities") / F.sum("entities").over(Window.partitionBy("column_name")))


def label_rates(df: DataFrame, label: str, groups: list[str]) -> DataFrame:
    """group_name, value, labelled, rate for every subgroup column, in one pass over df."""
    stacked = df.filter(F.col(label).isNotNull()).select(label, F.inline(F.array(*[F.struct(F.lit(c).alias("group_name"), F.col(c).cast("string").alias("value")) for c in groups])))
    return stacked.groupBy("group_name", "value").agg(F.count(F.lit(1)).alias("labelled"), F.avg(F.col(label).cast("int")).alias("rate"))


def flag_rates(df: DataFrame, flags: list[str]) -> DataFrame:
    """column_name, rate: how often a flag is set, nulls as not set."""
    return df.agg(*[F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")).alias(c) for c in flags]).unpivot([], flags, "column_name", "rate")


def profile_panel(panel: DataFrame, entity: str, label: str, numeric: list[str], flags: list[str], groups: list[str]) -> DataFrame:
    """section, item, measure, value: the panel's profile as one long table."""
    rows = panel.groupBy(entity).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("entities"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"))
    balance = panel.agg(F.avg(F.col(label).cast("int")).alias("rate"), F.avg(F.col(label).isNull().cast("int")).alias("missing"))
    long = lambda df, section, item, measures: df.unpivot([item], measures, "measure", "value").select(F.lit(section).alias("section"), F.col(item).cast("string").alias("item"), "measure", F.col("value").cast("double").alias("value"))
    cast = lambda df, measures: df.withColumns({m: F.col(m).cast("double") for m in measures})
    stats = ["n", "mean", "std", "min", "p1", "p50", "p99", "max"]
    parts = [
        long(cast(rows, ["rows", "entities", "min_rows", "max_rows"]).withColumn("item", F.lit("panel")), "volume", "item", ["rows", "entities", "min_rows", "max_rows"]),
        long(balance.withColumn("item", F.lit(label)), "label", "item", ["rate", "missing"]),
        long(flag_rates(panel, flags), "flag", "column_name", ["rate"]),
        long(missing_rates(panel, numeric), "missing", "column_name", ["missing_rate"]),
        long(cast(numeric_summary(panel, numeric), stats), "numeric", "column_name", stats),
        long(cast(label_rates(panel, label, groups).withColumn("item", F.concat_ws("=", "group_name", F.coalesce("value", F.lit("null")))), ["labelled", "rate"]), "subgroup", "item", ["labelled", "rate"]),
    ]
    return reduce(DataFrame.unionByName, parts)
