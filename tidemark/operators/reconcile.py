"""Reconciliation: a view against its recomputation by key, decisions against their source and their run's audit row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.activate import CATEGORIES, OUTCOMES, REASONS
from tidemark.operators.aggregates import BANDS, GOVERNANCE, band_of
from tidemark.operators.quality import Rule, none, run_checks
from tidemark.sources.tables import literal_rows


def both_sides(view: DataFrame, again: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """A row for each key of either side: keys, view_rows, source_rows, and each column's value on both (v_..., s_...).

    The sides are stacked and grouped, so null keys meet like others and partial sums apply; no join is made. With repeated keys,
    which are counted, a value is the largest.
    """
    side = lambda df, name: df.select(*keys, *columns, F.lit(name).alias("_side"))
    rows = side(view, "v").unionByName(side(again, "s"))
    on = lambda s, c: F.when(F.col("_side") == s, c)
    values = [F.max(on(s, F.col(c))).alias(f"{s}_{c}") for c in columns for s in ("v", "s")]
    return rows.groupBy(*keys).agg(F.count(on("v", F.lit(1))).alias("view_rows"), F.count(on("s", F.lit(1))).alias("source_rows"), *values)


def differs(column: str, kind: str, tolerance: float) -> Column:
    """Whether the two sides of a column differ: null-safe, doubles by more than the tolerance."""
    v, s = F.col(f"v_{column}"), F.col(f"s_{column}")
    if kind not in ("double", "float"):
        return ~v.eqNullSafe(s)
    return ~v.eqNullSafe(s) & F.coalesce(F.abs(v - s) > tolerance, F.lit(True))


def reconciled(view: DataFrame, again: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Checks of a view against its recomputation: keys that one side lacks, keys that repeat, and cells of each column that differ."""
    rows, kinds = both_sides(view, again, keys, columns), dict(view.dtypes)
    here, there = F.col("view_rows") > 0, F.col("source_rows") > 0
    rules = [Rule("rows", F.count(F.lit(1)), 1, float("inf")), none("missing_keys", ~here), none("extra_keys", ~there), none("repeated_keys", F.col("view_rows") > 1)]
    return run_checks(rows, rules + [none(f"{c}_differs", here & there & differs(c, kinds[c], tolerance)) for c in columns])


def _grid(runs: DataFrame, codes: list[tuple], schema: str) -> DataFrame:
    return runs.select("run_id").distinct().crossJoin(F.broadcast(literal_rows(runs.sparkSession, codes, schema)))  # a few fixed codes


def _share(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))


def daily_again(preds: DataFrame) -> DataFrame:
    """Day, rows, entities and high rows from the flags, entity by entity, not from the daily aggregate."""
    own = preds.groupBy("prediction_date", "entity_id").agg(F.count(F.lit(1)).alias("n"), F.sum("probability").alias("p"), F.count_if(F.col("probability") >= F.col("threshold")).alias("high"))
    days = own.groupBy("prediction_date").agg(F.sum("n").alias("scored_rows"), F.count("entity_id").alias("entities"), (F.sum("p") / F.sum("n")).alias("mean_probability"), F.sum("high").alias("high_rows"))
    return days.withColumn("high_rate", _share("high_rows", "scored_rows"))


def bands_again(preds: DataFrame) -> DataFrame:
    """Day x band, dense, in one wide aggregate that is turned into rows."""
    band = band_of(F.col("probability"))
    wide = preds.groupBy("prediction_date").agg(F.count(F.lit(1)).alias("day_rows"), *[F.count_if(band == b).alias(f"b{i}") for i, b in enumerate(BANDS)])
    rows = wide.select("prediction_date", "day_rows", F.inline(F.array(*[F.struct(F.lit(b).alias("risk_band"), F.lit(i + 1).alias("band_order"), F.col(f"b{i}").alias("band_rows")) for i, b in enumerate(BANDS)])))
    return rows.withColumn("share_of_day", F.coalesce(_share("band_rows", "day_rows"), F.lit(0.0)))


def outcomes_again(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Run x outcome: rows from the decisions, audited_rows from the run's counter."""
    counts = decisions.groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("n"))
    audited = runs.select("run_id", "source_rows", F.inline(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("audited_rows")) for o in OUTCOMES])))
    rows = _grid(runs, [(o, i) for i, o in enumerate(OUTCOMES, 1)], "outcome string, outcome_order int").join(audited, ["run_id", "outcome"]).join(counts, ["run_id", "outcome"], "left")
    return rows.withColumn("rows", F.coalesce("n", F.lit(0))).withColumn("share_of_run", _share("rows", "source_rows")).drop("n")


def reasons_again(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Run x reason: rows, and shares of the run's and the outcome's decisions."""
    codes = [(r, o, i) for i, (r, o) in enumerate(REASONS.items(), 1)]
    of = decisions.groupBy("run_id").agg(F.count(F.lit(1)).alias("run_rows"), *[F.count_if((F.col("reason") == r) & (F.col("outcome") == o)).alias(f"r{i}") for r, o, i in codes], *[F.count_if(F.col("outcome") == o).alias(f"o_{o}") for o in OUTCOMES])
    pieces = [F.struct(F.lit(r).alias("reason"), F.lit(o).alias("outcome"), F.lit(i).alias("reason_order"), F.coalesce(f"r{i}", F.lit(0)).alias("rows"), F.coalesce(f"o_{o}", F.lit(0)).alias("outcome_rows")) for r, o, i in codes]
    rows = runs.select("run_id", "source_rows").join(of, "run_id", "left").select("run_id", "source_rows", F.inline(F.array(*pieces)))
    return rows.withColumn("share_of_run", _share("rows", "source_rows")).withColumn("share_of_outcome", _share("rows", "outcome_rows"))


def selections_again(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Run x category of the selected rows."""
    chosen = decisions.filter(F.col("outcome") == OUTCOMES[0])
    counts, every = chosen.groupBy("run_id", "category").agg(F.count(F.lit(1)).alias("n")), chosen.groupBy("run_id").agg(F.count(F.lit(1)).alias("m"))
    rows = _grid(runs, [(c, i) for i, c in enumerate(CATEGORIES, 1)], "category string, category_order int").join(counts, ["run_id", "category"], "left").join(every, "run_id", "left")
    return rows.withColumns({"rows": F.coalesce("n", F.lit(0)), "selected_rows": F.coalesce("m", F.lit(0))}).withColumn("share_of_selected", _share("rows", "selected_rows")).drop("n", "m")


#: What each view is keyed by, and the columns that are recomputed.
VIEWS = {
    "daily_summary": (["prediction_date"], ["scored_rows", "entities", "mean_probability", "high_rows", "high_rate"]),
    "risk_distribution": (["prediction_date", "risk_band"], ["band_order", "band_rows", "share_of_day"]),
    "outcome_summary": (["run_id", "outcome"], ["outcome_order", "rows", "audited_rows", "share_of_run"]),
    "reason_summary": (["run_id", "reason"], ["outcome", "reason_order", "rows", "outcome_rows", "share_of_run", "share_of_outcome"]),
    "selection_summary": (["run_id", "category"], ["category_order", "rows", "selected_rows", "share_of_selected"]),
}


def reconcile_views(views: dict[str, DataFrame], preds: DataFrame, runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """view_name and the checks of reconciled() for each of `views`, which hold no empty state."""
    again = {
        "daily_summary": lambda: daily_again(preds), "risk_distribution": lambda: bands_again(preds), "outcome_summary": lambda: outcomes_again(runs, decisions),
        "reason_summary": lambda: reasons_again(runs, decisions), "selection_summary": lambda: selections_again(runs, decisions),
    }
    return reduce(DataFrame.unionByName, [reconciled(v, again[n](), *VIEWS[n]).withColumn("view_name", F.lit(n)) for n, v in views.items()])


def source_checks(decisions: DataFrame, preds: DataFrame) -> DataFrame:
    """Checks that decisions hold exactly the ids of their predictions, as often, with their probability, threshold and model."""
    keys, same = ["entity_id", "prediction_date"], ["probability", "threshold", "model_name"]
    rows, kinds = both_sides(decisions, preds, keys, same), dict(decisions.dtypes)
    both = (F.col("view_rows") > 0) & (F.col("source_rows") > 0)
    rules = [none("ids_missing", F.col("view_rows") < F.col("source_rows")), none("ids_not_of_source", F.col("view_rows") > F.col("source_rows")), none("null_ids", F.col("entity_id").isNull() | F.col("prediction_date").isNull())]
    return run_checks(rows, rules + [none(f"{c}_differs", both & differs(c, kinds[c], 0.0)) for c in same])


def audit_checks(decisions: DataFrame, runs: DataFrame) -> DataFrame:
    """Checks that each run's audit row says what its decisions do: totals, every outcome's counter, entities, and one policy, threshold and time."""
    told = decisions.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("source_rows"), F.count_distinct("entity_id").alias("entities"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.count_if(~F.col("outcome").isin(*OUTCOMES) | F.col("outcome").isNull()).alias("other_outcomes"),
        F.min("threshold").alias("threshold"), F.max("threshold").alias("_high"), F.count_distinct("policy_id").alias("policies"), F.count_distinct("model_name").alias("models"),
        F.coalesce(F.max("priority_rank"), F.lit(0)).cast("long").alias("_ranks"), F.count_distinct("priority_rank").alias("_distinct"),
    )
    columns = ["source_rows", "entities", *OUTCOMES, "threshold"]
    rows = both_sides(runs.select("run_id", *columns), told.select("run_id", *columns), ["run_id"], columns).join(told.select("run_id", "other_outcomes", "_high", "policies", "models", "_ranks", "_distinct"), "run_id", "left")
    both, kinds = (F.col("view_rows") > 0) & (F.col("source_rows") > 0), dict(runs.dtypes)
    rules = [none("runs_without_decisions", F.col("source_rows") == 0), none("decisions_without_run", F.col("view_rows") == 0), none("repeated_runs", F.col("view_rows") > 1)]
    rules += [none(f"{c}_differs", both & differs(c, kinds[c], 0.0)) for c in columns]
    rules += [none("unknown_outcomes", F.col("other_outcomes") > 0), none("mixed_thresholds", F.col("_high") != F.col("s_threshold")), none("mixed_policies", F.col("policies") != 1), none("mixed_models", F.col("models") != 1)]
    return run_checks(rows, rules + [none("rank_gaps", (F.col("_ranks") != F.col("_distinct")) | (F.col("_ranks") != F.col("s_selected_for_review")))])


def empty_state_checks(view: DataFrame) -> DataFrame:
    """Checks that a view over no runs is one row that says so: no other column may hold anything."""
    rules = [Rule("rows", F.count(F.lit(1)), 1, 1), none("not_empty_state", ~F.col("view_state").eqNullSafe("no_activation_runs"))]
    others = [c for c in view.columns if c != "view_state" and c not in GOVERNANCE]
    return run_checks(view, rules + [none(f"{c}_fabricated", F.col(c).isNotNull()) for c in others])
