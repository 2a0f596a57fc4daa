"""Queries that reconcile views and decisions with what they come from, sound and with faults put in, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import aggregates, reconcile
from tidemark.operators.activate import CATEGORIES, OUTCOMES
from tidemark.plans import run_queries as runs_
from tidemark.plans.panel_queries import FEATURES, features, rounded
from tidemark.plans.run_queries import DECIDED, FAULTS, PREDS, RUN
from tidemark.sources import demo
from tidemark.sources.scratch import materialise


def _told(checks: DataFrame) -> DataFrame:
    return checks.withColumn("observed", F.col("observed").cast("long")).drop("low", "high")


def all_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five views, each against its recomputation."""
    preds = materialise(demo.predictions(spark, sf_dir), "predictions")
    audit, made = runs_.runs(spark, sf_dir)
    audit = materialise(audit, "audit")
    views = {"daily_summary": aggregates.scoring_daily_summary(preds), "risk_distribution": aggregates.risk_distribution(preds)}
    views |= {n: v for n, v in runs_.run_views(audit, made).items() if n in reconcile.VIEWS}
    return _told(reconcile.reconcile_views(views, preds, audit, made))


def changed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A risk view in which cells were raised, days are missing, others repeated, and a band has another name."""
    preds = materialise(demo.predictions(spark, sf_dir), "predictions")
    view, day = aggregates.risk_distribution(preds), F.dayofmonth("prediction_date")
    kept = view.filter(day % 7 != 0).withColumn("band_rows", F.when(day % 5 == 0, F.col("band_rows") + 1).otherwise(F.col("band_rows")))
    kept = kept.withColumn("risk_band", F.when((day == 3) & (F.col("band_order") == 1), F.lit("unknown")).otherwise(F.col("risk_band")))
    return _told(reconcile.reconciled(kept.unionByName(kept.filter(day == 4)), reconcile.bands_again(preds), *reconcile.VIEWS["risk_distribution"]))


def decision_sources(spark: SparkSession, sf_dir: str, faults: bool) -> DataFrame:
    """Decisions against their predictions; with faults, ids were exchanged, rows lost and repeated, probabilities lost."""
    made, preds = runs_.decisions(spark, sf_dir), demo.predictions(spark, sf_dir)
    if faults:
        e = F.col("entity_id")
        odd = made.filter(e % 11 != 0).withColumn("probability", F.when(e % 7 != 0, F.col("probability"))).withColumn("entity_id", F.when(e % 9 == 0, e + 1_000_000).otherwise(e))
        made = odd.unionByName(made.filter(e % 13 == 1))
    return _told(reconcile.source_checks(made, preds))


def audits(spark: SparkSession, sf_dir: str, faults: bool) -> DataFrame:
    """Each day's decisions as a run of their own, against its audit row; with faults, counters were moved, rows repeated and runs lost."""
    made = runs_.decisions(spark, sf_dir).withColumn("run_id", F.col("prediction_date").cast("string"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("priority_rank"))  # a run selects at most its capacity
    chosen = made.filter("priority_rank IS NOT NULL").withColumn("priority_rank", place)
    made = materialise(made.filter("priority_rank IS NULL").unionByName(chosen), "decisions-by-day")
    told = made.groupBy("run_id").agg(F.count(F.lit(1)).alias("source_rows"), F.count_distinct("entity_id").alias("entities"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.max("threshold").alias("threshold"))
    if faults:
        day = F.dayofmonth(F.col("run_id").cast("date"))
        moved = told.withColumn("no_contact_capacity", F.col("no_contact_capacity") + F.when(day % 3 == 0, F.lit(1)).otherwise(F.lit(0))).withColumn("threshold", F.when(day % 4 != 0, F.col("threshold")))
        told = moved.filter(day % 10 != 0).unionByName(moved.filter(day == 2))
        made = made.withColumn("policy_id", F.when((day == 5) & (F.col("entity_id") % 2 == 0), F.lit("other")).otherwise(F.col("policy_id")))
    return _told(reconcile.audit_checks(made, told))


def empty_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four run views over no runs, and the same with a cell filled in; how many of their checks fail."""
    audit, made = runs_.runs(spark, sf_dir)
    views = runs_.run_views(audit.limit(0), made.limit(0))
    column = {"run_summary": "source_rows", "outcome_summary": "rows", "reason_summary": "share_of_run", "selection_summary": "category"}
    parts = []
    for name, view in views.items():
        for kind, v in (("sound", view), ("filled", view.withColumn(column[name], F.lit(0).cast(dict(view.dtypes)[column[name]])))):
            parts.append(reconcile.empty_state_checks(v).agg(F.lit(name).alias("view_name"), F.lit(kind).alias("kind"), F.count_if(~F.col("passed")).alias("failed")))
    return reduce(DataFrame.unionByName, parts)


def broken_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bands of predictions with every fault; the source's counters say which."""
    return rounded(aggregates.risk_distribution(materialise(runs_.broken_predictions(spark, sf_dir), "broken-predictions")))


def broken_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed outcomes of features in which some entities' rows are repeated."""
    rows = materialise(features(spark, sf_dir), "features")
    return rounded(aggregates.observed_outcomes(rows.unionByName(rows.filter(F.col("entity_id") % 17 == 0))))


def moved_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of a run in which some decisions have another known outcome than the audit counted."""
    audit, made = runs_.runs(spark, sf_dir)
    moved = made.withColumn("outcome", F.when((F.col("entity_id") % 5 == 0) & (F.col("outcome") == "no_contact_excluded"), F.lit("no_contact_capacity")).otherwise(F.col("outcome")))
    return rounded(aggregates.outcome_summary(audit, moved))


def broken_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections of a run of which some lack a category or have an unknown one, and decisions that have one but were not selected."""
    audit, made = runs_.runs(spark, sf_dir)
    rank, category = F.col("priority_rank"), F.col("category")
    leaked = F.when(F.col("entity_id") % 5 == 0, F.lit("goal_planning"))
    odd = made.withColumn("category", F.when(rank.isNull(), leaked).when(rank % 3 == 0, F.lit(None)).when(rank % 3 == 1, F.lit("unknown")).otherwise(category))
    return rounded(aggregates.selection_summary(audit, odd))


QUERIES = {
    "risk_distribution_faults": broken_risk,
    "observed_outcomes_faults": broken_outcomes,
    "outcome_summary_faults": moved_outcomes,
    "selection_summary_faults": broken_selections,
    "view_reconciliation": all_views,
    "view_reconciliation_faults": changed_view,
    "decision_sources": lambda s, d: decision_sources(s, d, False),
    "decision_sources_faults": lambda s, d: decision_sources(s, d, True),
    "run_audits": lambda s, d: audits(s, d, False),
    "run_audits_faults": lambda s, d: audits(s, d, True),
    "empty_states": empty_states,
}

_AUDITED = ("source_rows", "entities", *OUTCOMES, "threshold")
_AUDIT_CHECKS = ["runs_without_decisions", "decisions_without_run", "repeated_runs", *[f"{c}_differs" for c in _AUDITED], "unknown_outcomes", "mixed_thresholds", "mixed_policies", "mixed_models", "rank_gaps"]
_SOURCE_CHECKS = ["ids_missing", "ids_not_of_source", "null_ids", *[f"{c}_differs" for c in ("probability", "threshold", "model_name")]]


def _zero(checks: list[str], observed: dict[str, str]) -> str:
    """A row for each check: what the SQL `observed` says of it, else 0; a check passes at 0."""
    return " UNION ALL ".join(f"SELECT '{c}' AS check_name, ({observed.get(c, '0')})::bigint AS observed, ({observed.get(c, '0')}) = 0 AS passed" for c in checks)


def _view_sql() -> str:
    rows = {"daily_summary": "SELECT count(DISTINCT prediction_date) FROM preds", "risk_distribution": "SELECT 5 * count(DISTINCT prediction_date) FROM preds", "outcome_summary": "6", "reason_summary": "11", "selection_summary": "4"}
    parts = []
    for name, (_, columns) in reconcile.VIEWS.items():
        parts.append(f"SELECT 'rows' AS check_name, ({rows[name]})::bigint AS observed, true AS passed, '{name}' AS view_name")
        parts += [f"SELECT '{c}', 0, true, '{name}'" for c in ("missing_keys", "extra_keys", "repeated_keys", *[f"{x}_differs" for x in columns])]
    return f"WITH {PREDS} " + " UNION ALL ".join(parts)


_CELLS = """,
cells AS (SELECT d.prediction_date, day(d.prediction_date) AS day, b.i AS band FROM (SELECT DISTINCT prediction_date FROM preds) d, (SELECT unnest([1, 2, 3, 4, 5]) AS i) b),
kept AS (SELECT * FROM cells WHERE day % 7 <> 0)"""
_LOST = "decided WHERE entity_id % 11 <> 0"
_META = "invalid_reason IS NULL AS is_valid, 'synthetic' AS data_status, 'aggregate_monitoring' AS intended_use, false AS contains_identifiers"
_TOLD = """CASE WHEN null_p > 0 THEN 'null_probability' WHEN out_of_range_p > 0 THEN 'probability_out_of_range' WHEN threshold_mismatch > 0 THEN 'threshold_mismatch' WHEN duplicate_keys > 0 THEN 'duplicate_keys' END AS invalid_reason"""
_COUNTER = " ".join(f"WHEN '{o}' THEN {o}" for o in OUTCOMES)
SQL = {
    "risk_distribution_faults": FAULTS.split("days AS (")[0] + f"""
bands AS (SELECT * FROM (VALUES ('0.0-0.2', 1), ('0.2-0.4', 2), ('0.4-0.6', 3), ('0.6-0.8', 4), ('0.8-1.0', 5)) b(risk_band, band_order)),
placed AS (SELECT *, CASE WHEN probability < 0.2 THEN 1 WHEN probability < 0.4 THEN 2 WHEN probability < 0.6 THEN 3 WHEN probability < 0.8 THEN 4 ELSE 5 END AS band_order FROM broken),
own AS (SELECT prediction_date, count(*) AS day_rows FROM broken GROUP BY 1), cells AS (SELECT prediction_date, band_order, count(*) AS n, count(DISTINCT entity_id) AS m FROM placed GROUP BY ALL),
grid AS (SELECT o.prediction_date, risk_band, day_rows, b.band_order, coalesce(n, 0) AS band_rows, coalesce(m, 0) AS entities, round(coalesce(n, 0) / day_rows::double, 6) AS share_of_day, told.*
  FROM own o CROSS JOIN bands b CROSS JOIN told LEFT JOIN cells c ON c.prediction_date = o.prediction_date AND c.band_order = b.band_order),
judged AS (SELECT *, {_TOLD} FROM grid)
SELECT *, {_META} FROM judged""",
    "observed_outcomes_faults": f"""WITH {FEATURES}, twice AS (SELECT * FROM features UNION ALL SELECT * FROM features WHERE entity_id % 17 = 0),
d AS (SELECT (count(*) - count(DISTINCT (entity_id, prediction_date)))::bigint AS duplicate_keys FROM twice),
o AS (SELECT prediction_date, count(*) AS labelled_rows, count(*) FILTER (will_miss) AS missed, count(*) FILTER (NOT will_miss) AS met, round(count(*) FILTER (will_miss) / count(*)::double, 6) AS missed_rate, prediction_date + 7 AS outcome_window_end
  FROM twice WHERE will_miss IS NOT NULL GROUP BY prediction_date), j AS (SELECT *, CASE WHEN duplicate_keys > 0 THEN 'duplicate_keys' END AS invalid_reason FROM o, d)
SELECT *, {_META} FROM j""",
    "outcome_summary_faults": f"""WITH {RUN}, dim AS (SELECT * FROM (VALUES {', '.join(f"('{o}', {i})" for i, o in enumerate(OUTCOMES, 1))}) d(outcome, outcome_order)),
odd AS (SELECT CASE WHEN entity_id % 5 = 0 AND outcome = 'no_contact_excluded' THEN 'no_contact_capacity' ELSE outcome END AS outcome FROM decided), n AS (SELECT outcome, count(*) AS rows FROM odd GROUP BY 1),
f AS (SELECT run_id, dim.outcome, source_rows, outcome_order, coalesce(n.rows, 0) AS rows, 0 AS unexpected_rows, (SELECT count(*) FROM odd) AS recognised_rows, 0 AS orphan_rows, CASE dim.outcome {_COUNTER} END AS audited_rows FROM run CROSS JOIN dim LEFT JOIN n ON n.outcome = dim.outcome),
j AS (SELECT *, round(rows / source_rows::double, 6) AS share_of_run, CASE WHEN rows <> audited_rows THEN 'outcome_mismatch' END AS invalid_reason, 'available' AS view_state FROM f)
SELECT *, {_META} FROM j""",
    "selection_summary_faults": f"""WITH {RUN}, dim AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(CATEGORIES, 1))}) d(category, category_order)),
odd AS (SELECT priority_rank IS NOT NULL AS chosen, CASE WHEN priority_rank IS NULL THEN CASE WHEN entity_id % 5 = 0 THEN 'goal_planning' END WHEN priority_rank % 3 = 0 THEN NULL WHEN priority_rank % 3 = 1 THEN 'unknown' ELSE category END AS category FROM decided),
n AS (SELECT category, count(*) AS rows FROM odd WHERE chosen GROUP BY 1),
t AS (SELECT count_if(chosen)::bigint AS selected_rows, count_if(chosen AND category IS NULL)::bigint AS missing_category, count_if(chosen AND category = 'unknown')::bigint AS unexpected_category, count_if(NOT chosen AND category IS NOT NULL)::bigint AS leaked_category FROM odd),
f AS (SELECT run_id, dim.category, selected_for_review AS audited_selected, category_order, coalesce(n.rows, 0) AS rows, t.*, 0 AS orphan_rows, round(coalesce(n.rows, 0) / selected_rows::double, 6) AS share_of_selected, 'pending' AS review_status
  FROM run CROSS JOIN dim CROSS JOIN t LEFT JOIN n ON n.category = dim.category),
j AS (SELECT *, CASE WHEN missing_category > 0 THEN 'missing_category' WHEN unexpected_category > 0 THEN 'unexpected_category' WHEN leaked_category > 0 THEN 'leaked_category' WHEN selected_rows <> audited_selected THEN 'selected_mismatch' END AS invalid_reason, 'available' AS view_state FROM f)
SELECT *, {_META} FROM j""",
    "view_reconciliation": _view_sql(),
    "view_reconciliation_faults": f"WITH {PREDS}{_CELLS} SELECT 'rows' AS check_name, (SELECT count(*) + count(*) FILTER (day = 3 AND band = 1) FROM cells)::bigint AS observed, true AS passed UNION ALL "
    + _zero(
        ["missing_keys", "extra_keys", "repeated_keys", "band_order_differs", "band_rows_differs", "share_of_day_differs"],
        {
            "missing_keys": "SELECT count(*) FROM cells WHERE day % 7 = 0 OR day = 3 AND band = 1", "extra_keys": "SELECT count(*) FROM kept WHERE day = 3 AND band = 1",
            "repeated_keys": "SELECT count(*) FROM kept WHERE day = 4", "band_rows_differs": "SELECT count(*) FROM kept WHERE day % 5 = 0",
        },
    ),
    "decision_sources": f"WITH {DECIDED} " + _zero(_SOURCE_CHECKS, {}),
    "decision_sources_faults": f"WITH {DECIDED} "
    + _zero(
        _SOURCE_CHECKS,
        {
            "ids_missing": "SELECT count(*) FROM decided WHERE (entity_id % 11 = 0 OR entity_id % 9 = 0) AND entity_id % 13 <> 1",
            "ids_not_of_source": f"SELECT (SELECT count(*) FROM {_LOST} AND entity_id % 9 = 0) + (SELECT count(*) FROM {_LOST} AND entity_id % 9 <> 0 AND entity_id % 13 = 1)",
            "probability_differs": f"SELECT count(*) FROM {_LOST} AND entity_id % 9 <> 0 AND entity_id % 7 = 0 AND entity_id % 13 <> 1",
        },
    ),
    "run_audits": f"WITH {DECIDED} " + _zero(_AUDIT_CHECKS, {}),
    "run_audits_faults": f"WITH {DECIDED}, days AS (SELECT prediction_date, day(prediction_date) AS day, count(*) FILTER (entity_id % 2 = 0) AS even, count(*) AS n FROM decided GROUP BY ALL) "
    + _zero(
        _AUDIT_CHECKS,
        {
            "decisions_without_run": "SELECT count(*) FROM days WHERE day % 10 = 0", "repeated_runs": "SELECT count(*) FROM days WHERE day = 2",
            "no_contact_capacity_differs": "SELECT count(*) FROM days WHERE day % 3 = 0 AND day % 10 <> 0", "threshold_differs": "SELECT count(*) FROM days WHERE day % 4 = 0 AND day % 10 <> 0",
            "mixed_policies": "SELECT count(*) FROM days WHERE day = 5 AND even > 0 AND even < n",
        },
    ),
    "empty_states": "SELECT unnest(['run_summary', 'outcome_summary', 'reason_summary', 'selection_summary']) AS view_name, 'sound' AS kind, 0 AS failed UNION ALL SELECT unnest(['run_summary', 'outcome_summary', 'reason_summary', 'selection_summary']), 'filled', 1",
}
