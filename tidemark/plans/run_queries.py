"""Queries on drift, activation, aggregate views, monitoring, suites and models, with their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import activate, aggregates, drift, evaluate, model, monitor, quality
from tidemark.operators.activate import Policy
from tidemark.operators.monitor import FrozenModel, MonitoringPolicy
from tidemark.plans import panel_queries as base
from tidemark.plans.panel_queries import DAILY, FEATURES, LABELLED, PANEL, SPLIT, SWEEP, rounded
from tidemark.sources import demo, tables
from tidemark.sources.commits import TableSet
from tidemark.sources.scratch import materialise, scratch
from tidemark.sources.tables import file_facts

POLICY = Policy(capacity=10)
DRIFT_DAY = "2024-01-16"
NUMERIC = ["amount_sum", "amount_mean", "sessions_sum", "purchase_days", "late_days", "active_days"]
TYPES = ["click", "error", "purchase", "signup", "view"]


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events before and from DRIFT_DAY: value, k, event_type."""
    k = F.get_json_object("props", "$.k").cast("int")
    ev = demo.table(spark, sf_dir, "events").select((F.col("ts").cast("date") < F.lit(DRIFT_DAY).cast("date")).alias("is_ref"), "value", k.alias("k"), "event_type", F.when(k % 10 == 0, F.lit(None)).otherwise(k).alias("sparse"), F.lit(1).alias("constant"))
    return ev.filter("is_ref"), ev.filter("NOT is_ref")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decided once and kept, as each view refers to them several times."""
    return materialise(activate.decide(demo.predictions(spark, sf_dir), demo.contact_context(spark, sf_dir), POLICY, demo.DECISION_TIME), "decisions")


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The run audit and the decisions of one run, with a fixed run id."""
    made = decisions(spark, sf_dir).withColumn("run_id", F.lit("act_0123456789abcdef01234567"))
    ident = spark.range(1).select(F.lit("act_0123456789abcdef01234567").alias("run_id"), F.lit(demo.DECISION_TIME).cast("timestamp_ntz").alias("snapshot_at"))
    return activate.run_audit(made.drop("run_id"), POLICY, ident), made


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest the run twice into new tables; the second time appends nothing. One row of counts."""
    audit, made = runs(spark, sf_dir)
    paths = {n: scratch(spark, n) for n in ("decisions", "runs")}
    for name, df in (("decisions", made), ("runs", audit)):
        df.limit(0).write.parquet(paths[name])
    keys = {"decisions": ["run_id", "entity_id", "prediction_date"], "runs": ["run_id"]}
    stored = lambda: {n: (spark.read.parquet(paths[n]), df, keys[n], paths[n]) for n, df in (("decisions", made), ("runs", audit))}
    first, second = activate.ingest(stored()), activate.ingest(stored())
    rows = [(n, first[n], second[n]) for n in paths]
    told = spark.createDataFrame(rows, "table_name string, appended_first long, appended_again long")
    counts = spark.read.parquet(paths["decisions"]).agg(F.lit("decisions").alias("table_name"), F.count(F.lit(1)).alias("stored")).union(spark.read.parquet(paths["runs"]).agg(F.lit("runs"), F.count(F.lit(1))))
    return told.join(counts, "table_name")


def committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest the run into a set of tables in one commit, again, and with a second run of which a part is known; counts by table."""
    audit, made = runs(spark, sf_dir)
    audit = materialise(audit, "audit")
    schema = lambda df: ", ".join(f"{c} {t}" for c, t in df.dtypes)
    store = TableSet(spark, scratch(spark, "ingest-set"), {"decisions": schema(made), "runs": schema(audit)})
    keys = {"decisions": ["run_id", "entity_id", "prediction_date"], "runs": ["run_id"]}
    staged = lambda rows, run: {"decisions": (rows, keys["decisions"]), "runs": (run, keys["runs"])}
    other = lambda df: df.withColumn("run_id", F.lit("act_0123456789abcdef01234568"))
    told = [activate.ingest_atomic(store, staged(made, audit)), activate.ingest_atomic(store, staged(made, audit)), activate.ingest_atomic(store, staged(made.unionByName(other(made)), audit.unionByName(other(audit))))]
    rows = spark.createDataFrame([(t, *[x[t] for x in told], store.snapshot().version) for t in keys], "table_name string, appended_first long, appended_again long, appended_second_run long, version int")
    stored = reduce(DataFrame.unionByName, [store.read(t).agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("stored"), F.count_distinct("run_id").alias("stored_runs")) for t in keys])
    return rows.join(stored, "table_name")


def stored_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A changed batch of one month's decisions against all of them, stored by day in buckets of their keys."""
    keys, table = ["entity_id", "prediction_date"], f"tidemark_decisions_{uuid.uuid4().hex}"
    made = decisions(spark, sf_dir).withColumn("day", F.col("prediction_date"))
    tables.write_bucketed(made, table, keys, 8, "day")
    batch = made.filter(F.col("prediction_date") >= F.lit("2024-01-20").cast("date"))
    changed = batch.withColumn("reason", F.when(F.col("entity_id") % 7 == 0, F.lit("changed")).otherwise(F.col("reason")))
    told = materialise(activate.stored_conflicts(spark, table, changed, keys, "day"), "stored-conflicts")
    spark.sql(f"DROP TABLE {table}")
    return told


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the governed views; only what it needs is computed."""
    if name in ("daily_summary", "risk_distribution"):
        preds = materialise(demo.predictions(spark, sf_dir), "predictions")
        return aggregates.scoring_daily_summary(preds) if name == "daily_summary" else aggregates.risk_distribution(preds)
    if name == "observed_outcomes":
        return aggregates.observed_outcomes(base.features(spark, sf_dir))
    audit, made = runs(spark, sf_dir)
    return run_views(materialise(audit, "audit"), made)[name]


def run_views(audit: DataFrame, made: DataFrame) -> dict[str, DataFrame]:
    """The four views over the runs and their decisions."""
    over = {"outcome_summary": aggregates.outcome_summary, "reason_summary": aggregates.reason_summary, "selection_summary": aggregates.selection_summary}
    return {"run_summary": aggregates.run_summary(audit)} | {n: make(audit, made) for n, make in over.items()}


def sources(spark: SparkSession, sf_dir: str, audit: DataFrame | None) -> DataFrame:
    """The lineage of seven sources; without an audit the runs are a table that is not there."""
    t = lambda n: demo.table(spark, sf_dir, n)
    names = {"events": ("ts", "ts"), "orders": ("o_orderdate", None), "lineitem": ("l_shipdate", None), "customer": (None, None), "part": (None, None), "supplier": (None, None)}
    facts = reduce(DataFrame.unionByName, [file_facts(spark, n, f"{sf_dir}/{n}.parquet") for n in names])
    latest = lambda c: F.col(f"max_{c}") if c else F.lit(None)
    footers = {n: tables.footer_facts(spark, n, f"{sf_dir}/{n}.parquet", list({c for c in own if c})) for n, own in names.items()}
    counted = {n: f.select("row_count", latest(names[n][0]).alias("latest_business_date"), latest(names[n][1]).alias("latest_ingest")) for n, f in footers.items()}
    return aggregates.lineage({n: (t(n), *dates) for n, dates in names.items()} | {"runs": (audit, "decided_at" if audit is not None else None, None)}, "2024-02-06", facts=facts, counted=counted)


def lineage_of(spark: SparkSession, sf_dir: str, complete: bool) -> DataFrame:
    """The lineage without what depends on the files' place and time."""
    return no_time(sources(spark, sf_dir, runs(spark, sf_dir)[0] if complete else None).drop("total_bytes"))


def status(spark: SparkSession, sf_dir: str, found: dict[str, DataFrame] | None = None) -> DataFrame:
    found = found or all_views(spark, sf_dir)[0]
    return aggregates.quality_status(found, found["lineage"], {"daily_summary": "events", "risk_distribution": "events", "observed_outcomes": "events"})


def all_views(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The eight governed views, the lineage among them, each kept, as status and governance refer to them several times; and the audit."""
    audit, made = runs(spark, sf_dir)
    audit = materialise(audit, "audit")
    found = {n: view(spark, sf_dir, n) for n in ("daily_summary", "risk_distribution", "observed_outcomes")} | run_views(audit, made)
    found["lineage"] = sources(spark, sf_dir, audit)
    return {n: materialise(v, n) for n, v in found.items()}, audit


def governed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = all_views(spark, sf_dir)
    return monitor.governance_monitoring({k: found[k] for k in ("run_summary", "outcome_summary", "reason_summary", "selection_summary")}, status(spark, sf_dir, found), found["lineage"])


def view_suites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of all governed views against their sources, and of an empty one."""
    found, audit = all_views(spark, sf_dir)
    scored = demo.predictions(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("prediction_date").alias("days")).first()
    known = base.features(spark, sf_dir).filter("will_miss IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("prediction_date").alias("days")).first()
    run = audit.agg(F.count(F.lit(1)).alias("n"), F.sum("source_rows").alias("rows"), F.sum("selected_for_review").alias("selected")).first()
    total = lambda c: F.sum(c)
    rules = {
        "daily_summary": quality.suite_rules(scored.days, (total("scored_rows"), scored.n)),
        "risk_distribution": quality.suite_rules(5 * scored.days, (total("band_rows"), scored.n), ("share_of_day", scored.days), ("risk_band", list(aggregates.BANDS))),
        "observed_outcomes": quality.suite_rules(known.days, (F.sum(F.col("missed") + F.col("met")), known.n)),
        "run_summary": quality.suite_rules(run.n, (total("reconciled_rows"), run.rows)),
        "outcome_summary": quality.suite_rules(6 * run.n, (total("rows"), run.rows), ("share_of_run", run.n), ("outcome", list(activate.OUTCOMES))),
        "reason_summary": quality.suite_rules(11 * run.n, (total("rows"), run.rows), ("share_of_run", run.n), ("reason", list(activate.REASONS))),
        "selection_summary": quality.suite_rules(4 * run.n, (total("rows"), run.selected), None, ("category", list(activate.CATEGORIES))),
        "lineage": quality.suite_rules(monitor.LINEAGE_ROWS),
    }
    checks = [quality.run_checks(found[n], r).withColumn("view_name", F.lit(n)) for n, r in rules.items()]
    empty = quality.run_checks(aggregates.run_summary(audit.filter("source_rows < 0")), quality.empty_state_rules()).withColumn("view_name", F.lit("empty_run_summary"))
    return reduce(DataFrame.unionByName, [*checks, empty])


def broken_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with every fault: null and too large probabilities, flags that disagree, and a repeated key for some entities."""
    e, p = F.col("entity_id"), F.col("probability")
    rows = demo.predictions(spark, sf_dir).withColumns({"probability": F.when(e % 7 == 0, F.lit(None)).when(e % 11 == 0, F.lit(1.5)).otherwise(p), "is_high": F.when(e % 13 == 0, ~F.col("is_high")).otherwise(F.col("is_high"))})
    return rows.unionByName(rows.filter(e % 17 == 0))


def broken_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's decisions as a run; the day of the month says which fault its audit row has, if any."""
    made, day = decisions(spark, sf_dir), F.col("prediction_date")
    counts = made.groupBy("prediction_date").agg(F.count(F.lit(1)).alias("source_rows"), *[F.count_if(F.col("outcome") == o).alias(o) for o in activate.OUTCOMES])
    fault, n = F.dayofmonth("prediction_date") % 15, F.col
    only = lambda *pairs, rest: reduce(lambda a, p: F.when(n("fault") == p[0], p[1]).otherwise(a), pairs, rest)
    none, at = F.lit(None), lambda days: F.date_add(day, days).cast("timestamp_ntz")
    return counts.withColumn("fault", fault).withColumns({
        "run_id": only((1, none), (2, F.lit("run-1")), rest=F.concat(F.lit("act_"), F.date_format(day, "yyyyMMdd"))), "policy_id": only((3, none), rest=F.lit("p")), "model_name": only((4, none), rest=F.lit("m")),
        "decided_at": only((5, none), rest=at(2)), "snapshot_at": only((6, none), (8, at(3)), rest=at(1)), "threshold": only((7, F.lit(1.5)), (14, none), rest=F.lit(0.5)),
        "capacity": only((9, F.lit(0)), (10, F.greatest(n("selected_for_review") - 1, F.lit(1))), rest=F.lit(10)), "eligible": n("selected_for_review") + n("no_contact_capacity") - only((11, F.lit(1)), rest=F.lit(0)),
        "entities": n("source_rows") - n("no_contact_superseded") + only((12, F.lit(1)), rest=F.lit(0)), "no_contact_below_threshold": n("no_contact_below_threshold") + only((13, F.lit(1)), rest=F.lit(0)),
    })


def broken_decisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A run and decisions of which some have an unknown reason, one that does not fit, or belong to no run."""
    audit, made = runs(spark, sf_dir)
    e = F.col("entity_id")
    odd = made.withColumns({"reason": F.when(e % 5 == 0, F.lit("unknown")).when(e % 7 == 0, F.lit("active_case_open")).otherwise(F.col("reason")), "run_id": F.when(e % 11 == 0, F.lit("act_ffffffffffffffffffffffff")).otherwise(F.col("run_id"))})
    return audit, materialise(odd, "broken-decisions")


def batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training rows, scoring rows, and predictions for the latter by a fixed rule; features are computed once and kept."""
    p = F.col("late_days") / F.lit(14.0)
    rows = base.split_features(spark, sf_dir).filter("dataset_split IN ('train', 'scoring')")
    with_p = materialise(rows.withColumns({"probability": p, "is_high": p >= demo.THRESHOLD, "threshold": F.lit(demo.THRESHOLD), "model_name": F.lit("rule")}), "batch")
    return with_p.filter("dataset_split = 'train'"), with_p.filter("dataset_split = 'scoring'"), with_p.filter("dataset_split = 'scoring'").select("entity_id", "prediction_date", "probability", "is_high", "threshold", "model_name")


def model_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, scoring, preds = batch(spark, sf_dir)
    return monitor.model_monitoring(preds, scoring, train, ["active_days", "outlier_days"], 1050, 150, 7, "2024-01-30")


def run_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, scoring, preds = batch(spark, sf_dir)
    policy, frozen = MonitoringPolicy(expected_rows=1050, expected_entities=150, expected_days=7), FrozenModel("rule", demo.THRESHOLD, (*NUMERIC, "latest_type"))
    return rounded(monitor.monitoring_run(train, scoring, preds, train, NUMERIC, {"latest_type": TYPES}, policy, frozen, "run", demo.DECISION_TIME))


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that models use, computed once and kept: fitting passes over them many times."""
    return materialise(base.split_features(spark, sf_dir).select("entity_id", "prediction_date", "dataset_split", "will_miss", "latest_type", *NUMERIC), "model-rows")


def _model(rows: DataFrame, kind: str) -> tuple:
    fit = {"logistic": model.fit_logistic, "warehouse": model.fit_reference_coded, "gbt": model.fit_gbt}[kind]
    return fit(rows.filter("dataset_split = 'train'"), NUMERIC, ["latest_type"], "will_miss")


def scored_by(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = model_rows(spark, sf_dir)
    fitted, fills = _model(rows, kind)
    return model.score(fitted, fills, rows.filter("dataset_split IN ('validation', 'test', 'scoring')"), NUMERIC, demo.THRESHOLD, kind)


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both models' measures on the validation rows."""
    found, rows = {}, model_rows(spark, sf_dir)
    for kind in ("logistic", "gbt"):
        fitted, fills = _model(rows, kind)
        scored = model.score(fitted, fills, rows.filter("dataset_split = 'validation'"), NUMERIC, demo.THRESHOLD, kind, ("entity_id", "prediction_date", "will_miss"))
        scored = materialise(scored, "scored")  # each measure reads it
        found[kind] = evaluate.evaluate_binary(scored.select(F.struct("entity_id", "prediction_date").alias("key"), F.col("probability").alias("p"), F.col("will_miss").alias("y")), demo.THRESHOLD)
    return evaluate.compare_models(found)


def explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir)
    fitted, fills = _model(rows, "logistic")
    return model.explain_logistic(fitted, fitted.transform(model.prepared(rows, NUMERIC, fills)), NUMERIC)


def no_time(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c, t in df.dtypes if t.startswith("timestamp")])


QUERIES = {
    "numeric_psi": lambda s, d: rounded(drift.numeric_psi(*halves(s, d), ["value", "k", "sparse", "constant"])),
    "psi_bins": lambda s, d: drift.numeric_bins(*halves(s, d), ["value", "sparse"]),
    "categorical_psi": lambda s, d: rounded(drift.categorical_psi(*halves(s, d), ["event_type", "k"])),
    "unexpected_rates": lambda s, d: rounded(drift.unexpected_rates(halves(s, d)[1], {"event_type": ["view", "click"], "k": [str(i) for i in range(50)]})),
    "support_breaches": lambda s, d: rounded(drift.support_breaches(*batch(s, d)[:2], ["amount_sum", "active_days", "outlier_days", "late_days"])),
    "decide": lambda s, d: no_time(decisions(s, d)),
    "run_audit": lambda s, d: no_time(runs(s, d)[0]),
    "run_id": lambda s, d: activate.run_id(demo.predictions(s, d), POLICY, demo.DECISION_TIME),
    "review_queue": lambda s, d: activate.review_queue(decisions(s, d)),
    "ingest_audit": ingested,
    "ingest_commits": committed,
    "stored_conflicts": stored_conflicts,
    "ingest_conflicts": lambda s, d: activate.conflicts(decisions(s, d), decisions(s, d).withColumn("reason", F.when(F.col("entity_id") % 7 == 0, F.lit("changed")).otherwise(F.col("reason"))), ["entity_id", "prediction_date"]),
    "context_checks": lambda s, d: activate.context_errors(demo.contact_context(s, d), demo.DECISION_TIME),
    "daily_summary": lambda s, d: rounded(view(s, d, "daily_summary")),
    "risk_distribution": lambda s, d: rounded(view(s, d, "risk_distribution")),
    "observed_outcomes": lambda s, d: rounded(view(s, d, "observed_outcomes")),
    "run_summary": lambda s, d: no_time(rounded(view(s, d, "run_summary"))),
    "outcome_summary": lambda s, d: rounded(view(s, d, "outcome_summary")),
    "reason_summary": lambda s, d: rounded(view(s, d, "reason_summary")),
    "selection_summary": lambda s, d: rounded(view(s, d, "selection_summary")),
    "empty_run_summary": lambda s, d: aggregates.run_summary(runs(s, d)[0].filter("source_rows < 0")).select("view_state", "run_id"),
    "suppressed_cells": lambda s, d: aggregates.suppress_small_cells(rounded(view(s, d, "risk_distribution")), "band_rows", ["share_of_day", "entities"], 20).select("prediction_date", "risk_band", "band_rows", "entities", "share_of_day", "is_suppressed", "suppression_label"),
    "lineage": lambda s, d: lineage_of(s, d, True),
    "lineage_gap": lambda s, d: lineage_of(s, d, False),
    "view_suites": view_suites,
    "daily_summary_faults": lambda s, d: rounded(aggregates.scoring_daily_summary(broken_predictions(s, d))),
    "run_summary_faults": lambda s, d: no_time(rounded(aggregates.run_summary(broken_runs(s, d)))).select("prediction_date", "fault", "run_id", "reconciled_rows", "capacity_use", "invalid_reason", "is_valid"),
    "reason_summary_faults": lambda s, d: rounded(aggregates.reason_summary(*broken_decisions(s, d))),
    "source_files": lambda s, d: file_facts(s, "events", f"{d}/events.parquet").select("table_name", "row_count", "file_count"),
    "quality_status": status,
    "model_monitoring": model_checks,
    "governance_monitoring": governed,
    "monitoring_run": run_checks,
    "panel_checks": lambda s, d: rounded(quality.run_checks(base.staged(s, d), quality.panel_rules({"last_type": TYPES}))),
    "label_checks": lambda s, d: quality.run_checks(quality.with_rows_after(base.labelled(s, d)), quality.label_rules()),
    "feature_checks": lambda s, d: quality.run_checks(base.features(s, d), quality.feature_rules(14, 11, base.TRENDS, ["purchase_rate"])),
    "split_checks": lambda s, d: quality.run_checks(base.split_features(s, d).filter("dataset_split <> 'unassigned'"), quality.split_rules(base.SPLITS)),
    "prediction_checks": lambda s, d: quality.run_checks(demo.predictions(s, d), quality.prediction_rules(demo.THRESHOLD)).select("check_name", "passed"),
    "evaluation_checks": lambda s, d: quality.run_checks(evaluate.evaluate_binary(demo.scored_events(s, d), 0.467), quality.evaluation_rules()).select("check_name", "passed"),
    "decision_checks": lambda s, d: quality.run_checks(decisions(s, d), quality.decision_rules(POLICY.capacity)),
    "view_checks": lambda s, d: rounded(quality.run_checks(view(s, d, "risk_distribution"), quality.view_rules("share_of_day", 30)), 9),
    "duplicate_keys": lambda s, d: quality.duplicate_keys(demo.table(s, d, "events").select("user_id", F.col("ts").cast("date").alias("day")), ["user_id", "day"]),
    "category_shares": lambda s, d: rounded(quality.category_shares(demo.table(s, d, "events"), "user_id", ["event_type"])),
    "numeric_summary": lambda s, d: rounded(quality.numeric_summary(base.staged(s, d), ["amount", "sessions", "purchase_amount"]), 4),
    "label_rates": lambda s, d: rounded(quality.label_rates(base.labelled(s, d), "will_miss", ["last_type", "is_late"])),
    "missing_rates": lambda s, d: rounded(quality.missing_rates(base.staged(s, d), ["amount", "purchase_amount", "last_type"])),
    "flag_rates": lambda s, d: rounded(quality.flag_rates(base.staged(s, d), ["is_missing", "is_outlier", "is_late"])),
    "profile_panel": lambda s, d: rounded(quality.profile_panel(base.labelled(s, d), "entity_id", "will_miss", ["amount", "sessions"], ["is_missing", "is_late"], ["last_type"]), 4),
    "score_logistic": lambda s, d: scored_by(s, d, "logistic"),
    "score_warehouse": lambda s, d: scored_by(s, d, "warehouse"),
    "score_gbt": lambda s, d: scored_by(s, d, "gbt"),
    "explain_logistic": explained,
    "compare_models": compared,
}

PREDS = DAILY + """,
preds AS (SELECT user_id AS entity_id, activity_date AS prediction_date, k / 100.0::double AS probability, k / 100.0::double >= 0.467::double AS is_high, 'demo' AS model_name, 0.467::double AS threshold FROM daily)"""
DECIDED = PREDS + """,
context AS (SELECT c_custkey AS entity_id, c_custkey % 10 <> 0 AS allowed, c_custkey % 10 <> 0 AND c_custkey % 13 = 0 AS opted_out, c_custkey % 7 = 0 AS open_case,
  CASE WHEN c_custkey % 3 <> 0 THEN timestamp '2024-02-06' - to_days((1 + c_custkey % 15)::int) END AS last_contact, c_custkey % 4 AS interventions FROM customer WHERE c_mktsegment <> 'MACHINERY'),
ladder AS (SELECT p.*, CASE WHEN prediction_date < max(prediction_date) OVER (PARTITION BY p.entity_id) THEN 'superseded_by_latest_prediction' WHEN probability < threshold THEN 'below_frozen_threshold'
  WHEN c.entity_id IS NULL THEN 'missing_activation_context' WHEN NOT allowed THEN 'contact_not_permitted' WHEN opted_out THEN 'member_opted_out' WHEN date '2024-02-06' - prediction_date > 7 THEN 'prediction_too_old'
  WHEN open_case THEN 'active_case_open' WHEN timestamp '2024-02-06' < last_contact + interval 7 day THEN 'contact_cooldown_active' WHEN interventions >= 2 THEN 'prior_intervention_limit_reached' END AS early
  FROM preds p LEFT JOIN context c ON c.entity_id = p.entity_id),
ranked AS (SELECT *, CASE WHEN early IS NULL THEN row_number() OVER (PARTITION BY early IS NULL ORDER BY probability DESC, prediction_date DESC, entity_id) END AS place FROM ladder),
coded AS (SELECT entity_id, prediction_date, probability, threshold, model_name, coalesce(early, CASE WHEN place <= 10 THEN 'selected_for_human_review' ELSE 'capacity_limit_reached' END) AS reason, CASE WHEN place <= 10 THEN place::int END AS priority_rank FROM ranked),
decided AS (SELECT entity_id, prediction_date, probability, threshold, model_name, CASE reason WHEN 'selected_for_human_review' THEN 'selected_for_review' WHEN 'superseded_by_latest_prediction' THEN 'no_contact_superseded' WHEN 'below_frozen_threshold' THEN 'no_contact_below_threshold'
  WHEN 'missing_activation_context' THEN 'no_contact_excluded' WHEN 'contact_not_permitted' THEN 'no_contact_excluded' WHEN 'member_opted_out' THEN 'no_contact_excluded' WHEN 'capacity_limit_reached' THEN 'no_contact_capacity' ELSE 'no_contact_suppressed' END AS outcome,
  reason, priority_rank, CASE WHEN priority_rank IS NOT NULL THEN 'supportive_check_in' END AS category, 'default' AS policy_id FROM coded)"""
RUN = DECIDED + """,
run AS (SELECT 'act_0123456789abcdef01234567' AS run_id, count(*) AS source_rows, count(DISTINCT entity_id) AS entities, count(*) FILTER (outcome = 'selected_for_review') AS selected_for_review, count(*) FILTER (outcome = 'no_contact_superseded') AS no_contact_superseded,
  count(*) FILTER (outcome = 'no_contact_below_threshold') AS no_contact_below_threshold, count(*) FILTER (outcome = 'no_contact_excluded') AS no_contact_excluded, count(*) FILTER (outcome = 'no_contact_suppressed') AS no_contact_suppressed,
  count(*) FILTER (outcome = 'no_contact_capacity') AS no_contact_capacity, max(threshold) AS threshold, count(*) FILTER (outcome IN ('selected_for_review', 'no_contact_capacity')) AS eligible, 10 AS capacity,
  count(*) - count(*) FILTER (outcome = 'no_contact_superseded') = count(DISTINCT entity_id) AND count(*) FILTER (outcome = 'selected_for_review') <= 10 AS reconciles FROM decided)"""
GOV = "NULL::varchar AS invalid_reason, true AS is_valid, 'synthetic' AS data_status, 'aggregate_monitoring' AS intended_use, false AS contains_identifiers"
CHECKED = "source_rows, 0 AS null_p, 0 AS out_of_range_p, 0 AS threshold_mismatch, 0 AS duplicate_keys"
RISK = PREDS + """,
banded AS (SELECT *, CASE WHEN probability < 0.2 THEN '0.0-0.2' WHEN probability < 0.4 THEN '0.2-0.4' WHEN probability < 0.6 THEN '0.4-0.6' WHEN probability < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END AS risk_band FROM preds),
bands AS (SELECT * FROM (VALUES ('0.0-0.2', 1), ('0.2-0.4', 2), ('0.4-0.6', 3), ('0.6-0.8', 4), ('0.8-1.0', 5)) b(risk_band, band_order)),
days AS (SELECT prediction_date, count(*) AS day_rows FROM preds GROUP BY 1),
cells AS (SELECT prediction_date, risk_band, count(*) AS band_rows, count(DISTINCT entity_id) AS entities FROM banded GROUP BY ALL),
risk AS (SELECT d.prediction_date, b.risk_band, day_rows, band_order, coalesce(band_rows, 0) AS band_rows, coalesce(entities, 0) AS entities, round(coalesce(band_rows, 0) / day_rows::double, 6) AS share_of_day, (SELECT count(*) FROM preds) AS source_rows
  FROM days d CROSS JOIN bands b LEFT JOIN cells c ON c.prediction_date = d.prediction_date AND c.risk_band = b.risk_band)"""
_REASONS = ", ".join(f"('{r}', '{o}', {i})" for i, (r, o) in enumerate(activate.REASONS.items(), 1))
_OUTCOMES = ", ".join(f"('{o}', {i})" for i, o in enumerate(activate.OUTCOMES, 1))
_CATEGORIES = ", ".join(f"('{c}', {i})" for i, c in enumerate(activate.CATEGORIES, 1))
HALVES = """
ev AS (SELECT ts::date < date '2024-01-16' AS is_ref, value, k::double AS k, CASE WHEN k % 10 <> 0 THEN k END::double AS sparse, 1.0::double AS constant, event_type FROM (SELECT *, json_extract_string(props, '$.k')::integer AS k FROM events))"""
NUMERIC_BINS = HALVES + """,
long AS (SELECT is_ref, unnest(['value', 'k', 'sparse', 'constant']) AS feature, unnest([value, k, sparse, constant]) AS v FROM ev),
quantiles AS (SELECT feature, quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]) AS q FROM long WHERE is_ref AND v IS NOT NULL GROUP BY feature),
edges AS (SELECT feature, CASE WHEN q[1] = q[11] THEN [q[1] + 2.220446049250313e-16] ELSE list_sort(list_distinct(q[2:10])) END AS edges FROM quantiles),
placed AS (SELECT l.feature, is_ref, CASE WHEN v IS NULL THEN len(edges) + 1 ELSE len(list_filter(edges, lambda e: e <= v)) END AS bin FROM long l JOIN edges USING (feature)),
grid AS (SELECT feature, unnest(range(0, len(edges) + 2)) AS bin FROM edges),
binned AS (SELECT g.feature, g.bin::int AS bin, count(*) FILTER (is_ref) AS ref, count(*) FILTER (NOT is_ref) AS cur FROM grid g LEFT JOIN placed p ON p.feature = g.feature AND p.bin = g.bin GROUP BY g.feature, g.bin)"""
PSI = """
shares AS (SELECT feature, (ref + 1e-6) / sum(ref + 1e-6) OVER w AS r, (cur + 1e-6) / sum(cur + 1e-6) OVER w AS c FROM binned WINDOW w AS (PARTITION BY feature)),
psi AS (SELECT feature, greatest(sum((c - r) * ln(c / r)), 0) AS psi FROM shares GROUP BY feature)"""
CATEGORY_BINS = HALVES + """,
long AS (SELECT is_ref, unnest(['event_type', 'k']) AS feature, coalesce(unnest([event_type, k::int::varchar]), '__missing__') AS bin FROM ev),
binned AS (SELECT feature, bin, count(*) FILTER (is_ref) AS ref, count(*) FILTER (NOT is_ref) AS cur FROM long GROUP BY ALL),
unseen AS (SELECT feature, sum(CASE WHEN ref = 0 THEN cur ELSE 0 END) / nullif(sum(cur), 0)::double AS unseen_rate FROM binned GROUP BY 1)"""


def _zero(table: str, tests: dict[str, str], brief: bool = False) -> str:
    """Checks that count the rows of a table that meet a condition, and pass if there are none."""
    shape = "count(*) FILTER ({t}) = 0 AS passed" if brief else "count(*) FILTER ({t})::double AS observed, 0.0 AS low, 0.0 AS high, count(*) FILTER ({t}) = 0 AS passed"
    return " UNION ALL ".join(f"SELECT '{n}' AS check_name, {shape.format(t=t)} FROM {table}" for n, t in tests.items())


def _between(name: str, observed: str, low: str, high: str, table: str) -> str:
    return f"SELECT '{name}', {observed}::double, {low}::double, {high}::double, {observed} BETWEEN {low} AND {high} FROM {table}"


_REASON_MAP = "CASE reason " + " ".join(f"WHEN '{r}' THEN '{o}'" for r, o in activate.REASONS.items()) + " END"
_COMMON = "FROM run CROSS JOIN"
LINEAGE = """
SELECT s.*, CASE WHEN freshness = 'missing' THEN 'table_missing' END AS invalid_reason, freshness <> 'missing' AS is_valid, 'synthetic' AS data_status, 'aggregate_monitoring' AS intended_use, false AS contains_identifiers FROM (
SELECT 'events' AS source_name, count(*) AS row_count, max(ts)::date AS latest_business_date, true AS table_present, CASE WHEN date '2024-02-06' - max(ts)::date > 7 THEN 'historical_snapshot' ELSE 'available' END AS freshness, 1 AS file_count FROM events
UNION ALL SELECT 'orders', count(*), max(o_orderdate)::date, true, CASE WHEN date '2024-02-06' - max(o_orderdate)::date > 7 THEN 'historical_snapshot' ELSE 'available' END, 1 FROM orders
UNION ALL SELECT 'lineitem', count(*), max(l_shipdate)::date, true, CASE WHEN date '2024-02-06' - max(l_shipdate)::date > 7 THEN 'historical_snapshot' ELSE 'available' END, 1 FROM lineitem
UNION ALL SELECT 'customer', count(*), NULL, true, 'available', 1 FROM customer UNION ALL SELECT 'part', count(*), NULL, true, 'available', 1 FROM part UNION ALL SELECT 'supplier', count(*), NULL, true, 'available', 1 FROM supplier
UNION ALL {runs}) s"""
#: Rows of each governed view as the tables and the rules of the views make them, and the faults that the run's counts show.
ASSETS = f"WITH {FEATURES}" + RUN.removeprefix(DAILY) + """,
labelled_days AS (SELECT count(DISTINCT prediction_date) AS n FROM features WHERE will_miss IS NOT NULL), scored_days AS (SELECT count(DISTINCT prediction_date) AS n FROM preds),
faults AS (SELECT count_if(probability IS NULL OR probability NOT BETWEEN 0 AND 1 OR is_high IS DISTINCT FROM (probability >= threshold)) + count(*) - count(DISTINCT (entity_id, prediction_date)) AS odd FROM preds),
audit AS (SELECT count_if(NOT (selected_for_review <= capacity AND source_rows - no_contact_superseded = entities)) AS odd FROM run),
assets AS (SELECT 'daily_summary' AS asset, s.n AS row_count, CASE WHEN f.odd > 0 THEN s.n ELSE 0 END AS invalid_rows, 'events' AS source FROM scored_days s, faults f
UNION ALL SELECT 'risk_distribution', 5 * s.n, CASE WHEN f.odd > 0 THEN 5 * s.n ELSE 0 END, 'events' FROM scored_days s, faults f UNION ALL SELECT 'observed_outcomes', n, 0, 'events' FROM labelled_days
UNION ALL SELECT 'run_summary', 1, odd, NULL FROM audit UNION ALL SELECT 'outcome_summary', (SELECT 6 * count(*) FROM run), 0, NULL UNION ALL SELECT 'reason_summary', (SELECT 11 * count(*) FROM run), 0, NULL
UNION ALL SELECT 'selection_summary', (SELECT 4 * count(*) FROM run), 0, NULL UNION ALL SELECT 'lineage', 7, 0, NULL)"""
QUALITY = ASSETS + """
SELECT asset, row_count, invalid_rows, invalid_rows AS reason_rows, 0 AS metadata_missing, 0 AS empty_state_rows, CASE WHEN source IS NOT NULL THEN true END AS lineage_valid, CASE WHEN source IS NULL THEN 'not_tracked' ELSE 'available' END AS freshness,
CASE WHEN row_count = 0 THEN 'no_rows' WHEN invalid_rows > 0 THEN 'invalid_rows' END AS first_reason, CASE WHEN row_count = 0 OR invalid_rows > 0 THEN 'fail' ELSE 'pass' END AS status FROM assets"""
GOVERNANCE = ASSETS + """,
g AS (SELECT count(*) FILTER (row_count > 0 AND invalid_rows = 0) AS passing, count(*) AS n FROM assets),
c AS (SELECT 1 AS check_order, 'empty_state_validity' AS check_name, count_if(row_count = 0)::double AS observed, 0.0 AS expected, CASE WHEN count_if(row_count = 0) = 0 THEN 'pass' ELSE 'critical' END AS severity FROM assets WHERE asset IN ('run_summary', 'outcome_summary', 'reason_summary', 'selection_summary')
UNION ALL SELECT 2, 'assets_pass', passing::double, 8.0, CASE WHEN passing = 8 AND n = 8 THEN 'pass' ELSE 'critical' END FROM g UNION ALL SELECT 3, 'lineage_complete', 7.0, 7.0, 'pass')
SELECT *, CASE WHEN bool_or(severity = 'critical') OVER () THEN 'critical' ELSE 'pass' END AS overall_severity FROM c"""
SUITES = f"WITH {FEATURES}" + RUN.removeprefix(DAILY) + """,
p AS (SELECT count(*) AS n, count(DISTINCT prediction_date) AS days, count_if(probability IS NULL OR probability NOT BETWEEN 0 AND 1) AS odd FROM preds),
l AS (SELECT count(*) AS n, count(DISTINCT prediction_date) AS days FROM features WHERE will_miss IS NOT NULL), d AS (SELECT count(*) AS n, count(*) FILTER (outcome = 'selected_for_review') AS selected FROM decided),
v AS (SELECT 'daily_summary' AS view_name, days AS rows, n AS total, NULL AS codes, false AS shares FROM p UNION ALL SELECT 'risk_distribution', 5 * days, n, 5, true FROM p UNION ALL SELECT 'observed_outcomes', days, n, NULL, false FROM l
UNION ALL SELECT 'run_summary', 1, n, NULL, false FROM d UNION ALL SELECT 'outcome_summary', 6, n, 6, true FROM d UNION ALL SELECT 'reason_summary', 11, n, 11, true FROM d UNION ALL SELECT 'selection_summary', 4, selected, 4, false FROM d UNION ALL SELECT 'lineage', 7, NULL, NULL, false),
c AS (SELECT view_name, 'rows' AS check_name, rows::double AS observed, rows::double AS low, rows::double AS high FROM v UNION ALL SELECT view_name, unnest(['invalid_rows', 'reasons', 'metadata_missing']), 0.0, 0.0, 0.0 FROM v
UNION ALL SELECT view_name, 'total', total, total, total FROM v WHERE total IS NOT NULL UNION ALL SELECT view_name, 'share_total', 1.0, 1 - 1e-9, 1 + 1e-9 FROM v WHERE shares
UNION ALL SELECT view_name, 'unknown_code', 0, 0, 0 FROM v WHERE codes IS NOT NULL UNION ALL SELECT view_name, 'codes', codes, codes, codes FROM v WHERE codes IS NOT NULL
UNION ALL SELECT 'empty_run_summary', 'rows', 1, 1, 1 UNION ALL SELECT 'empty_run_summary', unnest(['not_empty_state', 'fabricated']), 0, 0, 0)
SELECT *, observed BETWEEN low AND high AS passed FROM c"""
FAULTS = f"WITH {PREDS}" + """,
changed AS (SELECT entity_id, prediction_date, CASE WHEN entity_id % 7 = 0 THEN NULL WHEN entity_id % 11 = 0 THEN 1.5 ELSE probability END AS probability, CASE WHEN entity_id % 13 = 0 THEN NOT is_high ELSE is_high END AS is_high, threshold FROM preds),
broken AS (SELECT * FROM changed UNION ALL SELECT * FROM changed WHERE entity_id % 17 = 0),
told AS (SELECT count(*) AS source_rows, count_if(probability IS NULL)::bigint AS null_p, count_if(probability NOT BETWEEN 0 AND 1)::bigint AS out_of_range_p, count_if(is_high IS DISTINCT FROM (probability >= threshold))::bigint AS threshold_mismatch, (count(*) - count(DISTINCT (entity_id, prediction_date)))::bigint AS duplicate_keys FROM broken),
days AS (SELECT prediction_date, count(*) AS scored_rows, count(DISTINCT entity_id) AS entities, round(avg(probability), 6) AS mean_probability, count(*) FILTER (is_high) AS high_rows, round(count(*) FILTER (is_high) / count(*)::double, 6) AS high_rate FROM broken GROUP BY 1),
judged AS (SELECT *, CASE WHEN source_rows = 0 THEN 'empty_source' WHEN null_p > 0 THEN 'null_probability' WHEN out_of_range_p > 0 THEN 'probability_out_of_range' WHEN threshold_mismatch > 0 THEN 'threshold_mismatch' WHEN duplicate_keys > 0 THEN 'duplicate_keys' END AS invalid_reason FROM days, told)
SELECT *, invalid_reason IS NULL AS is_valid, 'synthetic' AS data_status, 'aggregate_monitoring' AS intended_use, false AS contains_identifiers FROM judged"""
RUN_FAULTS = f"WITH {DECIDED}" + """,
c AS (SELECT prediction_date, day(prediction_date)::int % 15 AS fault, count(*) AS source, count(*) FILTER (outcome = 'selected_for_review') AS selected, count(*) FILTER (outcome = 'no_contact_capacity') AS over, count(*) FILTER (outcome = 'no_contact_superseded') AS gone FROM decided GROUP BY ALL),
r AS (SELECT *, CASE fault WHEN 1 THEN NULL WHEN 2 THEN 'run-1' ELSE 'act_' || strftime(prediction_date, '%Y%m%d') END AS run_id, fault IN (3, 4, 5, 6) AS lacks, CASE fault WHEN 7 THEN 1.5 WHEN 14 THEN NULL ELSE 0.5 END AS threshold,
  CASE fault WHEN 9 THEN 0 WHEN 10 THEN greatest(selected - 1, 1) ELSE 10 END AS capacity, source + (fault = 13)::int AS total FROM c),
j AS (SELECT *, CASE WHEN run_id IS NULL THEN 'run_id_missing' WHEN threshold NOT BETWEEN 0 AND 1 THEN 'threshold_out_of_range' WHEN fault = 8 THEN 'snapshot_after_decision' WHEN capacity < 1 THEN 'capacity_not_positive' WHEN selected > capacity THEN 'capacity_exceeded'
  WHEN fault = 11 THEN 'eligible_mismatch' WHEN fault = 12 THEN 'entities_mismatch' WHEN total <> source THEN 'total_mismatch' END AS invalid_reason FROM r)
SELECT prediction_date, fault, run_id, total AS reconciled_rows, round(selected / nullif(capacity, 0)::double, 6) AS capacity_use, invalid_reason, CASE WHEN invalid_reason IS NOT NULL OR lacks THEN false WHEN threshold IS NULL THEN NULL ELSE true END AS is_valid FROM j"""
REASON_FAULTS = f"WITH {RUN}, dim AS (SELECT * FROM (VALUES {_REASONS}) d(reason, outcome, reason_order))" + """,
broken AS (SELECT entity_id, outcome, CASE WHEN entity_id % 5 = 0 THEN 'unknown' WHEN entity_id % 7 = 0 THEN 'active_case_open' ELSE reason END AS reason, CASE WHEN entity_id % 11 = 0 THEN 'act_ffffffffffffffffffffffff' ELSE 'act_0123456789abcdef01234567' END AS run_id FROM decided),
own AS (SELECT * FROM broken WHERE run_id = 'act_0123456789abcdef01234567'), n AS (SELECT outcome, reason, count(*) AS rows FROM own GROUP BY ALL), o AS (SELECT outcome, count(*) AS outcome_rows FROM own GROUP BY 1),
t AS (SELECT count_if(d.reason IS NULL)::bigint AS unexpected_rows, count_if(d.outcome <> own.outcome)::bigint AS mismatched_rows, count(*) AS decision_rows FROM own LEFT JOIN dim d ON d.reason = own.reason),
f AS (SELECT run.run_id, dim.outcome, dim.reason, source_rows, reason_order, coalesce(n.rows, 0) AS rows, coalesce(outcome_rows, 0) AS outcome_rows, unexpected_rows, mismatched_rows, decision_rows, (SELECT count(*) FROM broken) - decision_rows AS orphan_rows
  FROM run CROSS JOIN dim CROSS JOIN t LEFT JOIN n ON n.outcome = dim.outcome AND n.reason = dim.reason LEFT JOIN o ON o.outcome = dim.outcome),
j AS (SELECT *, round(rows / nullif(source_rows, 0)::double, 6) AS share_of_run, round(rows / nullif(outcome_rows, 0)::double, 6) AS share_of_outcome, CASE WHEN orphan_rows > 0 THEN 'orphan_decisions' WHEN unexpected_rows > 0 THEN 'unexpected_reason' WHEN mismatched_rows > 0 THEN 'reason_outcome_mismatch' WHEN decision_rows <> source_rows THEN 'total_mismatch' END AS invalid_reason FROM f)
SELECT *, invalid_reason IS NULL AS is_valid, 'synthetic' AS data_status, 'aggregate_monitoring' AS intended_use, false AS contains_identifiers, 'available' AS view_state FROM j"""
SQL: dict[str, str] = {
    "numeric_psi": f"WITH {NUMERIC_BINS}, {PSI} SELECT feature, round(psi, 6) AS psi FROM psi",
    "psi_bins": f"WITH {NUMERIC_BINS} SELECT * FROM binned WHERE feature IN ('value', 'sparse')",
    "categorical_psi": f"WITH {CATEGORY_BINS}, {PSI} SELECT feature, round(psi, 6) AS psi, round(unseen_rate, 6) AS unseen_rate FROM psi JOIN unseen USING (feature)",
    "unexpected_rates": f"""
WITH {HALVES} SELECT 'event_type' AS feature, round(avg((event_type NOT IN ('view', 'click'))::int), 6) AS unexpected_rate FROM ev WHERE NOT is_ref UNION ALL SELECT
  'k', round(avg((k >= 50)::int), 6) FROM ev WHERE NOT is_ref""",
    "support_breaches": f"WITH {SPLIT} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER (dataset_split = 'scoring' AND {c} > (SELECT max({c}) FROM split WHERE dataset_split = 'train')) AS breaches, max({c}) FILTER (dataset_split = 'train')::double AS train_max, max({c}) FILTER (dataset_split = 'scoring')::double AS scoring_max FROM split" for c in ("amount_sum", "active_days", "outlier_days", "late_days")),
    "decide": f"WITH {DECIDED} SELECT * FROM decided",
    "run_audit": f"WITH {RUN} SELECT * FROM run",
    "review_queue": f"WITH {DECIDED} SELECT priority_rank, entity_id, prediction_date, probability, category, 'pending' AS review_status FROM decided WHERE priority_rank IS NOT NULL",
    "ingest_audit": f"WITH {DECIDED} SELECT 'decisions' AS table_name, count(*) AS appended_first, 0 AS appended_again, count(*) AS stored FROM decided UNION ALL SELECT 'runs', 1, 0, 1",
    "ingest_commits": f"""WITH {DECIDED} SELECT 'decisions' AS table_name, count(*) AS appended_first, 0 AS appended_again, count(*) AS appended_second_run, 2 AS version, 2 * count(*) AS stored, 2 AS stored_runs
  FROM decided UNION ALL SELECT 'runs', 1, 0, 1, 2, 2, 2""",
    "stored_conflicts": f"""WITH {DECIDED} SELECT 0 AS target_duplicates, 0 AS staged_duplicates, count(*) FILTER (entity_id % 7 = 0) AS conflicting_rows, count(*) AS known_rows, 0 AS null_keys
  FROM decided WHERE prediction_date >= date '2024-01-20'""",
    "ingest_conflicts": f"WITH {DECIDED} SELECT 0 AS target_duplicates, 0 AS staged_duplicates, count(*) FILTER (entity_id % 7 = 0) AS conflicting_rows FROM decided",
    "context_checks": f"""
WITH {DECIDED} SELECT count(*) FILTER (entity_id IS NULL) AS blank_ids, count(entity_id) - count(DISTINCT entity_id) AS duplicate_ids, count(*) FILTER (allowed IS
  NULL) AS null_flags, count(*) FILTER (interventions < 0) AS bad_counts, count(*) FILTER (NOT allowed AND opted_out) AS opted_out_but_never_allowed, 0 AS
  extra_snapshots, count(*) FILTER (last_contact > timestamp '2024-02-06') AS contacts_after_snapshot, 0 AS snapshots_after_decision, 0 AS null_snapshots FROM context""",
    "daily_summary": f"""
WITH {PREDS} SELECT prediction_date, count(*) AS scored_rows, count(DISTINCT entity_id) AS entities, round(avg(probability), 6) AS mean_probability, count(*) FILTER
  (is_high) AS high_rows, round(count(*) FILTER (is_high) / count(*)::double, 6) AS high_rate, (SELECT count(*) FROM preds) AS source_rows, 0 AS null_p, 0 AS
  out_of_range_p, 0 AS threshold_mismatch, 0 AS duplicate_keys, {GOV} FROM preds GROUP BY prediction_date""",
    "risk_distribution": f"WITH {RISK} SELECT prediction_date, risk_band, day_rows, band_order, band_rows, entities, share_of_day, {CHECKED}, {GOV} FROM risk",
    "observed_outcomes": f"""
WITH {FEATURES} SELECT prediction_date, count(*) AS labelled_rows, count(*) FILTER (will_miss) AS missed, count(*) FILTER (NOT will_miss) AS met, round(count(*)
  FILTER (will_miss) / count(*)::double, 6) AS missed_rate, prediction_date + 7 AS outcome_window_end, 0 AS duplicate_keys, {GOV} FROM features WHERE will_miss IS
  NOT NULL GROUP BY prediction_date""",
    "run_summary": f"WITH {RUN} SELECT *, source_rows AS reconciled_rows, round(selected_for_review / capacity::double, 6) AS capacity_use, {GOV}, 'available' AS view_state FROM run",
    "outcome_summary": f"""
WITH {RUN}, dim AS (SELECT * FROM (VALUES {_OUTCOMES}) d(outcome, outcome_order)), n AS (SELECT outcome, count(*) AS rows FROM decided GROUP BY 1) SELECT run_id,
  outcome, source_rows, outcome_order, coalesce(n.rows, 0) AS rows, 0 AS unexpected_rows, source_rows AS recognised_rows, 0 AS orphan_rows, coalesce(n.rows, 0) AS
  audited_rows, round(coalesce(n.rows, 0) / source_rows::double, 6) AS share_of_run, {GOV}, 'available' AS view_state {_COMMON} dim LEFT JOIN n USING (outcome)""",
    "reason_summary": f"""
WITH {RUN}, dim AS (SELECT * FROM (VALUES {_REASONS}) d(reason, outcome, reason_order)), n AS (SELECT reason, count(*) AS rows FROM decided GROUP BY 1), o AS (SELECT
  outcome, count(*) AS outcome_rows FROM decided GROUP BY 1) SELECT run_id, outcome, reason, source_rows, reason_order, coalesce(n.rows, 0) AS rows,
  coalesce(outcome_rows, 0) AS outcome_rows, 0 AS unexpected_rows, 0 AS mismatched_rows, source_rows AS decision_rows, 0 AS orphan_rows, round(coalesce(n.rows, 0) /
  source_rows::double, 6) AS share_of_run, round(coalesce(n.rows, 0) / nullif(coalesce(outcome_rows, 0), 0)::double, 6) AS share_of_outcome, {GOV}, 'available' AS
  view_state {_COMMON} dim LEFT JOIN n USING (reason) LEFT JOIN o USING (outcome)""",
    "selection_summary": f"""
WITH {RUN}, dim AS (SELECT * FROM (VALUES {_CATEGORIES}) d(category, category_order)), n AS (SELECT category, count(*) AS rows FROM decided WHERE category IS NOT
  NULL GROUP BY 1) SELECT run_id, category, selected_for_review AS audited_selected, category_order, coalesce(n.rows, 0) AS rows, selected_for_review AS
  selected_rows, 0 AS missing_category, 0 AS unexpected_category, 0 AS leaked_category, 0 AS orphan_rows, round(coalesce(n.rows, 0) / selected_for_review::double, 6)
  AS share_of_selected, 'pending' AS review_status, {GOV}, 'available' AS view_state {_COMMON} dim LEFT JOIN n USING (category)""",
    "empty_run_summary": "SELECT 'no_activation_runs' AS view_state, NULL::varchar AS run_id",
    "suppressed_cells": f"""
WITH {RISK} SELECT prediction_date, risk_band, CASE WHEN band_rows >= 20 THEN band_rows END AS band_rows, CASE WHEN band_rows >= 20 THEN entities END AS entities,
  CASE WHEN band_rows >= 20 THEN share_of_day END AS share_of_day, band_rows < 20 AS is_suppressed, CASE WHEN band_rows < 20 THEN 'fewer than 20' END AS
  suppression_label FROM risk""",
    "lineage": LINEAGE.format(runs="SELECT 'runs', 1, date '2024-02-06', true, 'available', NULL"),
    "lineage_gap": LINEAGE.format(runs="SELECT 'runs', 0, NULL, false, 'missing', NULL"),
    "daily_summary_faults": FAULTS,
    "view_suites": SUITES,
    "run_summary_faults": RUN_FAULTS,
    "reason_summary_faults": REASON_FAULTS,
    "source_files": "SELECT 'events' AS table_name, count(*) AS row_count, 1 AS file_count FROM events",
    "panel_checks": f"WITH {PANEL} " + _zero("panel", {"null_keys": "entity_id IS NULL OR activity_date IS NULL", "missing_flag_disagrees": "is_missing IS DISTINCT FROM (purchase_amount IS NULL)", "outlier_flag_disagrees": "is_outlier IS DISTINCT FROM (amount > 20000)", "late_flag_disagrees": "is_late IS DISTINCT FROM (delay_days > 0)", "delay_out_of_range": "delay_days NOT BETWEEN 0 AND 3", "arrival_differs": "available_date IS DISTINCT FROM activity_date + delay_days", "negative_amount": "amount < 0", "goal_missing": "goal IS NULL", "last_type_outside_domain": "last_type NOT IN ('click', 'error', 'purchase', 'signup', 'view')"}) + " UNION ALL " + _between("rows", "count(*)", "1", "'inf'::double", "panel") + " UNION ALL " + _between("late_rate", "round(avg(is_late::int), 6)", "0", "1", "panel"),
    "label_checks": f"WITH {LABELLED}, after AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY activity_date DESC) - 1 AS rows_after FROM labelled) " + _zero("after", {"label_in_last_days": "rows_after < 7 AND will_miss IS NOT NULL", "label_missing_earlier": "rows_after >= 7 AND will_miss IS NULL", "label_disagrees": "will_miss = goal_met", "goal_met_disagrees": "(future_amount >= goal) <> goal_met"}),
    "feature_checks": f"WITH {FEATURES} " + _zero("features", {"window_start_differs": "window_start <> prediction_date - 14", "window_end_differs": "window_end <> prediction_date - 1", "future_activity": "max_activity_date >= prediction_date", "unavailable_record": "max_available_date > prediction_date", "coverage_differs": "available_days + unavailable_days <> 14", "too_few_days": "available_days < 11", "purchase_rate_out_of_range": "purchase_rate NOT BETWEEN 0 AND 1", "amount_trend_differs": "abs(amount_trend - (amount_recent_mean - amount_prior_mean)) > 1e-9", "sessions_trend_differs": "abs(sessions_trend - (sessions_recent_mean - sessions_prior_mean)) > 1e-9"}),
    "split_checks": f"WITH {SPLIT}, own AS (SELECT * FROM split WHERE dataset_split <> 'unassigned') " + _zero("own", {f"{n}_outside_dates": f"dataset_split = '{n}' AND prediction_date NOT BETWEEN date '{a}' AND date '{b}'" for n, (a, b) in base.SPLITS.items()} | {f"{n}_labels": f"dataset_split = '{n}' AND will_miss IS {'NOT NULL' if n == 'scoring' else 'NULL'}" for n in base.SPLITS}) + " UNION ALL " + " UNION ALL ".join(_between(f"{n}_rows", f"count(*) FILTER (dataset_split = '{n}')", "1", "'inf'::double", "own") for n in base.SPLITS) + " UNION ALL " + " UNION ALL ".join(_between(f"{a}_before_{b}", f"datediff('day', max(prediction_date) FILTER (dataset_split = '{a}'), min(prediction_date) FILTER (dataset_split = '{b}'))", "1", "'inf'::double", "own") for a, b in (("train", "validation"), ("validation", "test"), ("test", "scoring"))),
    "prediction_checks": f"WITH {PREDS} " + _zero("preds", {"null_probability": "probability IS NULL", "probability_out_of_range": "probability NOT BETWEEN 0 AND 1", "flag_disagrees": "is_high IS DISTINCT FROM (probability >= 0.467::double)", "threshold_differs": "threshold <> 0.467::double"}, True) + " UNION ALL SELECT 'distinct_probabilities', count(DISTINCT probability) >= 2 FROM preds UNION ALL SELECT 'models', count(DISTINCT model_name) = 1 FROM preds",
    "decision_checks": f"WITH {DECIDED} " + _zero("decided", {"unknown_reason": f"{_REASON_MAP} IS NULL", "reason_outcome_mismatch": f"{_REASON_MAP} <> outcome", "rank_misplaced": "(outcome = 'selected_for_review') <> (priority_rank IS NOT NULL)", "category_misplaced": "(outcome = 'selected_for_review') <> (category IS NOT NULL)", "unknown_category": "category NOT IN ('supportive_check_in', 'goal_planning', 'activity_reminder', 'rewards_education')"}) + " UNION ALL " + " UNION ALL ".join(_between(*x, "decided") for x in (("selected", "count(*) FILTER (outcome = 'selected_for_review')", "0", "10"), ("rank_gap", "coalesce(max(priority_rank), 0) - count(DISTINCT priority_rank)", "0", "0"), ("first_rank", "coalesce(min(priority_rank), 1)", "1", "1"), ("policy_id_values", "count(DISTINCT policy_id)", "1", "1"), ("model_name_values", "count(DISTINCT model_name)", "1", "1"), ("threshold_values", "count(DISTINCT threshold)", "1", "1"), ("decided_at_values", "max(1)", "1", "1"))),
    "duplicate_keys": "SELECT (count(*) - count(DISTINCT (user_id, ts::date)))::bigint AS duplicates FROM events",
    "category_shares": """
SELECT 'event_type' AS column_name, event_type AS value, count(DISTINCT user_id) AS entities, round(count(DISTINCT user_id) / (SELECT count(*) FROM (SELECT DISTINCT
  user_id, event_type FROM events))::double, 6) AS share FROM events GROUP BY event_type""",
    "numeric_summary": f"WITH {PANEL} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::double AS min, round(quantile_cont({c}, 0.01), 4) AS p1, round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.99), 4) AS p99, max({c})::double AS max FROM panel" for c in ("amount", "sessions", "purchase_amount")),
    "label_rates": f"""
WITH {LABELLED} SELECT 'last_type' AS group_name, last_type AS value, count(*) AS labelled, round(avg(will_miss::int), 6) AS rate FROM labelled WHERE will_miss IS
  NOT NULL GROUP BY ALL UNION ALL SELECT 'is_late', is_late::varchar, count(*), round(avg(will_miss::int), 6) FROM labelled WHERE will_miss IS NOT NULL GROUP BY ALL""",
    "missing_rates": f"WITH {PANEL} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(({c} IS NULL)::int), 6) AS missing_rate FROM panel" for c in ("amount", "purchase_amount", "last_type")),
    "flag_rates": f"WITH {PANEL} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg({c}::int), 6) AS rate FROM panel" for c in ("is_missing", "is_outlier", "is_late")),
    "profile_panel": f"""WITH {LABELLED}, per AS (SELECT entity_id, count(*) AS n FROM labelled GROUP BY 1),
        volume AS (SELECT 'volume' AS section, 'panel' AS item, ['rows', 'entities', 'min_rows', 'max_rows'] AS m, [sum(n)::double, count(*)::double, min(n)::double, max(n)::double] AS v FROM per),
        balance AS (SELECT 'label' AS section, 'will_miss' AS item, ['rate', 'missing'] AS m, [avg(will_miss::int), avg((will_miss IS NULL)::int)] AS v FROM labelled),
        flags AS (SELECT 'flag' AS section, 'is_missing' AS item, ['rate'] AS m, [avg(is_missing::int)] AS v FROM labelled UNION ALL SELECT 'flag', 'is_late', ['rate'], [avg(is_late::int)] FROM labelled),
        lost AS ({" UNION ALL ".join(f"SELECT 'missing' AS section, '{c}' AS item, ['missing_rate'] AS m, [avg(({c} IS NULL)::int)] AS v FROM labelled" for c in ("amount", "sessions"))}),
        stats AS ({" UNION ALL ".join(f"SELECT 'numeric' AS section, '{c}' AS item, ['n', 'mean', 'std', 'min', 'p1', 'p50', 'p99', 'max'] AS m, [count({c})::double, avg({c}), stddev_samp({c}), min({c})::double, quantile_cont({c}, 0.01), quantile_cont({c}, 0.5), quantile_cont({c}, 0.99), max({c})::double] AS v FROM labelled" for c in ("amount", "sessions"))}),
        groups AS (SELECT 'subgroup' AS section, 'last_type=' || coalesce(last_type, 'null') AS item, ['labelled', 'rate'] AS m, [count(*)::double, avg(will_miss::int)] AS v FROM labelled WHERE will_miss IS NOT NULL GROUP BY last_type),
        every AS (SELECT * FROM volume UNION ALL SELECT * FROM balance UNION ALL SELECT * FROM flags UNION ALL SELECT * FROM lost UNION ALL SELECT * FROM stats UNION ALL SELECT * FROM groups)
        SELECT section, item, measure, round(value, 4) AS value FROM (SELECT section, item, unnest(m) AS measure, unnest(v) AS value FROM every)""",
    "model_monitoring": f"""
WITH {SPLIT}, b AS (SELECT count(*) AS n, count(DISTINCT entity_id) AS entities, count(DISTINCT prediction_date) AS days, max(prediction_date) AS last, count(*)
  FILTER (active_days > (SELECT max(active_days) FROM split WHERE dataset_split = 'train')) AS over1, count(*) FILTER (outlier_days > (SELECT max(outlier_days) FROM
  split WHERE dataset_split = 'train')) AS over2 FROM split WHERE dataset_split = 'scoring'), """
    "c AS (SELECT unnest([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11])::int AS check_order, unnest(['row_count', 'entity_count', 'day_count', 'duplicate_keys', 'null_probability', 'probability_out_of_range', 'threshold_mismatch', 'source_reconciliation', 'latest_date', 'support_active_days', 'support_outlier_days']) AS check_name, "
    "unnest([n, entities, days, 0, 0, 0, 0, n, strftime(last, '%Y%m%d')::bigint, over1, over2])::double AS observed, unnest([1050, 150, 7, 0, 0, 0, 0, n, 20240130, 0, 0])::double AS expected FROM b), "
    "s AS (SELECT *, CASE WHEN observed = expected THEN 'pass' WHEN check_order > 9 THEN 'warning' ELSE 'critical' END AS severity FROM c) "
    "SELECT *, CASE WHEN bool_or(severity = 'critical') OVER () THEN 'critical' WHEN bool_or(severity = 'warning') OVER () THEN 'warning' ELSE 'pass' END AS overall_severity, severity <> 'critical' AS is_valid, CASE WHEN severity = 'critical' THEN check_name END AS invalid_reason, 'synthetic' AS data_status, 'aggregate_monitoring' AS intended_use, false AS contains_identifiers FROM s",
    "quality_status": QUALITY,
    "governance_monitoring": GOVERNANCE,
    "evaluation_checks": f"WITH {SWEEP}, {base.RANKING}, {base.TOP}, {base.WIDTH}, {base.AT}, e AS (SELECT *, (SELECT count(*) FROM scored) AS n, (SELECT avg(y::int) FROM scored) AS base_rate, (SELECT avg(p) FROM scored) AS mean_p, (SELECT avg(pow(p - y::int, 2)) FROM scored) AS brier FROM ranking, top, ece, standard) " + _zero("e", {"confusion_total_differs": "tp + fp + tn + fn <> n", "pr_auc_below_base_rate": "pr_auc <= base_rate", "lift_not_above_one": "lift <= 1", "ece_above_limit": "ece > 0.10"} | {f"{c}_out_of_range": f"{c} NOT BETWEEN 0 AND 1" for c in ("base_rate", "mean_p", "brier", "roc_auc", "pr_auc", "average_precision", "ece", "macro_f1", "accuracy")}, True),
    "view_checks": f"WITH {RISK} " + _zero("risk", {"invalid_rows": "source_rows = 0", "metadata_missing": "prediction_date IS NULL"}) + " UNION ALL " + _between("rows", "count(*)", "1", "'inf'::double", "risk") + " UNION ALL SELECT 'share_total', round(sum(band_rows / day_rows::double) / 30, 9), 1 - 1e-9, 1 + 1e-9, abs(sum(band_rows / day_rows::double) / 30 - 1) <= 1e-9 FROM risk",
}
