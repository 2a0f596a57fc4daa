"""Governed aggregate views over predictions, labels and activation runs, their lineage and their status.

Every view carries GOVERNANCE, is_valid and invalid_reason (the first check that fails). Views over predictions
return no row for an empty source; views over runs return one explicit empty-state row instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.activate import CATEGORIES, OUTCOMES, REASONS
from tidemark.sources.tables import literal_rows

GOVERNANCE = {"data_status": "synthetic", "intended_use": "aggregate_monitoring", "contains_identifiers": False}
BANDS = ("0.0-0.2", "0.2-0.4", "0.4-0.6", "0.6-0.8", "0.8-1.0")
MINIMUM_CELL = 10


def first_reason(checks: list[tuple[Column, str]]) -> Column:
    """The name of the first check that holds, in order; null if none does."""
    return F.coalesce(*[F.when(test, F.lit(name)) for test, name in checks], F.lit(None).cast("string"))


def governed(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in GOVERNANCE.items()})


def prediction_quality(preds: DataFrame) -> DataFrame:
    """One row: rows, null_p, out_of_range_p, threshold_mismatch, duplicate_keys."""
    p = F.col("probability")
    whole = preds.agg(
        F.count(F.lit(1)).alias("source_rows"), F.count_if(p.isNull()).alias("null_p"), F.count_if(~p.between(0.0, 1.0)).alias("out_of_range_p"),
        F.count_if(~F.col("is_high").eqNullSafe(p >= F.col("threshold"))).alias("threshold_mismatch"),
    )
    twice = preds.groupBy("entity_id", "prediction_date").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_keys"))
    return whole.crossJoin(F.broadcast(twice))


PREDICTION_CHECKS = {"source_rows": "empty_source", "null_p": "null_probability", "out_of_range_p": "probability_out_of_range", "threshold_mismatch": "threshold_mismatch", "duplicate_keys": "duplicate_keys"}


def _judged(df: DataFrame) -> DataFrame:
    tests = [((F.col(c) == 0) if c == "source_rows" else (F.col(c) > 0), reason) for c, reason in PREDICTION_CHECKS.items()]
    out = df.withColumn("invalid_reason", first_reason(tests))
    return governed(out.withColumn("is_valid", F.col("invalid_reason").isNull()))


def scoring_daily_summary(preds: DataFrame) -> DataFrame:
    """Per day: rows, entities, mean probability, high-risk count and rate, with the source's quality counters."""
    days = preds.groupBy("prediction_date").agg(F.count(F.lit(1)).alias("scored_rows"), F.count_distinct("entity_id").alias("entities"), F.avg("probability").alias("mean_probability"), F.count_if("is_high").alias("high_rows"))
    days = days.withColumn("high_rate", F.try_divide(F.col("high_rows").cast("double"), F.col("scored_rows").cast("double")))
    return _judged(days.crossJoin(F.broadcast(prediction_quality(preds))))


def band_of(p: Column) -> Column:
    """The band of width 0.2 that holds p, lower bound included; a missing or larger p falls into the last one."""
    tests = [F.when(p < (i + 1) / 5, F.lit(b)) for i, b in enumerate(BANDS[:-1])]
    return F.coalesce(*tests, F.lit(BANDS[-1]))


def risk_distribution(preds: DataFrame) -> DataFrame:
    """Day x band, dense: rows, entities and share of the day."""
    bands = literal_rows(preds.sparkSession, [(b, i) for i, b in enumerate(BANDS, 1)], "risk_band string, band_order int")
    counts = preds.groupBy("prediction_date", band_of(F.col("probability")).alias("risk_band")).agg(F.count(F.lit(1)).alias("band_rows"), F.count_distinct("entity_id").alias("entities"))
    days = preds.groupBy("prediction_date").agg(F.count(F.lit(1)).alias("day_rows"))
    grid = days.crossJoin(F.broadcast(bands)).join(counts, ["prediction_date", "risk_band"], "left").na.fill(0, ["band_rows", "entities"])
    grid = grid.withColumn("share_of_day", F.coalesce(F.try_divide(F.col("band_rows").cast("double"), F.col("day_rows").cast("double")), F.lit(0.0)))
    return _judged(grid.crossJoin(F.broadcast(prediction_quality(preds))))


def observed_outcomes(labelled: DataFrame, label: str = "will_miss", date: str = "prediction_date", horizon: int = 7) -> DataFrame:
    """Per day, labelled rows only: missed and met, the rate, and the end of the outcome window."""
    known = labelled.filter(F.col(label).isNotNull())
    days = known.groupBy(date).agg(F.count(F.lit(1)).alias("labelled_rows"), F.count_if(F.col(label)).alias("missed"), F.count_if(~F.col(label)).alias("met"))
    days = days.withColumn("missed_rate", F.try_divide(F.col("missed").cast("double"), F.col("labelled_rows").cast("double"))).withColumn("outcome_window_end", F.date_add(date, horizon))
    twice = labelled.groupBy("entity_id", date).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_keys"))
    out = days.crossJoin(F.broadcast(twice)).withColumn("invalid_reason", first_reason([(F.col("duplicate_keys") > 0, "duplicate_keys")]))
    return governed(out.withColumn("is_valid", F.col("invalid_reason").isNull()))


def _or_empty(view: DataFrame, runs: DataFrame) -> DataFrame:
    """view, and where there are no runs one row that says so."""
    none = runs.sparkSession.range(1).join(runs.limit(1).select(F.lit(0).cast("long").alias("id")), "id", "left_anti").select(F.lit("no_activation_runs").alias("view_state"))
    return view.withColumn("view_state", F.lit("available")).unionByName(none, allowMissingColumns=True)


def run_summary(runs: DataFrame) -> DataFrame:
    """Per run: use of the capacity, the reconciled total, whether the run is valid, and the first of eight reasons against it.

    A run without policy, model, decision, snapshot or ingest time is invalid, but only a missing id has a reason. The form of an id is not judged. Where a
    number is null and nothing else fails, is_valid is null: unknown is not valid.
    """
    total, at = reduce(lambda a, b: a + b, [F.col(o) for o in OUTCOMES]), {c for c in ("policy_id", "model_name", "decided_at", "snapshot_at", "ingested_at") if c in runs.columns}
    rows = runs.withColumn("reconciled_rows", total).withColumn("capacity_use", F.try_divide(F.col("selected_for_review").cast("double"), F.col("capacity").cast("double")))
    checks = [
        (F.col("run_id").isNull(), "run_id_missing"), (~F.col("threshold").between(0.0, 1.0), "threshold_out_of_range"), (F.col("snapshot_at") > F.col("decided_at"), "snapshot_after_decision"),
        (F.col("capacity") < 1, "capacity_not_positive"), (F.col("selected_for_review") > F.col("capacity"), "capacity_exceeded"), (F.col("eligible") != F.col("selected_for_review") + F.col("no_contact_capacity"), "eligible_mismatch"),
        (F.col("source_rows") - F.col("no_contact_superseded") != F.col("entities"), "entities_mismatch"), (F.col("reconciled_rows") != F.col("source_rows"), "total_mismatch"),
    ]
    sound = reduce(lambda a, b: a & b, [*(~t for t, _ in checks), *(F.col(c).isNotNull() for c in sorted(at))])
    return _or_empty(governed(rows.withColumn("invalid_reason", first_reason(checks)).withColumn("is_valid", sound)), runs)


def _orphans(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    return decisions.join(runs.select("run_id"), "run_id", "left_anti").agg(F.count(F.lit(1)).alias("orphan_rows"))


def outcome_summary(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Run x outcome, dense: counted rows against the run audit's counter."""
    dim = F.broadcast(literal_rows(runs.sparkSession, [(o, i) for i, o in enumerate(OUTCOMES, 1)], "outcome string, outcome_order int"))
    counts = decisions.groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("rows"))
    odd = decisions.groupBy("run_id").agg(F.count_if(~F.col("outcome").isin(*OUTCOMES)).alias("unexpected_rows"), F.count_if(F.col("outcome").isin(*OUTCOMES)).alias("recognised_rows"))
    told = F.coalesce(*[F.when(F.col("outcome") == o, F.col(o)) for o in OUTCOMES])
    rows = runs.select("run_id", "source_rows", *OUTCOMES).crossJoin(dim).join(counts, ["run_id", "outcome"], "left").join(odd, "run_id", "left").crossJoin(F.broadcast(_orphans(runs, decisions)))
    rows = rows.na.fill(0, ["rows", "unexpected_rows", "recognised_rows"]).withColumn("audited_rows", told).drop(*OUTCOMES)
    rows = rows.withColumn("share_of_run", F.try_divide(F.col("rows").cast("double"), F.col("source_rows").cast("double")))
    checks = [(F.col("orphan_rows") > 0, "orphan_decisions"), (F.col("unexpected_rows") > 0, "unexpected_outcome"), (F.col("recognised_rows") != F.col("source_rows"), "total_mismatch"), (F.col("rows") != F.col("audited_rows"), "outcome_mismatch")]
    return _or_empty(governed(rows.withColumn("invalid_reason", first_reason(checks)).withColumn("is_valid", F.col("invalid_reason").isNull())), runs)


def reason_summary(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Run x reason, dense: share of the run and of the outcome, and codes that don't fit."""
    dim = F.broadcast(literal_rows(runs.sparkSession, [(r, o, i) for i, (r, o) in enumerate(REASONS.items(), 1)], "reason string, outcome string, reason_order int"))
    counts = decisions.groupBy("run_id", "outcome", "reason").agg(F.count(F.lit(1)).alias("rows"))
    outcome = decisions.groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("outcome_rows"))
    fits = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    odd = decisions.groupBy("run_id").agg(F.count_if(~F.col("reason").isin(*REASONS)).alias("unexpected_rows"), F.count_if(F.col("reason").isin(*REASONS) & (fits[F.col("reason")] != F.col("outcome"))).alias("mismatched_rows"), F.count(F.lit(1)).alias("decision_rows"))
    rows = runs.select("run_id", "source_rows").crossJoin(dim).join(counts, ["run_id", "outcome", "reason"], "left").join(outcome, ["run_id", "outcome"], "left").join(odd, "run_id", "left").crossJoin(F.broadcast(_orphans(runs, decisions)))
    rows = rows.na.fill(0, ["rows", "outcome_rows", "unexpected_rows", "mismatched_rows", "decision_rows"])
    rows = rows.withColumn("share_of_run", F.try_divide(F.col("rows").cast("double"), F.col("source_rows").cast("double"))).withColumn("share_of_outcome", F.try_divide(F.col("rows").cast("double"), F.col("outcome_rows").cast("double")))
    checks = [(F.col("orphan_rows") > 0, "orphan_decisions"), (F.col("unexpected_rows") > 0, "unexpected_reason"), (F.col("mismatched_rows") > 0, "reason_outcome_mismatch"), (F.col("decision_rows") != F.col("source_rows"), "total_mismatch")]
    return _or_empty(governed(rows.withColumn("invalid_reason", first_reason(checks)).withColumn("is_valid", F.col("invalid_reason").isNull())), runs)


def selection_summary(runs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Run x category of the selected rows, dense, with missing, unexpected and leaked categories."""
    dim = F.broadcast(literal_rows(runs.sparkSession, [(c, i) for i, c in enumerate(CATEGORIES, 1)], "category string, category_order int"))
    chosen = F.col("outcome") == OUTCOMES[0]
    counts = decisions.filter(chosen).groupBy("run_id", "category").agg(F.count(F.lit(1)).alias("rows"))
    odd = decisions.groupBy("run_id").agg(
        F.count_if(chosen).alias("selected_rows"), F.count_if(chosen & F.col("category").isNull()).alias("missing_category"),
        F.count_if(chosen & ~F.col("category").isin(*CATEGORIES)).alias("unexpected_category"), F.count_if(~chosen & F.col("category").isNotNull()).alias("leaked_category"),
    )
    rows = runs.select("run_id", F.col("selected_for_review").alias("audited_selected")).crossJoin(dim).join(counts, ["run_id", "category"], "left").join(odd, "run_id", "left").crossJoin(F.broadcast(_orphans(runs, decisions)))
    rows = rows.na.fill(0, ["rows", "selected_rows", "missing_category", "unexpected_category", "leaked_category"]).withColumn("share_of_selected", F.try_divide(F.col("rows").cast("double"), F.col("selected_rows").cast("double"))).withColumn("review_status", F.lit("pending"))
    checks = [(F.col("orphan_rows") > 0, "orphan_decisions"), (F.col("missing_category") > 0, "missing_category"), (F.col("unexpected_category") > 0, "unexpected_category"), (F.col("leaked_category") > 0, "leaked_category"), (F.col("selected_rows") != F.col("audited_selected"), "selected_mismatch")]
    return _or_empty(governed(rows.withColumn("invalid_reason", first_reason(checks)).withColumn("is_valid", F.col("invalid_reason").isNull())), runs)


def lineage(sources: dict[str, tuple[DataFrame | None, str | None, str | None]], as_of: str, snapshot_days: int = 7, facts: DataFrame | None = None, counted: dict[str, DataFrame] | None = None) -> DataFrame:
    """A row for each source {name: (frame or None, its business date, its ingest time)}: rows, latest dates, freshness, validity.

    facts (table_name, file_count, total_bytes, last_modified) adds what is known of the sources' files; counted ({name: one row of row_count,
    latest_business_date, latest_ingest}), from footers for one, spares reading those sources.

    Freshness: missing (no table), missing_data (rows without dates), empty, historical_snapshot (older than `snapshot_days` at as_of), available.
    """
    parts = []
    spark = next(df.sparkSession for df, _, _ in sources.values() if df is not None)
    for name, (df, date, ingest) in sources.items():
        if df is None:
            row = spark.range(1).select(F.lit(0).cast("long").alias("row_count"), F.lit(None).cast("date").alias("latest_business_date"), F.lit(None).cast("timestamp_ntz").alias("latest_ingest"))
        elif name in (counted or {}):
            row = counted[name].select("row_count", F.col("latest_business_date").cast("date"), F.col("latest_ingest").cast("timestamp_ntz"))
        else:
            row = df.agg(F.count(F.lit(1)).alias("row_count"), (F.max(F.col(date).cast("date")) if date else F.lit(None).cast("date")).alias("latest_business_date"), (F.max(F.col(ingest).cast("timestamp_ntz")) if ingest else F.lit(None).cast("timestamp_ntz")).alias("latest_ingest"))
        parts.append(row.withColumns({"source_name": F.lit(name), "table_present": F.lit(df is not None), "has_date": F.lit(date is not None)}))
    rows = reduce(DataFrame.unionByName, parts)
    latest = F.greatest(F.col("latest_business_date").cast("timestamp_ntz"), F.col("latest_ingest"))
    fresh = (
        F.when(~F.col("table_present"), F.lit("missing")).when(F.col("row_count") == 0, F.lit("empty")).when(F.col("has_date") & F.col("latest_business_date").isNull(), F.lit("missing_data"))
        .when(F.datediff(F.lit(as_of).cast("date"), F.col("latest_business_date")) > snapshot_days, F.lit("historical_snapshot")).otherwise(F.lit("available"))
    )
    out = rows.withColumn("latest_timestamp", latest).withColumn("freshness", fresh)
    checks = [(F.col("freshness") == "missing", "table_missing"), (F.col("freshness") == "missing_data", "dates_missing")]
    if facts is not None:
        stored = facts.select(F.col("table_name").alias("source_name"), "file_count", "total_bytes", "last_modified")
        out = out.join(F.broadcast(stored), "source_name", "left")  # a row for each source
    return governed(out.withColumn("invalid_reason", first_reason(checks)).withColumn("is_valid", F.col("invalid_reason").isNull()).drop("has_date"))


def quality_status(views: dict[str, DataFrame], lineage_rows: DataFrame | None = None, lineage_of: dict[str, str] | None = None) -> DataFrame:
    """A row for each view: its rows, invalid rows, reasons and missing metadata, and pass or fail with the first reason."""
    parts = []
    for name, view in views.items():
        meta = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in GOVERNANCE])
        empty = F.coalesce(F.col("view_state") == "no_activation_runs", F.lit(False)) if "view_state" in view.columns else F.lit(False)
        parts.append(view.agg(
            F.lit(name).alias("asset"), F.count(F.lit(1)).alias("row_count"), F.count_if(~F.col("is_valid").eqNullSafe(True) & ~empty).alias("invalid_rows"),
            F.count("invalid_reason").alias("reason_rows"), F.count_if(meta & ~empty).alias("metadata_missing"), F.count_if(empty).alias("empty_state_rows"),
        ))
    rows = reduce(DataFrame.unionByName, parts)
    if lineage_rows is not None:
        pairs = literal_rows(rows.sparkSession, list((lineage_of or {}).items()), "asset string, source_name string")
        told = lineage_rows.select("source_name", F.col("is_valid").alias("lineage_valid"), "freshness")
        rows = rows.join(F.broadcast(pairs), "asset", "left").join(F.broadcast(told), "source_name", "left").drop("source_name")
    else:
        rows = rows.withColumns({"lineage_valid": F.lit(True), "freshness": F.lit("available")})
    rows = rows.withColumn("freshness", F.coalesce("freshness", F.lit("not_tracked")))
    checks = [(F.col("row_count") == 0, "no_rows"), (F.col("invalid_rows") > 0, "invalid_rows"), (F.col("reason_rows") > 0, "explicit_reasons"), (F.col("metadata_missing") > 0, "metadata_missing"), (F.col("lineage_valid").eqNullSafe(False), "lineage_invalid"), (F.col("freshness") == "missing", "lineage_incomplete")]
    out = rows.withColumn("first_reason", first_reason(checks))
    return out.withColumn("status", F.when(F.col("first_reason").isNull(), F.lit("pass")).otherwise(F.lit("fail")))


def suppress_small_cells(view: DataFrame, count: str, metrics: list[str], minimum: int = MINIMUM_CELL) -> DataFrame:
    """view with the metrics (and the count) of cells below the minimum set to null, never 0, and a label."""
    small = F.coalesce(F.col(count) < minimum, F.lit(True))
    out = view.withColumn("is_suppressed", small)
    return out.withColumns({c: F.when(~F.col("is_suppressed"), F.col(c)) for c in [*metrics, count]} | {"suppression_label": F.when(F.col("is_suppressed"), F.lit(f"fewer than {minimum}"))})
