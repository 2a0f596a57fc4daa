"""Monitoring: the daily model checks, governance checks and a whole drift-monitoring run, as long tables of checks."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import aggregates, drift
from tidemark.sources.scratch import materialise

#: Severities in ascending order; limits are inclusive.
SEVERITIES = ("pass", "warning", "critical")
PSI_LIMITS, RATE_LIMITS = (0.10, 0.25), (0.01, 0.05)


def severity(value: Column, limits: tuple[float, float]) -> Column:
    return F.when(value >= limits[1], F.lit("critical")).when(value >= limits[0], F.lit("warning")).otherwise(F.lit("pass"))


def severity_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), name).cast("int") - 1


def worst(checks: DataFrame) -> DataFrame:
    """checks with overall_severity on every row; an aggregate of at most a few dozen rows."""
    top = checks.agg(F.element_at(F.array(*map(F.lit, SEVERITIES)), F.max(severity_rank(F.col("severity"))) + 1).alias("overall_severity"))
    return checks.crossJoin(F.broadcast(top))


def _check(order: int, name: str, observed: Column, expected: Column, bad: Column, level: str = "critical") -> Column:
    return F.struct(
        F.lit(order).alias("check_order"), F.lit(name).alias("check_name"), observed.cast("double").alias("observed"), expected.cast("double").alias("expected"),
        F.when(bad, F.lit(level)).otherwise(F.lit("pass")).alias("severity"),
    )


def model_monitoring(preds: DataFrame, scoring: DataFrame, train: DataFrame, supports: list[str], expected_rows: int, expected_entities: int, expected_days: int, expected_last_day: str) -> DataFrame:
    """The ordered checks of a scored batch: volumes, keys, probabilities, thresholds, source, latest date and support.

    preds: entity_id, prediction_date, probability, is_high, threshold; scoring and train: feature rows. All checks come
    from one wide row of aggregates, turned into rows.
    """
    day = lambda c: F.date_format(c, "yyyyMMdd").cast("double")
    sums = preds.agg(F.count_distinct("entity_id").alias("entities"), F.count_distinct("prediction_date").alias("days"), F.max("prediction_date").alias("last_day"))
    source = scoring.agg(F.count(F.lit(1)).alias("scoring_rows"), F.max("prediction_date").alias("scoring_last_day"))
    tops = train.agg(*[F.max(F.col(c).cast("double")).alias(f"top_{c}") for c in supports])
    over = scoring.crossJoin(F.broadcast(tops)).agg(*[F.count_if(F.col(c) > F.col(f"top_{c}")).alias(f"over_{c}") for c in supports])
    wide = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [sums, source, over, aggregates.prediction_quality(preds)])
    c, zero = F.col, F.lit(0)
    checks = [
        _check(1, "row_count", c("source_rows"), F.lit(expected_rows), c("source_rows") != expected_rows),
        _check(2, "entity_count", c("entities"), F.lit(expected_entities), c("entities") != expected_entities),
        _check(3, "day_count", c("days"), F.lit(expected_days), c("days") != expected_days),
        _check(4, "duplicate_keys", c("duplicate_keys"), zero, c("duplicate_keys") > 0),
        _check(5, "null_probability", c("null_p"), zero, c("null_p") > 0),
        _check(6, "probability_out_of_range", c("out_of_range_p"), zero, c("out_of_range_p") > 0),
        _check(7, "threshold_mismatch", c("threshold_mismatch"), zero, c("threshold_mismatch") > 0),
        _check(8, "source_reconciliation", c("source_rows"), c("scoring_rows"), c("source_rows") != c("scoring_rows")),
        _check(9, "latest_date", day(c("last_day")), day(F.lit(expected_last_day).cast("date")), ~(c("last_day").eqNullSafe(F.lit(expected_last_day).cast("date")) & c("scoring_last_day").eqNullSafe(F.lit(expected_last_day).cast("date")))),
        *[_check(10 + i, f"support_{s}", c(f"over_{s}"), zero, c(f"over_{s}") > 0, "warning") for i, s in enumerate(supports)],
    ]
    out = worst(wide.select(F.inline(F.array(*checks))))
    return aggregates.governed(out.withColumn("is_valid", F.col("severity") != "critical").withColumn("invalid_reason", F.when(F.col("severity") == "critical", F.col("check_name"))))


#: Governed views and lineage rows that there must be.
ASSETS, LINEAGE_ROWS = 8, 7


def governance_monitoring(activation_views: dict[str, DataFrame], status: DataFrame, lineage: DataFrame, assets: int = ASSETS, lineage_rows: int = LINEAGE_ROWS) -> DataFrame:
    """Three checks: activation views are rows or one pure empty state; all `assets` views are there and pass; all `lineage_rows` rows are there and valid."""
    states = reduce(DataFrame.unionByName, [v.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("view_state") == "no_activation_runs").alias("empty")) for v in activation_views.values()])
    impure = states.agg(F.count_if((F.col("n") == 0) | ((F.col("empty") > 0) & (F.col("n") != 1))).alias("impure"))
    found = status.agg(F.count(F.lit(1)).alias("assets"), F.count_if(~F.col("status").eqNullSafe("pass")).alias("failing"))
    rows = lineage.agg(F.count(F.lit(1)).alias("lineage_rows"), F.count_if(~F.col("is_valid").eqNullSafe(True)).alias("incomplete"))
    wide = impure.crossJoin(found).crossJoin(rows)
    c, zero = F.col, F.lit(0)
    return worst(wide.select(F.inline(F.array(
        _check(1, "empty_state_validity", c("impure"), zero, c("impure") > 0),
        _check(2, "assets_pass", c("assets") - c("failing"), F.lit(assets), (c("failing") > 0) | (c("assets") != assets)),
        _check(3, "lineage_complete", c("lineage_rows") - c("incomplete"), F.lit(lineage_rows), (c("incomplete") > 0) | (c("lineage_rows") != lineage_rows)),
    ))))


def identity_checks(preds: DataFrame, scoring: DataFrame) -> DataFrame:
    """One row: duplicate ids on either side and ids that only one side has, by a full outer join of keys."""
    keys = ["entity_id", "prediction_date"]
    a, b = preds.groupBy(*keys).agg(F.count(F.lit(1)).alias("p")), scoring.groupBy(*keys).agg(F.count(F.lit(1)).alias("s"))
    both = a.join(b, keys, "full")
    return both.agg(F.coalesce(F.sum(F.col("p") - 1), F.lit(0)).alias("duplicate_predictions"), F.coalesce(F.sum(F.col("s") - 1), F.lit(0)).alias("duplicate_scoring"), F.count_if(F.col("p").isNull() | F.col("s").isNull()).alias("unmatched_ids"))


@dataclass(frozen=True)
class MonitoringPolicy:
    """What a run expects of a batch, and its limits."""

    version: str = "1"
    expected_rows: int = 3500
    expected_entities: int = 500
    expected_days: int = 7
    psi_limits: tuple[float, float] = PSI_LIMITS
    rate_limits: tuple[float, float] = RATE_LIMITS
    bins: int = 10


@dataclass(frozen=True)
class FrozenModel:
    """The model that predictions must come from."""

    name: str
    threshold: float
    features: tuple[str, ...]


def _digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def monitoring_run(train: DataFrame, scoring: DataFrame, preds: DataFrame, train_probability: DataFrame, numeric: list[str], categorical: dict[str, list[str]], policy: MonitoringPolicy, model: FrozenModel, run_id: str, at: str) -> DataFrame:
    """All checks of a run, 16 columns each: 3 volumes, 3 identities, the probability's PSI, every numeric PSI, and PSI and unexpected rate of every categorical.

    train_probability: the model's probabilities on the training rows (column probability). With 44 numeric and 3
    categorical features these are the 57 checks. Predictions and scoring rows must have the same unique ids, else it is an error. Where the
    model's name or threshold differs, the probability's PSI is critical. The checks are kept before the worst severity is taken.
    """
    odd = {k: v for k, v in identity_checks(preds, scoring).first().asDict().items() if v}
    if odd:
        raise ValueError(f"predictions and scoring rows differ: {odd}")
    c, none, number = F.col, F.lit(None).cast("double"), lambda v: F.lit(float(v))
    sizes = {"reference_row_count": train.count(), "current_row_count": scoring.count()}
    wide = preds.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("entity_id").alias("entities"), F.count_distinct("prediction_date").alias("days"),
        F.count_if(~c("model_name").eqNullSafe(F.lit(model.name))).alias("model"), F.count_if(~c("threshold").eqNullSafe(F.lit(model.threshold))).alias("threshold"),
    ).withColumn("schema", F.lit(0 if list(model.features) == [*numeric, *categorical] else 1))
    check = lambda name, kind, observed, expected, bad: F.struct(F.lit(name).alias("check_name"), F.lit(kind).alias("check_type"), F.when(bad, F.lit("critical")).otherwise(F.lit("pass")).alias("severity"), observed.cast("double").alias("observed_value"), expected.alias("expected_value"))
    volumes = {"scoring_row_count": ("rows", policy.expected_rows), "scoring_entity_count": ("entities", policy.expected_entities), "scoring_day_count": ("days", policy.expected_days)}
    head = [check(name, "scoring_volume", c(column), number(want), c(column) != want) for name, (column, want) in volumes.items()]
    head += [check(f"{n}_identity", f"{n}_identity", (c(n) == 0).cast("int"), number(1), c(n) > 0) for n in ("model", "threshold", "schema")]
    shape = ["check_name", "check_type", "severity", "feature_name", "observed_value", "expected_value", "warning_threshold", "critical_threshold", "details"]
    told = wide.select(F.inline(F.array(*head))).withColumns({"feature_name": F.lit(None).cast("string"), "warning_threshold": none, "critical_threshold": none, "details": F.lit("exact match with the governed value")})
    comparable = wide.select(((c("model") == 0) & (c("threshold") == 0)).alias("comparable"))

    def drifted(rows: DataFrame, name: str, kind: str, limits: tuple[float, float], value: str, details: str) -> DataFrame:
        out = rows.withColumns({"check_name": F.concat(F.lit(name), c("feature")), "check_type": F.lit(kind), "severity": severity(c(value), limits), "feature_name": c("feature"), "observed_value": c(value), "expected_value": number(0)})
        return out.withColumns({"warning_threshold": number(limits[0]), "critical_threshold": number(limits[1]), "details": F.lit(details)}).select(*shape)

    p = drift.numeric_psi(train_probability, preds, ["probability"], policy.bins).crossJoin(F.broadcast(comparable)).withColumn("psi", F.when(c("comparable"), c("psi")).otherwise(F.lit(policy.psi_limits[1])))
    parts = [
        told.select(*shape),
        drifted(p, "psi__", "probability_drift", policy.psi_limits, "psi", "probabilities of training rows against the batch's").withColumn("feature_name", F.lit(None).cast("string")),
        drifted(drift.numeric_psi(train, scoring, numeric, policy.bins), "numeric_psi__", "numeric_feature_drift", policy.psi_limits, "psi", "training values against scoring values"),
        drifted(drift.categorical_psi(train, scoring, list(categorical)), "categorical_psi__", "categorical_feature_drift", policy.psi_limits, "psi", "training categories against scoring categories"),
        drifted(drift.unexpected_rates(scoring, categorical), "unexpected_rate__", "unseen_category_rate", policy.rate_limits, "unexpected_rate", "rows outside the approved domain"),
    ]
    checks = materialise(reduce(DataFrame.unionByName, parts), "monitoring-checks")
    stamped = worst(checks).withColumns({"run_id": F.lit(run_id), "monitoring_timestamp": F.lit(at).cast("timestamp_ntz"), "policy_version": F.lit(policy.version), "policy_fingerprint": F.lit(_digest(asdict(policy))), **{k: F.lit(v) for k, v in sizes.items()}})
    return stamped.select("run_id", "monitoring_timestamp", "policy_version", "policy_fingerprint", "overall_severity", *shape[:-1], "reference_row_count", "current_row_count", "details")
