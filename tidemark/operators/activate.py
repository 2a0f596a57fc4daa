"""Activation: a rule ladder that decides on predictions, a capacity, audit rows, and their idempotent ingestion."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.spread import spread_join
from tidemark.sources.commits import Snapshot, TableSet
from tidemark.sources.scratch import materialise

#: Outcomes and final reasons, in their order, and the categories of a review.
OUTCOMES = ("selected_for_review", "no_contact_superseded", "no_contact_below_threshold", "no_contact_excluded", "no_contact_suppressed", "no_contact_capacity")
REASONS = {
    "selected_for_human_review": "selected_for_review",
    "superseded_by_latest_prediction": "no_contact_superseded",
    "below_frozen_threshold": "no_contact_below_threshold",
    "missing_activation_context": "no_contact_excluded",
    "contact_not_permitted": "no_contact_excluded",
    "member_opted_out": "no_contact_excluded",
    "prediction_too_old": "no_contact_suppressed",
    "active_case_open": "no_contact_suppressed",
    "contact_cooldown_active": "no_contact_suppressed",
    "prior_intervention_limit_reached": "no_contact_suppressed",
    "capacity_limit_reached": "no_contact_capacity",
}
CATEGORIES = ("supportive_check_in", "goal_planning", "activity_reminder", "rewards_education")


@dataclass(frozen=True)
class Policy:
    """Limits of a run."""

    policy_id: str = "default"
    max_age_days: int = 7
    cooldown_days: int = 7
    max_interventions: int = 2
    capacity: int = 100
    category: str = CATEGORIES[0]


def fingerprint(policy: Policy) -> Column:
    """SHA-256 of the policy's canonical JSON."""
    import json

    return F.sha2(F.lit(json.dumps(asdict(policy), sort_keys=True, separators=(",", ":"))), 256)


def content_digest(preds: DataFrame) -> DataFrame:
    """One row, `digest`: the same for equal rows in any order."""
    row = F.xxhash64(*sorted(preds.columns))
    sums = preds.select(row.alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.expr("bit_xor(h)").alias("x"))
    return sums.select(F.sha2(F.to_json(F.struct("n", F.col("s").cast("string").alias("s"), "x")), 256).alias("digest"))


def run_id(preds: DataFrame, policy: Policy, at: str) -> DataFrame:
    """One row, `run_id`: act_ and 24 hex digits of source, policy and decision time."""
    return content_digest(preds).select(F.concat(F.lit("act_"), F.substring(F.sha2(F.concat_ws("|", "digest", fingerprint(policy), F.lit(at)), 256), 1, 24)).alias("run_id"))


def input_errors(preds: DataFrame, context: DataFrame, at: str) -> DataFrame:
    """One row of counts that must all be 0, and `empty`, which must be false, before decisions are made."""
    when, probability, threshold = F.lit(at).cast("timestamp_ntz"), F.col("probability"), F.col("threshold")
    sound = lambda c: F.coalesce(~F.isnan(c) & c.between(0.0, 1.0), F.lit(False))
    flag = [F.count_if(~F.col("is_high").eqNullSafe(probability >= threshold)).alias("flag_mismatches")] if "is_high" in preds.columns else []
    p = preds.agg(
        (F.count(F.lit(1)) == 0).alias("empty"), F.count_if(F.col("prediction_date").cast("timestamp_ntz") > when).alias("future_predictions"),
        F.greatest(F.count_distinct("model_name") - 1, F.lit(0)).alias("extra_models"), F.greatest(F.count_distinct("threshold") - 1, F.lit(0)).alias("extra_thresholds"),
        F.count_if(F.col("entity_id").isNull() | F.col("prediction_date").isNull() | F.col("model_name").isNull()).alias("null_keys"),
        F.count_if(~sound(probability)).alias("bad_probabilities"), F.count_if(~sound(threshold)).alias("bad_thresholds"), *flag,
    )
    twice = preds.groupBy("entity_id", "prediction_date").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_predictions"))
    odd = F.col("contact_allowed").isNull() | F.col("opted_out").isNull() | F.col("open_case").isNull()
    limits = F.col("interventions_28d").isNull() | (F.col("interventions_28d") < 0)
    own = context.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.max("last_contacted_at").alias("last"), F.count_if(odd).alias("odd"), F.count_if(limits).alias("limits"))
    c = own.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_contexts"), F.count_if(F.col("last") > when).alias("contacts_after_decision"),
        F.count_if(F.col("entity_id").isNull()).alias("null_context_ids"), F.coalesce(F.sum("odd"), F.lit(0)).alias("null_flags"), F.coalesce(F.sum("limits"), F.lit(0)).alias("bad_counts"),
    )
    return p.crossJoin(twice).crossJoin(c)


def with_latest(preds: DataFrame) -> DataFrame:
    """preds with each entity's latest prediction date as `latest`, found by partial aggregates: no task gathers an entity."""
    own = preds.filter("entity_id IS NOT NULL").groupBy("entity_id").agg(F.max("prediction_date").alias("latest"), F.count(F.lit(1)).alias("_n"))
    return spread_join(preds, own, ["entity_id"], "_n", preds.count(), "left")


def decide(preds: DataFrame, context: DataFrame, policy: Policy, at: str, strict: bool = True) -> DataFrame:
    """One audit row for each prediction: outcome, reason, rank and category.

    The first rule that applies decides. Eligible rows are ranked by probability, then date, both descending, then entity; the first
    `capacity` are selected. Only those are ranked (a top-k of at most `capacity` rows), so no task sorts the table.
    The rules fail closed: a probability that is null, NaN or outside [0, 1] is below the threshold, and a null permission, flag, count or
    date is one that forbids. With `strict` such inputs are an error before any decision is made.
    """
    if strict:
        bad = {k: v for k, v in input_errors(preds, context, at).first().asDict().items() if v}
        if bad:
            raise ValueError(f"predictions or contexts are unsound: {bad}")
    when = F.lit(at).cast("timestamp_ntz")
    rows = with_latest(preds).join(context.withColumn("has_context", F.lit(True)), "entity_id", "left")
    age = F.datediff(when.cast("date"), F.col("prediction_date"))
    p = F.col("probability")
    unless = lambda fine: ~F.coalesce(fine, F.lit(False))
    ladder = [
        (F.col("prediction_date") < F.col("latest"), "superseded_by_latest_prediction"),
        (unless((p >= F.col("threshold")) & ~F.isnan(p) & p.between(0.0, 1.0) & F.col("threshold").between(0.0, 1.0)), "below_frozen_threshold"),
        (F.col("has_context").isNull(), "missing_activation_context"),
        (unless(F.col("contact_allowed")), "contact_not_permitted"),
        (unless(~F.col("opted_out")), "member_opted_out"),
        (unless(age.between(0, policy.max_age_days)), "prediction_too_old"),
        (unless(~F.col("open_case")), "active_case_open"),
        (when < F.col("last_contacted_at") + F.make_dt_interval(days=F.lit(policy.cooldown_days)), "contact_cooldown_active"),
        (unless(F.col("interventions_28d") < policy.max_interventions), "prior_intervention_limit_reached"),
    ]
    judged = rows.withColumn("reason", F.coalesce(*[F.when(test, F.lit(reason)) for test, reason in ladder])).select("entity_id", "prediction_date", "probability", "threshold", "model_name", "reason")
    order = [F.desc("probability"), F.desc("prediction_date"), F.asc("entity_id")]
    chosen = judged.filter(F.col("reason").isNull()).orderBy(*order).limit(policy.capacity)
    chosen = F.broadcast(chosen.select("entity_id", "prediction_date", F.row_number().over(Window.orderBy(*order)).alias("priority_rank")))  # at most `capacity` rows
    out = judged.join(chosen, ["entity_id", "prediction_date"], "left")
    picked = F.col("priority_rank").isNotNull()
    reason = F.coalesce("reason", F.when(picked, F.lit("selected_for_human_review")).otherwise(F.lit("capacity_limit_reached")))
    outcome = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    out = out.withColumn("reason", reason).withColumn("outcome", outcome[F.col("reason")])
    return out.select("entity_id", "prediction_date", "probability", "threshold", "model_name", "outcome", "reason", "priority_rank", F.when(picked, F.lit(policy.category)).alias("category"), F.lit(policy.policy_id).alias("policy_id"), when.alias("decided_at"))


def run_audit(decisions: DataFrame, policy: Policy, ident: DataFrame) -> DataFrame:
    """One row of counts by outcome, and whether the run's sums agree."""
    counts = decisions.agg(F.count(F.lit(1)).alias("source_rows"), F.count_distinct("entity_id").alias("entities"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES], F.max("threshold").alias("threshold"), F.max("decided_at").alias("decided_at"))
    counts = counts.withColumn("eligible", F.col("selected_for_review") + F.col("no_contact_capacity")).withColumn("capacity", F.lit(policy.capacity))
    total = reduce(lambda a, b: a + b, [F.col(o) for o in OUTCOMES])
    sound = (total == F.col("source_rows")) & (F.col("source_rows") - F.col("no_contact_superseded") == F.col("entities")) & (F.col("selected_for_review") <= F.col("capacity"))
    return ident.crossJoin(counts.withColumn("reconciles", sound))


def review_queue(decisions: DataFrame) -> DataFrame:
    """The selected rows in rank order, all pending; ranks run from 1 without a gap."""
    return decisions.filter(F.col("outcome") == "selected_for_review").select("priority_rank", "entity_id", "prediction_date", "probability", "category", F.lit("pending").alias("review_status")).orderBy("priority_rank")


def conflicts(target: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """One row: duplicate keys on either side, and staged rows that differ from the stored row of their key (null-safe)."""
    twice = lambda df, n: df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias(n))
    others = [c for c in staged.columns if c not in keys]
    both = staged.alias("s").join(target.alias("t"), [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys])
    differ = reduce(lambda a, b: a | b, [~F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}")) for c in others], F.lit(False))
    return twice(target, "target_duplicates").crossJoin(twice(staged, "staged_duplicates")).crossJoin(both.agg(F.count_if(differ).alias("conflicting_rows")))


def unseen(target: DataFrame, staged: DataFrame, keys: list[str]) -> DataFrame:
    """The staged rows whose key the target lacks."""
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    return staged.alias("s").join(target.alias("t"), on, "left_anti")


def ingest(tables: dict[str, tuple[DataFrame, DataFrame, list[str], str]]) -> dict[str, int]:
    """Append the unseen rows of several tables: {name: (target, staged, keys, path)}; the last one marks the run as whole.

    All tables are checked before any is written, and a repeated call appends nothing: rows are insert-only.
    """
    new = {}
    for name, (target, staged, keys, _) in tables.items():
        bad = {k: v for k, v in conflicts(target, staged, keys).first().asDict().items() if v}
        if bad:
            raise ValueError(f"{name}: {bad}")
        new[name] = unseen(target, staged, keys)
    counts = {}
    for name, rows in new.items():
        kept = materialise(rows, f"ingest-{name}")  # computed once: what is counted is what is written
        counts[name] = kept.count()
        if counts[name]:
            kept.write.mode("append").parquet(tables[name][3])
    return counts


def ingest_atomic(store: TableSet, staged: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, int]:
    """Append the unseen rows of several tables ({name: (staged, keys)}) in one commit; how many each got.

    Rows are insert-only: a staged row that differs from the stored one of its key, or a repeated key, is an error and nothing is written. A crash before the
    commit leaves nothing to be read; callers that race with the same keys append them once, as the later one finds them stored.
    """

    def make(snapshot: Snapshot) -> dict[str, DataFrame]:
        new = {}
        for name, (rows, keys) in staged.items():
            target = store.read(name, snapshot)
            bad = {k: v for k, v in conflicts(target, rows, keys).first().asDict().items() if v}
            if bad:
                raise ValueError(f"{name}: {bad}")
            new[name] = unseen(target, rows, keys)
        return new

    return store.commit(make)[1]


def stored_conflicts(spark: SparkSession, table: str, staged: DataFrame, keys: list[str], partition: str | None = None) -> DataFrame:
    """conflicts() against a table stored in buckets of its keys (see tables.write_bucketed), which is not shuffled.

    The staged rows go to the table's buckets, and only the partitions whose values they have are read. Keys must not be null: where one is, that is counted
    as null_keys.
    """
    target, others = spark.table(table), [c for c in staged.columns if c not in keys]
    if partition:
        values = [r[0] for r in staged.select(partition).distinct().collect()]  # a batch's partitions
        target = target.filter(F.col(partition).isin(values))
    rows = staged.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    twice = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias(n))
    both = rows.hint("merge").select(*keys, F.struct(*others).alias("staged")).join(target.select(*keys, F.struct(*others).alias("stored")), keys)
    differ = both.agg(F.count_if(~F.col("staged").eqNullSafe(F.col("stored"))).alias("conflicting_rows"), F.count(F.lit(1)).alias("known_rows"))
    nulls = staged.agg(F.count_if(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])).alias("null_keys"))
    return twice(target, "target_duplicates").crossJoin(twice(rows, "staged_duplicates")).crossJoin(differ).crossJoin(nulls)


def context_errors(context: DataFrame, at: str) -> DataFrame:
    """One row of counts of unsound contexts, by rule."""
    when = F.lit(at).cast("timestamp_ntz")
    rows = context.agg(
        F.count_if(F.col("entity_id").isNull() | (F.trim(F.col("entity_id").cast("string")) == "")).alias("blank_ids"),
        (F.count("entity_id") - F.count_distinct("entity_id")).alias("duplicate_ids"),
        F.count_if(F.col("contact_allowed").isNull() | F.col("opted_out").isNull() | F.col("open_case").isNull()).alias("null_flags"),
        F.count_if(F.col("interventions_28d").isNull() | (F.col("interventions_28d") < 0)).alias("bad_counts"),
        F.count_if(~F.col("contact_allowed") & F.col("opted_out")).alias("opted_out_but_never_allowed"),
        F.greatest(F.count_distinct("context_as_of") - 1, F.lit(0)).alias("extra_snapshots"), F.count_if(F.col("context_as_of").isNull()).alias("null_snapshots"),
        F.count_if(F.col("last_contacted_at") > F.col("context_as_of")).alias("contacts_after_snapshot"),
        F.count_if(F.col("context_as_of") > when).alias("snapshots_after_decision"),
    )
    return rows
