"""Adapters from the supplied tables onto the inputs of the jobs: panel, scores, predictions and contact context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.panel import dense_panel

FIRST_DAY, DAYS = "2024-01-01", 30
THRESHOLD, DECISION_TIME = 0.467, "2024-02-06 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user and day with events."""
    k = F.get_json_object("props", "$.k").cast("int")
    ev = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("activity_date"), "ts", "event_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), k.alias("k"))
    return ev.groupBy("user_id", "activity_date").agg(
        F.sum("cents").alias("amount"),
        F.sum(F.when(F.col("event_type") == "purchase", F.col("cents"))).alias("purchase_amount"),
        F.count_if(F.col("event_type").isin("view", "click")).alias("sessions"),
        F.max("k").alias("k"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"),
    )


def raw_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel before staging: one row for each user and day of the month."""
    entities = table(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id")).distinct()
    facts = daily_events(spark, sf_dir).withColumnRenamed("user_id", "entity_id").withColumnRenamed("activity_date", "date")
    rows = dense_panel(entities, FIRST_DAY, DAYS).join(facts, ["entity_id", "date"], "left")
    delay = F.coalesce(F.col("k"), F.lit(0)) % 4
    amount = F.coalesce("amount", F.lit(0))
    return rows.select(
        "entity_id", "date", F.date_add("date", delay).alias("available_date"), amount.alias("amount"), "purchase_amount", F.coalesce("sessions", F.lit(0)).alias("sessions"), "last_type",
        delay.alias("delay_days"), F.col("purchase_amount").isNull().alias("is_missing"), (amount > 20000).alias("is_outlier"), (delay > 0).alias("is_late"), (F.lit(70000) + 5000 * (F.col("entity_id") % 5)).alias("goal"),
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, p, y: a score with many ties and a label, for evaluation."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), (k / 100).alias("p"), (F.col("value") > 50).alias("y"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity_id, prediction_date, probability, is_high, model_name, threshold."""
    p = F.col("k") / F.lit(100.0)
    return daily_events(spark, sf_dir).select(F.col("user_id").alias("entity_id"), F.col("activity_date").alias("prediction_date"), p.alias("probability"), (p >= THRESHOLD).alias("is_high"), F.lit("demo").alias("model_name"), F.lit(THRESHOLD).alias("threshold"))


def contact_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each customer whose contact rules are known: those of one market segment have none."""
    c, at = F.col("c_custkey"), F.lit(DECISION_TIME).cast("timestamp_ntz")
    allowed = c % 10 != 0
    last = at - F.make_dt_interval(days=(1 + c % 15).cast("int"))
    return table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") != "MACHINERY").select(
        c.alias("entity_id"), allowed.alias("contact_allowed"), (allowed & (c % 13 == 0)).alias("opted_out"), (c % 7 == 0).alias("open_case"),
        F.when(c % 3 != 0, last).alias("last_contacted_at"), (c % 4).alias("interventions_28d"), at.alias("context_as_of"),
    )
