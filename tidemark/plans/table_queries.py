"""Queries on sources, sinks and contracts of stored tables, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import aggregates, evaluate, model, panel
from tidemark.plans.panel_queries import rounded
from tidemark.sources import demo, tables
from tidemark.sources.scratch import scratch

EVENT_SCHEMA = "event_id long, user_id long, event_type string, day date"


def pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the columns, by type of event."""
    return rounded(tables.scan(spark, f"{sf_dir}/events.parquet", ["event_type", "value"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")), 2)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("date").alias("day"))


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported rows as read back, and how many of their neighbours break the order."""
    path = scratch(spark, "export")
    tables.export_ordered(_events(spark, sf_dir), ["event_id", "user_id", "day"], {"user_id": "entity_id"}, ["entity_id", "day", "event_id"], path)
    kept = spark.read.parquet(path)
    broken = tables.ordered_violations(kept, ["entity_id", "day", "event_id"], spark.read.parquet(f"{path}.zones")).agg(F.count(F.lit(1)).alias("out_of_order"))
    return kept.crossJoin(F.broadcast(broken))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "paired")
    tables.write_both(_events(spark, sf_dir), path)
    return tables.both_agree(spark, path)


def partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and users of each folder of a table by day, from one day's folders on."""
    path = scratch(spark, "by-day")
    tables.write_partitioned(_events(spark, sf_dir), path, "day", ["user_id"])
    return spark.read.parquet(path).filter(F.col("day") >= F.lit("2024-01-16").cast("date")).groupBy("day").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"))


def loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table loaded from text values twice: the second load replaces the first."""
    path, text = scratch(spark, "loaded"), _events(spark, sf_dir)
    text = text.select(*[F.col(c).cast("string").alias(c) for c in text.columns])
    tables.staged_load(text, EVENT_SCHEMA, path)
    return tables.staged_load(text, EVENT_SCHEMA, path).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.max("day").alias("last_day"))


def sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.store_predictions(demo.predictions(spark, sf_dir), scratch(spark, "stored-predictions"))


def text_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that are text: true, false, and for some events neither."""
    y = F.when(F.col("value") > 50, F.lit("true")).when(F.col("value") > 10, F.lit("FALSE")).otherwise(F.lit("unknown"))
    k = F.get_json_object("props", "$.k").cast("double")
    rows = demo.table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), (k / 100).alias("p"), y.alias("y"))
    return evaluate.usable(rows).groupBy("y").agg(F.count(F.lit(1)).alias("rows"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by the UTC day of a local time two hours ahead, given as text; some of the texts are no times."""
    local = F.when(F.col("event_id") % 50 == 0, F.lit("unknown")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00")))
    parts = panel.calendar_parts(demo.table(spark, sf_dir, "events").select(local.alias("local_time")), "local_time")
    return parts.groupBy("utc_date", "day_of_year", "iso_weekday", "is_weekend").agg(F.count(F.lit(1)).alias("events"))


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL reads from a published view."""
    tables.publish({"tidemark_daily": aggregates.scoring_daily_summary(demo.predictions(spark, sf_dir))})
    return spark.sql("SELECT prediction_date, scored_rows, high_rows FROM tidemark_daily WHERE is_valid")


def persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What another session reads from a view that this one has put into the catalog."""
    text = "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS events, count_if(event_type = 'purchase') AS purchases FROM events GROUP BY user_id, CAST(ts AS DATE)"
    tables.publish_persistent(spark, "tidemark_published", {"events": f"{sf_dir}/events.parquet"}, {"user_days": text})
    return spark.newSession().sql("SELECT day, count(*) AS users, sum(events) AS events, sum(purchases) AS purchases FROM tidemark_published.user_days GROUP BY day")


def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by day, built without the purchases of the month's second half, after these have arrived late."""
    path, rows = scratch(spark, "refreshed-by-day"), _events(spark, sf_dir)
    late = rows.filter((F.col("event_type") == "purchase") & (F.col("day") >= F.lit("2024-01-16").cast("date")))
    daily = lambda df: df.groupBy("day", "user_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))
    tables.write_partitioned(daily(rows.join(late.select("event_id"), "event_id", "left_anti")), path, "day", ["user_id"])
    tables.refresh_partitions(path, "day", late, lambda touched: daily(rows.join(F.broadcast(touched), "day", "left_semi")), ["user_id"])
    return spark.read.parquet(path)


KEYS = {"customer": "c_custkey", "events": "event_id", "lineitem": "l_orderkey", "orders": "o_orderkey", "part": "p_partkey"}


def footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and the range of a key of five tables, from their files' footers."""
    one = lambda t, k: tables.footer_facts(spark, t, f"{sf_dir}/{t}.parquet", [k]).select("table_name", "row_count", F.col(f"min_{k}").cast("long").alias("first_key"), F.col(f"max_{k}").cast("long").alias("last_key"))
    return reduce(DataFrame.unionByName, [one(t, k) for t, k in KEYS.items()])


QUERIES = {
    "pruned_scan": pruned,
    "ordered_export": exported,
    "paired_export": paired,
    "partitioned_table": partitioned,
    "staged_load": loaded,
    "prediction_sink": sink,
    "prediction_summary": lambda s, d: rounded(model.prediction_summary(demo.predictions(s, d))),
    "text_labels": text_labels,
    "calendar_parts": calendar,
    "published_view": published,
    "persisted_view": persisted,
    "refreshed_table": refreshed,
    "footer_facts": footers,
    "edge_rows": lambda s, d: tables.edge_rows(demo.raw_panel(s, d).select("entity_id", "date", "amount"), "entity_id", "date", 3),
}
_EVENTS = "SELECT event_id, user_id, event_type, ts::date AS day FROM events"
_PREDS = """
WITH daily AS (SELECT user_id AS entity_id, ts::date AS prediction_date, max((props->>'k')::int) AS k FROM events GROUP BY ALL),
preds AS (SELECT entity_id, prediction_date, k / 100.0::double AS probability, k / 100.0::double >= 0.467::double AS is_high, 'demo' AS model_name, 0.467::double AS threshold FROM daily)
"""
SQL = {
    "pruned_scan": "SELECT event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY event_type",
    "ordered_export": "SELECT event_id, user_id AS entity_id, ts::date AS day, 0 AS out_of_order FROM events",
    "paired_export": "SELECT count(*) AS parquet_rows, count(*) AS csv_rows, 0 AS differing_rows, true AS columns_equal, true AS agree FROM events",
    "partitioned_table": f"SELECT day, count(*) AS events, count(DISTINCT user_id) AS users FROM ({_EVENTS}) WHERE day >= date '2024-01-16' GROUP BY day",
    "staged_load": f"SELECT event_type, count(*) AS rows, max(day) AS last_day FROM ({_EVENTS}) GROUP BY event_type",
    "prediction_sink": _PREDS + "SELECT * FROM preds",
    "prediction_summary": _PREDS
    + """SELECT count(*) AS row_count, count(DISTINCT entity_id) AS entity_count, min(prediction_date) AS first_date, max(prediction_date) AS last_date, count_if(is_high)::bigint AS high_count,
  round(count_if(is_high) / count(*)::double, 6) AS high_rate, round(min(probability), 6) AS min_probability, round(avg(probability), 6) AS mean_probability, round(max(probability), 6) AS max_probability FROM preds""",
    "text_labels": "SELECT value > 50 AS y, count(*) AS rows FROM events WHERE value > 10 AND (props->>'k') IS NOT NULL GROUP BY ALL",
    "calendar_parts": """
WITH e AS (SELECT CASE WHEN event_id % 50 <> 0 THEN (date_trunc('second', ts) - interval 2 hour)::date END AS utc_date FROM events)
SELECT utc_date, dayofyear(utc_date)::int AS day_of_year, isodow(utc_date)::int AS iso_weekday, isodow(utc_date) >= 6 AS is_weekend, count(*) AS events FROM e GROUP BY ALL""",
    "published_view": _PREDS + "SELECT prediction_date, count(*) AS scored_rows, count_if(is_high)::bigint AS high_rows FROM preds GROUP BY prediction_date",
    "persisted_view": """
SELECT day, count(*) AS users, sum(n)::bigint AS events, sum(p)::bigint AS purchases FROM (SELECT user_id, ts::date AS day, count(*) AS n, count_if(event_type = 'purchase') AS p FROM events GROUP BY ALL) GROUP BY day""",
    "refreshed_table": f"SELECT day, user_id, count(*) AS events, count_if(event_type = 'purchase')::bigint AS purchases FROM ({_EVENTS}) GROUP BY ALL",
    "footer_facts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count, min({k})::bigint AS first_key, max({k})::bigint AS last_key FROM {t}" for t, k in KEYS.items()),
    "edge_rows": """
WITH days AS (SELECT date '2024-01-01' + i::int AS date FROM range(30) r(i)), users AS (SELECT DISTINCT user_id AS entity_id FROM events),
daily AS (SELECT user_id AS entity_id, ts::date AS date, sum(round(value * 100)::bigint)::bigint AS amount FROM events GROUP BY ALL),
panel AS (SELECT entity_id, date, coalesce(amount, 0) AS amount FROM users CROSS JOIN days LEFT JOIN daily USING (entity_id, date))
SELECT *, 'first' AS edge FROM panel WHERE date < date '2024-01-04' UNION ALL SELECT *, 'last' FROM panel WHERE date > date '2024-01-27'
""",
}
