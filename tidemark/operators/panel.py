"""Panel preparation: staging, dense panels, weekly goals, labels, as-of features and chronological splits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.spread import spread_join
from tidemark.operators import arrivals


def stage_panel(raw: DataFrame, dates: tuple[str, ...] = ("date", "available_date", "week_start"), key_date: str = "date") -> DataFrame:
    """Cast the date-like columns, name the key date activity_date, and leave every other column and null as it is."""
    cast = {c: F.col(c).cast("date") for c in dates if c in raw.columns}
    return raw.withColumns(cast).withColumnRenamed(key_date, "activity_date")


def dense_panel(entities: DataFrame, first_day: str, days: int) -> DataFrame:
    """Every entity on every day: entity columns and `date`. The calendar is bounded by `days`, so it is exploded in place."""
    calendar = F.sequence(F.lit(first_day).cast("date"), F.date_add(F.lit(first_day).cast("date"), days - 1))
    return entities.withColumn("date", F.explode(calendar))


def weekly_progress(panel: DataFrame, value: str = "amount", goal: str = "goal") -> DataFrame:
    """week_start (Monday), the running total of the week, and the share of the goal in per cent to one decimal (half even)."""
    week = F.date_trunc("week", "activity_date").cast("date")
    running = F.sum(value).over(Window.partitionBy("entity_id", "week_start").orderBy("activity_date").rowsBetween(Window.unboundedPreceding, 0))
    rows = panel.withColumn("week_start", week).withColumn("week_total", running)
    return rows.withColumn("goal_percentage", F.bround(F.try_divide(F.col("week_total") * 100.0, F.col(goal).cast("double")), 1))


def weekly_history(panel: DataFrame, value: str = "amount", goal: str = "goal") -> DataFrame:
    """entity_id, week_start, week_total, completed, streak_before, failures_before: what was known before each week."""
    weeks = panel.groupBy("entity_id", F.date_trunc("week", "activity_date").cast("date").alias("week_start")).agg(F.sum(value).alias("week_total"), F.max(goal).alias("goal"))
    order = Window.partitionBy("entity_id").orderBy("week_start")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    weeks = weeks.withColumn("completed", F.col("week_total") >= F.col("goal")).withColumn("n", F.row_number().over(order))
    last_failure = F.coalesce(F.max(F.when(~F.col("completed"), F.col("n"))).over(past), F.lit(0))
    failures = F.coalesce(F.sum(F.when(~F.col("completed"), 1).otherwise(0)).over(past), F.lit(0))
    return weeks.select("entity_id", "week_start", "week_total", "completed", (F.col("n") - 1 - last_failure).cast("long").alias("streak_before"), failures.alias("failures_before"))


def goal_history(panel: DataFrame, value: str = "amount", goal: str = "goal") -> DataFrame:
    """panel with each day's week facts: many days to one week, joined on entity and week."""
    weeks = weekly_history(panel, value, goal).select("entity_id", "week_start", "streak_before", "failures_before")
    return panel.withColumn("week_start", F.date_trunc("week", "activity_date").cast("date")).join(weeks, ["entity_id", "week_start"], "left")


def future_label(panel: DataFrame, horizon: int = 7, value: str = "amount", goal: str = "goal") -> DataFrame:
    """future_amount, goal_met and will_miss over the next `horizon` rows of the entity; null where fewer follow."""
    ahead = Window.partitionBy("entity_id").orderBy("activity_date").rowsBetween(1, horizon)
    whole = F.count(F.lit(1)).over(ahead) == horizon
    rows = panel.withColumn("future_amount", F.when(whole, F.sum(value).over(ahead)))
    return rows.withColumn("goal_met", F.col("future_amount") >= F.col(goal)).withColumn("will_miss", ~F.col("goal_met"))


def recency(panel: DataFrame, value: str = "sessions") -> DataFrame:
    """days_since: rows since the last one with a positive value, itself included as 0; from the start where there was none."""
    order = Window.partitionBy("entity_id").orderBy("activity_date")
    rows = panel.withColumn("_n", F.row_number().over(order))
    last = F.last(F.when(F.col(value) > 0, F.col("_n")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("days_since", F.col("_n") - F.coalesce(last, F.lit(0)).cast("long")).drop("_n")


@dataclass(frozen=True)
class Metric:
    """One feature: `how` over `column` in the whole history, its recent days, or the as many days before those."""

    name: str
    how: str  # latest, sum, avg, std, min, max, count, observed, true, positive
    column: str | None = None
    window: str = "all"  # all, recent, prior


#: The jobs' default catalogue for a daily panel with these columns; trends, rates and coverage are derived from it.
DEFAULT_METRICS = (
    *(Metric(f"latest_{c}", "latest", c) for c in ("age_band", "membership_months", "activity_level", "reward_profile", "intervention_profile", "weekly_goal", "weekly_active_minutes_so_far", "goal_completion_percentage", "previous_goal_streak", "previous_failed_goals", "days_since_last_app_session")),
    *(Metric(f"{c}_{w}", h, c, s) for c in ("daily_steps", "active_minutes") for w, h, s in (("mean", "avg", "all"), ("std", "std", "all"), ("recent_mean", "avg", "recent"), ("prior_mean", "avg", "prior"))),
    Metric("active_minutes_sum", "sum", "active_minutes"),
    Metric("active_days", "positive", "active_minutes"),
    Metric("sleep_mean", "avg", "sleep_hours"),
    Metric("sleep_recent_mean", "avg", "sleep_hours", "recent"),
    Metric("sleep_days", "observed", "sleep_hours"),
    Metric("sleep_missing_days", "true", "sleep_hours_missing"),
    Metric("app_sessions_sum", "sum", "app_sessions"),
    *(Metric(f"app_sessions_{w}mean", "avg", "app_sessions", s) for w, s in (("", "all"), ("recent_", "recent"), ("prior_", "prior"))),
    Metric("app_session_days", "observed", "app_sessions"),
    Metric("app_session_missing_days", "true", "app_sessions_missing"),
    *(Metric(f"{c}_sum", "sum", c) for c in ("rewards_viewed", "rewards_redeemed")),
    *(Metric(f"{c}_days", "true", c) for c in ("intervention_received", "intervention_opened", "intervention_clicked", "is_step_outlier", "is_late_record", "activity_level_changed")),
    Metric("goal_percentage_mean", "avg", "goal_completion_percentage"),
)
DEFAULT_TRENDS = {f"{c}_trend": (f"{c}_recent_mean", f"{c}_prior_mean") for c in ("daily_steps", "active_minutes", "app_sessions")}
DEFAULT_RATES = {
    "redemption_rate": ("rewards_redeemed_sum", "rewards_viewed_sum"),
    "open_rate": ("intervention_opened_days", "intervention_received_days"),
    "click_rate": ("intervention_clicked_days", "intervention_received_days"),
}


def _aggregate(m: Metric, date: Column, anchor: Column, recent: int) -> Column:
    age = F.datediff(anchor, date)  # 1 is the day before the anchor
    inside = {"all": None, "recent": age.between(1, recent), "prior": age.between(recent + 1, 2 * recent)}[m.window]
    value = F.col(f"h.{m.column}") if m.column else F.lit(1)
    value = value if inside is None else F.when(inside, value)
    plain = {"sum": F.sum, "avg": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    if m.how in plain:
        return plain[m.how](value).alias(m.name)
    if m.how == "latest":
        return F.max_by(value, F.when(value.isNotNull(), date)).alias(m.name)
    if m.how == "observed":
        return F.count(value).alias(m.name)
    if m.how == "count":
        return F.count(F.when(date.isNotNull() if inside is None else inside, 1)).alias(m.name)
    return F.count_if(value if m.how == "true" else value > 0).alias(m.name)


def asof_features(
    panel: DataFrame, metrics: tuple[Metric, ...] = DEFAULT_METRICS, history: int = 28, recent: int = 7, label: str | None = "will_miss_goal_next_7_days", trends: dict[str, tuple[str, str]] = DEFAULT_TRENDS, rates: dict[str, tuple[str, str]] = DEFAULT_RATES, strategy: str = "auto", dense_days: int = 200
) -> DataFrame:
    """What was known at the start of each day about the `history` days before it.

    An anchor is a day at least `history` days after its entity's first; it sees a row only if its day lies in
    [t - history, t - 1] and it had arrived by t. A row without an arrival date is never seen. Anchors without any row to see stay, with nulls and
    zero counts; a row without an entity or a day is neither anchor nor seen. The panel has one row for an entity and day.

    All strategies give equal results. "range" joins on the entity and filters the days: one shuffle by entity, work of days x days each. "explode"
    sends each row to the at most `history` anchors that see it and joins on (entity, t): linear in the rows, partial
    sums apply, and a long or hot entity spreads over many keys. "arrival" frames blocks of days by window and sends only late rows once more, to the day of their
    arrival (see arrivals.py): a hot entity spreads over its blocks. "auto" takes "arrival" where some entity has more than `dense_days` rows.
    """
    kept = ["entity_id", "activity_date", *([label] if label else [])]
    used = sorted({m.column for m in metrics if m.column})
    entities = panel.filter("entity_id IS NOT NULL").groupBy("entity_id").agg(F.min("activity_date").alias("_first"), F.count(F.lit(1)).alias("_n"))
    if strategy != "arrival":
        total, longest = entities.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
        strategy = strategy if strategy != "auto" else "arrival" if longest > dense_days else "range"
    if strategy == "arrival":
        empty = panel.alias("h").groupBy("h.entity_id").agg(*[_aggregate(m, F.col("h.activity_date"), F.col("h.activity_date"), recent) for m in metrics])  # never run: for its types
        out = arrivals.features_by_arrival(panel, metrics, kept[2:], history, recent, dict(empty.dtypes))
        return _derived(out, history, trends, rates)
    anchors = spread_join(panel.select(*kept), entities, ["entity_id"], "_n", total).filter(F.col("activity_date") >= F.date_add("_first", history)).drop("_first")
    anchors = anchors.withColumnRenamed("activity_date", "prediction_date").alias("a")
    rows = panel.select(*dict.fromkeys(["entity_id", "activity_date", "available_date", *used])).filter("available_date IS NOT NULL")
    t, date = F.col("a.prediction_date"), F.col("h.activity_date")
    if strategy == "range":
        on = (F.col("a.entity_id") == F.col("h.entity_id")) & date.between(F.date_sub(t, history), F.date_sub(t, 1)) & (F.col("h.available_date") <= t)
        joined = anchors.join(rows.alias("h"), on, "left")
    else:
        seen = F.greatest(F.date_add("activity_date", 1), F.col("available_date"))
        last = F.date_add("activity_date", history)
        h = rows.filter(seen <= last).withColumn("t", F.explode(F.sequence(seen, last))).alias("h")
        joined = anchors.join(h, (F.col("a.entity_id") == F.col("h.entity_id")) & (t == F.col("h.t")), "left")
    keys = [F.col("a.entity_id"), t, *([F.col(f"a.{label}")] if label else [])]
    coverage = [F.count(date).alias("available_days"), F.max(date).alias("max_activity_date"), F.max("h.available_date").alias("max_available_date")]
    out = joined.groupBy(*keys).agg(*[_aggregate(m, date, t, recent) for m in metrics], *coverage)
    return _derived(out, history, trends, rates)


def _derived(out: DataFrame, history: int, trends: dict[str, tuple[str, str]], rates: dict[str, tuple[str, str]]) -> DataFrame:
    """out with the window's ends, the days that were not available, differences and rates of its columns."""
    out = out.withColumns({"window_start": F.date_sub("prediction_date", history), "window_end": F.date_sub("prediction_date", 1), "unavailable_days": F.lit(history) - F.col("available_days")})
    out = out.withColumns({n: F.col(a) - F.col(b) for n, (a, b) in trends.items()}) if trends else out
    return out.withColumns({n: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")) for n, (a, b) in rates.items()}) if rates else out


def chronological_split(features: DataFrame, ranges: dict[str, tuple[str, str]], date: str = "prediction_date", name: str = "dataset_split") -> DataFrame:
    """features with the split whose inclusive dates hold the row, or `unassigned`."""
    tests = [F.when(F.col(date).between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(split)) for split, (a, b) in ranges.items()]
    return features.withColumn(name, F.coalesce(*tests, F.lit("unassigned")))


def split_of(frame: DataFrame, split: str) -> DataFrame:
    """The rows of one split."""
    return frame.filter(F.col("dataset_split") == split)


def model_matrix(frame: DataFrame, predictors: list[str], label: str, ids: tuple[str, ...] = ("entity_id", "prediction_date"), forbidden: tuple[str, ...] = ()) -> DataFrame:
    """The ids, the label and the approved predictors in their order; a forbidden or missing one is an error."""
    leaked, missing = sorted(set(predictors) & set(forbidden)), [c for c in predictors if c not in frame.columns]
    if leaked or missing or len(set(predictors)) != len(predictors):
        raise ValueError(f"predictors leak {leaked}, miss {missing}, or repeat")
    return frame.select(*ids, label, *predictors)


def calendar_parts(df: DataFrame, time: str) -> DataFrame:
    """df with the UTC time of `time`, text with an offset or a timestamp, and its date, day of year, ISO weekday and whether that is a weekend.

    Text that is no time gives nulls.
    """
    at = F.col(time).try_cast("timestamp") if dict(df.dtypes)[time] == "string" else F.col(time).cast("timestamp")
    utc = F.convert_timezone(None, F.lit("UTC"), at.cast("timestamp_ntz"))
    out = df.withColumn("utc_time", utc).withColumn("utc_date", F.col("utc_time").cast("date"))
    weekday = F.weekday("utc_date") + 1
    return out.withColumns({"day_of_year": F.dayofyear("utc_date"), "iso_weekday": weekday, "is_weekend": weekday >= 6})
