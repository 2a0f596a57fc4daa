"""Queries on the daily panel and on scored rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evaluate, panel
from tidemark.operators.panel import Metric
from tidemark.sources import demo

METRICS = (
    Metric("latest_type", "latest", "last_type"), Metric("latest_purchase", "latest", "purchase_amount"), Metric("latest_goal", "latest", "goal"),
    Metric("amount_sum", "sum", "amount"), Metric("amount_mean", "avg", "amount"), Metric("amount_std", "std", "amount"),
    Metric("amount_recent_mean", "avg", "amount", "recent"), Metric("amount_prior_mean", "avg", "amount", "prior"), Metric("active_days", "positive", "amount"),
    Metric("sessions_sum", "sum", "sessions"), Metric("sessions_recent_mean", "avg", "sessions", "recent"), Metric("sessions_prior_mean", "avg", "sessions", "prior"),
    Metric("purchase_sum", "sum", "purchase_amount"), Metric("purchase_days", "observed", "purchase_amount"), Metric("missing_days", "true", "is_missing"),
    Metric("outlier_days", "true", "is_outlier"), Metric("late_days", "true", "is_late"),
)
TRENDS = {"amount_trend": ("amount_recent_mean", "amount_prior_mean"), "sessions_trend": ("sessions_recent_mean", "sessions_prior_mean")}
RATES = {"purchase_rate": ("purchase_days", "active_days"), "purchase_share": ("purchase_sum", "amount_sum")}
SPLITS = {"train": ("2024-01-15", "2024-01-19"), "validation": ("2024-01-20", "2024-01-21"), "test": ("2024-01-22", "2024-01-23"), "scoring": ("2024-01-24", "2024-01-30")}


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.stage_panel(demo.raw_panel(spark, sf_dir))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.future_label(staged(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str, strategy: str = "range") -> DataFrame:
    return panel.asof_features(labelled(spark, sf_dir), METRICS, 14, 7, "will_miss", TRENDS, RATES, strategy)


def features_of_lost_rows(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    """Features where the latest rows of days with an odd number of sessions never arrive."""
    lost = F.col("delay_days") + F.col("sessions") % 2 * 4 >= 6
    rows = labelled(spark, sf_dir).withColumn("available_date", F.when(~lost, F.col("available_date")))
    return panel.asof_features(rows, METRICS, 14, 7, "will_miss", TRENDS, RATES, strategy)


def split_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.chronological_split(features(spark, sf_dir), SPLITS)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, where sums in another order differ in the last digits."""
    return df.withColumns({c: F.round(c, places) for c, t in df.dtypes if t == "double"})


def wide_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.evaluate_binary(demo.scored_events(spark, sf_dir), 0.467))


QUERIES = {
    "stage_panel": staged,
    "dense_panel": lambda s, d: panel.dense_panel(demo.table(s, d, "events").select(F.col("user_id").alias("entity_id")).distinct(), demo.FIRST_DAY, demo.DAYS),
    "weekly_progress": lambda s, d: panel.weekly_progress(staged(s, d)).select("entity_id", "activity_date", "week_start", "week_total", "goal_percentage"),
    "goal_history": lambda s, d: panel.goal_history(staged(s, d)).select("entity_id", "activity_date", "week_start", "streak_before", "failures_before"),
    "future_label": lambda s, d: labelled(s, d).select("entity_id", "activity_date", "future_amount", "goal_met", "will_miss"),
    "recency": lambda s, d: panel.recency(staged(s, d)).select("entity_id", "activity_date", "days_since"),
    "asof_features": lambda s, d: rounded(features(s, d)),
    "asof_features_explode": lambda s, d: rounded(features(s, d, "explode")),
    "asof_features_arrival": lambda s, d: rounded(features(s, d, "arrival")),
    "asof_lost_range": lambda s, d: rounded(features_of_lost_rows(s, d, "range")),
    "asof_lost_explode": lambda s, d: rounded(features_of_lost_rows(s, d, "explode")),
    "asof_lost_arrival": lambda s, d: rounded(features_of_lost_rows(s, d, "arrival")),
    "chrono_split": lambda s, d: split_features(s, d).groupBy("dataset_split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity_id").alias("entities"), F.min("prediction_date").alias("first_day"), F.max("prediction_date").alias("last_day"), F.count("will_miss").alias("labelled"), F.count_if("will_miss").alias("positives")),
    "model_matrix": lambda s, d: panel.model_matrix(panel.split_of(split_features(s, d), "train"), ["latest_type", "amount_sum", "active_days", "sessions_sum", "purchase_days", "late_days"], "will_miss", forbidden=("future_amount", "goal_met")),
    "threshold_sweep": lambda s, d: evaluate.threshold_sweep(demo.scored_events(s, d)),
    "threshold_sweep_zero": lambda s, d: evaluate.threshold_sweep(demo.scored_events(s, d), 0.0).select("threshold", "precision", "recall", "f1"),
    "calibration_ntile": lambda s, d: rounded(evaluate.calibration_ntile(demo.scored_events(s, d))),
    "calibration_width": lambda s, d: rounded(evaluate.calibration_width(demo.scored_events(s, d))),
    "calibration_error": lambda s, d: rounded(evaluate.calibration_error(evaluate.calibration_width(demo.scored_events(s, d)))),
    "risk_deciles": lambda s, d: evaluate.ntile(demo.scored_events(s, d), 10, [-F.col("p"), F.col("key")], "decile").select("key", "decile"),
    "select_threshold": lambda s, d: evaluate.select_threshold(evaluate.threshold_sweep(demo.scored_events(s, d))),
    "top_fraction": lambda s, d: rounded(evaluate.top_fraction(demo.scored_events(s, d))),
    "ranking_quality": lambda s, d: rounded(evaluate.ranking_quality(demo.scored_events(s, d))),
    "grid_pr_auc": lambda s, d: rounded(evaluate.grid_pr_auc(evaluate.threshold_sweep(demo.scored_events(s, d)))),
    "evaluate_binary": wide_evaluation,
}

DAILY = """
ev AS (SELECT user_id, ts::date AS activity_date, ts, event_id, event_type, round(value * 100)::bigint AS cents, json_extract_string(props, '$.k')::integer AS k FROM events),
daily AS (SELECT user_id, activity_date, sum(cents)::bigint AS amount, (sum(cents) FILTER (event_type = 'purchase'))::bigint AS purchase_amount,
  count(*) FILTER (event_type IN ('view', 'click')) AS sessions, max(k) AS k, last(event_type ORDER BY ts, event_id) AS last_type FROM ev GROUP BY ALL)"""
PANEL = DAILY + """,
panel AS (SELECT u.user_id AS entity_id, c.day AS activity_date, c.day + coalesce(k, 0) % 4 AS available_date, coalesce(amount, 0) AS amount, purchase_amount,
  coalesce(sessions, 0) AS sessions, last_type, coalesce(k, 0) % 4 AS delay_days, purchase_amount IS NULL AS is_missing, coalesce(amount, 0) > 20000 AS is_outlier,
  coalesce(k, 0) % 4 > 0 AS is_late, 70000 + 5000 * (u.user_id % 5) AS goal
  FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(date '2024-01-01', date '2024-01-31', interval 1 day))::date AS day) c
  LEFT JOIN daily d ON d.user_id = u.user_id AND d.activity_date = c.day)"""
LABELLED = PANEL + """,
ahead AS (SELECT *, CASE WHEN count(*) OVER w = 7 THEN (sum(amount) OVER w)::bigint END AS future_amount FROM panel
  WINDOW w AS (PARTITION BY entity_id ORDER BY activity_date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)),
labelled AS (SELECT *, future_amount >= goal AS goal_met, NOT (future_amount >= goal) AS will_miss FROM ahead)"""
FEATURES = LABELLED + """,
anchors AS (SELECT entity_id, activity_date AS t, will_miss FROM (SELECT *, min(activity_date) OVER (PARTITION BY entity_id) AS f FROM labelled) WHERE activity_date >= f + 14),
seen AS (SELECT a.entity_id, a.t, a.will_miss, h.* EXCLUDE (entity_id, will_miss), datediff('day', h.activity_date, a.t) AS age FROM anchors a
  LEFT JOIN labelled h ON h.entity_id = a.entity_id AND h.activity_date BETWEEN a.t - 14 AND a.t - 1 AND h.available_date <= a.t),
sums AS (SELECT entity_id, t AS prediction_date, will_miss, arg_max(last_type, activity_date) AS latest_type, arg_max(purchase_amount, activity_date) AS latest_purchase, arg_max(goal, activity_date) AS latest_goal,
  sum(amount)::bigint AS amount_sum, avg(amount) AS amount_mean, stddev_samp(amount) AS amount_std, avg(amount) FILTER (age BETWEEN 1 AND 7) AS amount_recent_mean, avg(amount) FILTER (age BETWEEN 8 AND 14) AS amount_prior_mean,
  count(*) FILTER (amount > 0) AS active_days, sum(sessions)::bigint AS sessions_sum, avg(sessions) FILTER (age BETWEEN 1 AND 7) AS sessions_recent_mean, avg(sessions) FILTER (age BETWEEN 8 AND 14) AS sessions_prior_mean,
  sum(purchase_amount)::bigint AS purchase_sum, count(purchase_amount) AS purchase_days, count(*) FILTER (is_missing) AS missing_days, count(*) FILTER (is_outlier) AS outlier_days, count(*) FILTER (is_late) AS late_days,
  count(activity_date) AS available_days, max(activity_date) AS max_activity_date, max(available_date) AS max_available_date FROM seen GROUP BY entity_id, t, will_miss),
features AS (SELECT *, prediction_date - 14 AS window_start, prediction_date - 1 AS window_end, 14 - available_days AS unavailable_days, amount_recent_mean - amount_prior_mean AS amount_trend,
  sessions_recent_mean - sessions_prior_mean AS sessions_trend, purchase_days / nullif(active_days, 0)::double AS purchase_rate, purchase_sum / nullif(amount_sum, 0)::double AS purchase_share FROM sums)"""
SPLIT = FEATURES + """,
split AS (SELECT *, CASE WHEN prediction_date BETWEEN date '2024-01-15' AND date '2024-01-19' THEN 'train' WHEN prediction_date BETWEEN date '2024-01-20' AND date '2024-01-21' THEN 'validation'
  WHEN prediction_date BETWEEN date '2024-01-22' AND date '2024-01-23' THEN 'test' WHEN prediction_date BETWEEN date '2024-01-24' AND date '2024-01-30' THEN 'scoring' ELSE 'unassigned' END AS dataset_split FROM features)"""
SCORED = """
scored AS (SELECT event_id AS key, json_extract_string(props, '$.k')::double / 100 AS p, value > 50 AS y FROM events)"""
SWEEP = SCORED + """,
hits AS (SELECT i / 1000.0::double AS threshold, count(*) FILTER (p >= i / 1000.0::double AND y) AS tp, count(*) FILTER (p >= i / 1000.0::double AND NOT y) AS fp,
  count(*) FILTER (p < i / 1000.0::double AND NOT y) AS tn, count(*) FILTER (p < i / 1000.0::double AND y) AS fn
  FROM (SELECT p, y FROM scored), (SELECT unnest(range(0, 1001)) AS i) GROUP BY i),
sweep AS (SELECT *, tp + fp AS predicted_positive, tp / nullif(tp + fp, 0)::double AS precision, tp / nullif(tp + fn, 0)::double AS recall, tn / nullif(tn + fp, 0)::double AS specificity,
  (tp + tn) / nullif(tp + fp + tn + fn, 0)::double AS accuracy, 2 * tp / nullif(2 * tp + fp + fn, 0)::double AS f1 FROM hits)"""
BINS = """
count(*) AS n, min(p) AS min_p, max(p) AS max_p, round(avg(p), 6) AS mean_p, round(avg(y::int), 6) AS observed_rate, round(avg(p) - avg(y::int), 6) AS gap,
  round(abs(avg(p) - avg(y::int)), 6) AS abs_gap"""
_DOUBLES = ("amount_mean", "amount_std", "amount_recent_mean", "amount_prior_mean", "sessions_recent_mean", "sessions_prior_mean", "amount_trend", "sessions_trend", "purchase_rate", "purchase_share")
_FEATURES = f"WITH {FEATURES} SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in _DOUBLES)}) FROM features"
_LOST = _FEATURES.replace("FROM ahead)", "FROM (SELECT * REPLACE (CASE WHEN delay_days + sessions % 2 * 4 < 6 THEN available_date END AS available_date) FROM ahead))", 1)
RANKING = """
groups AS (SELECT p, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM scored GROUP BY p),
curve AS (SELECT *, coalesce(sum(pos) OVER w, 0)::double AS pos_below, coalesce(sum(neg) OVER w, 0)::double AS neg_below, sum(pos) OVER ()::double AS P_, sum(neg) OVER ()::double AS N_ FROM groups
  WINDOW w AS (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
points AS (SELECT *, (P_ - pos_below) / (P_ - pos_below + N_ - neg_below) AS here,
  CASE WHEN P_ - pos_below - pos + N_ - neg_below - neg = 0 THEN 1.0 ELSE (P_ - pos_below - pos) / (P_ - pos_below - pos + N_ - neg_below - neg) END AS prior FROM curve),
ranking AS (SELECT sum(pos * (neg_below + neg / 2.0)) / max(P_ * N_) AS roc_auc, sum(pos / P_ * (here + prior) / 2) AS pr_auc, sum(pos / P_ * here) AS average_precision FROM points)"""
GRID = """
steps AS (SELECT (recall - lag(recall) OVER (ORDER BY threshold DESC)) * (coalesce(precision, 1) + lag(coalesce(precision, 1)) OVER (ORDER BY threshold DESC)) / 2 AS area FROM sweep),
grid AS (SELECT sum(area) AS grid_pr_auc FROM steps)"""
TOP = """
ordered AS (SELECT *, row_number() OVER (ORDER BY p DESC, key) AS place, count(*) OVER () AS n, count(*) FILTER (y) OVER () AS positives FROM scored WHERE p IS NOT NULL),
topmost AS (SELECT count(*) AS selected, count(*) FILTER (y) AS hits, max(positives) AS positives, max(n) AS n FROM ordered WHERE place <= greatest(1, ceil(0.1 * n))),
top AS (SELECT selected, hits, hits / nullif(positives, 0)::double AS recall, hits / selected::double AS precision, (hits / selected::double) / (positives / n::double) AS lift FROM topmost)"""
WIDTH = """
width AS (SELECT least(floor(p * 10), 9)::int AS bin, count(*) AS n, abs(avg(p) - avg(y::int)) AS abs_gap FROM scored GROUP BY 1),
ece AS (SELECT sum(n * abs_gap) / sum(n) AS ece, max(abs_gap) AS max_gap FROM width)"""
AT = """
marks AS (SELECT count(*) FILTER (p >= 0.467 AND y) AS tp, count(*) FILTER (p >= 0.467 AND NOT y) AS fp, count(*) FILTER (p < 0.467 AND NOT y) AS tn, count(*) FILTER (p < 0.467 AND y) AS fn FROM scored),
standard AS (SELECT tp, fp, tn, fn, (tp / (tp + fp)::double + tn / (tn + fn)::double) / 2 AS macro_precision, (tp / (tp + fn)::double + tn / (tn + fp)::double) / 2 AS macro_recall,
  (2 * tp / (2 * tp + fp + fn)::double + 2 * tn / (2 * tn + fp + fn)::double) / 2 AS macro_f1, (tp + tn) / (tp + fp + tn + fn)::double AS accuracy FROM marks)"""

SQL = {
    "stage_panel": f"WITH {PANEL} SELECT * FROM panel",
    "dense_panel": f"WITH {PANEL} SELECT entity_id, activity_date AS date FROM panel",
    "weekly_progress": f"""WITH {PANEL}, w AS (SELECT *, date_trunc('week', activity_date)::date AS week_start FROM panel),
        r AS (SELECT *, (sum(amount) OVER (PARTITION BY entity_id, week_start ORDER BY activity_date))::bigint AS week_total FROM w)
        SELECT entity_id, activity_date, week_start, week_total, round_even(week_total * 100.0::double / goal, 1) AS goal_percentage FROM r""",
    "goal_history": f"""WITH {PANEL}, w AS (SELECT entity_id, date_trunc('week', activity_date)::date AS week_start, sum(amount) >= max(goal) AS completed FROM panel GROUP BY ALL),
        n AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY week_start) AS n FROM w),
        h AS (SELECT entity_id, week_start, n - 1 - coalesce(max(CASE WHEN NOT completed THEN n END) OVER b, 0) AS streak_before, coalesce(sum((NOT completed)::int) OVER b, 0)::bigint AS failures_before FROM n
          WINDOW b AS (PARTITION BY entity_id ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT p.entity_id, activity_date, h.week_start, streak_before, failures_before FROM panel p JOIN h ON h.entity_id = p.entity_id AND h.week_start = date_trunc('week', p.activity_date)::date""",
    "future_label": f"WITH {LABELLED} SELECT entity_id, activity_date, future_amount, goal_met, will_miss FROM labelled",
    "recency": f"""WITH {PANEL}, n AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY activity_date) AS n FROM panel)
        SELECT entity_id, activity_date, n - coalesce(max(CASE WHEN sessions > 0 THEN n END) OVER (PARTITION BY entity_id ORDER BY activity_date), 0) AS days_since FROM n""",
    "asof_features": _FEATURES,
    "asof_features_explode": _FEATURES,
    "asof_features_arrival": _FEATURES,
    "asof_lost_range": _LOST,
    "asof_lost_explode": _LOST,
    "asof_lost_arrival": _LOST,
    "chrono_split": f"""
WITH {SPLIT} SELECT dataset_split, count(*) AS n, count(DISTINCT entity_id) AS entities, min(prediction_date) AS first_day, max(prediction_date) AS last_day,
  count(will_miss) AS labelled, count(*) FILTER (will_miss) AS positives FROM split GROUP BY 1""",
    "model_matrix": f"WITH {SPLIT} SELECT entity_id, prediction_date, will_miss, latest_type, amount_sum, active_days, sessions_sum, purchase_days, late_days FROM split WHERE dataset_split = 'train'",
    "threshold_sweep": f"WITH {SWEEP} SELECT * FROM sweep",
    "threshold_sweep_zero": f"WITH {SWEEP} SELECT threshold, coalesce(precision, 0) AS precision, coalesce(recall, 0) AS recall, coalesce(f1, 0) AS f1 FROM sweep",
    "calibration_ntile": f"WITH {SCORED} SELECT decile::int AS decile, {BINS} FROM (SELECT *, ntile(10) OVER (ORDER BY p, key) AS decile FROM scored WHERE p IS NOT NULL) GROUP BY decile",
    "calibration_width": f"WITH {SCORED} SELECT least(floor(p * 10), 9)::int AS bin, {BINS} FROM scored GROUP BY 1",
    "calibration_error": f"WITH {SCORED}, {WIDTH} SELECT round(ece, 6) AS ece, round(max_gap, 6) AS max_gap FROM ece",
    "risk_deciles": f"WITH {SCORED} SELECT key, (ntile(10) OVER (ORDER BY p DESC, key))::int AS decile FROM scored",
    "select_threshold": f"WITH {SWEEP} SELECT * FROM sweep ORDER BY f1 DESC NULLS LAST, recall DESC NULLS LAST, threshold LIMIT 1",
    "top_fraction": f"WITH {SCORED}, {TOP} SELECT selected, hits, round(recall, 6) AS recall, round(precision, 6) AS precision, round(lift, 6) AS lift FROM top",
    "ranking_quality": f"WITH {SCORED}, {RANKING} SELECT round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(average_precision, 6) AS average_precision FROM ranking",
    "grid_pr_auc": f"WITH {SWEEP}, {GRID} SELECT round(grid_pr_auc, 6) AS grid_pr_auc FROM grid",
    "evaluate_binary": f"""WITH {SWEEP}, {RANKING}, {GRID}, {TOP}, {WIDTH}, {AT},
        plain AS (SELECT count(*) AS n, avg(y::int) AS base_rate, avg(p) AS mean_p, avg(pow(p - y::int, 2)) AS brier, avg(-ln(CASE WHEN y THEN least(greatest(p, 1e-15), 1 - 1e-15) ELSE 1 - least(greatest(p, 1e-15), 1 - 1e-15) END)) AS log_loss FROM scored)
        SELECT n, round(base_rate, 6) AS base_rate, round(mean_p, 6) AS mean_p, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(average_precision, 6) AS average_precision,
          round(grid_pr_auc, 6) AS grid_pr_auc, round(recall, 6) AS top_recall, round(precision, 6) AS top_precision, round(lift, 6) AS top_lift, round(ece, 6) AS ece, round(max_gap, 6) AS max_gap, tp, fp, tn, fn,
          round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy
        FROM plain, ranking, grid, top, ece, standard""",
}
