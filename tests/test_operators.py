"""Tiny cases for the jobs."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.prefix import with_rank, with_running_sum
from tidemark.functions import quantiles
from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators import activate, aggregates, drift, evaluate, model, monitor, panel, quality
from tidemark.operators.panel import Metric
from tidemark.sources import scratch as scratch_module
from tidemark.sources import tables
from tidemark.sources.scratch import materialise, scratch

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(n)


@pytest.fixture()
def small(spark):
    rows = [(1, day(i), day(i + i % 4), i * 10, None if i % 3 else i) for i in range(40)] + [(2, day(i), day(i), 5, 1) for i in range(3)]
    return spark.createDataFrame(rows, "entity_id long, activity_date date, available_date date, amount long, extra long").withColumn("label", F.lit(True))


def brute(rows, history, recent):
    out = {}
    by = {}
    for e, d, a, amount, extra in rows:
        by.setdefault(e, []).append((d, a, amount, extra))
    for e, own in by.items():
        first = min(d for d, *_ in own)
        for t, *_ in own:
            if (t - first).days < history:
                continue
            seen = [r for r in own if 1 <= (t - r[0]).days <= history and r[1] <= t]
            new = [r[2] for r in seen if (t - r[0]).days <= recent]
            old = [r[2] for r in seen if recent < (t - r[0]).days <= 2 * recent]
            last = [r for r in sorted(seen) if r[3] is not None]
            out[e, t] = (sum(r[2] for r in seen) if seen else None, sum(new) / len(new) if new else None, sum(old) / len(old) if old else None, last[-1][3] if last else None, len(seen))
    return out


@pytest.mark.parametrize("strategy", ["range", "explode", "arrival", "auto"])
def test_asof_sees_only_what_had_arrived(small, strategy):
    metrics = (Metric("total", "sum", "amount"), Metric("new", "avg", "amount", "recent"), Metric("old", "avg", "amount", "prior"), Metric("last", "latest", "extra"))
    got = panel.asof_features(small, metrics, 28, 7, "label", {}, {}, strategy).collect()
    want = brute([tuple(r)[:5] for r in small.collect()], 28, 7)
    assert {(r.entity_id, r.prediction_date): (r.total, r.new, r.old, r.last, r.available_days) for r in got} == want
    assert all(r.available_days + r.unavailable_days == 28 for r in got)


def test_asof_keeps_anchors_without_history(spark):
    df = spark.createDataFrame([(1, day(0), day(99), 1), (1, day(20), day(99), 1)], "entity_id long, activity_date date, available_date date, amount long")
    got = panel.asof_features(df, (Metric("total", "sum", "amount"),), 14, 7, None, {}, {"rate": ("total", "total")}, "range").collect()
    assert [(r.prediction_date, r.total, r.available_days, r.rate) for r in got] == [(day(20), None, 0, None)]


def test_default_catalogue(spark):
    fields = {m.column: ("string" if m.how == "latest" and m.column in ("age_band", "activity_level", "reward_profile", "intervention_profile") else "boolean" if m.how == "true" else "double") for m in panel.DEFAULT_METRICS}
    schema = "entity_id long, activity_date date, available_date date, will_miss_goal_next_7_days boolean, " + ", ".join(f"{c} {t}" for c, t in fields.items())
    rows = [(1, day(i), day(i), True, *[{"string": "a", "boolean": True, "double": 1.0}[t] for t in fields.values()]) for i in range(30)]
    got = panel.asof_features(spark.createDataFrame(rows, schema), strategy="range")
    assert len(got.columns) == 55 and got.count() == 2 and {r.available_days for r in got.collect()} == {28}


def test_weeks_streaks_and_labels(spark):
    amounts = [10] * 7 + [0] * 7 + [10] * 7 + [10] * 7
    df = spark.createDataFrame([(1, day(i), a, 50) for i, a in enumerate(amounts)], "entity_id long, activity_date date, amount long, goal long")
    weeks = panel.weekly_history(df).orderBy("week_start").collect()
    assert [(w.streak_before, w.failures_before) for w in weeks] == [(0, 0), (1, 0), (0, 1), (1, 1)]
    labels = panel.future_label(df).orderBy("activity_date").collect()
    assert [r.will_miss for r in labels[-7:]] == [None] * 7 and labels[0].future_amount == 60 and labels[0].will_miss is False
    progress = panel.weekly_progress(df).orderBy("activity_date").collect()
    assert progress[6].week_total == 70 and progress[7].week_total == 0 and progress[6].goal_percentage == 140.0


def test_recency_counts_from_start(spark):
    df = spark.createDataFrame([(1, day(i), s) for i, s in enumerate([0, 0, 2, 0, 1, 0])], "entity_id long, activity_date date, sessions long")
    assert [r.days_since for r in panel.recency(df).orderBy("activity_date").collect()] == [1, 2, 0, 1, 0, 1]


def test_model_matrix_refuses_leaks(small):
    with pytest.raises(ValueError):
        panel.model_matrix(small, ["amount", "extra"], "label", ("entity_id",), forbidden=("extra",))


def test_ranks_and_sums_match_plain_windows(spark):
    df = spark.range(997).select((F.col("id") * 37 % 101).alias("a"), "id").repartition(7)
    got = {r.id: r.r for r in with_rank(df, [F.col("a"), F.col("id")], "r", materialise).collect()}
    order = sorted((i * 37 % 101, i) for i in range(997))
    assert got == {i: n for n, (_, i) in enumerate(order)}
    sums, total = {}, 0
    for _, i in order:
        sums[i] = total
        total += i
    assert {r.id: r.s for r in with_running_sum(df, [F.col("a"), F.col("id")], "id", "s", materialise).collect()} == sums


@pytest.mark.parametrize("n", [1, 9, 10, 23, 100])
def test_ntile(spark, n):
    got = [r.t for r in evaluate.ntile(spark.range(n), 10, [F.col("id")], "t").orderBy("id").collect()]
    q, r = divmod(n, 10)
    assert got == [t for t in range(1, 11) for _ in range(q + (t <= r))]


def test_sweep_at_the_edges(spark):
    df = spark.createDataFrame([(1, 0.0, False), (2, 1.0, True), (3, 0.467, True), (4, 0.4669999, False), (5, None, True)], "key long, p double, y boolean")
    got = {round(r.threshold, 3): r for r in evaluate.threshold_sweep(df).collect()}
    assert len(got) == 1001 and (got[0.467].tp, got[0.467].fp) == (2, 0) and (got[0.466].tp, got[0.466].fp) == (2, 1)
    assert got[1.0].tp == 1 and got[0.0].tn == 0 and got[0.0].specificity == 0
    best = evaluate.select_threshold(evaluate.threshold_sweep(df)).first()
    assert best.threshold == 0.467


def test_ranking_equals_pair_counting(spark):
    rows = [(i, (i * 7 % 5) / 5, i * 3 % 4 == 0) for i in range(40)]
    got = evaluate.ranking_quality(spark.createDataFrame(rows, "key long, p double, y boolean")).first()
    pos, neg = [p for _, p, y in rows if y], [p for _, p, y in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert math.isclose(got.roc_auc, want)


def test_psi(spark):
    ref = spark.createDataFrame([(float(i), "a" if i % 2 else "b", 1.0) for i in range(100)], "x double, c string, k double")
    same = drift.numeric_psi(ref, ref, ["x", "k"]).collect()
    assert all(abs(r.psi) < 1e-9 for r in same)
    moved = ref.select((F.col("x") + 50).alias("x"), F.lit("z").alias("c"), F.lit(2.0).alias("k"))
    assert all(r.psi > 0.25 for r in drift.numeric_psi(ref, moved, ["x", "k"]).collect())
    gone = ref.select(F.lit(None).cast("double").alias("x"), "c", "k")
    assert drift.numeric_psi(ref, gone, ["x"]).first().psi > 0.25
    with pytest.raises(ValueError):
        drift.psi_edges(gone, ["x"])
    unseen = drift.categorical_psi(ref, moved, ["c"]).first()
    assert unseen.unseen_rate == 1.0 and unseen.psi > 0.25
    assert drift.unexpected_rates(moved, {"c": ["a"]}).first().unexpected_rate == 1.0


def test_psi_sees_ties_at_the_ends(spark):
    ref = spark.createDataFrame([(float(i % 2), float(i % 3)) for i in range(300)], "flag double, three double")
    cur = spark.createDataFrame([(float(i % 10 == 0), float(i % 10 == 0) + 1) for i in range(300)], "flag double, three double")
    assert {c: (e[0], e[-1]) for c, e in drift.psi_edges(ref, ["flag", "three"]).items()} == {"flag": (0.0, 1.0), "three": (0.0, 2.0)}
    assert all(r.psi > 0.25 for r in drift.numeric_psi(ref, cur, ["flag", "three"]).collect())


def test_severities():
    assert monitor.SEVERITIES == ("pass", "warning", "critical")


def test_severity_limits_are_inclusive(spark):
    got = spark.createDataFrame([(0.0999,), (0.1,), (0.25,)], "v double").select(monitor.severity(F.col("v"), monitor.PSI_LIMITS)).collect()
    assert [r[0] for r in got] == ["pass", "warning", "critical"]


AT = "2024-02-06 00:00:00"


def contexts(spark, rows):
    return spark.createDataFrame(rows, "entity_id long, contact_allowed boolean, opted_out boolean, open_case boolean, last_contacted_at timestamp_ntz, interventions_28d long, context_as_of timestamp_ntz")


def test_ladder(spark):
    at = dt.datetime(2024, 2, 6)
    preds = spark.createDataFrame([(i, dt.date(2024, 2, 5), 0.9 - i / 100, True, "m", 0.5) for i in range(9)] + [(0, dt.date(2024, 2, 4), 0.99, True, "m", 0.5), (20, dt.date(2024, 2, 5), 0.1, False, "m", 0.5), (21, dt.date(2024, 1, 1), 0.9, True, "m", 0.5)], "entity_id long, prediction_date date, probability double, is_high boolean, model_name string, threshold double")
    ok = (True, False, False, None, 0, at)
    rows = [(0, *ok), (1, False, False, False, None, 0, at), (2, True, True, False, None, 0, at), (3, True, False, True, None, 0, at), (4, True, False, False, dt.datetime(2024, 1, 31), 0, at), (5, True, False, False, dt.datetime(2024, 1, 30), 2, at), (6, *ok), (7, *ok), (21, *ok)]
    got = activate.decide(preds, contexts(spark, rows), activate.Policy(capacity=2), AT)
    reasons = {(r.entity_id, str(r.prediction_date)): r.reason for r in got.collect()}
    assert reasons == {
        (0, "2024-02-05"): "selected_for_human_review", (0, "2024-02-04"): "superseded_by_latest_prediction", (1, "2024-02-05"): "contact_not_permitted", (2, "2024-02-05"): "member_opted_out",
        (3, "2024-02-05"): "active_case_open", (4, "2024-02-05"): "contact_cooldown_active", (5, "2024-02-05"): "prior_intervention_limit_reached", (6, "2024-02-05"): "selected_for_human_review",
        (7, "2024-02-05"): "capacity_limit_reached", (8, "2024-02-05"): "missing_activation_context", (20, "2024-02-05"): "below_frozen_threshold", (21, "2024-01-01"): "prediction_too_old",
    }
    assert [(r.priority_rank, r.entity_id) for r in activate.review_queue(got).collect()] == [(1, 0), (2, 6)]
    assert all(r.passed for r in quality.run_checks(got, quality.decision_rules(2)).collect())
    with pytest.raises(ValueError):
        activate.decide(preds.union(preds.limit(1)), contexts(spark, rows), activate.Policy(), AT)


PREDS = "entity_id long, prediction_date date, probability double, is_high boolean, model_name string, threshold double"


def test_decisions_fail_closed(spark):
    nan, day_, at = float("nan"), dt.date(2024, 2, 5), dt.datetime(2024, 2, 6)
    preds = [(1, day_, nan, True, "m", 0.5), (2, day_, None, True, "m", 0.5), (3, day_, 1.5, True, "m", 0.5), (4, day_, -0.5, False, "m", 0.5), *[(i, day_, 0.9, True, "m", 0.5) for i in range(5, 11)], (None, day_, 0.9, True, "m", 0.5), (11, None, 0.9, True, "m", 0.5), (12, day_, 0.9, True, "m", nan)]
    rows = [*[(i, True, False, False, None, 0, at) for i in (1, 2, 3, 4, 9, 11, 12)], (5, None, False, False, None, 0, at), (6, True, None, False, None, 0, at), (7, True, False, None, None, 0, at), (8, True, False, False, None, None, at)]
    frame, context = spark.createDataFrame(preds, PREDS), contexts(spark, rows)
    got = {(r.entity_id): r.reason for r in activate.decide(frame, context, activate.Policy(), AT, strict=False).collect()}
    below = "below_frozen_threshold"
    assert got == {1: below, 2: below, 3: below, 4: below, 5: "contact_not_permitted", 6: "member_opted_out", 7: "active_case_open", 8: "prior_intervention_limit_reached", 9: "selected_for_human_review", 10: "missing_activation_context", 11: "prediction_too_old", 12: below, None: "missing_activation_context"}
    errors = activate.input_errors(frame, context, AT).first().asDict()
    assert errors["bad_probabilities"] == 4 and errors["null_keys"] == 2 and errors["bad_thresholds"] == 1 and errors["null_flags"] == 3 and errors["bad_counts"] == 1
    for one in (preds[0], preds[1], preds[2], preds[-1], preds[-2], preds[-3], (1, day_, 0.9, False, "m", 0.5)):
        with pytest.raises(ValueError):
            activate.decide(spark.createDataFrame([one], PREDS), contexts(spark, rows[:4]), activate.Policy(), AT)
    for odd in rows[-4:]:
        with pytest.raises(ValueError):
            activate.decide(spark.createDataFrame([preds[8]], PREDS), contexts(spark, [odd]), activate.Policy(), AT)


def test_stored_predictions_hold_their_contract(spark):
    day_ = dt.date(2024, 2, 5)
    good = [(i, day_, i / 10, i >= 5, "m", 0.5) for i in range(10)]
    kept = model.store_predictions(spark.createDataFrame(good, PREDS), scratch(spark, "test-sink"))
    assert kept.count() == 10 and tuple(kept.columns) == model.PREDICTION_COLUMNS
    told = model.prediction_summary(kept).first()
    assert (told.row_count, told.entity_count, told.high_count, told.min_probability, told.max_probability) == (10, 10, 5, 0.0, 0.9)
    for odd in ((11, day_, float("nan"), True, "m", 0.5), (11, day_, 0.6, False, "m", 0.5), (1, day_, 0.1, False, "m", 0.5), (11, None, 0.1, False, "m", 0.5), (11, day_, 0.1, False, "n", 0.5)):
        with pytest.raises(ValueError):
            model.store_predictions(spark.createDataFrame([*good, odd], PREDS), scratch(spark, "test-sink"))


def test_scoring_refuses_other_features_and_ids(spark):
    rows = [(i, DAY, float(i % 7), float(i % 3), "ab"[i % 2], i % 7 > 3) for i in range(60)]
    df = spark.createDataFrame(rows, "entity_id long, prediction_date date, x double, z double, c string, y boolean")
    fitted, fills = model.fit_logistic(df, ["x", "z"], ["c"], "y")
    got = model.score(fitted, fills, df, ["x", "z"], 0.5, "m").collect()
    assert sum(r.is_high == (r.entity_id % 7 > 3) for r in got) == 60
    for bad, numeric in ((df, ["z", "x"]), (df.union(df.limit(1)), ["x", "z"]), (df.withColumn("entity_id", F.lit(None).cast("long")), ["x", "z"])):
        with pytest.raises(ValueError):
            model.score(fitted, fills, bad, numeric, 0.5, "m")


def test_boosted_trees_and_comparison(spark):
    rows = [(i, DAY, float(i % 10), float(i * 7 % 13), "ab"[i % 2], (i % 10 > 4) != (i * 7 % 13 > 10)) for i in range(400)]
    df = spark.createDataFrame(rows, "entity_id long, prediction_date date, x double, z double, c string, y boolean")
    fitted, fills = model.fit_gbt(df, ["x", "z"], ["c"], "y", iterations=10)
    scored = model.score(fitted, fills, df, ["x", "z"], 0.5, "gbt", ("entity_id", "prediction_date", "y"))
    measured = evaluate.evaluate_binary(scored.select(F.col("entity_id").alias("key"), F.col("probability").alias("p"), "y"), 0.5)
    told = evaluate.compare_models({"gbt": measured, "again": measured}).collect()
    assert {r.model_name for r in told} == {"gbt", "again"} and all(r.roc_auc > 0.9 and r.tp + r.fp + r.tn + r.fn == 400 for r in told)


def test_quantiles_equal_numpy(spark):
    import numpy as np

    g = np.random.default_rng(3)
    data = {"a": g.normal(size=500), "b": g.integers(0, 4, 500).astype(float), "c": np.full(500, 2.5)}
    rows = [(*(float(v[i]) for v in data.values()), None) for i in range(500)] + [(float("nan"), None, None, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    at = [k / 10 for k in range(11)]
    got = exact_quantiles(df, ["a", "b", "c", "d"], at)
    assert got.pop("d") is None and all(np.allclose(got[c], np.quantile(v, at), rtol=0, atol=1e-12) for c, v in data.items())


def rule_psi(reference, current, bins=10, epsilon=1e-6):
    """The stated rule: unique inner quantile positions as edges, half-open bins, epsilon added to counts."""
    import numpy as np

    q = np.quantile(reference, [k / bins for k in range(bins + 1)])
    edges = np.array([np.nextafter(q[0], np.inf)]) if q[0] == q[-1] else np.unique(q[1:-1])
    count = lambda x: np.append(np.bincount(np.searchsorted(edges, x, "right"), minlength=len(edges) + 1), 0) + epsilon
    r, c = (count(x) / count(x).sum() for x in (reference, current))
    return max(0.0, float(((c - r) * np.log(c / r)).sum()))


def test_psi_equals_its_rule_where_mass_lies_at_the_ends(spark):
    import numpy as np

    g = np.random.default_rng(5)
    normal = g.normal(10, 2, 1000)
    cases = {
        "flag": ((g.random(1000) < 0.35).astype(float), (g.random(1000) < 0.9).astype(float)),
        "low": (np.where(g.random(1000) < 0.3, 0.0, normal), np.where(g.random(1000) < 0.3, -1.0, normal)),
        "high": (np.where(g.random(1000) < 0.5, 20.0, normal), np.where(g.random(1000) < 0.1, 20.0, normal)),
    }
    frames = [spark.createDataFrame([tuple(float(c[side][i]) for c in cases.values()) for i in range(1000)], ", ".join(f"{c} double" for c in cases)) for side in (0, 1)]
    got = {r.feature: r.psi for r in drift.numeric_psi(*frames, list(cases)).collect()}
    assert all(abs(got[c] - rule_psi(*sides)) < 1e-6 for c, sides in cases.items()) and min(got.values()) > 0.5


def test_a_monitoring_run_has_57_checks_of_16_columns(spark):
    numeric, categorical = [f"n{i}" for i in range(44)], {f"c{i}": ["a", "b"] for i in range(3)}
    shape = "entity_id long, prediction_date date, probability double, is_high boolean, model_name string, threshold double, " + ", ".join([f"{c} double" for c in numeric] + [f"{c} string" for c in categorical])
    made = lambda n, shift: spark.createDataFrame([(i, day(i % 2), i / n, i / n >= 0.5, "m", 0.5, *[float((i + shift * k) % 9) for k in range(44)], *["abz"[(i + k) % (2 + (shift > 0 and k == 2))] for k in range(3)]) for i in range(n)], shape)
    train, scoring = made(200, 0), made(90, 1)
    policy, frozen = monitor.MonitoringPolicy(expected_rows=90, expected_entities=90, expected_days=3), monitor.FrozenModel("m", 0.5, (*numeric, *categorical))
    got = monitor.monitoring_run(train, scoring, scoring, train, numeric, categorical, policy, frozen, "r", AT)
    rows = {r.check_name: r for r in got.collect()}
    assert len(rows) == 57 and len(got.columns) == 16 and {r.overall_severity for r in rows.values()} == {"critical"}
    assert rows["scoring_day_count"].severity == "critical" and rows["scoring_row_count"].severity == rows["schema_identity"].severity == "pass" and rows["unexpected_rate__c2"].observed_value == pytest.approx(1 / 3)
    assert rows["numeric_psi__n3"].reference_row_count == 200 and rows["numeric_psi__n3"].current_row_count == 90
    other = monitor.monitoring_run(train, scoring, scoring, train, numeric, categorical, policy, monitor.FrozenModel("other", 0.5, ("x",)), "r", AT)
    told = {r.check_name: r for r in other.collect()}
    assert told["model_identity"].severity == told["schema_identity"].severity == "critical" and told["psi__probability"].observed_value == 0.25 and told["psi__probability"].severity == "critical"
    with pytest.raises(ValueError):
        monitor.monitoring_run(train, scoring, scoring.limit(80), train, numeric, categorical, policy, frozen, "r", AT)


def test_governance_asks_for_every_asset(spark):
    views = {"v": spark.createDataFrame([("no_activation_runs",)], "view_state string")}
    status = lambda n, bad=0: spark.createDataFrame([(f"a{i}", "fail" if i < bad else "pass") for i in range(n)], "asset string, status string")
    rows = lambda n, bad=0: spark.createDataFrame([(f"s{i}", None if i < bad else True) for i in range(n)], "source_name string, is_valid boolean")
    found = lambda *a: [r.severity for r in monitor.governance_monitoring(views, *a).orderBy("check_order").collect()]
    assert found(status(8), rows(7)) == ["pass"] * 3
    assert found(status(7), rows(7)) == ["pass", "critical", "pass"] and found(status(8, 1), rows(7)) == ["pass", "critical", "pass"]
    assert found(status(8), rows(6)) == ["pass", "pass", "critical"] and found(status(8), rows(7, 1)) == ["pass", "pass", "critical"]


def test_scratch_is_local_only_in_local_mode(spark, monkeypatch):
    kept = materialise(spark.range(3).toDF("id"), "dropped")
    assert kept.count() == 3
    monkeypatch.setattr(scratch_module, "_MADE", scratch_module._MADE[-1:])
    assert scratch_module.drop_scratch(spark) == 1 and scratch_module.drop_scratch(spark) == 0


def test_run_id_ignores_order(spark):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    one, two = (activate.run_id(d, activate.Policy(), AT).first().run_id for d in (df, df.orderBy(F.desc("id")).repartition(5)))
    assert one == two and one.startswith("act_") and len(one) == 28


def test_ingest_is_idempotent_and_refuses_changes(spark):
    path = scratch(spark, "test-ingest")
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, v string")
    df.limit(0).write.parquet(path)
    assert activate.ingest({"t": (spark.read.parquet(path), df, ["id"], path)}) == {"t": 2}
    assert activate.ingest({"t": (spark.read.parquet(path), df, ["id"], path)}) == {"t": 0}
    with pytest.raises(ValueError):
        activate.ingest({"t": (spark.read.parquet(path), df.withColumn("v", F.lit("b")), ["id"], path)})


def test_views(spark):
    preds = spark.createDataFrame([(1, DAY, 0.05, False, "m", 0.5), (2, DAY, 0.2, False, "m", 0.5), (3, DAY, None, False, "m", 0.5)], "entity_id long, prediction_date date, probability double, is_high boolean, model_name string, threshold double")
    rows = {r.risk_band: r for r in aggregates.risk_distribution(preds).collect()}
    assert [rows[b].band_rows for b in aggregates.BANDS] == [1, 1, 0, 0, 1] and rows["0.0-0.2"].invalid_reason == "null_probability" and not rows["0.0-0.2"].is_valid
    assert aggregates.scoring_daily_summary(preds.limit(0)).count() == 0
    small = aggregates.suppress_small_cells(aggregates.risk_distribution(preds), "band_rows", ["share_of_day"], 2).collect()
    assert all(r.share_of_day is None and r.is_suppressed for r in small)


def test_checks_report_and_raise(spark):
    df = spark.createDataFrame([(1,), (None,)], "x long")
    rules = [quality.none("null_x", F.col("x").isNull()), quality.Rule("rows", F.count(F.lit(1)), 2, 2)]
    assert {r.check_name: r.passed for r in quality.run_checks(df, rules).collect()} == {"null_x": False, "rows": True}
    with pytest.raises(Exception, match="failed"):
        quality.run_checks(df, rules, strict=True).collect()


def test_exports(spark):
    path = scratch(spark, "test-export")
    df = spark.range(200).select((F.col("id") % 10).cast("int").alias("d"), "id")
    tables.export_ordered(df, ["d", "id"], {"id": "key"}, ["d", "key"], path)
    back = spark.read.parquet(path)
    assert back.columns == ["d", "key"] and back.count() == 200 and tables.ordered_violations(back, ["d", "key"]).count() == 0
    tables.write_both(df, f"{path}-both")
    assert tables.both_agree(spark, f"{path}-both").first().agree
    tables.write_partitioned(df, f"{path}-parts", "d", ["id"])
    assert spark.read.parquet(f"{path}-parts").filter("d = 3").count() == 20
    assert tables.file_facts(spark, "x", f"{path}-parts").first().row_count == 200
    with pytest.raises(ValueError):
        tables.assert_columns(df, ["id", "d"])


@pytest.mark.parametrize("taken", [200_000, 10])
def test_bracketed_quantiles(spark, monkeypatch, taken):
    monkeypatch.setattr(quantiles, "TAKEN", taken)
    g = np.random.default_rng(7)
    data = {"a": g.normal(0, 1, 30_000), "b": np.round(g.exponential(2, 30_000)), "c": np.where(g.random(30_000) < 0.9, 0.0, g.random(30_000)), "d": np.full(30_000, np.nan)}
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in zip(*data.values(), strict=True)], ", ".join(f"{c} double" for c in data)).repartition(6)
    at = [0.0, 0.01, 0.25, 0.5, 0.5, 0.999, 1.0]
    got = exact_quantiles(df, list(data), at)
    assert got.pop("d") is None and all(np.allclose(got[c], np.quantile(data[c], at), rtol=0, atol=1e-12) for c in got)
    ranges = {"a": quantiles.brackets(*quantiles._sketches(df, ["a"])["a"], [0.25, 0.75])}
    inside = quantiles._kept(df, ranges).filter("value IS NOT NULL").count()
    assert len(ranges["a"]) == 2 and 2 < inside < 400  # of 30,000 values


def test_quantiles_survive_wrong_brackets(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "brackets", lambda n, grid, at: [(7.0, 8.0)])
    df = spark.createDataFrame([(float(i),) for i in range(101)], "x double")
    assert exact_quantiles(df, ["x"], [0.5, 0.25]) == {"x": [50.0, 25.0]}
    assert exact_quantiles(df.limit(0), ["x"], [0.5]) == {"x": None}


ASOF = tuple(
    Metric(f"{c}_{h}_{w}", h, None if h == "count" else c, w)
    for w in ("all", "recent", "prior") for c, kinds in {"amount": ("latest", "sum", "avg", "std", "min", "max", "observed", "positive", "count"), "score": ("sum", "avg", "std", "latest"), "flag": ("true",)}.items() for h in kinds
)


def arrivals_panel(spark, entities=4, days=120):
    import random

    r, rows = random.Random(9), []
    for e in range(entities):
        for i in range(days if e else 2 * days):
            if r.random() < 0.93:
                delay = r.choice([0, 0, 0, 1, 1, 2, 3, 9, 40, None])
                rows.append((e, day(i), None if delay is None else day(i + delay), r.choice([None, 0, r.randrange(1000)]), r.choice([None, 0.1, r.random()]), r.choice([None, True, False]), r.random() < 0.5))
    rows += [(None, day(3), day(3), 1, 1.0, True, True), (1, None, day(3), 1, 1.0, True, True)]
    return spark.createDataFrame(rows, "entity_id long, activity_date date, available_date date, amount int, score double, flag boolean, label boolean")


def test_asof_strategies_agree_on_late_and_lost_rows(spark):
    df = arrivals_panel(spark)
    found = {s: {(r.entity_id, r.prediction_date): r.asDict() for r in panel.asof_features(df, ASOF, 14, 4, "label", {}, {}, s).collect()} for s in ("range", "explode", "arrival")}
    want = found.pop("range")
    assert len(want) > 400
    for name, got in found.items():
        assert got.keys() == want.keys() and [*next(iter(got.values()))] == [*next(iter(want.values()))], name
        for key, row in want.items():
            for c, v in row.items():
                same = got[key][c] == v or (isinstance(v, float) and got[key][c] is not None and math.isclose(got[key][c], v, rel_tol=1e-9, abs_tol=1e-12))
                assert same, (name, key, c, got[key][c], v)
    types = {s: panel.asof_features(df, ASOF, 14, 4, "label", {}, {}, s).dtypes for s in ("range", "arrival")}
    assert types["range"] == types["arrival"]


def test_asof_never_sees_a_row_that_has_not_arrived(spark):
    """Forty days, every fifth arrival unknown: 23 of 28 days are seen, whatever the strategy."""
    rows = [(1, day(i), None if i % 5 == 0 else day(i), 1) for i in range(40)]
    df = spark.createDataFrame(rows, "entity_id long, activity_date date, available_date date, amount long")
    for s in ("range", "explode", "arrival", "auto"):
        got = panel.asof_features(df, (Metric("total", "sum", "amount"),), 28, 7, None, {}, {}, s).orderBy("prediction_date").collect()
        assert len(got) == 12 and {r.available_days for r in got} <= {22, 23} and all(r.total == r.available_days for r in got), s


def test_arrival_sends_each_row_once_and_late_ones_twice(spark):
    from tidemark.operators import arrivals

    df = arrivals_panel(spark).filter("entity_id IS NOT NULL AND activity_date IS NOT NULL")
    n, late = df.count(), df.filter("available_date > activity_date + 1 AND available_date <= activity_date + 14").count()
    sent = arrivals.placed_rows(df, ["amount"], 14)
    assert sent.filter("_kind <> 'first'").count() <= n * (1 + 1 / arrivals.SPAN) * 1.1 + 1.5 * late < n * 14 / 3
    plan = panel.asof_features(df, ASOF, 14, 4, "label", {}, {}, "arrival")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def grown(bins, y, raw, growth):
    """One best-first tree by going over all rows for every leaf: leaf of each row, its value, and the splits in order."""
    p = 1 / (1 + np.exp(-raw))
    g, h = p - y, p * (1 - p)
    leaves, splits = [np.arange(len(y))], []
    while len(leaves) < growth.leaves:
        best = None
        for at, rows in enumerate(leaves):
            whole = g[rows].sum() ** 2 / (h[rows].sum() + growth.l2)
            for f in range(bins.shape[1]):
                for b in np.unique(bins[rows, f])[:-1]:
                    low = bins[rows, f] <= b
                    if growth.least <= low.sum() <= len(rows) - growth.least:
                        gain = g[rows][low].sum() ** 2 / (h[rows][low].sum() + growth.l2) + g[rows][~low].sum() ** 2 / (h[rows][~low].sum() + growth.l2) - whole
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                            best = gain, at, f, int(b), low
        if best is None:
            break
        _, at, f, b, low = best
        rows = leaves.pop(at)
        leaves += [rows[low], rows[~low]]
        splits.append((f, b))
    value = np.zeros(len(y))
    for rows in leaves:
        value[rows] = -growth.rate * g[rows].sum() / (h[rows].sum() + growth.l2)
    return value, splits, len(leaves)


def boosting_rows(spark, n=1500):
    g = np.random.default_rng(12)
    x, z, c = g.normal(size=n), np.round(g.normal(size=n) * 3), g.choice(["a", "b", "d"], n)
    y = g.random(n) < 1 / (1 + np.exp(-(1.5 * np.sin(2 * x) + 0.4 * z * (c == "a") - 0.5)))
    rows = [(i, day(i % 9), None if i % 17 == 0 else float(x[i]), float("nan") if i % 23 == 0 else float(z[i]), None if i % 31 == 0 else str(c[i]), None if i % 40 == 39 else bool(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "entity_id long, prediction_date date, x double, z double, c string, y boolean")


def test_boosting_equals_brute_force(spark):
    from tidemark.operators import boosting

    growth = boosting.Growth(rounds=4, rate=0.3, leaves=9, least=40, l2=1.0)
    df = boosting_rows(spark)
    fitted, fills = model.fit_gbt(df.repartition(5), ["x", "z"], ["c"], "y", 4, growth)
    rows = fitted.features(model.prepared(df.filter("y IS NOT NULL"), ["x", "z"], fills)).orderBy("entity_id").toArrow()
    bins, y = fitted.bins(rows["features"].combine_chunks()), np.array(rows["y"].to_pylist(), float)
    assert bins[:, 0].max() > 200 and bins.shape[1] == 5 and fitted.medians["z"] == np.median([v for v in rows["z"].to_pylist() if v is not None])
    raw = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for tree in fitted.trees:
        value, splits, leaves = grown(bins, y, raw, growth)
        own = np.array(tree.value)[tree.place(bins)]
        assert np.allclose(own, value, atol=1e-9) and sorted(splits) == sorted((f, b) for f, b in zip(tree.feature, tree.bin, strict=True) if f >= 0)
        assert tree.feature.count(-1) == leaves <= 9
        raw = raw + value
    told = {r.entity_id: r.probability for r in model.score(fitted, fills, df, ["x", "z"], 0.5, "gbt").collect()}
    assert np.allclose([told[i] for i in rows["entity_id"].to_pylist()], 1 / (1 + np.exp(-raw)), atol=1e-9) and len(told) == df.count()


def test_boosting_takes_rows_of_equal_bins_as_one(spark, monkeypatch):
    from tidemark.operators import boosting

    df, states, histograms = boosting_rows(spark, 300), [], boosting._histograms
    monkeypatch.setattr(boosting, "_histograms", lambda state, *rest: states.append(state) or histograms(state, *rest))
    once, _ = model.fit_gbt(df, ["x", "z"], ["c"], "y", 2, boosting.Growth(rate=0.3, leaves=4, least=20, l2=1.0))
    rows = len(np.frombuffer(b"".join(r.n for r in states[0].collect())))
    states.clear()
    thrice, _ = model.fit_gbt(df.union(df).union(df), ["x", "z"], ["c"], "y", 2, boosting.Growth(rate=0.3, leaves=4, least=60, l2=3.0))
    held = states[0].collect()
    n = np.frombuffer(b"".join(r.n for r in held))
    assert len(n) == rows and n.sum() == 3 * df.filter("y IS NOT NULL").count() and len(held) <= spark.sparkContext.defaultParallelism
    assert [(t.feature, t.bin) for t in once.trees] == [(t.feature, t.bin) for t in thrice.trees] and np.allclose(once.trees[1].value, thrice.trees[1].value, atol=1e-12)


def test_boosting_beats_the_base_rate_on_held_out_rows(spark, monkeypatch):
    from tidemark.operators import boosting

    monkeypatch.setattr(boosting, "KEPT", 7)
    df = boosting_rows(spark)
    train, held = df.filter("entity_id % 3 > 0"), df.filter("entity_id % 3 = 0 AND y IS NOT NULL")
    fitted, fills = model.fit_gbt(train, ["x", "z"], ["c"], "y", 20, boosting.Growth(rate=0.2, least=20))
    rows = model.score(fitted, fills, held, ["x", "z"], 0.5, "gbt", ("entity_id", "prediction_date", "y")).collect()
    loss = lambda p: -np.mean([math.log(q if r.y else 1 - q) for r, q in zip(rows, p, strict=True)])
    rate = np.mean([r.y for r in rows])
    assert loss([r.probability for r in rows]) < 0.9 * loss([rate] * len(rows))
    new = held.withColumn("c", F.lit("unheard of"))
    assert all(0 < r.probability < 1 for r in model.score(fitted, fills, new, ["x", "z"], 0.5, "gbt").collect())
    with pytest.raises(ValueError, match="positive"):
        model.fit_gbt(df.filter("y"), ["x"], ["c"], "y", 1)


def newton(x, y, penalty=0.0):
    """Logistic regression with an intercept, by Newton's method; the penalty leaves the intercept alone."""
    x = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
    return w


def known_design(df, reference):
    """The numerics standardised after their gaps are filled, and flags of the categories."""
    rows = [r for r in df.orderBy("entity_id").collect() if r.y is not None]
    out, y = [], np.array([r.y for r in rows], float)
    for c in ("x", "z"):
        v = np.array([np.nan if r[c] is None else r[c] for r in rows], float)
        v = np.where(np.isnan(v), np.nanmean(v) if reference else np.nanmedian(v), v)
        out.append((v - v.mean()) / v.std(ddof=1))
    mode = "__missing__" if reference else max("abd", key=lambda k: (sum(r.c == k for r in rows if True), -ord(k)))
    cats = [mode if r.c is None else r.c for r in rows]
    return np.stack([*out, *[np.array([c == k for c in cats], float) for k in sorted(set(cats))[1 if reference else 0 :]]], axis=1), y


def test_logistic_models_equal_newton(spark):
    df, seen = boosting_rows(spark, 600), []
    fitted, fills = model.fit_reference_coded(df, ["x", "z"], ["c"], "y", 200, 1e-14, seen)
    w = newton(*known_design(df, True))
    assert np.allclose(fitted.stages[-1].coefficients.toArray(), w[:-1], atol=1e-4) and abs(fitted.stages[-1].intercept - w[-1]) < 1e-4
    assert all(a >= b - 1e-12 for a, b in zip(seen, seen[1:], strict=False))
    early = []
    short, _ = model.fit_reference_coded(df, ["x", "z"], ["c"], "y", seen=early)
    assert 2 <= len(early) <= 31 and early == pytest.approx(seen[: len(early)], rel=1e-6) and early[-2] - early[-1] < 0.01 * early[-2] and all(a - b >= 0.01 * a for a, b in zip(early[:-2], early[1:-1], strict=True))
    told = model.score(short, fills, df.withColumn("c", F.lit("it's new")), ["x", "z"], 0.5, "warehouse")
    assert told.count() == 600 and told.filter("probability BETWEEN 0 AND 1").count() == 600
    with pytest.raises(ValueError, match="fitted on"):
        model.score(short, fills, df, ["z", "x"], 0.5, "warehouse")
    labelled = df.filter("y IS NOT NULL")
    ridge, _ = model.fit_logistic(labelled, ["x", "z"], ["c"], "y")
    w = newton(*known_design(labelled, False), penalty=1.0)
    assert np.allclose(ridge.stages[-1].coefficients.toArray(), w[:-1], atol=1e-3) and abs(ridge.stages[-1].intercept - w[-1]) < 1e-3
