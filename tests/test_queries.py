"""Every query with SQL gives what the SQL gives, on the smallest tables; plans hold what they promise."""

import pytest

from tests.conftest import SF
from tests.oracle import expected, rows
from tidemark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, name):
    got, want = registry.QUERIES[name](spark, SF).toPandas(), expected(registry.SQL[name], SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["asof_features", "asof_features_explode", "asof_features_arrival", "weekly_progress", "decide", "threshold_sweep", "calibration_width", "numeric_psi", "panel_checks"])
def test_plans_are_native(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["score_logistic", "explain_logistic", "monitoring_run", "run_id"])
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_boosted_trees_have_all_their_rounds(spark, monkeypatch):
    from tidemark.operators import model
    from tidemark.plans import run_queries

    real, asked = model.fit_gbt, []

    def fit(*args, **kwargs):
        asked.append(kwargs.get("iterations", real.__defaults__[0]))
        return None, {}

    monkeypatch.setattr(model, "fit_gbt", fit)
    run_queries._model(spark, SF, "gbt")
    assert asked == [200]


def test_models_read_features_that_are_kept(spark):
    files = registry.QUERIES["score_logistic"](spark, SF).inputFiles()
    assert files and all("model-rows" in f for f in files)


def test_compared_models_are_scored_once(spark, monkeypatch):
    from tidemark.operators import evaluate, model
    from tidemark.plans import run_queries

    seen, fit = [], model.fit_gbt
    monkeypatch.setattr(model, "fit_gbt", lambda *a: fit(*a, iterations=1))
    monkeypatch.setattr(evaluate, "evaluate_binary", lambda preds, threshold: seen.append(preds.inputFiles()) or preds.limit(1))
    assert run_queries.compared(spark, SF).count() == 2
    assert len(seen) == 2 and all(files and all("/scored-" in f for f in files) for files in seen)
