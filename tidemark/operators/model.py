"""Models on Spark ML: the logistic baseline, a boosted-tree challenger, scoring and explanation."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators import boosting, quality
from tidemark.operators.activate import content_digest
from tidemark.operators.boosting import Boosted, Growth
from tidemark.sources.scratch import materialise


def modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The most frequent non-null value of each column, ties to the smallest; one aggregate."""
    stacked = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]))).filter("v IS NOT NULL")
    counts = stacked.groupBy("c", "v").count()
    best = counts.groupBy("c").agg(F.min(F.struct((-F.col("count")).alias("n"), "v")).alias("best"))
    return {r["c"]: r["best"]["v"] for r in best.collect()}  # a row for each column


def prepared(df: DataFrame, numeric: list[str], fills: dict[str, str]) -> DataFrame:
    """Numerics as double with NaN as null, categoricals as strings with nulls filled by their training mode."""
    num = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in numeric}
    return df.withColumns(num | {c: F.coalesce(F.col(c).cast("string"), F.lit(v)) for c, v in fills.items()})


def _filled(columns: dict[str, str]) -> SQLTransformer:
    """A stage that adds columns {name: SQL expression}."""
    return SQLTransformer(statement=f"SELECT *, {', '.join(f'{e} AS `{n}`' for n, e in columns.items())} FROM __THIS__")


def _features(numeric: list[str], categorical: list[str], medians: dict[str, list[float] | None]) -> list:
    filled = [f"{c}__filled" for c in numeric]
    return [
        _filled({f"{c}__filled": f"coalesce(`{c}`, {float((medians[c] or [0.0])[0])!r}D)" for c in numeric}),
        StringIndexer(inputCols=categorical, outputCols=[f"{c}__index" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc"),
        # With the extra level for unknown values dropped, an unknown value is all zero and every known one has a column.
        OneHotEncoder(inputCols=[f"{c}__index" for c in categorical], outputCols=[f"{c}__hot" for c in categorical], dropLast=True, handleInvalid="error"),
        VectorAssembler(inputCols=filled, outputCol="numeric_vector"),
        StandardScaler(inputCol="numeric_vector", outputCol="scaled_vector", withMean=True, withStd=True),
        VectorAssembler(inputCols=["scaled_vector", *(f"{c}__hot" for c in categorical)], outputCol="features"),
    ]


def fit_logistic(train: DataFrame, numeric: list[str], categorical: list[str], label: str, c: float = 1.0, max_iter: int = 1000) -> tuple[PipelineModel, dict[str, str]]:
    """An L2 logistic model; Spark averages the loss, so the penalty C becomes 1 / (C n). Returns the model and the modes.

    Gaps in numerics are filled by exact medians, 0 where a column has no value.
    """
    fills = modes(train, categorical)
    rows = prepared(train, numeric, fills).withColumn("label", F.col(label).cast("double")).filter("label IS NOT NULL")
    lr = LogisticRegression(regParam=1.0 / (c * max(1, rows.count())), maxIter=max_iter, standardization=False)
    return Pipeline(stages=[*_features(numeric, categorical, exact_quantiles(rows, numeric, [0.5])), lr]).fit(rows), fills


def fit_reference_coded(train: DataFrame, numeric: list[str], categorical: list[str], label: str, max_iter: int = 30, progress: float = 0.01, seen: list[float] | None = None) -> tuple[PipelineModel, dict[str, str]]:
    """The warehouse's logistic model: no penalty, no split of its own, categories coded against a reference level, early stopping on the loss.

    Every category but the first in order has a flag; a missing one is a category of its own, and an unknown one counts as the reference. Numerics are
    standardised, gaps filled by the mean. Training ends after `max_iter` steps, or with the first one that lowers the loss by less than `progress` of
    it; `seen` gets the losses step by step.
    """
    fills = dict.fromkeys(categorical, "__missing__")
    rows = prepared(train, numeric, fills).withColumn("label", F.col(label).cast("double")).filter("label IS NOT NULL")
    levels = {c: sorted(r[0] for r in rows.select(c).distinct().collect())[1:] for c in categorical}  # a row for each level
    means = rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in numeric]).first() if numeric else {}
    flags = {f"{c}__{v}": f"CASE WHEN `{c}` = '{v.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}' THEN 1D ELSE 0D END" for c, vs in levels.items() for v in vs}
    stages = [
        _filled({f"{c}__filled": f"coalesce(`{c}`, {float(means[c])!r}D)" for c in numeric} | flags),
        VectorAssembler(inputCols=[f"{c}__filled" for c in numeric], outputCol="numeric_vector"),
        StandardScaler(inputCol="numeric_vector", outputCol="scaled_vector", withMean=True, withStd=True),
        VectorAssembler(inputCols=["scaled_vector", *flags], outputCol="features"),
    ]
    design = Pipeline(stages=stages).fit(rows)
    placed = materialise(design.transform(rows).select("features", "label"), "reference-coded")
    whole = LogisticRegression(regParam=0.0, maxIter=max_iter, tol=0.0, standardization=False).fit(placed)
    losses = [float(x) for x in whole.summary.objectiveHistory]
    steps = next((i for i in range(1, len(losses)) if losses[i - 1] - losses[i] < progress * abs(losses[i - 1])), len(losses) - 1)
    if seen is not None:
        seen.extend(losses[: steps + 1])
    last = whole if steps >= len(losses) - 1 else LogisticRegression(regParam=0.0, maxIter=steps, tol=0.0, standardization=False).fit(placed)
    return PipelineModel([*design.stages, last]), fills


def fit_gbt(train: DataFrame, numeric: list[str], categorical: list[str], label: str, iterations: int = 200, growth: Growth = Growth()) -> tuple[Boosted, dict[str, str]]:  # noqa: B008
    """The boosted-tree challenger: best-first trees of 15 leaves with at least 50 rows and an L2 term of 1, see boosting.py. Returns the model and the modes."""
    fills = modes(train, categorical)
    rows = prepared(train, numeric, fills).filter(F.col(label).isNotNull())
    levels = {c: sorted(r[0] for r in rows.select(c).distinct().collect()) for c in categorical}  # a row for each level
    return boosting.fit(rows, numeric, levels, label, replace(growth, rounds=iterations)), fills


def _contract(model: PipelineModel | Boosted, categorical: list[str]) -> tuple[list[str], list[str]]:
    """The numerics and categories that a model was fitted on, in their order; a reference-coded one tells the numerics alone."""
    if isinstance(model, Boosted):
        return model.numeric, list(model.levels)
    numeric = next(s for s in model.stages if isinstance(s, VectorAssembler) and s.getOutputCol() == "numeric_vector")
    indexed = [list(s.getInputCols()) for s in model.stages if isinstance(s, StringIndexerModel)]
    return [c.removesuffix("__filled") for c in numeric.getInputCols()], *(indexed or [categorical])


def score(model: PipelineModel | Boosted, fills: dict[str, str], batch: DataFrame, numeric: list[str], threshold: float, name: str, ids: tuple[str, ...] = ("entity_id", "prediction_date"), strict: bool = True) -> DataFrame:
    """ids, probability of the positive class, is_high (inclusive), model_name and threshold of every row.

    strict: the batch must have the features that the model was fitted on, in their order, and unique ids without nulls. The ids are the
    first two columns of `ids`; others are passed through.
    """
    if strict:
        fitted = _contract(model, list(fills))
        if fitted != (list(numeric), list(fills)):
            raise ValueError(f"the model was fitted on {fitted}, not on {(list(numeric), list(fills))}")
        keys = list(ids[:2])
        missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        counts = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"), F.count_if(missing).alias("null_ids"))
        bad = {k: v for k, v in counts.first().asDict().items() if v}
        if bad:
            raise ValueError(f"the batch's ids are unsound: {bad}")
    rows = prepared(batch, numeric, fills)
    if isinstance(model, Boosted):
        out = model.transform(rows.select(*dict.fromkeys([*ids, *numeric, *fills])))
    else:
        out = model.transform(rows).withColumn("probability", vector_to_array("probability")[1])
    return out.select(*ids, "probability", (F.col("probability") >= threshold).alias("is_high"), F.lit(name).alias("model_name"), F.lit(threshold).alias("threshold"))


def prediction_summary(preds: DataFrame) -> DataFrame:
    """One row on a batch: rows, entities, first and last date, high-risk count and rate, and the smallest, mean and largest probability."""
    p, high = F.col("probability"), F.count_if("is_high")
    return preds.agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("entity_id").alias("entity_count"), F.min("prediction_date").alias("first_date"), F.max("prediction_date").alias("last_date"),
        high.alias("high_count"), F.try_divide(high.cast("double"), F.count(F.lit(1)).cast("double")).alias("high_rate"), F.min(p).alias("min_probability"), F.avg(p).alias("mean_probability"), F.max(p).alias("max_probability"),
    )


#: The columns of stored predictions, in their order.
PREDICTION_COLUMNS = ("entity_id", "prediction_date", "probability", "is_high", "model_name", "threshold")


def prediction_errors(preds: DataFrame) -> DataFrame:
    """One row of counts that must all be 0 in a batch of predictions."""
    p, t = F.col("probability"), F.col("threshold")
    whole = preds.agg(
        F.count_if(F.col("entity_id").isNull() | F.col("prediction_date").isNull()).alias("null_ids"), F.count_if(~F.coalesce(~F.isnan(p) & p.between(0.0, 1.0), F.lit(False))).alias("bad_probabilities"),
        F.count_if(~F.col("is_high").eqNullSafe(p >= t)).alias("flag_mismatches"), F.greatest(F.count_distinct("model_name") - 1, F.lit(0)).alias("extra_models"),
        F.greatest(F.count_distinct("threshold") - 1, F.lit(0)).alias("extra_thresholds"), (F.count(F.lit(1)) == 0).cast("long").alias("empty"),
    )
    return whole.crossJoin(quality.duplicate_keys(preds, ["entity_id", "prediction_date"]))


def store_predictions(preds: DataFrame, path: str) -> DataFrame:
    """Write predictions as Parquet, read them back and return what was read, if it holds the contract and what was written.

    The columns are PREDICTION_COLUMNS; the rows must pass prediction_errors; a digest of the rows, the same in any order, must agree.
    """
    kept = materialise(preds.select(*PREDICTION_COLUMNS), "predictions")
    kept.write.mode("overwrite").parquet(path)
    found = preds.sparkSession.read.parquet(path)
    if tuple(found.columns) != PREDICTION_COLUMNS or found.dtypes != kept.dtypes:
        raise ValueError(f"stored predictions have the columns {found.dtypes}")
    bad = {k: v for k, v in prediction_errors(found).first().asDict().items() if v}
    if bad or content_digest(found).first() != content_digest(kept).first():
        raise ValueError(f"stored predictions are unsound: {bad or 'their rows differ from what was written'}")
    return found


def explain_logistic(model: PipelineModel, scored: DataFrame, numeric: list[str]) -> DataFrame:
    """feature, source_feature, coefficient, absolute, odds_ratio, direction, effect_rank; scored: one transformed frame, for names."""
    import math

    fitted = model.stages[-1]
    attrs = scored.schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in attrs.values() for a in group} | dict(enumerate(numeric))  # scaling drops the numerics' names
    rows = [(names.get(i, str(i)), float(w)) for i, w in enumerate(fitted.coefficients.toArray())]
    rows.sort(key=lambda r: (-abs(r[1]), r[0]))
    source = lambda n: n.split("__")[0]
    table = [(n, source(n), w, abs(w), math.exp(w), "increases" if w > 0 else "decreases" if w < 0 else "none", i) for i, (n, w) in enumerate(rows, 1)]
    return scored.sparkSession.createDataFrame(table, "feature string, source_feature string, coefficient double, absolute double, odds_ratio double, direction string, effect_rank int")
