"""Train, validate, tune, score, save: preprocessing and model as one pipeline."""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from statistics import fmean, pstdev

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecraft.functions.columns import col, require
from tablecraft.learn import metrics
from tablecraft.learn.models import TabularModel, param_grid, random_settings
from tablecraft.learn.prepare import TabularPrepModel, prep_for
from tablecraft.learn.products import curve_scores, fold_scores, summed
from tablecraft.learn.split import nested_subset, safe_folds, with_folds
from tablecraft.plans.recipe import Recipe
from tablecraft.session import freeze, small_frame

LABEL = "label"
#: Columns that the stages make; an input column of such a name steps aside meanwhile.
MADE = ("label", "features", "prediction", "probability", "rawPrediction")
ASIDE = "__input_"
#: Number of rows that are alike.
ROWS = "__rows"


def _aside(name: str) -> str:
    return ASIDE + name if name in MADE else name


def _put_aside(df: DataFrame) -> DataFrame:
    return df.select(*[col(c).alias(_aside(c)) for c in df.columns])
SMALLER_IS_BETTER = ("rmse", "mae", "mse")
CURVE_SCHEMA = "fraction double, train_mean double, train_std double, test_mean double, test_std double"


def pipeline_for(df: DataFrame, target: str, features: Sequence[str], task: str, model: str, settings: dict | None = None,
                 scaler: str = "standard") -> Pipeline:
    """Label, preprocessing and model stages; everything is fitted together on the rows given to fit."""
    require(df, target, *features)
    stages = []
    if task == "classification":
        stages.append(StringIndexer(inputCol=target, outputCol=LABEL, stringOrderType="alphabetAsc", handleInvalid="keep"))
    stages += [prep_for(df, features, scaler), TabularModel(task=task, model=model, settings=json.dumps(settings or {}))]
    return Pipeline(stages=stages)


def _labelled(df: DataFrame, target: str, task: str) -> DataFrame:
    known = df.where(col(target).isNotNull())
    return known if task == "classification" else known.withColumn(LABEL, col(target).cast("double"))


@dataclass
class Trained:
    """A fitted pipeline with what is needed to use it later."""

    model: PipelineModel
    task: str
    target: str
    features: list[str]
    name: str
    settings: dict = field(default_factory=dict)

    @property
    def prep(self) -> TabularPrepModel:
        return next(s for s in self.model.stages if isinstance(s, TabularPrepModel))

    @property
    def labels(self) -> list[str]:
        return list(self.model.stages[0].labels) if self.task == "classification" else []

    def raw(self, df: DataFrame) -> DataFrame:
        """Input columns (those named like a made one under ``__input_``), ``label`` where the target is known, ``prediction`` and scores."""
        known, df = self.target in df.columns, _put_aside(df)
        source = df.withColumn(LABEL, col(_aside(self.target)).cast("double")) if known and self.task == "regression" else df
        return self.model.transform(source)

    def predict(self, df: DataFrame) -> DataFrame:
        """The input columns and ``prediction``, in the target's own values."""
        require(df, *self.features)
        scored, value = self.raw(df), F.col("prediction")
        if self.task == "classification":
            scored = IndexToString(inputCol="prediction", outputCol="__named", labels=self.labels).transform(scored)
            value = F.col("__named")
        return scored.select(*[col(_aside(c)).alias(c) for c in df.columns if c != "prediction"], value.alias("prediction"))

    def importance(self, top: int | None = None) -> DataFrame | None:
        """(feature, importance) of trees, or mean absolute coefficients; None for other models."""
        fitted, names = self.model.stages[-1], self.prep.feature_names
        if isinstance(fitted, PipelineModel):  # machines behind a feature map, or boosted classes
            trees = [s.featureImportances.toArray() for s in fitted.stages if hasattr(s, "featureImportances")]
            fitted = fitted.stages[-1]
        else:
            trees = []
        if trees:
            values = sum(trees) / len(trees)
        elif hasattr(fitted, "featureImportances"):
            values = fitted.featureImportances.toArray()
        elif hasattr(fitted, "coefficientMatrix"):
            values = abs(fitted.coefficientMatrix.toArray()).mean(axis=0)
        elif hasattr(fitted, "coefficients"):
            values = abs(fitted.coefficients.toArray())
        else:
            return None
        spark = SparkSession.getActiveSession()
        frame = small_frame(spark, [(n, float(v)) for n, v in zip(names, values)], "feature string, importance double")
        frame = frame.orderBy(F.desc("importance"), "feature")
        return frame.limit(top) if top else frame


def train(df: DataFrame, target: str, features: Sequence[str], task: str, model: str, settings: dict | None = None,
          scaler: str = "standard") -> Trained:
    """The stages read the rows many times, so the columns they use are kept meanwhile, unless the caller keeps ``df`` already."""
    level = df.storageLevel
    kept_before = level.useDisk or level.useMemory
    require(df, target, *features)
    df = _put_aside(df)
    named = list(dict.fromkeys(_aside(c) for c in (target, *features)))
    rows = _labelled(df.select(*[col(c) for c in named]), _aside(target), task)
    if not kept_before:
        rows = rows.persist(StorageLevel.DISK_ONLY)
    try:
        fitted = pipeline_for(df, _aside(target), [_aside(f) for f in features], task, model, settings, scaler).fit(rows)
    finally:
        if not kept_before:
            rows.unpersist()
    return Trained(fitted, task, target, list(features), model, dict(settings or {}))


def evaluate(trained: Trained, test: DataFrame) -> DataFrame:
    """One row of metrics on held-out rows."""
    known = test.where(col(trained.target).isNotNull())
    if trained.task == "regression":
        return metrics.regression_metrics(trained.raw(known))
    # rows alike in target and features are scored once, and each model once for all figures
    names = dict.fromkeys([trained.target, *trained.features])
    alike = freeze(known.groupBy(*[col(c) for c in names]).agg(F.count(F.lit(1)).alias(ROWS)))
    scored, two, score = trained.raw(alike), len(trained.labels) == 2, F.lit(None)
    if "probability" in scored.columns:
        score = col("probability") if dict(scored.dtypes)["probability"].startswith("array") else vector_to_array("probability")
    seen = freeze(scored.groupBy(LABEL, "prediction", (score[1] if two and "probability" in scored.columns else score).alias("__p")).agg(F.sum(ROWS).alias(ROWS)))
    # a class that was not in the training rows cannot be predicted; it counts as an error
    row = metrics.classification_metrics(seen, n=ROWS)
    if "probability" not in scored.columns:
        return row.withColumn("roc_auc", F.lit(None).cast("double"))
    if two:
        return row.join(metrics.roc_auc(seen, LABEL, "__p", n=ROWS), F.lit(True))
    return row.join(metrics.roc_auc_multiclass(seen, LABEL, "__p", range(len(trained.labels)), n=ROWS), F.lit(True))


def cross_validate(df: DataFrame, target: str, features: Sequence[str], key: Sequence[str], task: str, model: str, settings: dict | None = None,
                   folds: int = 5, metric: str | None = None, parallelism: int = 2, scaler: str = "standard") -> list[float]:
    """One score per fold; preprocessing is refitted on each fold's training rows.

    Linear models of numeric features come from sums of products of every fold, without a fit of their own.
    """
    k = safe_folds(df, target, folds, task)
    if k is None:
        raise ValueError("cross-validation needs two or more rows of each class")
    metric = metric or ("accuracy" if task == "classification" else "r2")
    marked = with_folds(df, target, key, k, task)
    if summed(df, features, task, model, settings, scaler, metric):
        return fold_scores(marked, target, features, k, model, [settings or {}], scaler, metric)[0]

    def score(i: int) -> float:
        fitted = train(marked.where(F.col("fold") != i).drop("fold"), target, features, task, model, settings, scaler)
        return evaluate(fitted, marked.where(F.col("fold") == i).drop("fold")).head()[metric]

    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(score, range(k)))


def tune(df: DataFrame, target: str, features: Sequence[str], key: Sequence[str], task: str, model: str, search: str = "grid",
         folds: int = 5, n_iter: int = 10, metric: str | None = None, grid: list[dict] | None = None) -> tuple[Trained, dict]:
    """Best settings by cross-validation, then a fit on all rows. A plain fit where there is nothing to search."""
    options = grid if grid is not None else (random_settings(task, model, n_iter) if search == "random" else param_grid(task, model))
    k = safe_folds(df, target, folds, task)
    if not options or k is None:
        return train(df, target, features, task, model), {}
    metric = metric or ("accuracy" if task == "classification" else "r2")
    sign = -1 if metric in SMALLER_IS_BETTER else 1
    if all(summed(df, features, task, model, o, "standard", metric) for o in options):
        means = [fmean(s) for s in fold_scores(with_folds(df, target, key, k, task), target, features, k, model, options, "standard", metric)]
    else:
        means = [fmean(cross_validate(df, target, features, key, task, model, o, k, metric)) for o in options]
    best = options[max(range(len(options)), key=lambda i: sign * means[i])]
    return train(df, target, features, task, model, best), best


def learning_curve(df: DataFrame, target: str, features: Sequence[str], key: Sequence[str], task: str, model: str, settings: dict | None = None,
                   folds: int = 5, fractions: Sequence[float] = (0.1, 0.325, 0.55, 0.775, 1.0)) -> DataFrame:
    """Train and test scores (mean, std over folds) for growing, nested training sets."""
    k = safe_folds(df, target, folds, task)
    if k is None:
        raise ValueError("not enough data for a learning curve")
    metric = "accuracy" if task == "classification" else "r2"
    marked, lines = with_folds(df, target, key, k, task), []
    if summed(df, features, task, model, settings, "standard", metric):
        for fraction, fitted, held in curve_scores(marked, target, features, key, k, model, settings, fractions, metric):
            lines.append((float(fraction), fmean(fitted), pstdev(fitted), fmean(held), pstdev(held)))
        return small_frame(df.sparkSession, lines, CURVE_SCHEMA)
    for fraction in fractions:
        train_scores, test_scores = [], []
        for i in range(k):
            part = nested_subset(marked.where(F.col("fold") != i), key, fraction).drop("fold")
            fitted = train(part, target, features, task, model, settings)
            train_scores.append(evaluate(fitted, part).head()[metric])
            test_scores.append(evaluate(fitted, marked.where(F.col("fold") == i).drop("fold")).head()[metric])
        lines.append((float(fraction), fmean(train_scores), pstdev(train_scores), fmean(test_scores), pstdev(test_scores)))
    return small_frame(df.sparkSession, lines, CURVE_SCHEMA)


def score_batch(trained: Trained, table: DataFrame, recipe: Recipe | None = None, mode: str = "recompute") -> DataFrame:
    """Predictions for a newly read table; the recipe is replayed when features are missing."""
    work = table
    if recipe is not None and any(f not in work.columns for f in trained.features):
        work, _ = recipe.apply(work, mode=mode)
    lacking = [f for f in trained.features if f not in work.columns]
    if lacking:
        raise ValueError(f"the table lacks the features {lacking}")
    return trained.predict(work)


def save_bundle(trained: Trained, folder: str, recipe: Recipe | None = None, scores: dict | None = None) -> None:
    """A folder with the pipeline and, as text files, its description, recipe and metrics."""
    spark = SparkSession.getActiveSession()
    trained.model.write().save(os.path.join(folder, "model"))
    info = {"task": trained.task, "target": trained.target, "features": trained.features, "name": trained.name,
            "settings": trained.settings, "metrics": scores or {}}
    texts = [("data_info", json.dumps(info))] + ([("recipe", recipe.to_json())] if recipe else [])
    for name, text in texts:
        spark.createDataFrame([(" ".join(text.splitlines()),)], "value string").coalesce(1).write.text(os.path.join(folder, f"{name}.json"))


def load_bundle(folder: str) -> tuple[Trained, Recipe | None, dict]:
    spark = SparkSession.getActiveSession()
    info = json.loads(spark.read.text(os.path.join(folder, "data_info.json")).head()[0])
    model = PipelineModel.load(os.path.join(folder, "model"))
    trained = Trained(model, info["task"], info["target"], info["features"], info["name"], info["settings"])
    try:
        recipe = Recipe.from_json(spark.read.text(os.path.join(folder, "recipe.json")).head()[0])
    except Exception as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        recipe = None
    return trained, recipe, info["metrics"]
