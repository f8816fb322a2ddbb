"""Model registry: names and settings of tabular models, translated to Spark ML."""

from __future__ import annotations

import itertools
import json
import random

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml import classification as C, regression as R
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from tablecraft.learn.boosting import boosted_classes
from tablecraft.learn.cells import MOST_CELLS, boosted_cells, cells_of, forest_of_cells
from tablecraft.learn.margins import support_vectors
from tablecraft.learn.neighbours import NearestNeighbours

SEED = 42
DEEPEST = 30


def depth_of(asked: int | None) -> int:
    """Spark grows trees of up to 30 levels; None means as deep as that."""
    if asked and asked > DEEPEST:
        raise ValueError(f"trees have at most {DEEPEST} levels")
    return asked or DEEPEST

# Model names, their default settings and the grids that tuning tries.
CLASSIFIERS = {
    "Logistic Regression": {"C": 1.0, "max_iter": 100},
    "Decision Tree": {"max_depth": 5, "min_samples_leaf": 1},
    "Random Forest": {"n_estimators": 100, "max_depth": 5, "min_samples_leaf": 1},
    "SVM": {"C": 1.0, "max_iter": 100, "kernel": "rbf", "gamma": "scale", "components": 512},
    "Naive Bayes": {},
    "K-Nearest Neighbors": {"n_neighbors": 5},
    "Gradient Boosting": {"learning_rate": 0.1, "max_depth": 5, "max_iter": 20},
}
REGRESSORS = {
    "Linear Regression": {},
    "Ridge Regression": {"alpha": 1.0},
    "Lasso Regression": {"alpha": 1.0},
    "Decision Tree Regressor": {"max_depth": 5, "min_samples_leaf": 1},
    "Random Forest Regressor": {"n_estimators": 100, "max_depth": 5, "min_samples_leaf": 1},
    "Elastic Net": {"alpha": 1.0, "l1_ratio": 0.5},
    "K-Nearest Neighbors": {"n_neighbors": 5},
    "Gradient Boosting": {"learning_rate": 0.1, "max_depth": 5, "max_iter": 20},
}
CLASSIFIER_GRIDS = {
    "Logistic Regression": {"C": [0.1, 1.0, 10.0]},
    "Decision Tree": {"max_depth": [3, 5, 10, None]},
    "Random Forest": {"n_estimators": [100, 200], "max_depth": [5, 10, None]},
    "SVM": {"C": [0.1, 1.0, 10.0], "kernel": ["rbf", "linear"]},
    "K-Nearest Neighbors": {"n_neighbors": [3, 5, 7, 11]},
    "Gradient Boosting": {"learning_rate": [0.05, 0.1], "max_depth": [3, 5]},
}
REGRESSOR_GRIDS = {
    "Ridge Regression": {"alpha": [0.1, 1.0, 10.0]},
    "Lasso Regression": {"alpha": [0.01, 0.1, 1.0]},
    "Elastic Net": {"alpha": [0.01, 0.1, 1.0], "l1_ratio": [0.2, 0.5, 0.8]},
    "Decision Tree Regressor": {"max_depth": [3, 5, 10, None]},
    "Random Forest Regressor": {"n_estimators": [100, 200], "max_depth": [5, 10, None]},
    "K-Nearest Neighbors": {"n_neighbors": [3, 5, 7, 11]},
    "Gradient Boosting": {"learning_rate": [0.05, 0.1], "max_depth": [3, 5]},
}
UNWEIGHTED = ("Naive Bayes", "K-Nearest Neighbors")


def registry(task: str) -> dict[str, dict]:
    if task not in ("classification", "regression"):
        raise ValueError(f"unknown task {task!r}")
    return CLASSIFIERS if task == "classification" else REGRESSORS


def param_grid(task: str, name: str) -> list[dict]:
    """All combinations of the model's tuning grid; empty when it has none."""
    grid = (CLASSIFIER_GRIDS if task == "classification" else REGRESSOR_GRIDS).get(name, {})
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())] if grid else []


def random_settings(task: str, name: str, n: int, seed: int = SEED) -> list[dict]:
    grid = param_grid(task, name)
    return random.Random(seed).sample(grid, min(n, len(grid)))


class TabularModel(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Fits the named model on ``features`` and ``label``; yields an ordinary Spark ML model.

    Penalties of the linear models depend on the training rows (their number, weights and
    the spread of the label), so they are worked out when fitting.
    """

    task = Param(Params._dummy(), "task", "classification or regression", TypeConverters.toString)
    model = Param(Params._dummy(), "model", "registered name", TypeConverters.toString)
    settings = Param(Params._dummy(), "settings", "model settings as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, task: str = "classification", model: str = "Logistic Regression", settings: str = "{}"):
        super().__init__()
        self._setDefault(task="classification", model="Logistic Regression", settings="{}")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame):
        task, name = self.getOrDefault("task"), self.getOrDefault("model")
        known = registry(task)
        if name not in known:
            raise ValueError(f"model {name!r} is not registered for {task}")
        given = json.loads(self.getOrDefault("settings"))
        foreign = set(given) - set(known[name]) - {"balanced"}
        if foreign:
            raise ValueError(f"{name} does not know the settings {sorted(foreign)}")
        s = {**known[name], **given}
        # the indexer's metadata counts a class for unseen labels, which no model should expect
        dataset = dataset.withColumn("label", F.col("label").alias("label", metadata={}))
        if task == "classification":
            return self._classifier(dataset, name, s)
        return self._regressor(dataset, name, s)

    def _classifier(self, dataset, name, s):
        counts = {r["label"]: r["count"] for r in dataset.groupBy("label").count().collect()}
        rows, classes = sum(counts.values()), len(counts)
        if classes < 2:
            raise ValueError("a classifier needs two or more classes")
        weights = {}
        if name not in UNWEIGHTED and s.get("balanced", True):
            weights = {"weightCol": "__weight"}
            weight = F.lit(1.0)
            for label, n in counts.items():
                weight = F.when(F.col("label") == label, rows / (classes * n)).otherwise(weight)
            dataset = dataset.withColumn("__weight", weight)
        tree = {"maxDepth": depth_of(s["max_depth"]), "seed": SEED} if "max_depth" in s else {}
        if "min_samples_leaf" in s:
            tree["minInstancesPerNode"] = s["min_samples_leaf"]
        if name == "Logistic Regression":
            # balanced weights add up to the number of rows
            made = C.LogisticRegression(regParam=1.0 / (s["C"] * rows), elasticNetParam=0.0, standardization=False, maxIter=s["max_iter"], **weights)
        elif name == "Decision Tree":
            made = C.DecisionTreeClassifier(**tree, **weights)
        elif name == "Random Forest":
            if s["min_samples_leaf"] == 1 and (cells := cells_of(dataset, rows, classes, weight=weights.get("weightCol"))):
                return forest_of_cells(dataset, cells, task="classification", weight=weights.get("weightCol"), trees=s["n_estimators"], seed=SEED, classes=classes, maxDepth=tree["maxDepth"])
            made = C.RandomForestClassifier(numTrees=s["n_estimators"], **tree, **weights)
        elif name == "SVM":
            return support_vectors(dataset, classes, weights.get("weightCol"), s["C"], rows, s["max_iter"], s["kernel"], s["gamma"], s["components"], SEED)
        elif name == "Naive Bayes":
            made = C.NaiveBayes(modelType="gaussian")
        elif name == "K-Nearest Neighbors":
            made = NearestNeighbours(k=s["n_neighbors"], task="classification")
        else:
            if classes > 2:
                return boosted_classes(dataset, classes, weights.get("weightCol"), s["learning_rate"], s["max_iter"], tree)
            if cells := cells_of(dataset, rows, classes, weight=weights.get("weightCol")):
                return boosted_cells(dataset, cells, "classification", weights.get("weightCol"), stepSize=s["learning_rate"], maxIter=s["max_iter"], **tree)
            made = C.GBTClassifier(stepSize=s["learning_rate"], maxIter=s["max_iter"], **tree, **weights)
        return made.fit(dataset)

    def _regressor(self, dataset, name, s):
        tree = {"maxDepth": depth_of(s["max_depth"]), "seed": SEED} if "max_depth" in s else {}
        if "min_samples_leaf" in s:
            tree["minInstancesPerNode"] = s["min_samples_leaf"]
        if name == "Decision Tree Regressor":
            made = R.DecisionTreeRegressor(**tree)
        elif name == "Random Forest Regressor":
            if s["min_samples_leaf"] == 1 and (cells := cells_of(dataset, dataset.count(), most=MOST_CELLS)):
                return forest_of_cells(dataset, cells, task="regression", weight=None, trees=s["n_estimators"], seed=SEED, maxDepth=tree["maxDepth"])
            made = R.RandomForestRegressor(numTrees=s["n_estimators"], **tree)
        elif name == "K-Nearest Neighbors":
            made = NearestNeighbours(k=s["n_neighbors"], task="regression")
        elif name == "Gradient Boosting":
            if cells := cells_of(dataset, dataset.count()):
                return boosted_cells(dataset, cells, "regression", None, stepSize=s["learning_rate"], maxIter=s["max_iter"], **tree)
            made = R.GBTRegressor(stepSize=s["learning_rate"], maxIter=s["max_iter"], **tree)
        else:
            row = dataset.agg(F.count("label").alias("n"), F.stddev_pop("label").alias("s")).head()
            spread = row["s"] or 1.0
            reg, mix = 0.0, 0.0
            if name == "Ridge Regression":
                reg = s["alpha"] / row["n"] * spread
            elif name == "Lasso Regression":
                reg, mix = s["alpha"], 1.0
            elif name == "Elastic Net":
                reg = s["alpha"] * s["l1_ratio"] + s["alpha"] * (1 - s["l1_ratio"]) * spread
                mix = s["alpha"] * s["l1_ratio"] / reg if reg else 0.0
            made = R.LinearRegression(regParam=reg, elasticNetParam=mix, standardization=False)
        return made.fit(dataset)
