"""Scores from sums of products against fits of their own."""

import random

import pytest
from pyspark.sql import functions as F

from tablecraft.learn import workflow
from tablecraft.learn.products import FoldSums, curve_scores, fold_scores
from tablecraft.learn.split import nested_subset, with_folds

FEATURES = ["x1", "x2", "x3", "fixed", "empty"]


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(8)
    rows = []
    for i in range(240):
        a, b, c = rng.gauss(1e6, 3), rng.random() * 40, rng.gauss(0, 1)
        y = 5 * (a - 1e6) - 2 * b + rng.gauss(0, 4) + 100
        rows.append((i, a, None if i % 7 == 0 else b, float("nan") if i % 31 == 0 else c, 3.0, None, y))
    df = spark.createDataFrame(rows, "id int, x1 double, x2 double, x3 double, fixed double, empty double, y double")
    return with_folds(df, "y", ["id"], 4, "regression").checkpoint()


def apart(marked, i, model, settings, scaler="standard", fraction=1.0):
    part = nested_subset(marked.where(F.col("fold") != i), ["id"], fraction).drop("fold")
    fitted = workflow.train(part, "y", FEATURES, "regression", model, settings, scaler)
    return [workflow.evaluate(fitted, rows).head().asDict() for rows in (part, marked.where(F.col("fold") == i).drop("fold"))]


@pytest.mark.parametrize("model, settings, scaler, near", [
    ("Linear Regression", {}, "standard", 1e-9), ("Linear Regression", {}, "minmax", 1e-9), ("Ridge Regression", {"alpha": 25.0}, "standard", 1e-9),
    ("Ridge Regression", {"alpha": 2.0}, "minmax", 1e-9), ("Lasso Regression", {"alpha": 2.0}, "standard", 1e-4), ("Elastic Net", {"alpha": 0.5, "l1_ratio": 0.3}, "standard", 1e-4),
])
def test_folds_score_as_separate_fits(marked, model, settings, scaler, near):
    for metric in ("r2", "rmse"):
        found = fold_scores(marked, "y", FEATURES, 4, model, [settings], scaler, metric)[0]
        if metric == "r2":
            wanted = [apart(marked, i, model, settings, scaler)[1] for i in range(4)]
        assert found == pytest.approx([w[metric] for w in wanted], rel=near)


def test_learning_curve_scores_as_separate_fits(marked):
    lines = curve_scores(marked, "y", FEATURES, ["id"], 4, "Linear Regression", {}, (0.2, 0.5, 1.0), "r2")
    assert [f for f, _, _ in lines] == [0.2, 0.5, 1.0]
    for fraction, train, test in lines:
        wanted = [apart(marked, i, "Linear Regression", {}, fraction=fraction) for i in range(4)]
        assert train == pytest.approx([w[0]["r2"] for w in wanted], abs=1e-9)
        assert test == pytest.approx([w[1]["r2"] for w in wanted], abs=1e-9)


def test_absolute_penalty_meets_its_conditions(marked):
    sums = FoldSums(marked.withColumn("segment", F.lit(0)), "y", ["x1", "x2"])
    part, medians = sums.training(0)
    weights = sums.fit((part, medians), "Lasso Regression", {"alpha": 2.0}).weights
    # at the optimum the mean of error x standardized feature equals the penalty, with the sign of the slope turned
    rows = [r for r in marked.where("fold <> 0").select("x1", "x2", "y").collect()]
    x1 = [r["x1"] for r in rows]
    mean = sum(x1) / len(x1)
    sd = (sum((v - mean) ** 2 for v in x1) / len(x1)) ** 0.5
    whole = sum(r["y"] for r in marked.collect()) / 240
    error = [weights[0] + weights[1] * (r["x1"] - sums.shift[0]) + (weights[2] * (r["x2"] - sums.shift[1]) if r["x2"] is not None else weights[3]) - (r["y"] - whole) for r in rows]
    assert sum(e * (v - mean) / sd for e, v in zip(error, x1)) / len(rows) == pytest.approx(-2.0 if weights[1] > 0 else 2.0, abs=1e-6)


def test_tuning_reads_the_table_as_often_for_any_grid(marked):
    few = fold_scores(marked, "y", FEATURES, 4, "Ridge Regression", [{"alpha": a} for a in (0.1, 1.0)], "standard", "rmse")
    many = fold_scores(marked, "y", FEATURES, 4, "Ridge Regression", [{"alpha": a / 10} for a in range(1, 11)], "standard", "rmse")
    assert few == [many[0], many[9]]
    _, best = workflow.tune(marked.drop("fold"), "y", FEATURES, ["id"], "regression", "Elastic Net", metric="rmse")
    assert best == {"alpha": 0.01, "l1_ratio": 0.8}
