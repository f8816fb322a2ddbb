import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tablecraft.learn import cells, select, workflow


@pytest.fixture()
def few_rows_are_many(monkeypatch):
    monkeypatch.setattr(cells, "MANY_ROWS", 1000)


def table(spark, n=4000, seed=5):
    """A column of few values, a continuous one, one that says nothing, and rows that are alike."""
    rng = np.random.default_rng(seed)
    few, wide, idle = rng.integers(0, 4, n), rng.normal(size=n), rng.integers(0, 3, n)
    y = few * 2.0 + np.where(wide > 0.3, 3.0, 0.0) + rng.normal(0, 0.3, n)
    rows = [(i, float(a), float(b), float(c), float(v), "high" if v > 5 else "low") for i, (a, b, c, v) in enumerate(zip(few, wide, idle, y))]
    return spark.createDataFrame(rows, "id bigint, few double, wide double, idle double, y double, kind string")


def test_limits_part_all_values_or_equal_shares():
    assert cells.limits_of(np.array([3.0, 1.0, 1.0, 7.0]), np.ones(4)) == [2.0, 5.0]
    assert cells.limits_of(np.array([2.0, 2.0]), np.ones(2)) == []
    limits = cells.limits_of(np.arange(3200.0), np.ones(3200))
    assert len(limits) == 31 and np.ptp(np.diff(limits)) <= 2
    assert cells.limits_of(np.arange(3200.0), np.where(np.arange(3200) < 1600, 3.0, 1.0))[15] < 1200


def test_bins_count_limits_below(spark):
    df = spark.createDataFrame([(0, [1.0, 9.0]), (1, [1.5, 9.0]), (2, [1.6, 9.0]), (3, [float("inf"), 9.0]), (4, [-1e300, 9.0])], "id int, v array<double>").withColumn("features", array_to_vector("v"))
    made = cells.Cells([[1.5, 3.0], []], "features")
    assert [r.cell for r in made.numbered(df, F.col("id")).orderBy("__c0").collect()] == [0, 0, 1, 2, 0]
    assert cells.Cells([[1.5, 3.0], [2.0]], "features").numbered(df).distinct().count() == 3


def test_every_row_is_drawn_for_itself(spark):
    """Sums over trees: a row counts once a tree on average, and labels come with their own rows."""
    values = spark.range(20_000, numPartitions=3).select((F.col("id") % 2).alias("cell"), F.col("id").cast("double").alias("label"))
    rows = {r.cell: r for r in cells._drawn_sums(values, 4, 30, 1).collect()}
    assert sorted(rows) == [0, 1]
    for r in rows.values():
        w, y = np.array([r[f"w{t}"] for t in range(30)]), np.array([r[f"y{t}"] for t in range(30)])
        assert abs(w.mean() - 10_000) < 6 * 100 / np.sqrt(30) and 40 < w.std() < 180 and abs((y / w).mean() - 10_000) < 200
    counts = spark.createDataFrame([(0, 0.0, 400, 2.0), (0, 1.0, 10_000, 0.5)], "cell bigint, label double, n bigint, w double")
    drawn = {r.label: np.array([r[f"w{t}"] for t in range(30)]) for r in cells._drawn_classes(counts, 30, 1).collect()}
    assert abs(drawn[0.0].mean() - 800) < 60 and abs(drawn[1.0].mean() - 5000) < 100 and set(drawn[0.0] % 2) == {0.0}


@pytest.mark.parametrize("target,task,model", [
    ("y", "regression", "Random Forest Regressor"), ("kind", "classification", "Random Forest"),
    ("y", "regression", "Gradient Boosting"), ("kind", "classification", "Gradient Boosting")])
def test_trees_of_cells_judge_like_trees_of_rows(spark, monkeypatch, tmp_path, target, task, model):
    train, test = table(spark).cache(), table(spark, 1500, 6)
    settings, metric = {"max_iter": 5} if "Boost" in model else {"n_estimators": 12}, "r2" if task == "regression" else "accuracy"
    plain = workflow.train(train, target, ["few", "wide", "idle"], task, model, settings)
    monkeypatch.setattr(cells, "MANY_ROWS", 1000)
    monkeypatch.setattr(cells, "ROWS_A_CELL", 4)
    made = workflow.train(train, target, ["few", "wide", "idle"], task, model, settings)
    assert isinstance(made.model.stages[-1], PipelineModel) and not isinstance(plain.model.stages[-1], PipelineModel)
    before, after = (workflow.evaluate(x, test).head()[metric] for x in (plain, made))
    assert before > 0.8 and abs(before - after) < (1e-9 if "Boost" in model else 0.03)
    assert [r.feature for r in made.importance().collect()][-1] == "idle"
    made.model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(test.withColumn("label", F.lit(0.0)) if task == "regression" else test)
    assert again.select("id", "prediction").exceptAll(made.raw(test).select("id", "prediction")).isEmpty()


def test_elimination_by_cells(spark, few_rows_are_many, monkeypatch):
    monkeypatch.setattr(cells, "ROWS_A_CELL", 4)
    used, grow = [], cells.forest_of_cells
    monkeypatch.setattr(cells, "forest_of_cells", lambda *a, **b: used.append(a) or grow(*a, **b))
    assert select.recursive_elimination(table(spark), ["idle", "wide", "few"], "y", 2, "regression", trees=8) == ["wide", "few"]
    assert select.recursive_elimination(table(spark), ["idle", "wide", "few"], "kind", 2, trees=8) == ["wide", "few"]
    assert len(used) == 2


def test_small_tables_and_many_cells_stay_with_rows(spark):
    data = table(spark).select(array_to_vector(F.array("few", "wide")).alias("features"), "y")
    assert cells.cells_of(data, 4000) is None
    assert cells.cells_of(data, 1_000_000).possible == 128 and cells.cells_of(data, 1_000_000, most=100) is None
