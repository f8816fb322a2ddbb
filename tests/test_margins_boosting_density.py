import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tablecraft.learn import boosting, margins, metrics, workflow
from tablecraft.operators import distributions


def ring(spark, n=600, classes=2, seed=3):
    """Classes are rings around each other, which no line can part."""
    rng = np.random.default_rng(seed)
    label = rng.integers(0, classes, n)
    angle, radius = rng.uniform(0, 2 * np.pi, n), 1.0 + 1.5 * label + rng.normal(0, 0.2, n)
    rows = [(i, float(r * np.cos(a)), float(r * np.sin(a)), f"ring{k}") for i, (a, r, k) in enumerate(zip(angle, radius, label))]
    return spark.createDataFrame(rows, "id bigint, x double, y double, kind string").coalesce(1)


def test_fourier_features_estimate_the_kernel(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").withColumn("features", array_to_vector("v"))
    errors = {}
    for count in (128, 2048):
        made = margins.FourierFeatures(gamma=0.15, count=count, seed=1).transform(df)
        z = np.array([r.z for r in made.select(vector_to_array("__kernel").alias("z")).orderBy("id").collect()])
        true = np.exp(-0.15 * ((x[:, None] - x[None]) ** 2).sum(-1))
        errors[count] = np.sqrt(((z @ z.T - true) ** 2).mean())
        assert errors[count] < np.sqrt(((1 - true**2) ** 2).mean() / count) * 1.3
    assert errors[2048] < errors[128] / 2


def test_kernel_machine_parts_rings_and_gives_probabilities(spark, tmp_path):
    for classes in (2, 3):
        train, test = ring(spark, classes=classes), ring(spark, classes=classes, seed=4)
        made = workflow.train(train, "kind", ["x", "y"], "classification", "SVM", {"max_iter": 25, "components": 128})
        row = workflow.evaluate(made, test).head()
        assert row["accuracy"] > 0.95 and row["roc_auc"] > 0.98
        sums = made.raw(test).select(F.aggregate("probability", F.lit(0.0), lambda t, p: t + p).alias("s"), F.get("probability", F.col("label").cast("int")).alias("own")).collect()
        assert all(abs(r.s - 1) < 1e-9 for r in sums) and np.mean([r.own for r in sums]) > 0.85
        path = str(tmp_path / f"machine{classes}")
        made.model.write().save(path)
        again = PipelineModel.load(path).transform(test)
        assert again.select("id", "prediction").exceptAll(made.model.transform(test).select("id", "prediction")).isEmpty()
        assert made.importance() is None
    linear = workflow.train(ring(spark), "kind", ["x", "y"], "classification", "SVM", {"kernel": "linear", "max_iter": 25})
    assert workflow.evaluate(linear, ring(spark, seed=4)).head()["accuracy"] < 0.8 and linear.importance().count() == 2
    with pytest.raises(ValueError):
        workflow.train(ring(spark), "kind", ["x", "y"], "classification", "SVM", {"kernel": "poly"})


def test_softmax_boosting_of_three_classes(spark, tmp_path):
    train, test = ring(spark, 400, 3), ring(spark, 400, 3, 4)
    data = train.select(array_to_vector(F.array("x", "y")).alias("features"), F.substring("kind", 5, 1).cast("double").alias("label"))
    losses = [boosting.log_loss(boosting.boosted_classes(data, 3, None, 0.3, rounds, {"maxDepth": 3, "seed": 1}).transform(data)) for rounds in (1, 3)]
    assert math.log(3) > losses[0] > losses[1]
    made = workflow.train(train, "kind", ["x", "y"], "classification", "Gradient Boosting", {"max_iter": 3, "learning_rate": 0.5, "max_depth": 4})
    row = workflow.evaluate(made, test).head()
    assert row["accuracy"] > 0.85 and row["roc_auc"] > 0.95 and made.importance().count() == 2
    path = str(tmp_path / "boosted")
    made.model.write().save(path)
    again = PipelineModel.load(path).transform(test).select("id", F.transform("probability", lambda p: F.round(p, 9)).alias("p"))
    assert again.exceptAll(made.model.transform(test).select("id", F.transform("probability", lambda p: F.round(p, 9)).alias("p"))).isEmpty()


def density_by_force(x, points):
    h = np.std(x, ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min(), x.max(), points)
    return np.exp(-0.5 * ((grid[:, None] - x[None]) / h) ** 2).sum(1) / (len(x) * h * math.sqrt(2 * math.pi)), h


def test_density_equals_the_direct_sum(spark):
    rng = np.random.default_rng(8)
    groups = {"smooth": rng.normal(3, 2, 4000), "heavy": rng.standard_cauchy(3000) * 1e4, "steps": rng.integers(0, 5, 2000).astype(float), "two": np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("one", 4.0), ("one", 4.0), ("none", None), (None, 1.0), (None, 2.5)]
    df = spark.createDataFrame(rows, "k string, v double")
    found = {}
    for r in distributions.density(df, "v", 60, "k").collect():
        found.setdefault(r.k, {})[r.point] = r.density
    assert set(found) <= {*groups, None} and set(groups) <= set(found)
    for k, x in groups.items():
        want, h = density_by_force(x, 60)
        got = np.array([found[k][i] for i in range(60)])
        assert np.abs(got - want).max() * h < 1e-12
        alone = distributions.density(df.where(F.col("k") == k), "v", 60).orderBy("point").collect()
        assert np.abs(np.array([r.density for r in alone]) - want).max() * h < 1e-12


def test_density_reads_each_row_once_into_few_cells(spark):
    df = spark.range(50_000).select((F.sin(F.col("id").cast("double")) * 100).alias("v"))
    plan = distributions.density(df, "v")._jdf.queryExecution().executedPlan().toString()
    assert "__cell" in plan and distributions.density(df, "v").count() == 200


def test_equal_rows_of_a_kernel_machine_are_mapped_once(spark, monkeypatch):
    data = ring(spark, 60).select(array_to_vector(F.array("x", "y")).alias("features"), (F.col("kind") == "ring1").cast("double").alias("label"))
    seen = []
    made = margins.FourierFeatures._transform

    def counted(self, dataset):
        seen.append(dataset.count())
        return made(self, dataset)

    monkeypatch.setattr(margins.FourierFeatures, "_transform", counted)
    fits = []
    for copies in (1, 20):
        rows = data.crossJoin(spark.range(copies)).drop("id")
        fits.append(margins.support_vectors(rows, 2, None, 1.0, 60, 30, "rbf", 0.5, 32, 1))
    assert seen == [60, 60]
    # copies weigh alike, so machine and margins stay what they were
    one, many = ([r.m for r in f.transform(data).select(F.col("rawPrediction")[1].alias("m")).collect()] for f in fits)
    assert np.mean(np.sign(one) == np.sign(many)) > 0.98


def test_equal_rows_of_a_boosted_class_are_one_row(spark, monkeypatch):
    data = ring(spark, 90, 3).select(array_to_vector(F.array("x", "y")).alias("features"), F.substring("kind", 5, 1).cast("double").alias("label"))
    sizes, freeze = [], boosting.freeze
    monkeypatch.setattr(boosting, "freeze", lambda df: sizes.append(freeze(df).count()) or freeze(df))
    one, many = (boosting.boosted_classes(data.crossJoin(spark.range(n)).drop("id"), 3, None, 0.3, 2, {"maxDepth": 3, "seed": 1}) for n in (1, 10))
    assert set(sizes) == {90}
    a, b = ([r.p for r in f.transform(data).select(F.col("probability")[0].alias("p")).collect()] for f in (one, many))
    assert a == pytest.approx(b, abs=1e-6)


def test_equal_held_out_rows_are_scored_once(spark, monkeypatch):
    made = workflow.train(ring(spark, 200), "kind", ["x", "y"], "classification", "SVM", {"max_iter": 10, "components": 32})
    test = ring(spark, 80, seed=4).drop("id")
    test = test.unionByName(spark.createDataFrame([(0.5, None, "ring0"), (None, None, "ring1"), (1.0, 1.0, None)], test.schema))
    many = test.crossJoin(spark.range(15)).drop("id")
    scored = made.raw(many.where("kind is not null"))
    wanted = metrics.classification_metrics(scored).head().asDict() | metrics.roc_auc(scored.select("label", F.col("probability")[1].alias("s")), "label", "s").head().asDict()
    seen, transform = [], margins.Margins._transform
    monkeypatch.setattr(margins.Margins, "_transform", lambda self, df: seen.append(df.count()) or transform(self, df))
    assert workflow.evaluate(made, many).head().asDict() == pytest.approx(wanted, abs=1e-12)
    assert seen == [82]


def test_a_kernel_machine_maps_rows_where_it_takes_margins(spark):
    data = ring(spark, 90).select("id", array_to_vector(F.array("x", "y")).alias("features"), (F.col("kind") == "ring1").cast("double").alias("label"))
    made = margins.support_vectors(data, 2, None, 1.0, 90, 10, "rbf", 0.5, 32, 1)
    assert len(made.stages) == 1
    apart = margins.Margins(machines=made.stages[0].getOrDefault("machines"), source="__kernel").transform(margins.FourierFeatures(gamma=0.5, count=32, seed=1).transform(data))
    one, two = ([r.m for r in f.select("id", F.col("rawPrediction")[1].alias("m")).orderBy("id").collect()] for f in (made.transform(data), apart))
    assert one == pytest.approx(two, abs=1e-9)


def test_gamma_of_counted_rows(spark):
    data = ring(spark, 50).select(array_to_vector(F.array("x", "y")).alias("features"), (F.col("id") % 7 + 1).alias("n"))
    copies = data.select("features", F.explode(F.sequence(F.lit(1), "n")))
    assert margins.scale_gamma(data, "n") == pytest.approx(margins.scale_gamma(copies), rel=1e-12)
    x = np.array([r.features.toArray() for r in copies.collect()])
    assert margins.scale_gamma(copies) == pytest.approx(1 / (2 * x.var()), rel=1e-9)
    assert margins.scale_gamma(data.limit(1), "n") > 0


def test_figures_of_counted_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), [p := float(rng.integers(0, 5) / 4), (1 - p) / 2, (1 - p) / 2], int(n)) for a, b, n in zip(rng.integers(0, 3, 60), rng.integers(0, 3, 60), rng.integers(1, 6, 60))]
    df = spark.createDataFrame(rows, "label double, prediction double, p array<double>, n bigint").withColumn("s", F.col("p")[0]).withColumn("hit", (F.col("label") == 1).cast("int"))
    copies = df.withColumn("i", F.explode(F.sequence(F.lit(1), "n")))
    for figures in (lambda t, **n: metrics.classification_metrics(t, **n), lambda t, **n: metrics.roc_auc(t, "hit", "s", **n), lambda t, **n: metrics.roc_auc_multiclass(t, "label", "p", range(3), **n)):
        assert figures(df, n="n").head().asDict() == pytest.approx(figures(copies).head().asDict(), abs=1e-12)
