import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecraft.learn import metrics, models, neighbours, prepare, select, split, workflow
from tablecraft.learn.prepare import TabularPrep
from tablecraft.plans.recipe import Recipe


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(1)
    rows = []
    for i in range(200):
        age = rng.randint(20, 70)
        rows.append((i, age, None if i % 9 == 0 else age * 100.0 + rng.random() * 500, rng.choice("abc") if i % 11 else None, int(age + rng.random() * 10 > 45)))
    return spark.createDataFrame(rows, "id int, age int, income double, city string, label_01 int")


@pytest.fixture(scope="module")
def plane(spark):
    rng = random.Random(2)
    rows = [(i, (a := rng.gauss(0, 1)), (b := rng.gauss(0, 1)), 3 * a - 2 * b + rng.gauss(0, 0.1)) for i in range(150)]
    return spark.createDataFrame(rows, "id int, x1 double, x2 double, y double")


@pytest.mark.parametrize("name", list(models.CLASSIFIERS))
def test_classifiers(people, name):
    train, test = split.train_test(people, "label_01", ["id"])
    settings = {"n_estimators": 5} if "Forest" in name else {"max_iter": 5} if name == "Gradient Boosting" else None
    trained = workflow.train(train, "label_01", ["age", "income", "city"], "classification", name, settings)
    row = workflow.evaluate(trained, test).head()
    assert row["accuracy"] > 0.7
    predicted = trained.predict(test.drop("label_01"))
    assert predicted.count() == test.count() and {r["prediction"] for r in predicted.collect()} <= {"0", "1"}


@pytest.mark.parametrize("name", list(models.REGRESSORS))
def test_regressors(plane, name):
    train, test = split.train_test(plane, "y", ["id"], task="regression")
    settings = {"Lasso Regression": {"alpha": 0.1}, "Elastic Net": {"alpha": 0.1}, "Random Forest Regressor": {"n_estimators": 10}}.get(name)
    trained = workflow.train(train, "y", ["x1", "x2"], "regression", name, settings)
    assert workflow.evaluate(trained, test).head()["r2"] > 0.6


def test_unknown_names_are_refused(people):
    with pytest.raises(ValueError):
        workflow.train(people, "label_01", ["age"], "classification", "Oracle")
    with pytest.raises(ValueError):
        workflow.train(people, "label_01", ["age"], "classification", "Naive Bayes", {"depth": 3})


def test_neighbours_by_brute_force(spark):
    rng = np.random.default_rng(5)
    points = np.vstack([rng.normal(size=(300, 3)), np.repeat(rng.normal(size=(1, 3)), 150, axis=0)])
    labels = rng.integers(0, 4, len(points)).astype(float)
    df = spark.createDataFrame([(p.tolist(), float(y)) for p, y in zip(points, labels)], "v array<double>, label double")
    train = df.groupBy("v", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("v", "label"))
    queries = rng.normal(size=(40, 3))
    q = spark.createDataFrame([(p.tolist(),) for p in queries], "q array<double>")
    got = neighbours.nearest(train, q, 7, block_rows=30, query_chunk=5).collect()
    for p in queries:
        want = sorted(np.round(np.sqrt(((points - p) ** 2).sum(1)), 8))[:7]
        mine = sorted(d for r in got if np.allclose(r["q"], p) for d in [round(r["distance"], 8)] * r["n"])
        assert mine == pytest.approx(want, abs=1e-6)


def test_preprocessing_is_fitted_on_training_rows_only(people):
    train, test = split.train_test(people, "label_01", ["id"])
    kept = TabularPrep(numericCols=["age"]).fit(train).fitted["numeric"][0]["center"]
    assert kept == pytest.approx(train.agg(F.avg("age")).head()[0])
    assert kept != pytest.approx(people.agg(F.avg("age")).head()[0], abs=1e-9)


def test_constant_dropped_unseen_zero_rare_grouped(spark):
    df = spark.range(120).select(F.lit(1.0).alias("same"), F.col("id").cast("double").alias("n"), F.concat(F.lit("k"), "id").alias("c"))
    model = TabularPrep(numericCols=["same", "n"], categoricalCols=["c"]).fit(df)
    assert "same" not in model.feature_names and len(model.feature_names) == 51
    vector = model.transform(spark.createDataFrame([(1.0, 3.0, "never seen")], "same double, n double, c string")).head()["features"]
    assert sum(vector.toArray()[1:]) == 0
    rare = [n for n in (f"k{i}" for i in range(120)) if f"c_{n}" not in model.feature_names][0]
    assert model.transform(spark.createDataFrame([(1.0, 3.0, rare)], "same double, n double, c string")).head()["features"].toArray()[-1] == 1


def test_power_transform_makes_a_skewed_column_normal(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(rng.lognormvariate(0, 1),) for _ in range(500)], "x double")
    out = TabularPrep(numericCols=["x"], scaler="power").fit(df).transform(df).toPandas()["features"].map(lambda v: v[0])
    assert abs(out.skew()) < 0.3 and abs(out.mean()) < 1e-9 and out.std(ddof=0) == pytest.approx(1)


def test_folds_clamp(spark):
    df = spark.createDataFrame([(c,) for c in (0, 0, 0, 1, 1)], "y int")
    assert split.safe_folds(df, "y", 5) == 2
    assert split.safe_folds(df.where("y = 0").union(df.where("y = 1").limit(1)), "y", 5) is None


def test_cross_validation_and_tuning(plane, people):
    scores = workflow.cross_validate(plane, "y", ["x1", "x2"], ["id"], "regression", "Linear Regression", folds=3)
    assert len(scores) == 3 and min(scores) > 0.9
    trained, best = workflow.tune(plane, "y", ["x1", "x2"], ["id"], "regression", "Ridge Regression", folds=2)
    assert best["alpha"] == 0.1 and trained.settings == best
    assert workflow.tune(people, "label_01", ["age"], ["id"], "classification", "Naive Bayes")[1] == {}
    assert len(models.random_settings("regression", "Elastic Net", 4)) == 4


def test_average_precision_and_curves(spark):
    rows = [(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)]
    df = spark.createDataFrame(rows, "y int, s double")
    assert metrics.average_precision(df, "y", "s").head()[0] == pytest.approx(0.8333333333333333, abs=1e-9)
    assert metrics.roc_auc(df, "y", "s").head()[0] == pytest.approx(0.75)
    curve = metrics.roc_curve(df, "y", "s").orderBy(F.desc("threshold")).collect()
    assert (curve[0]["fpr"], curve[0]["tpr"]) == (0, 0) and (curve[-1]["fpr"], curve[-1]["tpr"]) == (1, 1)


def test_selection(plane, people):
    df = plane.withColumn("noise", F.rand(3))
    assert {r["feature"] for r in select.k_best(df, ["x1", "x2", "noise"], "y", 2, "regression").collect()} == {"x1", "x2"}
    assert {r["feature"] for r in select.best_by_information(df, ["x1", "x2", "noise"], "y", 2, "regression").collect()} == {"x1", "x2"}
    assert set(select.recursive_elimination(df, ["x1", "x2", "noise"], "y", 2, "regression", trees=10)) == {"x1", "x2"}
    assert select.choose_features(people.drop("age", "income", "id"), "label_01", "automatic", k=1) == ["city"]


def test_bundle(people, tmp_path):
    recipe = Recipe("r").record("fill_missing", "income", strategy="median").record("normalize", "income").fit(people)
    ready, _ = recipe.apply(people)
    trained = workflow.train(ready, "label_01", ["age", "income_normalized", "city"], "classification", "Logistic Regression")
    workflow.save_bundle(trained, str(tmp_path / "b"), recipe, {"accuracy": 0.9})
    again, kept, scores = workflow.load_bundle(str(tmp_path / "b"))
    fresh = people.drop("label_01")
    a = workflow.score_batch(trained, fresh, recipe, "fitted").select("id", "prediction")
    b = workflow.score_batch(again, fresh, kept, "fitted").select("id", "prediction")
    assert a.exceptAll(b).isEmpty() and a.count() == 200 and scores == {"accuracy": 0.9}
    with pytest.raises(ValueError):
        workflow.score_batch(again, fresh.drop("age"), kept, "fitted")


def test_power_beyond_the_first_grid(spark):
    rng = np.random.default_rng(6)
    up, steep, plain = (1 - 11 * rng.uniform(0.02, 0.09, 400)) ** (-1 / 11) - 1, 10 - rng.exponential(size=400).clip(max=4), rng.exponential(size=400)

    def likelihood(x, lam):
        return -len(x) / 2 * np.log(np.var(((x + 1) ** lam - 1) / lam)) + (lam - 1) * np.log1p(x).sum()

    want = {c: max(np.arange(-12.005, 12, 0.01), key=lambda lam: likelihood(x, lam)) for c, x in zip("abc", (up, steep, plain))}
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(up, steep, plain)], "a double, b double, c double")
    found = prepare._best_lambdas(df, {c: F.col(c) for c in "abc"})
    assert all(abs(found[c] - want[c]) < 0.03 for c in "abc"), (found, want)
    assert want["a"] < -4 and want["b"] > 6


def test_unseen_and_rare_differ_at_any_number_of_levels(spark, monkeypatch, tmp_path):
    """With the levels in a table beside the model the vectors are those of a model that lists them."""
    df = spark.range(300).select(F.when(F.col("id") % 2 == 0, "often").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("c"), F.col("id").cast("double").alias("n"))
    asked = spark.createDataFrame([("often", 1.0), ("never seen", 2.0), ("k1", 3.0), ("k299", 4.0), (None, 5.0)], "c string, n double")
    wanted = {r.n: r.features for r in TabularPrep(numericCols=["n"], categoricalCols=["c"]).fit(df).transform(asked).collect()}
    monkeypatch.setattr("tablecraft.learn.prepare.KNOWN_VALUES", 60)
    model = TabularPrep(numericCols=["n"], categoricalCols=["c"]).fit(df)
    assert model.fitted["categorical"][0]["rare"] == [] and model.fitted["categorical"][0]["levels"]
    model.write().save(str(tmp_path / "prep"))
    for one in (model, type(model).load(str(tmp_path / "prep"))):
        out = one.transform(asked)
        assert out.columns == ["c", "n", "features"] and {r.n: r.features for r in out.collect()} == wanted
    assert wanted[2.0].toArray()[1:].sum() == 0 and wanted[4.0].toArray()[-1] == 1


def test_power_lambdas_from_bins_equal_those_of_rows(spark):
    from tablecraft.learn import prepare

    df = spark.range(6000).selectExpr("CAST(id % 50 AS DOUBLE) AS a", "EXP(PMOD(xxhash64(id), 9973) / 1000) AS b", "PMOD(xxhash64(id, 7), 997) / 100 - 3 AS c",
                                      "POW(1 + PMOD(xxhash64(id), 997) / 997, 60) AS d")
    names = ["a", "b", "c", "d"]
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("idx"), F.col(n).alias("x")) for i, n in enumerate(names)])))
    table = F.array(*[F.array(*[F.lit(v) for v in (-1.7, -0.3, 0.0, 0.45, 1.0, 2.0, 3.1)]) for _ in names])
    tops = df.agg(*[F.max(F.log1p(F.abs(n))) for n in names]).head()
    made = prepare._binned_moments(prepare._log_bins(long, [t / prepare.LAMBDA_BINS for t in tops]), table)
    got, want = ({(r["idx"], r["j"]): r["v"] for r in m.collect()} for m in (made, prepare._row_moments(long, table)))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, rel=1e-9) for k, v in want.items())


def test_power_fit_reads_the_rows_once_for_all_lambdas(spark, monkeypatch):
    from tablecraft.learn import prepare

    def no_rows(*_):
        return spark.range(0).selectExpr("0 AS idx", "0 AS j", "0D AS v").where("1 / 0 > 0")

    df = spark.range(3000).selectExpr("EXP(PMOD(xxhash64(id), 997) / 300) AS x")
    monkeypatch.setattr(prepare, "_row_moments", no_rows)
    assert prepare._best_lambdas(df, {"x": F.col("x")})["x"] < 0.5


def test_training_rows_are_kept_while_stages_read_them(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 9), float(i % 4), "ab"[i % 2]) for i in range(60)], "id int, x double, label double, kind string")
    plans, fit = [], models.TabularModel._fit
    monkeypatch.setattr(models.TabularModel, "_fit", lambda self, data: plans.append(data._jdf.queryExecution().optimizedPlan().toString()) or fit(self, data))
    left = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    made = workflow.train(df, "kind", ["x", "label"], "classification", "Decision Tree")
    assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == left
    held = df.select("kind", "x", "label").persist()
    again = workflow.train(held, "kind", ["x", "label"], "classification", "Decision Tree")
    held.unpersist()
    # of rows that the caller keeps, no second copy is made
    assert [p.count("InMemoryRelation") for p in plans] == [1, 1] and "[kind" in plans[1]
    assert made.predict(df).exceptAll(again.predict(df)).isEmpty()
