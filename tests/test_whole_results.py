import random

from pyspark.sql import functions as F

from tablecraft.learn import workflow
from tablecraft.operators import distributions, quality, relations, summaries
from tablecraft.plans.dashboard import dashboard_frames
from tablecraft.plans.recipe import Recipe


def test_features_named_like_made_columns(spark):
    random.seed(1)
    rows = [(random.random(), random.random(), random.random(), random.random()) for _ in range(300)]
    df = spark.createDataFrame(rows, "label double, features double, q double, y double")
    trained = workflow.train(df, "y", ["label", "features", "q"], "regression", "Linear Regression")
    assert workflow.evaluate(trained, df).head()["r2"] < 0.3
    out = trained.predict(df)
    assert out.columns == ["label", "features", "q", "y", "prediction"]
    assert sorted(r["label"] for r in out.collect()) == sorted(r[0] for r in rows)


def test_one_failing_statistic_costs_only_its_own_step(spark):
    df = spark.createDataFrame([(float(i % 19 + 1), f"v{i}") for i in range(10_500)], "x double, code string")
    recipe = Recipe("r").record("fill_missing", "x", strategy="mean").record("label_encode", "code")
    fresh = spark.createDataFrame([(None, "v1"), (99.0, "v2")], "x double, code string")
    mean = df.agg(F.avg("x")).head()[0]
    try:
        recipe.fit(df)
        out, _ = recipe.apply(fresh, mode="fitted")
        assert abs(min(r["x"] for r in out.collect()) - mean) < 1e-9
    except ValueError as refused:
        assert "label_encode" in str(refused)


def test_fitted_mode_never_looks_at_the_new_batch(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    recipe = Recipe("r").record("group_features", "g", "v", ["mean"]).record("fill_missing", "v", strategy="mean")
    recipe.fitted = {}
    out, report = recipe.apply(df, mode="fitted")
    assert [r["status"] for r in report] == ["failed", "failed"] and out.columns == ["g", "v"]


def test_nothing_is_cut_unasked(spark):
    df = spark.createDataFrame([(f"g{i}", i % 7, float(i)) for i in range(60)], "g string, h int, v double")
    assert summaries.group_statistics(df, "g", ["v"]).count() == 60
    assert distributions.box(df, "v", ["g"]).count() == 60
    assert relations.grouped_counts(df, "g", "h").count() == 60
    wide = spark.createDataFrame([(1, 2, 3, 4, 5, 6, 7)], "k int, a int, b int, c int, d int, e int, f int")
    assert relations.pair_plot(wide, list("abcdef"), ["k"]).count() == 30
    assert "Cartesian" not in distributions.box(df, "v")._jdf.queryExecution().toString()


def test_nan_is_missing_and_titles_may_repeat(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    assert quality.missing_report(df).head()["missing_count"] == 1
    assert quality.numeric_profile(df).head()["mean"] == 2.0
    spec = {"components": [{"title": "t", "chart_type": "histogram", "config": {"x": "x"}}] * 2}
    frames, errors = dashboard_frames(df, spec)
    assert len(frames) + len(errors) == 2


def test_resampling_reads_all_events(spark, folder):
    from tablecraft import catalog

    events, run = spark.read.parquet(f"{folder}/events.parquet"), catalog.queries()
    total = events.selectExpr("sum(value)").head()[0]
    assert abs(run["j23_resample_whole_day"](spark, folder).selectExpr("sum(value)").head()[0] - total) < 1e-3
    days = {r.period: r.value for r in run["j23_resample_day_hole"](spark, folder).collect()}
    inside = [v for d, v in days.items() if 10 <= d.day <= 12]
    assert inside and not any(inside) and any(days.values())
    weeks = events.selectExpr("count(distinct date_trunc('week', ts))").head()[0]
    assert run["j23_resample_whole_week"](spark, folder).where("value IS NOT NULL").count() == weeks
