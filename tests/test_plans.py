import pytest

from tablecraft.plans.dashboard import dashboard_frames, export_dashboard, read_spec
from tablecraft.plans.recipe import STEPS, Recipe, Step, map_columns, register_step


@pytest.fixture()
def df(spark):
    return spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "a")], "x double, c string")


def values(df, name):
    return [r[0] for r in df.select(f"`{name}`").collect()]


def test_statistics_follow_the_data(spark, df):
    recipe = Recipe("mean").record("fill_missing", "x", strategy="mean")
    other = spark.createDataFrame([(10.0,), (30.0,), (None,)], "x double")
    assert values(recipe.apply(df)[0], "x")[2] == 2 and values(recipe.apply(other)[0], "x")[2] == 20
    recipe.fit(df)
    assert values(recipe.apply(other, mode="fitted")[0], "x")[2] == 2


def test_all_arguments_survive(df):
    recipe = Recipe.from_json(Recipe("p").record("polynomial", "x", 3).record("binning", "x", 2).to_json())
    out, report = recipe.apply(df)
    assert {"x^3", "x_binned"} <= set(out.columns) and all(r["status"] == "applied" for r in report)


def test_unknown_steps_are_refused(df):
    with pytest.raises(ValueError):
        Recipe("bad").record("drop_table", "x")
    crafted = Recipe("bad", [Step("__import__", {"name": "os"}), Step("polynomial", {"column": "x"})])
    out, report = crafted.apply(df)
    assert [r["status"] for r in report] == ["failed", "applied"] and "x^2" in out.columns


def test_circle_and_removal(df):
    recipe = Recipe("c", [Step("polynomial", {"column": "x"}, depends_on=[1]), Step("log_transform", {"column": "x"}, depends_on=[0])])
    with pytest.raises(ValueError):
        recipe.check()
    chain = Recipe("r").record("polynomial", "x").record("normalize", "x").record("log_transform", "x", depends_on=[1])
    chain.remove(0)
    assert chain.steps[1].depends_on == [0]


def test_step_on_made_column(df):
    recipe = Recipe("two").record("fill_missing", "x", strategy="mean").record("normalize", "x").record("standardize", "x_normalized")
    out, report = recipe.apply(df)
    assert "x_normalized_standardized" in out.columns, report


def test_column_mapping(df):
    assert map_columns(["unit_price", "qty"], ["unitprice", "region"]) == {"unit_price": "unitprice"}
    out, _ = Recipe("m").record("merge_categories", "category", ["a"], "z").apply(df.withColumnRenamed("c", "categorys"))
    assert values(out, "categorys_merged") == ["z", "b", "z"]


def test_register(df):
    register_step("double_it", lambda df, column: df.withColumn("twice", df[column] * 2))
    try:
        assert values(Recipe("d").record("double_it", "x").apply(df)[0], "twice") == [2, 6, None]
        with pytest.raises(ValueError):
            register_step("double_it", lambda df: df)
    finally:
        del STEPS["double_it"]


def test_dashboard(spark, df, tmp_path):
    spec, problems = read_spec('{"components": [{"title": "m", "chart_type": "metric", "config": {"column": "x", "calculation": "sum"}}, {"title": "t", "chart_type": "nope"}, 7], "filters": {"c": {"values": ["a"]}}}')
    assert len(problems) == 1
    frames, errors = dashboard_frames(df, spec)
    assert values(frames["m"], "value") == [1.0] and set(errors) == {"t"}
    assert set(export_dashboard(df, spec, str(tmp_path / "out"))) == {"t"}
    assert spark.read.parquet(str(tmp_path / "out" / "m")).count() == 1


def test_saved_component_specs(spark, folder):
    from tablecraft.operators.charts import CHARTS, NAMES, chart_data

    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    assert set(NAMES.values()) <= set(CHARTS)
    specs = [
        ("custom_radar", {"category": "l_returnflag", "variables": ["l_quantity", "l_tax"]}, 6),
        ("custom_time", {"date_column": "l_shipdate", "value_column": "l_tax", "group_column": "l_linestatus"}, df.count()),
        ("custom_3d", {"x": "l_tax", "y": "l_discount", "z": "l_quantity", "color": "l_returnflag"}, 1000),
        ("custom_sunburst", {"path": ["l_returnflag", "l_linestatus"], "values": "l_tax"}, 10),
        ("custom_parallel", {"dimensions": ["l_tax", "l_discount", "l_quantity"]}, 1000),
        ("custom_grid", {"variables": ["l_tax", "l_discount"]}, 2000),
        ("custom_summary", {"columns": ["l_tax"], "height": 300}, 1),
        ("scatter", {"x": "l_tax", "y": "l_discount", "title": "t"}, 5000),
        ("box", {"x": "l_returnflag", "y": "l_tax"}, 3), ("violin", {"y": "l_tax"}, 200), ("heatmap", {"x": "l_linestatus", "y": "l_returnflag", "values": "l_tax", "aggregation": "mean"}, 6),
        ("table", {"columns": ["l_tax"], "max_rows": 4}, 4), ("Missing Value Analysis", {}, 0),
    ]
    for name, config, rows in specs:
        assert chart_data(df, {"chart_type": name, "config": config}).count() == rows, name
    with pytest.raises(ValueError):
        chart_data(df, {"chart_type": "bar", "config": {"wrong": 1}})


def test_fitted_tables(spark, tmp_path):
    seen = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 9.0)], "g string, x double")
    new = spark.createDataFrame([("a", 0.0), ("c", 0.0), (None, 0.0)], "g string, x double")
    recipe = Recipe("t").record("group_features", "g", "x", ["mean"]).record("label_encode", "g").fit(seen, str(tmp_path / "kept"))
    again = Recipe.from_json(recipe.to_json())
    out, report = again.apply(new, mode="fitted")
    assert {(r["g"], r["x_mean_by_g"], r["g_encoded"]) for r in out.collect()} == {("a", 2.0, 0), ("c", None, None), (None, None, None)}, report
    del again.fitted["0"]
    assert [r["status"] for r in again.apply(new, mode="fitted")[1]] == ["failed", "applied"]


def test_best_pair_of_names_comes_first():
    assert map_columns(["unit_price", "unit_prices"], ["unit_pricess", "x"]) == {"unit_prices": "unit_pricess"}
