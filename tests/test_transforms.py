import math

import pytest
from pyspark.sql import functions as F

from tablecraft.operators import encode, features, impute, numeric, quality, rows, series, temporal


def values(df, name):
    return [r[0] for r in df.select(f"`{name}`").collect()]


def test_polynomial_and_interaction(spark):
    df = spark.createDataFrame([(2.0, 4.0, 0.0), (3.0, 5.0, 2.0)], "x double, b double, z double")
    out = features.polynomial(df, "x", 3)
    assert values(out, "x^2") == [4, 9] and values(out, "x^3") == [8, 27]
    assert values(features.interaction(df, "x", "b"), "x_x_b") == [8, 15]
    assert values(features.interaction(df, "b", "z", "divide"), "b_div_z") == [None, 2.5]
    with pytest.raises(ValueError):
        features.interaction(df, "x", "b", "power")


def test_bins(spark):
    df = spark.range(20).select(F.col("id").cast("double").alias("x"))
    for method in ("equal_width", "equal_frequency"):
        assert sorted(set(values(numeric.binning(df, "x", 4, method), "x_binned"))) == [1, 2, 3, 4]
    labelled = numeric.binning(df, "x", 2, labels=["low", "high"])
    assert values(labelled, "x_binned") == ["low"] * 10 + ["high"] * 10
    constant = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    assert values(numeric.binning(constant, "x", 3), "x_binned")[2] is None


def test_group_features_with_missing_group(spark):
    df = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("b", 30.0), (None, 5.0)], "g string, v double")
    out = {(r["g"], r["v"]): r["v_mean_by_g"] for r in features.group_features(df, "g", "v", ["mean", "median"]).collect()}
    assert out == {("a", 10.0): 15.0, ("a", 20.0): 15.0, ("b", 30.0): 30.0, (None, 5.0): None}


def test_encodings(spark):
    df = spark.createDataFrame([(1, "s"), (2, "m"), (3, "l"), (4, "s"), (5, None)], "id int, c string")
    codes = {r["id"]: r["c_encoded"] for r in encode.label_encode(df, "c").collect()}
    assert codes == {1: 2, 2: 1, 3: 0, 4: 2, 5: None}
    hot = encode.one_hot(df, "c")
    assert hot.columns == ["id", "c_l", "c_m", "c_s"]
    assert tuple(hot.where("id = 5").head()) == (5, False, False, False)
    assert values(encode.merge_categories(df, "c", ["s", "m"], "sm"), "c_merged") == ["sm", "sm", "l", "sm", None]
    with pytest.raises(ValueError):
        encode.one_hot(df, "c", cap=2)


def test_fills(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "a"), (None, "b"), (8.0, None)], "x double, c string")
    assert values(impute.fill_missing(df, "x", strategy="mean"), "x")[2] == 4.0
    assert values(impute.fill_missing(df, "x", strategy="median"), "x")[2] == 3.0
    assert values(impute.fill_missing(df, "x", 99), "x")[2] == 99
    assert values(impute.fill_missing(df, "c", strategy="most_frequent"), "c")[3] == "a"
    empty = spark.createDataFrame([(None, None)], "x double, c string")
    assert values(impute.fill_missing(empty, "x", strategy="mode"), "x") == [0]
    assert values(impute.fill_missing(empty, "c", strategy="mode"), "c") == ["Unknown"]
    assert values(impute.fill_missing(empty, "x", strategy="mean"), "x") == [None]
    with pytest.raises(ValueError):
        impute.fill_missing(df, "c", strategy="mean")


def test_log_keeps_missing_and_stays_finite(spark):
    df = spark.createDataFrame([(0.0,), (-5.0,), (10.0,), (None,)], "x double")
    out = values(numeric.log_transform(df, "x"), "x_log")
    assert out[3] is None and all(math.isfinite(v) for v in out[:3])
    assert numeric.log_offset(df, "x") == 6


def test_scaling_of_constant_column_adds_nothing(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert numeric.normalize(df, "x").columns == ["x"] and numeric.standardize(df, "x").columns == ["x"]


def test_outliers(spark):
    df = spark.createDataFrame([(float(i),) for i in (*range(1, 10), 1000)] + [(None,)], "x double")
    assert values(quality.outlier_report(df, ["x"]), "outliers_count") == [1]
    assert numeric.handle_outliers(df, "x", 0, 100, "remove").count() == 9
    assert values(numeric.handle_outliers(df, "x", 0.0, 100.0, "cap"), "x_capped")[-2:] == [100.0, None]


def test_cyclic_and_text(spark):
    df = spark.createDataFrame([(6, "Ab c"), (12, ""), (18, None)], "hour int, t string")
    assert values(features.cyclic(df, "hour"), "hour_sin") == pytest.approx([1, 0, -1], abs=1e-12)
    with pytest.raises(ValueError):
        features.cyclic(df.withColumnRenamed("hour", "h"), "h")
    out = features.text_features(df, "t")
    assert values(out, "t_length") == [4, 0, None] and values(out, "t_word_count") == [2, 0, None]
    assert values(out, "t_capital_ratio") == [0.25, 0.0, None]


def test_date_parts_of_text(spark):
    df = spark.createDataFrame([("2024-03-04 12:00:00",), ("nonsense",)], "d string")
    row = temporal.date_parts(df, "d").collect()
    assert tuple(row[0])[1:] == (2024, 3, 4, 0, 1) and tuple(row[1])[1:] == (None,) * 5
    assert values(temporal.days_since(df, "d", "2024-03-04"), "d_days_since") == [0.5, None]


def test_resample_keeps_empty_periods(spark):
    df = spark.createDataFrame([("2024-01-03", 1.0), ("2024-03-05", 2.0)], "d string, v double")
    total = [tuple(map(str, r)) for r in series.resample(df, "d", "v", "month", "sum").orderBy("period").collect()]
    assert total == [("2024-01-31", "1.0"), ("2024-02-29", "0.0"), ("2024-03-31", "2.0")]
    assert values(series.resample(df, "d", "v", "month", "mean").orderBy("period"), "value") == [1.0, None, 2.0]


def test_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, c string")
    assert rows.drop_rows_by_key(df, "id", [1]).count() == 2
    assert rows.filter_range(df, "id", 2, 2).count() == 3 and rows.filter_range(df, "id", 1, 2).count() == 2
    assert rows.filter_values(df, "id", ["3"]).count() == 1
    with pytest.raises(ValueError):
        rows.complete_cases(df.where("c is null"), ["c"], True)
    with pytest.raises(ValueError):
        rows.choose_columns(df, ["zzz"])


def test_figures_and_codes_of_few_keys_shuffle_no_rows(spark):
    df = spark.range(500).selectExpr("id", "IF(id % 10 = 0, NULL, IF(id % 10 < 8, 'a', 'b')) AS g", "CAST(id AS DOUBLE) AS x")
    for out, name in ((encode.label_encode(df, "g"), "g_encoded"), (features.group_features(df, "g", "x", ["max"]), "x_max_by_g")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        want = {None: None, "a": 0 if name == "g_encoded" else 497.0, "b": 1 if name == "g_encoded" else 499.0}
        assert out.count() == 500 and all(r[name] == want[r["g"]] for r in out.collect())
