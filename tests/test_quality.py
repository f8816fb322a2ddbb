from pyspark.sql import functions as F

from tablecraft.operators import quality


def issues(df):
    return {(r["column"], r["issue"], r["severity"]) for r in quality.quality_findings(df).collect()}


def test_constant(spark):
    assert ("x", "constant", "high") in issues(spark.createDataFrame([(5,)] * 4, "x int"))


def test_outliers(spark):
    found = issues(spark.createDataFrame([(float(i),) for i in (*range(1, 10), 1000)], "x double"))
    assert ("x", "outliers", "low") in found and any(i[1] == "skewness" for i in found)


def test_high_cardinality_and_numeric_text(spark):
    df = spark.range(120).select(F.concat(F.lit("v"), "id").alias("c"), F.col("id").cast("string").alias("n"))
    found = issues(df)
    assert ("c", "high_cardinality", "medium") in found and ("n", "type_conversion", "medium") in found


def test_empty_and_all_missing(spark):
    assert issues(spark.createDataFrame([], "x int")) == {(None, "empty_dataset", "high")}
    found = issues(spark.createDataFrame([(None, None, 1), (None, None, 2)], "x double, c string, k int"))
    assert ("x", "missing_values", "high") in found and ("c", "missing_values", "high") in found


def test_duplicates_treat_missing_as_equal(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,)], "x int")
    assert quality.duplicate_rows(df).head()[0] == 2


def test_severity_order(spark):
    df = spark.createDataFrame([(5, "2024-01-01")] * 3, "x int, some_date string")
    ranks = [r["severity"] for r in quality.quality_findings(df).collect()]
    assert ranks == sorted(ranks, key=["high", "medium", "low"].index)


def test_approximate_distinct_keeps_the_rules(spark, folder):
    df = spark.read.parquet(f"{folder}/customer.parquet")
    exact, near = issues(df), {(r["column"], r["issue"], r["severity"]) for r in quality.quality_findings(df, True).collect()}
    assert exact == near
