"""Summary tables of columns and groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tablecraft.functions.columns import as_double, col, columns_of, kind, percent, require
from tablecraft.functions.quantiles import exact_quantiles, grouped_quantiles
from tablecraft.functions.stats import missing, sample_kurtosis, sample_skewness, to_long, value_counts
from tablecraft.operators.quality import categorical_profile, distinct_report, iqr_fences, missing_report
from tablecraft.operators.rows import keep_tops

GROUP_FIGURES = ("mean", "median", "min", "max", "count", "sum", "std")


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """describe plus skewness, kurtosis and missing share per column, rounded to 2 decimals."""
    columns = list(columns or columns_of(df, "numeric"))
    quartiles = exact_quantiles(df, {c: (col(c), [0.25, 0.5, 0.75]) for c in columns})
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        x = col(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"), F.min(x).alias(f"min{i}"),
                 F.max(x).alias(f"max{i}"), sample_skewness(x).alias(f"skew{i}"), sample_kurtosis(x).alias(f"kurt{i}"), missing(x).alias(f"miss{i}")]
    records = []
    for i, c in enumerate(columns):
        figures = {
            "mean": F.col(f"mean{i}"), "std": F.col(f"std{i}"), "min": F.col(f"min{i}"),
            **{n: F.lit(q).cast("double") for n, q in zip(("q25", "median", "q75"), quartiles[c])},
            "max": F.col(f"max{i}"), "skewness": F.col(f"skew{i}"), "kurtosis": F.col(f"kurt{i}"),
            "missing_percentage": percent(F.col(f"miss{i}"), F.col("rows")),
        }
        records.append({"column": F.lit(c), "count": F.col(f"n{i}"), "missing": F.col(f"miss{i}"),
                        **{n: F.round(e, 2) for n, e in figures.items()}})
    return to_long(df.agg(*aggs), records)


def categorical_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Distinct, missing and most common value per text column."""
    columns = list(columns or columns_of(df, "text"))
    lost = missing_report(df, columns)
    return lost.join(distinct_report(df, columns), "column").join(categorical_profile(df, columns), "column").drop("unique_percentage")


def category_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value counts with their share of all rows."""
    rows = df.count()
    return value_counts(df, columns).withColumn("percentage", F.round(percent(F.col("n"), F.lit(rows)), 2))


def group_statistics(df: DataFrame, group: str, columns: Sequence[str], top: int | None = None) -> DataFrame:
    """mean, median, min, max, count, sum, std per group and column; ``top`` cuts to the most frequent groups."""
    require(df, group, *columns)
    df = keep_tops(df, [(group, top)]).where(col(group).isNotNull())
    aggs = []
    for i, c in enumerate(columns):
        x = as_double(df, c)
        aggs += [F.avg(x).alias(f"mean{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"), F.count(x).alias(f"count{i}"),
                 F.sum(x).alias(f"sum{i}"), F.stddev_samp(x).alias(f"std{i}")]
    figures = df.groupBy(col(group)).agg(*aggs)
    for i, c in enumerate(columns):
        medians = grouped_quantiles(df.select(col(group), as_double(df, c).alias("__v")).where(F.col("__v").isNotNull()), [group], "__v", {f"median{i}": 0.5})
        figures = figures.join(medians, group, "left")  # a row per group on both sides
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{n}{i}").alias(n) for n in GROUP_FIGURES]) for i, c in enumerate(columns)
    ])
    return figures.select(col(group), F.inline(cells))


def column_outliers(df: DataFrame, column: str, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """First ``n`` rows outside the IQR fences, in the order given."""
    _, _, low, high = iqr_fences(df, [column])[column]
    if low is None:
        return df.limit(0)
    return df.where((col(column) < low) | (col(column) > high)).orderBy(*[col(c) for c in order_by]).limit(n)


def numbers_only(df: DataFrame, column: str) -> DataFrame:
    """The column as numbers, other texts missing; refused when nothing is left."""
    require(df, column)
    x = as_double(df, column)
    if kind(df.schema[column].dataType) == "text" and df.where(x.isNotNull()).isEmpty():
        raise ValueError(f"column {column} holds no numbers")
    return df.select(*[x.alias(c) if c == column else col(c) for c in df.columns])


def metric(df: DataFrame, column: str, calculation: str = "mean") -> DataFrame:
    """One figure: mean, sum, count, min or max."""
    f = {"mean": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}.get(calculation)
    if f is None:
        raise ValueError(f"unknown calculation {calculation!r}")
    require(df, column)
    return df.agg(f(col(column)).alias("value"))
