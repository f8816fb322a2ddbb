"""Derived columns: powers, interactions, group figures, rolling, lag, cyclic, text."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tablecraft.functions.columns import col, columns_of, require
from tablecraft.functions.ordering import ROWS_PER_BUCKET, over_sorted
from tablecraft.functions.quantiles import grouped_quantiles
from tablecraft.session import looked_up

# Periods by words in the column name, tried in this order.
PERIODS = ((("hour",), 24), (("day", "week"), 7), (("month",), 12), (("day",), 31))
GROUP_FUNCTIONS = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "sum": F.sum, "count": F.count}
ROLLING = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def polynomial(df: DataFrame, column: str, degree: int = 2) -> DataFrame:
    require(df, column)
    return df.withColumns({f"{column}^{i}": F.pow(col(column).cast("double"), F.lit(float(i))) for i in range(2, degree + 1)})


def interaction(df: DataFrame, column1: str, column2: str, operation: str = "multiply") -> DataFrame:
    require(df, column1, column2)
    a, b = col(column1), col(column2)
    made = {
        "multiply": ("x", a * b), "divide": ("div", F.try_divide(a.cast("double"), b.cast("double"))),
        "add": ("plus", a + b), "subtract": ("minus", a - b),
    }
    if operation not in made:
        raise ValueError(f"unknown operation {operation!r}")
    word, value = made[operation]
    return df.withColumn(f"{column1}_{word}_{column2}", value)


def group_figures(
    df: DataFrame, group_col: str, agg_col: str, functions: Sequence[str] = ("mean", "median", "min", "max", "std"),
) -> DataFrame:
    """One row per present group with ``<v>_<f>_by_<g>``; rows are combined before the shuffle."""
    require(df, group_col, agg_col)
    unknown = [f for f in functions if f not in GROUP_FUNCTIONS and f != "median"]
    if unknown:
        raise ValueError(f"unknown functions {unknown}")
    present = df.where(col(group_col).isNotNull())

    def named(f: str) -> str:
        return f"{agg_col}_{f}_by_{group_col}"

    plain = [GROUP_FUNCTIONS[f](col(agg_col)).alias(named(f)) for f in functions if f != "median"]
    figures = present.groupBy(col(group_col)).agg(*plain) if plain else None
    if "median" in functions:
        medians = grouped_quantiles(present, [group_col], agg_col, {named("median"): 0.5})
        figures = medians if figures is None else figures.join(medians, group_col)
    return figures.select(col(group_col), *[col(named(f)) for f in functions])


def group_tables(df: DataFrame, group_col: str, agg_col: str, **how) -> dict[str, DataFrame]:
    """What a fitted recipe keeps of :func:`group_features`."""
    return {f"groups:{group_col}:{agg_col}": group_figures(df, group_col, agg_col, **how)}


def group_features(
    df: DataFrame, group_col: str, agg_col: str, functions: Sequence[str] = ("mean", "median", "min", "max", "std"),
    tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """``<v>_<f>_by_<g>`` on every row; NULL where the group is missing, or not in the fitted ``tables``.

    Figures of few groups go to every task, so that no task reads all rows of a large group; those of many are
    joined by a shuffle, in which adaptive execution splits large groups.
    """
    require(df, group_col, agg_col)
    made = tables or group_tables(df, group_col, agg_col, functions=functions)
    figures = made[f"groups:{group_col}:{agg_col}"]
    new = [c for c in figures.columns if c != group_col]
    return looked_up(df, figures, group_col).select(*[col(c) for c in df.columns], *[col(c) for c in new])


def rolling(
    df: DataFrame, date_col: str, value_col: str, key: Sequence[str], windows: Sequence[int] = (3, 7, 30),
    functions: Sequence[str] = ("mean", "std"), partition_by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``<v>_rolling_<w>_<f>`` over the last ``w`` rows in date order; NULL unless all are present."""
    require(df, date_col, value_col, *key, *partition_by)
    unknown = [f for f in functions if f not in ROLLING]
    if unknown:
        raise ValueError(f"unknown functions {unknown}")

    def build(window):
        out = []
        for w in windows:
            frame = window.rowsBetween(-(w - 1), 0)
            full = F.count(col(value_col)).over(frame) == w
            out += [F.when(full, ROLLING[f](col(value_col)).over(frame)).alias(f"{value_col}_rolling_{w}_{f}") for f in functions]
        return out

    return over_sorted(df, [date_col, *key], build, max(windows) - 1, partition_by, rows_per_bucket)


def lags(
    df: DataFrame, date_col: str, value_col: str, key: Sequence[str], lags: Sequence[int] = (1, 7, 30),
    partition_by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """``<v>_lag_<k>``: the value ``k`` rows earlier in date order."""
    require(df, date_col, value_col, *key, *partition_by)

    def build(window):
        return [F.lag(col(value_col), k).over(window).alias(f"{value_col}_lag_{k}") for k in lags]

    return over_sorted(df, [date_col, *key], build, max(lags), partition_by, rows_per_bucket)


def cyclic(df: DataFrame, column: str, max_value: float | None = None) -> DataFrame:
    """``_sin`` and ``_cos``; the period follows from the name unless given."""
    require(df, column)
    if max_value is None:
        max_value = next((p for words, p in PERIODS if all(w in column.lower() for w in words)), None)
        if max_value is None:
            raise ValueError(f"give max_value for column {column}")
    angle = F.lit(2 * math.pi) * col(column) / F.lit(float(max_value))
    return df.withColumns({f"{column}_sin": F.sin(angle), f"{column}_cos": F.cos(angle)})


def text_features(df: DataFrame, column: str) -> DataFrame:
    """``_length``, ``_word_count`` and ``_capital_ratio``; missing text stays missing."""
    require(df, column)
    x = col(column)
    capitals = F.length(F.regexp_replace(x, r"[^\p{Lu}]", ""))
    return df.withColumns({
        f"{column}_length": F.length(x),
        f"{column}_word_count": F.regexp_count(x, F.lit(r"\S+")),
        f"{column}_capital_ratio": F.when(x.isNotNull(), F.coalesce(F.try_divide(capitals.cast("double"), F.length(x)), F.lit(0.0))),
    })


def text_columns(df: DataFrame, longer_than: float = 10) -> DataFrame:
    """Text columns with their mean length, longer ones only."""
    from tablecraft.functions.stats import to_long

    names = columns_of(df, "text")
    wide = df.agg(*[F.avg(F.length(col(c))).alias(f"a{i}") for i, c in enumerate(names)])
    return to_long(wide, [{"column": F.lit(c), "mean_length": F.col(f"a{i}")} for i, c in enumerate(names)]).where(
        F.col("mean_length") > longer_than)


