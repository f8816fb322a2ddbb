"""Filters, projections and row or column removal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tablecraft.functions.columns import col, columns_of, require
from tablecraft.functions.frequent import most_frequent

LISTED_KEYS = 2000


def rows_missing(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df.where(col(column).isNull())


def drop_rows_missing(df: DataFrame, column: str) -> DataFrame:
    require(df, column)
    return df.where(col(column).isNotNull())


def drop_rows_by_key(df: DataFrame, key: str, keys: Sequence | DataFrame) -> DataFrame:
    """Remove the rows whose ``key`` is listed; a short list becomes a scan filter."""
    require(df, key)
    if not isinstance(keys, DataFrame):
        if len(keys) <= LISTED_KEYS:
            return df.where(~F.coalesce(col(key).isin(list(keys)), F.lit(False))) if keys else df
        keys = df.sparkSession.createDataFrame([(k,) for k in keys], [key])
    return df.join(keys.select(col(key)).distinct(), key, "left_anti")


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require(df, *columns)
    return df.select(*[col(c) for c in df.columns if c not in set(columns)])


def choose_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require(df, *columns)
    return df.select(*[col(c) for c in columns])


def filter_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Inclusive range; no filter where the bounds are equal."""
    require(df, column)
    return df if low == high else df.where(col(column).between(low, high))


def filter_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Keep rows whose value, compared as text, is listed."""
    require(df, column)
    return df.where(col(column).cast("string").isin([str(v) for v in values])) if values else df


def filter_options(df: DataFrame, column: str) -> DataFrame:
    """Choices for a filter: min and max of a number, else the sorted distinct texts."""
    require(df, column)
    if column in columns_of(df, "numeric"):
        return df.agg(F.min(col(column)).alias("low"), F.max(col(column)).alias("high"))
    return df.select(col(column).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct().orderBy("value")


def top_categories(df: DataFrame, column: str, n: int) -> list:
    """The ``n`` most frequent values; equal counts go by value."""
    return [value for value, _ in most_frequent(df, [column], n)[column]]


def keep_top(df: DataFrame, column: str, n: int) -> DataFrame:
    """Rows of the ``n`` most frequent values. The short list is pushed into the scan."""
    require(df, column)
    return df.where(col(column).isin(top_categories(df, column, n)))


def keep_tops(df: DataFrame, limits: Sequence[tuple[str, int | None]]) -> DataFrame:
    """Rows of the most frequent values of several columns, each list taken from the whole table; None cuts nothing."""
    lists = [(c, top_categories(df, c, n)) for c, n in limits if n is not None]
    for column, values in lists:
        df = df.where(col(column).isin(values))
    return df


def numeric_only(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    wanted = set(columns or df.columns)
    return df.select(*[col(c) for c in columns_of(df, "numeric") if c in wanted])


def complete_cases(df: DataFrame, columns: Sequence[str], must_have_rows: bool = False) -> DataFrame:
    require(df, *columns)
    kept = df.dropna(subset=list(columns))
    if must_have_rows and kept.isEmpty():
        raise ValueError("no rows are left after removing missing values")
    return kept


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    return df.orderBy(*[col(c) for c in order_by]).limit(n)


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells, columns per type and completeness in percent."""
    cells = F.lit(float(len(df.columns))) * F.col("row_count")
    total = F.lit(0)
    for c in df.columns:
        total = total + F.isnull(col(c)).cast("int")
    lost = F.coalesce(F.try_divide(F.col("missing_cells") * 100.0, cells), F.lit(0.0))
    return df.agg(
        F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(total), F.lit(0)).alias("missing_cells")
    ).select(
        "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"), "missing_cells",
        *[F.lit(len(columns_of(df, *k))).cast("bigint").alias(f"{n}_columns") for n, k in
          (("numeric", ("numeric",)), ("datetime", ("datetime",)), ("categorical", ("text", "boolean")))],
        (F.lit(100.0) - F.least(F.lit(100.0), lost)).alias("completeness"),
    )
