"""Categorical columns: counts, one-hot, label codes, merged categories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablecraft.functions.columns import col, literal, require
from tablecraft.functions.stats import Needs, gather
from tablecraft.session import looked_up

ONE_HOT_CAP = 1000


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Counts of the non-missing values, most frequent first."""
    require(df, column)
    return df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def levels_needs(df: DataFrame, column: str, cap: int = ONE_HOT_CAP, **_) -> Needs:
    require(df, column)
    return Needs(levels={column: cap})


def _dummies(df: DataFrame, column: str, levels: Sequence) -> list[Column]:
    dtype = df.schema[column].dataType
    return [F.coalesce(col(column) == literal(v, dtype), F.lit(False)).alias(f"{column}_{_text(v)}") for v in levels]


def _text(v) -> str:
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def one_hot(
    df: DataFrame, column: str, keep_original: bool = False, cap: int = ONE_HOT_CAP, stats: dict | None = None,
) -> DataFrame:
    """A boolean ``<c>_<value>`` per distinct value; a missing value is false everywhere."""
    stats = stats or gather(df, levels_needs(df, column, cap))
    kept = [col(c) for c in df.columns if keep_original or c != column]
    return df.select(*kept, *_dummies(df, column, stats[f"levels:{column}"]))


def label_mapping(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in order with codes 0..n-1; distributed, for any number of values."""
    from tablecraft.functions.ordering import running_sums

    distinct = df.where(col(column).isNotNull()).select(col(column).alias("value")).distinct().withColumn("one", F.lit(1))
    ranked = running_sums(distinct, "value", ["one"], at_most=df.count())
    return ranked.select("value", (F.col("upto_one") - 1).cast("bigint").alias("code"))


def label_encode(df: DataFrame, column: str, mapping: Mapping | DataFrame | None = None) -> DataFrame:
    """``<c>_encoded`` by sorted order or a given mapping; unseen and missing become NULL.

    A mapping of few values goes to every task, so that no task reads all rows of a frequent value.
    """
    require(df, column)
    if mapping is None:
        mapping = label_mapping(df, column)
    elif not isinstance(mapping, DataFrame):
        dtype = df.schema[column].dataType
        rule = F.lit(None).cast("bigint")
        for value, code in reversed(list(mapping.items())):
            rule = F.when(col(column) == literal(value, dtype), F.lit(code).cast("bigint")).otherwise(rule)
        return df.withColumn(f"{column}_encoded", rule)
    codes = mapping.select(F.col("value").alias(column), F.col("code").alias(f"{column}_encoded"))
    return looked_up(df, codes, column).select(*[col(c) for c in df.columns], col(f"{column}_encoded"))


def label_tables(df: DataFrame, column: str, mapping: Mapping | None = None) -> dict[str, DataFrame]:
    """What a fitted recipe keeps of :func:`label_encode_step`: a code for each of any number of values."""
    require(df, column)
    return {f"labels:{column}": label_mapping(df, column)} if mapping is None else {}


def label_encode_step(
    df: DataFrame, column: str, mapping: Mapping | None = None, tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Recipe form of :func:`label_encode`: codes can come from fitted tables."""
    return label_encode(df, column, mapping if mapping is not None else (tables or {}).get(f"labels:{column}"))


def merge_categories(df: DataFrame, column: str, categories: Sequence, new_category: str) -> DataFrame:
    require(df, column)
    merged = F.when(col(column).isin(list(categories)), F.lit(new_category)).otherwise(col(column))
    return df.withColumn(f"{column}_merged", merged)


def encode_many(
    df: DataFrame, columns: Sequence[str], method: str, keep_original: bool = False, stats: dict | None = None,
    tables: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """one_hot or label over several columns; the distinct values of one_hot come from one job."""
    if method not in ("one_hot", "label"):
        raise ValueError(f"unknown encoding {method!r}")
    usable = [c for c in columns if c in df.columns]
    stats = stats or gather(df, encode_many_needs(df, columns, method))
    out = df
    for c in usable:
        out = one_hot(out, c, keep_original, stats=stats) if method == "one_hot" else label_encode_step(out, c, None, tables)
    return out


def encode_many_needs(df: DataFrame, columns: Sequence[str], method: str, **_) -> Needs:
    return Needs(levels={c: ONE_HOT_CAP for c in columns if c in df.columns}) if method == "one_hot" else Needs()


def encode_many_tables(df: DataFrame, columns: Sequence[str], method: str, **_) -> dict[str, DataFrame]:
    return {k: v for c in columns if c in df.columns and method == "label" for k, v in label_tables(df, c).items()}
