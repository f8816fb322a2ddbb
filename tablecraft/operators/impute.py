"""Replacing missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tablecraft.functions.columns import col, kind, literal, require
from tablecraft.functions.ordering import carry_fill
from tablecraft.functions.stats import Needs, gather, to_long, missing

NUMERIC = ("mean", "median", "mode", "zero", "custom")
TEXT = ("mode", "most_frequent", "custom")
DATES = ("min", "max", "median", "mode", "custom")


def _check(df: DataFrame, column: str, strategy: str | None, value) -> None:
    require(df, column)
    if strategy is None or strategy == "custom":
        if value is None:
            raise ValueError("a literal fill needs a value")
        return
    allowed = {"numeric": NUMERIC, "datetime": DATES}.get(kind(df.schema[column].dataType), TEXT)
    if strategy not in allowed:
        raise ValueError(f"strategy {strategy!r} does not fit column {column}; use one of {allowed}")


def fill_needs(df: DataFrame, column: str, value=None, strategy: str | None = None, inplace: bool = True) -> Needs:
    _check(df, column, strategy, value)
    dated = kind(df.schema[column].dataType) == "datetime"
    if strategy == "mean":
        return Needs(aggs={f"mean:{column}": F.avg(col(column))})
    if strategy in ("min", "max"):
        return Needs(aggs={f"{strategy}:{column}": (F.min if strategy == "min" else F.max)(col(column))})
    if strategy == "median" and dated:
        return Needs(date_medians={column})
    if strategy == "median":
        return Needs(quantiles={f"median:{column}": (col(column), [0.5])})
    if strategy in ("mode", "most_frequent"):
        return Needs(modes={column})
    return Needs()


def fill_value(df: DataFrame, column: str, value=None, strategy: str | None = None, stats: dict | None = None):
    """The value that :func:`fill_missing` puts in."""
    _check(df, column, strategy, value)
    if strategy is None or strategy == "custom":
        return value
    if strategy == "zero":
        return 0
    key = f"{'mode' if strategy == 'most_frequent' else strategy}:{column}"
    what = kind(df.schema[column].dataType)
    if stats is None or key not in stats:
        stats = gather(df, fill_needs(df, column, value, strategy))
    found = stats[key][0] if isinstance(stats[key], list) else stats[key]
    if found is None and strategy in ("mode", "most_frequent"):
        return {"numeric": 0, "datetime": None}.get(what, "Unknown")
    return found


def fill_missing(
    df: DataFrame, column: str, value=None, strategy: str | None = None, inplace: bool = True, stats: dict | None = None,
) -> DataFrame:
    """Fill with a literal, or a statistic of the given data (or of ``stats``, when fitted before)."""
    fill = fill_value(df, column, value, strategy, stats)
    dtype = df.schema[column].dataType
    if fill is None:
        filled = col(column)
    elif kind(dtype) == "numeric" and float(fill) != int(float(fill)):
        filled = F.coalesce(col(column).cast("double"), F.lit(float(fill)))
    else:
        filled = F.coalesce(col(column), literal(fill, dtype))
    if not inplace:
        return df.withColumn(f"{column}_filled", filled)
    return df.select(*[filled.alias(c) if c == column else col(c) for c in df.columns])


def fill_dates(
    df: DataFrame, column: str, method: str = "fill_na", value=None, order_by: Sequence[str] = (), inplace: bool = True,
) -> DataFrame:
    """Literal, forward or backward fill. The last two follow ``order_by``, which ends in a unique key."""
    require(df, column, *order_by)
    if method == "fill_na":
        if value is None:
            raise ValueError("fill_na needs a value")
        return fill_missing(df, column, value, inplace=inplace)
    if method not in ("forward_fill", "backward_fill"):
        raise ValueError(f"unknown method {method!r}")
    if not order_by:
        raise ValueError(f"{method} needs order_by")
    if inplace:
        return carry_fill(df, column, order_by, method == "forward_fill")
    name = f"{column}_filled"
    return carry_fill(df.withColumn(name, col(column)), name, order_by, method == "forward_fill")


def fill_many_needs(df: DataFrame, strategies: Mapping[str, str | Mapping]) -> Needs:
    needs = Needs()
    for c, s in strategies.items():
        s = {"strategy": s} if isinstance(s, str) else dict(s)
        needs += fill_needs(df, c, **s)
    return needs


def fill_many(df: DataFrame, strategies: Mapping[str, str | Mapping], stats: dict | None = None) -> DataFrame:
    """Fill several columns; all statistics come from one aggregate over the input."""
    if stats is None:
        stats = gather(df, fill_many_needs(df, strategies))
    out = df
    for c, s in strategies.items():
        out = fill_missing(out, c, stats=stats, **({"strategy": s} if isinstance(s, str) else dict(s)))
    return out


def fill_report(df: DataFrame, strategies: Mapping[str, str | Mapping]) -> DataFrame:
    """column, missing_count, strategy, fill_value for each filled column that had gaps."""
    stats = gather(df, fill_many_needs(df, strategies))
    records = []
    for i, (c, s) in enumerate(strategies.items()):
        s = {"strategy": s} if isinstance(s, str) else dict(s)
        records.append({
            "column": F.lit(c), "missing_count": F.col(f"m{i}"), "strategy": F.lit(s.get("strategy") or "custom"),
            "fill_value": F.lit(str(fill_value(df, c, stats=stats, **s))),
        })
    wide = df.agg(*[missing(col(c)).alias(f"m{i}") for i, c in enumerate(strategies)])
    return to_long(wide, records).where(F.col("missing_count") > 0)


def before_after(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Count, mean, std, min and max of a numeric column before and after a change."""
    def line(df, label):
        x = col(column).cast("double")
        return df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                      F.min(x).alias("min"), F.max(x).alias("max")).withColumn("stage", F.lit(label))
    return line(before, "before").unionByName(line(after, "after"))


def fill_target(df: DataFrame, target: str, task: str) -> DataFrame:
    """Optional target fill: mean for regression, most frequent value for classification."""
    return fill_missing(df, target, strategy="mean" if task == "regression" else "mode")
