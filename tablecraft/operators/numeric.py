"""Scaling, binning, log and outlier transforms of numeric columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablecraft.functions.columns import as_double, col, require
from tablecraft.functions.quantiles import exact_quantiles
from tablecraft.functions.stats import Needs, gather, sample_kurtosis, sample_skewness

# Fixed value: smallest argument of the logarithm.
LOG_FLOOR = 1e-9


def basic_statistics(df: DataFrame, column: str) -> DataFrame:
    """count, mean, std, min, quartiles, max, skewness and kurtosis in one row."""
    require(df, column)
    x = as_double(df, column)
    q25, q50, q75 = exact_quantiles(df, {column: (x, [0.25, 0.5, 0.75])})[column]
    return df.agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
        *[F.lit(q).cast("double").alias(n) for n, q in (("q25", q25), ("median", q50), ("q75", q75))],
        F.max(x).alias("max"), sample_skewness(x).alias("skewness"), sample_kurtosis(x).alias("kurtosis"),
    )


def range_needs(df: DataFrame, column: str, **_) -> Needs:
    require(df, column)
    x = as_double(df, column)
    return Needs(aggs={f"min:{column}": F.min(x), f"max:{column}": F.max(x)})


def spread_needs(df: DataFrame, column: str, **_) -> Needs:
    require(df, column)
    x = as_double(df, column)
    return Needs(aggs={f"mean:{column}": F.avg(x), f"std:{column}": F.stddev_samp(x)})


def normalize(df: DataFrame, column: str, stats: dict | None = None) -> DataFrame:
    """(x - min) / (max - min); no column is added when the range is zero."""
    stats = stats or gather(df, range_needs(df, column))
    low, high = stats[f"min:{column}"], stats[f"max:{column}"]
    if low is None or high == low:
        return df
    return df.withColumn(f"{column}_normalized", (as_double(df, column) - F.lit(low)) / F.lit(high - low))


def standardize(df: DataFrame, column: str, stats: dict | None = None) -> DataFrame:
    """(x - mean) / sample std; no column is added when the std is zero."""
    stats = stats or gather(df, spread_needs(df, column))
    mean, std = stats[f"mean:{column}"], stats[f"std:{column}"]
    if not std:
        return df
    return df.withColumn(f"{column}_standardized", (as_double(df, column) - F.lit(mean)) / F.lit(std))


def even_edges(low: float, high: float, bins: int) -> list[float]:
    step = (high - low) / bins
    return [low + i * step for i in range(bins)] + [high]


def bin_edges(df: DataFrame, column: str, bins: int) -> DataFrame:
    stats = gather(df, range_needs(df, column))
    edges = even_edges(stats[f"min:{column}"], stats[f"max:{column}"], bins)
    return df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(e) for e in edges])).alias("edge", "value"))


def right_closed_bin(x: Column, edges: Sequence[float]) -> Column:
    """1-based bin of ``x`` where bins are (edge, next edge] and the first one holds its lower edge."""
    inner = [F.lit(float(e)) for e in edges[1:-1]]
    if not inner:
        return F.when(x.isNotNull(), F.lit(1))
    position = F.size(F.filter(F.array(*inner), lambda e: e < x)) + 1
    return F.when(x.isNotNull() & x.between(F.lit(float(edges[0])), F.lit(float(edges[-1]))), position)


def binning_needs(df: DataFrame, column: str, bins: int = 4, method: str = "equal_width", **_) -> Needs:
    if method == "equal_width":
        return range_needs(df, column)
    require(df, column)
    return Needs(quantiles={f"edges{bins}:{column}": (as_double(df, column), [i / bins for i in range(bins + 1)])})


def binning(
    df: DataFrame, column: str, bins: int = 4, method: str = "equal_width",
    labels: Sequence[str] | None = None, stats: dict | None = None,
) -> DataFrame:
    """Add ``<c>_binned`` (1-based) with its bounds, or label, by equal width or equal frequency."""
    if method not in ("equal_width", "equal_frequency"):
        raise ValueError(f"unknown binning method {method!r}")
    stats = stats or gather(df, binning_needs(df, column, bins, method))
    if method == "equal_width":
        low, high = stats[f"min:{column}"], stats[f"max:{column}"]
        if low is not None and low == high:          # widened the way a constant column is
            pad = 0.001 * abs(low) if low else 0.001
            low, high = low - pad, high + pad
        edges = [] if low is None else even_edges(low, high, bins)
    else:
        edges = sorted({e for e in stats[f"edges{bins}:{column}"] if e is not None})
        if len(edges) == 1:
            edges = []                               # one distinct edge leaves no bin
    name = f"{column}_binned"
    if not edges:
        return df.withColumn(name, F.lit(None).cast("string" if labels else "int"))
    index = right_closed_bin(as_double(df, column), edges)
    if labels:
        if len(labels) != len(edges) - 1:
            raise ValueError(f"{len(edges) - 1} bins need as many labels, got {len(labels)}")
        return df.withColumn(name, F.get(F.array(*[F.lit(v) for v in labels]), index - 1))
    bounds = F.array(*[F.lit(float(e)) for e in edges])
    return df.withColumn(name, index).withColumn(f"{name}_lower", F.get(bounds, index - 1)).withColumn(
        f"{name}_upper", F.get(bounds, index))


def log_offset(df: DataFrame, column: str) -> float:
    """0 for positive data, else |min| + 1."""
    low = gather(df, range_needs(df, column))[f"min:{column}"]
    return abs(low) + 1 if low is not None and low <= 0 else 0.0


def log_transform(df: DataFrame, column: str, offset: float = 0) -> DataFrame:
    """ln(x + offset), floored so that it is always finite; missing stays missing."""
    require(df, column)
    x = as_double(df, column) + F.lit(float(offset))
    return df.withColumn(f"{column}_log", F.when(x.isNotNull(), F.ln(F.greatest(x, F.lit(LOG_FLOOR)))))


def outlier_bounds(df: DataFrame, column: str) -> DataFrame:
    from tablecraft.operators.quality import iqr_fences

    q1, q3, low, high = iqr_fences(df, [column])[column]
    iqr = None if q1 is None else q3 - q1
    return df.sparkSession.range(1).select(*[
        F.lit(v).cast("double").alias(n)
        for n, v in (("q1", q1), ("q3", q3), ("iqr", iqr), ("lower_bound", low), ("upper_bound", high))
    ])


def list_outliers(df: DataFrame, column: str, lower_bound: float, upper_bound: float) -> DataFrame:
    return df.where((col(column) < lower_bound) | (col(column) > upper_bound))


def handle_outliers(df: DataFrame, column: str, lower_bound: float, upper_bound: float, method: str = "cap") -> DataFrame:
    """cap -> ``<c>_capped``; remove -> fewer rows; null -> ``<c>_no_outliers``."""
    require(df, column)
    x = col(column)
    if method == "cap":
        capped = F.least(F.greatest(x, F.lit(lower_bound)), F.lit(upper_bound))
        return df.withColumn(f"{column}_capped", F.when(x.isNotNull(), capped))
    if method == "remove":
        return df.where(x.between(lower_bound, upper_bound))
    if method == "null":
        return df.withColumn(f"{column}_no_outliers", F.when(x.between(lower_bound, upper_bound), x))
    raise ValueError(f"unknown outlier method {method!r}")


def batch_needs(df: DataFrame, columns: Sequence[str], operation: str, offset: float | str | None = None) -> Needs:
    needs = Needs()
    for c in columns:
        if operation == "standardize":
            needs += spread_needs(df, c)
        elif operation == "normalize" or offset == "auto":
            needs += range_needs(df, c)
    return needs


def batch_numeric(
    df: DataFrame, columns: Sequence[str], operation: str, offset: float | str | None = None, stats: dict | None = None,
) -> DataFrame:
    """normalize / standardize / log over many columns; statistics come from one aggregate."""
    if operation not in ("normalize", "standardize", "log"):
        raise ValueError(f"unknown operation {operation!r}")
    usable = [c for c in columns if c in df.columns]
    stats = stats or gather(df, batch_needs(df, usable, operation, offset))
    out = df
    for c in usable:
        if operation == "normalize":
            out = normalize(out, c, stats)
        elif operation == "standardize":
            out = standardize(out, c, stats)
        else:
            low = stats.get(f"min:{c}")
            shift = (abs(low) + 1 if low is not None and low <= 0 else 0.0) if offset == "auto" else offset or 0.0
            out = log_transform(out, c, shift)
    return out
