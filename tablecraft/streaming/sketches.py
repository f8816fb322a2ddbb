"""Quantiles and distinct counts per window as mergeable sketches: days are kept, any longer span is merged without a rescan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tablecraft.functions.columns import as_double, col, kind, require
from tablecraft.operators.distributions import FENCE
from tablecraft.streaming.jobs import event_time

#: Size of a KLL sketch. A quantile's rank is then off by less than RANK_ERROR with 99 % confidence, merged or not.
KLL_SIZE = 400
RANK_ERROR = 2.296 / KLL_SIZE**0.9723
#: Logarithm of the registers of an HLL sketch; the relative standard error of a count is DISTINCT_ERROR.
HLL_LOG = 12
DISTINCT_ERROR = 1.04 / 2 ** (HLL_LOG / 2)
SHARES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def sketch_windows(df: DataFrame, time: str, columns: Sequence[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows, missing count, extremes and two sketches per column and time window, of a stream or a table.

    A sketch holds some KB whatever the number of rows, and is merged before the shuffle. Text columns have no
    quantile sketch. Rows without a time are dropped. A stream appends a window when the watermark passes its end.
    """
    require(df, time, *columns)
    timed = df.select(event_time(df, time).alias("at"), *[(as_double(df, c) if kind(df.schema[c].dataType) == "numeric" else col(c).cast("string")).alias(f"c{i}") for i, c in enumerate(columns)])
    aggs, cells = [F.count(F.lit(1)).alias("rows")], []
    for i, c in enumerate(columns):
        v, numeric = F.col(f"c{i}"), kind(df.schema[c].dataType) == "numeric"
        aggs += [F.count_if(v.isNull()).alias(f"m{i}"), F.hll_sketch_agg(v.cast("string"), F.lit(HLL_LOG)).alias(f"d{i}")]
        if numeric:
            aggs += [F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}"), F.kll_sketch_agg_double(v, F.lit(KLL_SIZE)).alias(f"q{i}")]
        none = F.lit(None)
        cells.append(F.struct(
            F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count"), (F.col(f"a{i}") if numeric else none.cast("double")).alias("min"),
            (F.col(f"b{i}") if numeric else none.cast("double")).alias("max"), (F.col(f"q{i}") if numeric else none.cast("binary")).alias("quantiles"), F.col(f"d{i}").alias("distinct")))
    grouped = timed.where(F.col("at").isNotNull()).withWatermark("at", late).groupBy(F.window("at", width)).agg(*aggs)
    start = F.timestamp_add("MICROSECOND", F.unix_micros("window.start"), F.lit("1970-01-01").cast("timestamp_ntz"))
    return grouped.select(start.alias("window_start"), "rows", F.inline(F.array(*cells)))


def merge_windows(stored: DataFrame, unit: str = "month") -> DataFrame:
    """Stored windows as windows of a longer ``unit``, in the same form: rows add up, sketches merge."""
    return stored.groupBy(F.date_trunc(unit, F.col("window_start")).cast("timestamp_ntz").alias("window_start"), "column").agg(
        F.sum("rows").alias("rows"), F.sum("missing_count").alias("missing_count"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"),
    ).select("window_start", "rows", "column", "missing_count", "min", "max", "quantiles", "distinct")


def sketch_figures(stored: DataFrame) -> DataFrame:
    """Quartiles, outlier fences and distinct counts read from sketches; NULL where a window has no number."""
    sketch = F.when(F.kll_sketch_get_n_double("quantiles") > 0, F.col("quantiles"))  # an empty one has no quantile
    figures = stored.select("window_start", "column", "rows", "missing_count", "min", "max", F.hll_sketch_estimate("distinct").alias("distinct_count"), *[
        F.kll_sketch_get_quantile_double(sketch, F.lit(share)).alias(name) for name, share in SHARES.items()])
    reach = FENCE * (F.col("q3") - F.col("q1"))
    return figures.withColumns({"lower_fence": F.col("q1") - reach, "upper_fence": F.col("q3") + reach})
