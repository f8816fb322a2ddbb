"""Date parts and durations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablecraft.functions.columns import col, kind, require
from tablecraft.functions.stats import Needs, gather
from tablecraft.sources.typing import parsed_date

DAY_MICROS = 86_400e6
PARTS = (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("weekday", F.weekday), ("quarter", F.quarter))


def moment(df: DataFrame, column: str) -> Column:
    """The column as TIMESTAMP_NTZ; text is parsed, bad text becomes NULL."""
    require(df, column)
    x = col(column)
    return x.cast("timestamp_ntz") if kind(df.schema[column].dataType) == "datetime" else parsed_date(x.cast("string"))


def date_parts(df: DataFrame, column: str) -> DataFrame:
    """``_year _month _day _weekday`` (Monday is 0) and ``_quarter``."""
    return df.withColumns({f"{column}_{name}": part(moment(df, column)) for name, part in PARTS})


def earliest_needs(df: DataFrame, column: str, reference=None, **_) -> Needs:
    return Needs() if reference is not None else Needs(aggs={f"earliest:{column}": F.min(moment(df, column))})


def days_since(df: DataFrame, column: str, reference=None, stats: dict | None = None) -> DataFrame:
    """Fractional days since ``reference``, or since the earliest value."""
    if reference is None:
        stats = stats or gather(df, earliest_needs(df, column))
        reference = stats[f"earliest:{column}"]
    start = F.lit(str(reference) if reference is not None else None).cast("timestamp_ntz")
    return df.withColumn(f"{column}_days_since", F.timestamp_diff("MICROSECOND", start, moment(df, column)) / F.lit(DAY_MICROS))


def dates_many_needs(df: DataFrame, columns: Sequence[str], operation: str, reference=None) -> Needs:
    needs = Needs()
    for c in columns if operation == "days_since" else ():
        needs += earliest_needs(df, c, reference)
    return needs


def dates_many(df: DataFrame, columns: Sequence[str], operation: str, reference=None, stats: dict | None = None) -> DataFrame:
    """parts or days_since over several columns; reference dates come from one aggregate."""
    if operation not in ("parts", "days_since"):
        raise ValueError(f"unknown date operation {operation!r}")
    usable = [c for c in columns if c in df.columns]
    stats = stats or gather(df, dates_many_needs(df, usable, operation, reference))
    out = df
    for c in usable:
        out = date_parts(out, c) if operation == "parts" else days_since(out, c, reference, stats)
    return out
