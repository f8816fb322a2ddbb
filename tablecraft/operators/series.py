"""Frames behind time charts: ordered series, resampling, seasonality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablecraft.functions.columns import as_double, col, require
from tablecraft.operators.rows import keep_tops
from tablecraft.operators.temporal import moment

AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}
UNITS = {"day": "1 day", "week": "7 days", "month": "1 month", "quarter": "3 months", "year": "1 year"}
# Names of months and weekdays (Monday first).
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def time_series(df: DataFrame, date: str, values: Sequence[str], category: str | None = None, top: int | None = None) -> DataFrame:
    """(date, [category], column, value) sorted by date; ``top`` limits the categories to the most frequent."""
    require(df, date, *values)
    if category:
        df = keep_tops(df, [(category, top)]).where(col(category).isNotNull())
    cells = F.array(*[F.struct(F.lit(v).alias("column"), as_double(df, v).alias("value")) for v in values])
    extra = [col(category)] if category else []
    return df.select(moment(df, date).alias("date"), *extra, F.inline(cells)).where(F.col("date").isNotNull()).orderBy("date", *extra, "column")


def period_end(start: Column, unit: str) -> Column:
    """Last day of the period that begins at ``start``; weeks end on Sunday."""
    if unit == "day":
        return start
    if unit == "week":
        return F.date_add(start, 6)
    months = {"month": 0, "quarter": 2, "year": 11}[unit]
    return F.last_day(F.add_months(start, months))


def resample(df: DataFrame, date: str, value: str, unit: str = "month", how: str = "mean") -> DataFrame:
    """One row per period, labelled by its last day. Empty periods stay: 0 for sum and count, else NULL."""
    if unit not in UNITS or how not in AGGREGATES:
        raise ValueError(f"unknown period {unit!r} or aggregate {how!r}")
    start = F.date_trunc(unit, moment(df, date)).cast("date")
    grouped = df.select(start.alias("start"), as_double(df, value).alias("v")).where(F.col("start").isNotNull()).groupBy("start").agg(
        AGGREGATES[how](F.col("v")).alias("value"))
    span = grouped.agg(F.min("start").alias("a"), F.max("start").alias("b")).where(F.col("a").isNotNull())
    calendar = span.select(F.explode(F.sequence("a", "b", F.expr(f"interval {UNITS[unit]}"))).alias("start"))
    filled = F.coalesce(F.col("value"), F.lit(0)) if how in ("sum", "count") else F.col("value")
    return calendar.join(grouped, "start", "left").select(period_end(F.col("start"), unit).alias("period"), filled.alias("value"))


def seasonality(df: DataFrame, date: str, value: str, by: str) -> DataFrame:
    """Mean and count by month, weekday, quarter or hour, in natural order."""
    at = moment(df, date)
    parts = {
        "month": (F.month(at), lambda p: F.get(F.array(*[F.lit(m) for m in MONTHS]), p - 1)),
        "weekday": (F.weekday(at), lambda p: F.get(F.array(*[F.lit(d) for d in WEEKDAYS]), p)),
        "quarter": (F.quarter(at), lambda p: F.concat(F.lit("Q"), p.cast("string"))),
        "hour": (F.hour(at), lambda p: p.cast("string")),
    }
    if by not in parts:
        raise ValueError(f"unknown season {by!r}")
    part, name = parts[by]
    grouped = df.select(part.alias("part"), as_double(df, value).alias("v")).where(F.col("part").isNotNull()).groupBy("part").agg(
        F.avg("v").alias("mean"), F.count("v").alias("n"))
    if by == "hour" and grouped.limit(2).count() < 2:
        return grouped.limit(0).select("part", name(F.col("part")).alias("name"), "mean", "n")
    return grouped.select("part", name(F.col("part")).alias("name"), "mean", "n").orderBy("part")
