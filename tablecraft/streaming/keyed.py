"""Keyed streaming state with event-time timers: empty periods, and features that depend on the order of rows.

Both operators need the RocksDB state store, which :func:`run_keyed` sets for the query it starts. Timers follow the
watermark of the whole stream, so a key that has gone quiet is served as soon as any key brings later rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tablecraft.functions.columns import as_double, col, require
from tablecraft.operators.series import AGGREGATES, UNITS
from tablecraft.streaming.jobs import event_time

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = date(1970, 1, 1)
DAY_MS = 86_400_000
ROLLED = {"mean", "std", "min", "max", "sum"}


def run_keyed(frame: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Append the results of all available input to Parquet files below ``output``."""
    conf = frame.sparkSession.conf
    before = conf.get(STORE)
    conf.set(STORE, ROCKS)
    try:
        return (frame.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
                .outputMode("append").trigger(availableNow=True).start())
    finally:
        conf.set(STORE, before)


def packed(column: Column) -> Column:
    """A value as text that is never missing: whole numbers beside missing ones would reach Python as floats."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def unpacked(column: Column, kind: T.DataType) -> Column:
    return F.when(column != "", F.substr(column, F.lit(2)).cast(kind))


def _frame(rows: list[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
    """One frame of the rows, none where there are none."""
    if rows:
        yield pd.DataFrame(rows, columns=names)


# ---------------------------------------------------------------- periods

def period_start(day: int, unit: str) -> int:
    """First day of the period that holds ``day``, as days since 1970; weeks begin on Monday."""
    at = EPOCH + timedelta(days=day)
    if unit == "day":
        return day
    if unit == "week":
        return day - at.weekday()
    month = {"month": at.month, "quarter": (at.month - 1) // 3 * 3 + 1, "year": 1}[unit]
    return (date(at.year, month, 1) - EPOCH).days


def following(start: int, unit: str) -> int:
    """First day of the next period."""
    return period_start(start + {"day": 1, "week": 7, "month": 31, "quarter": 93, "year": 366}[unit], unit)


class Periods(StatefulProcessor):
    """Folds the closed days of a key into periods and emits each period once the watermark has passed its end."""

    def __init__(self, unit: str, how: str) -> None:
        self.unit, self.how = unit, how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start int, n bigint, sum double, low double, high double")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        days = pd.concat(list(rows)).sort_values("day")
        state, made = self.open.get() if self.open.exists() else None, []
        for day, n, total, low, high in zip(days["day"], days["n"], days["sum"], days["low"], days["high"]):
            start = period_start(int(day), self.unit)
            if state is None:
                state = self._empty(start)
            while state[0] < start:
                made.append(state)
                state = self._empty(following(state[0], self.unit))
            if n:
                state = (state[0], state[1] + int(n), state[2] + float(total), min(state[3], float(low)), max(state[4], float(high)))
        yield from self._settled(key, state, made, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.open.exists():
            yield from self._settled(key, self.open.get(), [], timerValues)

    def _empty(self, start: int) -> tuple:
        return start, 0, 0.0, math.inf, -math.inf

    def _settled(self, key, state: tuple, made: list, timerValues) -> Iterator[pd.DataFrame]:
        """Emit what the watermark has passed; one timer waits for the end of the open period."""
        watermark = timerValues.getCurrentWatermarkInMs()
        state = tuple(state)
        while following(state[0], self.unit) * DAY_MS <= watermark:
            made.append(state)
            state = self._empty(following(state[0], self.unit))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.open.update(state)
        self.handle.registerTimer(following(state[0], self.unit) * DAY_MS)
        yield from _frame([(*key, EPOCH + timedelta(days=following(s, self.unit) - 1), self._value(n, total, low, high)) for s, n, total, low, high in made], [*[f"k{i}" for i in range(len(key))], "period", "value"])

    def _value(self, n: int, total: float, low: float, high: float) -> float | None:
        if self.how in ("sum", "count"):
            return float(n if self.how == "count" else total)
        return {"mean": lambda: total / n, "min": lambda: low, "max": lambda: high}[self.how]() if n else None


def resample_periods(stream: DataFrame, time: str, value: str, unit: str = "month", how: str = "mean", keys: Sequence[str] = (), late: str = "1 hour") -> DataFrame:
    """A stream's form of ``series.resample``: one row per key and period, empty ones included, labelled by its last day.

    Rows are first summed to days by Spark's own windowed aggregate, with partial sums before the shuffle, so a key gets a
    row per day whatever its size. The state of a key is one open period. A period is emitted, filled or
    empty, when the watermark (the latest time less ``late``) passes its end; rows that come later than that are dropped. Empty
    periods are 0 for sum and count, else NULL. Days are those of UTC. Missing values count as no value, rows without a
    time are dropped; a missing key is a key of its own.
    """
    if unit not in UNITS or how not in AGGREGATES:
        raise ValueError(f"unknown period {unit!r} or aggregate {how!r}")
    require(stream, time, value, *keys)
    short = [f"k{i}" for i in range(max(1, len(keys)))]
    by = [packed(col(k)) for k in keys] or [F.lit("")]
    timed = stream.select(*[c.alias(n) for c, n in zip(by, short)], event_time(stream, time).alias("at"), as_double(stream, value).alias("v")).where(F.col("at").isNotNull()).withWatermark("at", late)
    days = timed.groupBy(F.window("at", "1 day"), *short).agg(
        F.count("v").alias("n"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("sum"), F.coalesce(F.min("v"), F.lit(0.0)).alias("low"), F.coalesce(F.max("v"), F.lit(0.0)).alias("high"))
    closed = days.select(*short, F.window_time("window").alias("end"), F.floor(F.unix_seconds("window.start") / 86_400).cast("int").alias("day"), "n", "sum", "low", "high")
    schema = ", ".join([*[f"{n} string" for n in short], "period date, value double"])
    out = closed.groupBy(*short).transformWithStateInPandas(Periods(unit, how), schema, "append", "eventTime")
    number = F.col("value").cast("bigint") if how == "count" else F.col("value")
    return out.select(*[unpacked(F.col(n), stream.schema[k].dataType).alias(k) for k, n in zip(keys, short)], "period", number.alias("value"))


# ---------------------------------------------------------------- ordered features

class Ordered(StatefulProcessor):
    """Holds a key's rows until the watermark passes them, then gives each its features in the order of time and tie."""

    def __init__(self, whole_tie: bool, lags: Sequence[int], windows: Sequence[int], functions: Sequence[str], fill: bool) -> None:
        self.whole_tie = whole_tie
        self.lags, self.windows, self.functions, self.fill = list(lags), list(windows), list(functions), fill
        self.reach = max([0, *self.lags, *[w - 1 for w in self.windows]])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, tie string, value double")
        self.past = handle.getListState("past", "value double")
        self.known = handle.getValueState("known", "value double")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [(int(at), tie, None if pd.isna(v) else float(v)) for part in rows for at, tie, v in zip(part["us"], part["tie"], part["v"])]
        if fresh:
            self.waiting.appendList(fresh)
        yield from self._final(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._final(key, timerValues)

    def _order(self, row: tuple) -> tuple:
        at, tie, _ = row
        return at, not tie, int(tie[1:]) if tie and self.whole_tie else tie

    def _final(self, key, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((tuple(row) for row in self.waiting.get()), key=self._order)
        ready = [row for row in waiting if row[0] <= passed]
        rest = waiting[len(ready):]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if rest:
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        out = []
        if ready:
            past = [row[0] for row in self.past.get()]
            known = self.known.get()[0] if self.known.exists() else None
            for at, tie, value in ready:
                known = value if value is not None else known
                row = past + [value]
                out.append((*key, at, tie, value, *self._features(row), *([known] if self.fill else [])))
                past = row[-self.reach:] if self.reach else []
            self.past.put([(v,) for v in past]) if past else self.past.clear()
            if known is not None:
                self.known.update((known,))
            self.waiting.put(rest) if rest else self.waiting.clear()
        yield from _frame(out, [*[f"k{i}" for i in range(len(key))], "us", "tie", "v", *[f"f{i}" for i in range(len(self.names("")))]])

    def names(self, value: str) -> list[str]:
        made = [f"{value}_lag_{k}" for k in self.lags] + [f"{value}_rolling_{w}_{f}" for w in self.windows for f in self.functions]
        return made + ([f"{value}_filled"] if self.fill else [])

    def _features(self, row: list) -> list:
        """Of the last entry of ``row``, which begins with what came before it."""
        found = [row[-1 - k] if len(row) > k else None for k in self.lags]
        for w in self.windows:
            part = row[-w:]
            full = len(part) == w and None not in part
            for f in self.functions:
                found.append(self._rolled(part, f) if full else None)
        return found

    @staticmethod
    def _rolled(part: list, f: str) -> float | None:
        mean = math.fsum(part) / len(part)
        if f == "std":
            return math.sqrt(math.fsum((x - mean) ** 2 for x in part) / (len(part) - 1)) if len(part) > 1 else None
        return {"mean": mean, "sum": math.fsum(part), "min": min(part), "max": max(part)}[f]


def ordered_features(
    stream: DataFrame, time: str, value: str, tie: str, keys: Sequence[str], lags: Sequence[int] = (), windows: Sequence[int] = (),
    functions: Sequence[str] = ("mean", "std"), fill: bool = False, late: str = "1 hour",
) -> DataFrame:
    """Lags, rolling figures and forward fill of a stream, equal to those of a batch ordered by time and tie within each key.

    (keys, time, tie, value, <v>_lag_<k>, <v>_rolling_<w>_<f>, <v>_filled). A row waits until the watermark passes it, so rows that
    arrive late but within ``late`` are put in their place; later ones are dropped. Per key the state is the rows
    that wait, the last values that the features reach back to, and the last value that was not missing. A rolling
    figure is NULL unless all its values are there. ``tie`` must be unique within key and time. Rows without a time are
    dropped; a missing key is a key of its own. The order of one key is worked out in one task.
    """
    require(stream, time, value, tie, *keys)
    if set(functions) - ROLLED:
        raise ValueError(f"unknown functions {sorted(set(functions) - ROLLED)}")
    kind = stream.schema[tie].dataType
    if not isinstance(kind, (T.IntegralType, T.StringType)):
        raise ValueError(f"{tie} must be whole numbers or text")
    at, short = event_time(stream, time), [f"k{i}" for i in range(len(keys))]  # short names: pandas frames do not keep all others
    timed = stream.select(*[packed(col(k)).alias(n) for k, n in zip(keys, short)], packed(col(tie)).alias("tie"), as_double(stream, value).alias("v"), at.alias("at"), F.unix_micros(at).alias("us")).where(
        F.col("at").isNotNull()).withWatermark("at", late)
    work = Ordered(isinstance(kind, T.IntegralType), lags, windows, functions, fill)
    made = work.names(value)
    schema = ", ".join([*[f"{n} string" for n in short], "us bigint, tie string, v double", *[f"f{i} double" for i in range(len(made))]])
    out = timed.groupBy(*short).transformWithStateInPandas(work, schema, "append", "eventTime")
    return out.select(*[unpacked(F.col(n), stream.schema[k].dataType).alias(k) for k, n in zip(keys, short)], _moment(F.col("us")).alias(time),
                      unpacked(F.col("tie"), kind).alias(tie), F.col("v").alias(value), *[F.col(f"f{i}").alias(n) for i, n in enumerate(made)])


def _moment(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01").cast("timestamp_ntz"))
