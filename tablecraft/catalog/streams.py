"""Queries of the streaming forms (L), driven over all available input."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tablecraft.catalog import charts
from tablecraft.catalog.base import Catalog, r, rounded
from tablecraft.learn import workflow
from tablecraft.plans.recipe import Recipe
from tablecraft.session import scratch_path
from tablecraft.streaming import jobs, keyed, sketches

catalog = Catalog()
#: The streams' allowance for late rows.
HOUR = timedelta(hours=1)


def arriving(t, table, close: timedelta | None = None):
    """A table as a stream of its files, written to a folder of their own first.

    ``close`` adds a row without values so late that the last day is settled too.
    """
    folder = scratch_path(t.spark, "arriving")
    table.write.parquet(folder)
    if close is not None:
        last = table.agg(F.max("ts")).head()[0]
        if last is not None:
            jobs.close_stream(t.spark, folder, table.schema, "ts", datetime(last.year, last.month, last.day) + timedelta(days=1) + close)
    return jobs.file_stream(t.spark, folder, table.schema)


def settled(t, frame):
    return jobs.run_to_files(frame, scratch_path(t.spark, "settled"), scratch_path(t.spark, "progress"))


def settled_keys(t, frame):
    output = scratch_path(t.spark, "settled")
    keyed.run_keyed(frame, output, scratch_path(t.spark, "progress")).awaitTermination()
    return t.spark.read.schema(frame.schema).parquet(output)


@catalog.add("l01_stream_scoring")
def stream_scoring(t):
    recipe = Recipe("scaled").record("normalize", "value").fit(t.events)
    trained = workflow.train(recipe.apply(t.events)[0], "user_id", ["value_normalized", "event_type"], "regression", "Linear Regression")
    output = scratch_path(t.spark, "scored")
    jobs.score_stream(arriving(t, t.events), trained, output, scratch_path(t.spark, "progress"), recipe).awaitTermination()
    return t.spark.read.parquet(output).select("event_id", "value_normalized", F.round("prediction", 6).alias("prediction"))


@catalog.add("l02_quality_windows", f"""SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, count(*) AS rows, 'value' AS "column", CAST(0 AS BIGINT) AS missing_count, 0.0::DOUBLE AS missing_percentage,
  min(value) AS "min", max(value) AS "max", {r('avg(value)')} AS mean, {r('stddev_samp(value)')} AS std FROM events GROUP BY 1""")
def quality_windows(t):
    frame = jobs.quality_windows(arriving(t, t.events, HOUR), "ts", ["value"])
    return rounded(settled(t, frame).drop("window_end"))


@catalog.add("l02_sketch_months", f"""SELECT date_trunc('month', ts)::TIMESTAMP AS window_start, "column", count(*) AS rows, count_if(v IS NULL)::BIGINT AS missing_count, min(v) AS "min", max(v) AS "max",
  true AS q1_within, true AS median_within, true AS q3_within, true AS distinct_within
  FROM (SELECT ts, unnest(['value', 'user']) AS "column", unnest([CASE WHEN event_id % 9 > 0 THEN value END, user_id::DOUBLE]) AS v FROM events) GROUP BY 1, 2""")
def sketch_months(t):
    """Months merged from daily sketches of a stream, with the exact ranks of their quantiles and the exact distinct counts beside them."""
    events = t.events.select("ts", F.when(F.col("event_id") % 9 > 0, F.col("value")).alias("value"), F.col("user_id").cast("double").alias("user"))
    days = settled(t, sketches.sketch_windows(arriving(t, events, HOUR), "ts", ["value", "user"]))
    found = sketches.sketch_figures(sketches.merge_windows(days, "month"))
    rows = events.select(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("window_start"), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("v")) for c in ("value", "user")]))).groupBy(
        "window_start", "column", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("v").isNotNull())
    here = ["window_start", "column"]
    ranks = rows.join(found, here).groupBy(*here).agg(
        F.sum("n").alias("all"), F.count(F.lit(1)).alias("values"),
        *[F.sum(F.when(F.col("v") < F.col(q), F.col("n")).otherwise(0)).alias(f"below_{q}") for q in sketches.SHARES],
        *[F.sum(F.when(F.col("v") <= F.col(q), F.col("n")).otherwise(0)).alias(f"upto_{q}") for q in sketches.SHARES])
    reach = F.lit(sketches.RANK_ERROR)
    within = [((F.col(f"below_{q}") / F.col("all") <= share + reach) & (F.col(f"upto_{q}") / F.col("all") >= share - reach)).alias(f"{q}_within") for q, share in sketches.SHARES.items()]
    near = (F.abs(F.col("distinct_count") - F.col("values")) <= F.col("values") * 3 * sketches.DISTINCT_ERROR).alias("distinct_within")
    return found.join(ranks, here).select("window_start", "column", "rows", "missing_count", "min", "max", *within, near)


@catalog.add("l03_stream_resample", f"""SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, {r('avg(value)')} AS mean, {r('sum(value)')} AS "sum", min(value) AS "min", max(value) AS "max", count(value) AS count FROM events GROUP BY 1""")
def stream_resample(t):
    return rounded(settled(t, jobs.resample_stream(arriving(t, t.events, HOUR), "ts", "value")))


@catalog.add("l03_stream_periods", charts.resampled("day", "sum", "1 day", "d", "day(ts) NOT BETWEEN 10 AND 12"))
def stream_periods(t):
    stream = arriving(t, t.events.where(F.dayofmonth("ts").between(10, 12) == F.lit(False)), HOUR)
    return rounded(settled_keys(t, keyed.resample_periods(stream, "ts", "value", "day", "sum")))


@catalog.add("l03_stream_periods_by_type", f"""WITH e AS (SELECT * FROM events WHERE NOT (event_type = 'click' AND day(ts) BETWEEN 8 AND 22)),
  g AS (SELECT event_type, date_trunc('day', ts)::DATE AS d, avg(value) AS v FROM e GROUP BY ALL), s AS (SELECT event_type, min(d) AS low FROM g GROUP BY 1),
  c AS (SELECT event_type, unnest(generate_series(low, (SELECT max(d) FROM g), INTERVAL 1 DAY))::DATE AS d FROM s)
  SELECT event_type, d AS period, {r('v')} AS value FROM c LEFT JOIN g USING (event_type, d)""")
def stream_periods_by_type(t):
    gone = (F.col("event_type") == "click") & F.dayofmonth("ts").between(8, 22)
    return rounded(settled_keys(t, keyed.resample_periods(arriving(t, t.events.where(~gone), HOUR), "ts", "value", "day", "mean", ["event_type"])))


OVER = "OVER (PARTITION BY user_id ORDER BY ts, event_id"


@catalog.add("l04_stream_order_features", f"""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 5 > 0 THEN value END AS value FROM events)
  SELECT user_id, ts, event_id, value, lag(value, 1) {OVER}) AS value_lag_1, lag(value, 3) {OVER}) AS value_lag_3,
  CASE WHEN count(value) {OVER} ROWS 2 PRECEDING) = 3 THEN {r(f'avg(value) {OVER} ROWS 2 PRECEDING)')} END AS value_rolling_3_mean,
  CASE WHEN count(value) {OVER} ROWS 2 PRECEDING) = 3 THEN {r(f'stddev_samp(value) {OVER} ROWS 2 PRECEDING)')} END AS value_rolling_3_std,
  last_value(value IGNORE NULLS) {OVER} ROWS UNBOUNDED PRECEDING) AS value_filled FROM g""")
def stream_order_features(t):
    events = t.events.select("user_id", "ts", "event_id", F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("value"))
    frame = keyed.ordered_features(arriving(t, events, HOUR), "ts", "value", "event_id", ["user_id"], lags=(1, 3), windows=(3,), fill=True)
    return rounded(settled_keys(t, frame))
