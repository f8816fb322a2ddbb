"""Structured Streaming forms of scoring, quality monitoring and resampling."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from tablecraft.functions.columns import col, kind, micros, percent, require
from tablecraft.learn.workflow import Trained
from tablecraft.plans.recipe import STEPS, Recipe


def file_stream(spark: SparkSession, folder: str, schema, file_format: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """New files of ``folder`` as a stream."""
    reader = spark.readStream.format(file_format).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(folder)


def event_time(df: DataFrame, column: str) -> Column:
    """Event time for watermarks, which do not take zone-free timestamps: those are read as UTC."""
    require(df, column)
    dtype = df.schema[column].dataType
    return col(column) if isinstance(dtype, T.TimestampType) else F.timestamp_micros(micros(col(column), dtype))


def _zone_free(moment: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(moment), F.lit("1970-01-01").cast("timestamp_ntz"))


def score_stream(stream: DataFrame, trained: Trained, output: str, checkpoint: str, recipe: Recipe | None = None) -> StreamingQuery:
    """Score arriving rows with a fitted recipe and pipeline; each available file once."""
    work = stream
    if recipe is not None:
        if not recipe.fitted and any(STEPS[s.function].needs for s in recipe.steps if s.function in STEPS):
            raise ValueError("fit the recipe first: a stream has no statistics of its own")
        work, report = recipe.apply(stream, mode="fitted")
        failed = [r for r in report if r["status"] == "failed"]
        if failed:
            raise ValueError(f"the recipe does not fit the stream: {failed}")
    scored = trained.predict(work)
    return (scored.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start())


def quality_windows(stream: DataFrame, time: str, columns: Sequence[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows, missing share, min, max, mean and std per column and time window.

    Only figures that merge are kept per window. Rows later than the watermark are dropped;
    in append mode the last open window is written once later data closes it.
    """
    require(stream, time, *columns)
    numeric = [c for c in columns if kind(stream.schema[c].dataType) == "numeric"]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        aggs.append(F.count_if(col(c).isNull()).alias(f"m{i}"))
        if c in numeric:
            aggs += [f(col(c).cast("double")).alias(f"{t}{i}") for t, f in (("a", F.min), ("b", F.max), ("e", F.avg), ("s", F.stddev_samp))]
    timed = stream.withColumn("__at", event_time(stream, time)).withWatermark("__at", late)
    grouped = timed.groupBy(F.window("__at", width)).agg(*aggs)
    none = F.lit(None).cast("double")
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count"),
                 F.round(percent(F.col(f"m{i}"), F.col("rows")), 2).alias("missing_percentage"),
                 *[(F.col(f"{t}{i}") if c in numeric else none).alias(n) for t, n in (("a", "min"), ("b", "max"), ("e", "mean"), ("s", "std"))])
        for i, c in enumerate(columns)
    ])
    return grouped.select(_zone_free(F.col("window.start")).alias("window_start"), _zone_free(F.col("window.end")).alias("window_end"), "rows", F.inline(cells))


def resample_stream(stream: DataFrame, time: str, value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean, sum, min, max and count per window; empty windows are not filled in a stream."""
    require(stream, time, value)
    timed = stream.withColumn("__at", event_time(stream, time)).withWatermark("__at", late)
    v = col(value).cast("double")
    return timed.groupBy(F.window("__at", width)).agg(  # see keyed.resample_periods for empty ones
        F.avg(v).alias("mean"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("count"),
    ).select(_zone_free(F.col("window.start")).alias("window_start"), "mean", "sum", "min", "max", "count")


def run_to_files(frame: DataFrame, output: str, checkpoint: str) -> DataFrame:
    """Append what a stream settles over all available input to Parquet files below ``output``, and read them."""
    (frame.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
     .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return frame.sparkSession.read.schema(frame.schema).parquet(output)


def close_stream(spark: SparkSession, folder: str, schema: T.StructType, time: str, moment: datetime) -> None:
    """Add a row that holds nothing but ``moment`` to the files of a stream: the watermark then passes all that ends ``late`` before it.

    A stream that goes on needs no such row, since later data closes what is open.
    """
    row = spark.range(1).select(*[(F.lit(moment) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
    row.write.mode("append").parquet(folder)
