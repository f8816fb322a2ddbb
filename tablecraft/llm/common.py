"""What the operators share: saved intermediate tables, bounded Arrow batches, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablecraft.session import scratch_path

#: Rows of an Arrow batch; with texts of 100 KB a batch is then some 25 MB.
BATCH_ROWS = 256


#: Shuffle files of a query are deleted at its end, not when the driver happens to collect garbage.
CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def stored(df: DataFrame, path: str, settings: dict[str, str] = {}) -> DataFrame:
    """``df`` written to ``path`` under some settings and read back; no shuffle file of the writing is needed after it."""
    conf, settings = df.sparkSession.conf, CLEANUP | settings
    before = {name: conf.get(name, None) for name in settings}
    try:
        for name, value in settings.items():
            conf.set(name, value)
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: later passes survive lost executors."""
    return stored(df, scratch_path(df.sparkSession, label))


class Tables:
    """Saved tables by name, to be deleted one by one when what was made of them is written."""

    def __init__(self, spark: SparkSession, settings: dict[str, str] = {}):
        self.spark, self.paths, self.settings = spark, {}, settings

    def save(self, df: DataFrame, label: str) -> DataFrame:
        path = self.paths[label] = scratch_path(self.spark, label)
        return stored(df, path, self.settings)

    def drop(self, *labels: str) -> None:
        for label in labels:
            forget(self.spark, self.paths.pop(label))


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder after its last reader."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch] | None], schema: str) -> DataFrame:
    """``mapInArrow`` over batches small enough for rows that hold long texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return df.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected edges (a, b): component is the smallest node that links reach.

    Labels fall to the smallest label among the neighbours, then jump to the label of their label, until
    none changes. Every round is a join and a pre-aggregated minimum; nothing is collected.
    """
    both = saved(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("hook"))
        jumps = labels.select(F.col("node").alias("hook"), F.col("component").alias("jump"))
        moved = saved(hooked.join(jumps, "hook", "left").select("node", "old", F.least("hook", F.coalesce("jump", "hook")).alias("component")), "labels")
        labels = moved.select("node", "component")
        if moved.filter("component <> old").isEmpty():
            return labels
