"""Session helpers: the shared scratch folder and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

TASK_BYTES = 128 * 2**20
#: A table of at most so many keys goes to every task.
FEW_KEYS = 10_000
ARROW = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64()}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only where the session names none (local tests) is a temporary one made.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="tablecraft-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def freeze(df: DataFrame) -> DataFrame:
    """Materialize ``df`` reliably so later passes neither recompute nor depend on one executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def dealt(df: DataFrame, rows: int, row_bytes: int, *keys: str) -> DataFrame:
    """Rows dealt by a hash of ``keys`` over tasks of some 128 MB, over all cores at least."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows * row_bytes // TASK_BYTES)), *keys)


def looked_up(df: DataFrame, table: DataFrame, keys: str | Sequence[str], how: str = "left") -> DataFrame:
    """Join a table of one row per key. One of few keys is counted, kept and sent to every task, so that rows of a frequent
    key are not gathered in one; one of many is joined by a shuffle, where adaptive execution splits frequent keys.
    """
    kept = freeze(table)
    return df.join(F.broadcast(kept) if kept.count() <= FEW_KEYS else kept, keys, how)


def small_frame(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A frame of a few driver-side rows; it becomes a local relation, which needs no job."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    columns = [pa.array([row[i] for row in rows], ARROW[kind]) for i, (_, kind) in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, [name for name, _ in fields]))


def local_session(app: str = "tablecraft", cpus: int | str = "*") -> SparkSession:
    """Session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
