"""Clusters around centroids: exact integer dot products kept per vector and changed only by what changed in the centroids."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablecraft.llm.common import forget, map_arrow
from tablecraft.session import scratch_path, small_frame

#: Components beyond this could take a squared distance out of 64 bits.
LIMIT = 1 << 27
STATE = "vec_id bigint, v array<int>, dots array<bigint>, cluster int, distance bigint"
RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def integer_vectors(vectors: DataFrame, id_column: str, vector_column: str, width: int, scale: int) -> DataFrame:
    """(vec_id, v) of the vectors that have ``width`` finite components; each becomes floor(scale * x)."""
    given = vectors.select(F.col(f"`{id_column}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))  # NaN is above infinity
    return given.filter(F.size("x") == width).filter(finite).select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def changed(dots: np.ndarray, v: np.ndarray, step: np.ndarray) -> np.ndarray:
    """``dots`` after the centroids moved by ``step``: a centroid costs as much as it has components that changed."""
    out = dots.copy()
    for k in np.flatnonzero(step.any(1)):
        at = np.flatnonzero(step[k])
        out[:, k] += v[:, at] @ step[k, at]
    return out


def _advanced(state: DataFrame, old: np.ndarray, new: np.ndarray) -> DataFrame:
    """Every vector's dot products with the new centroids, and the nearest of them."""
    step, norms, (count, width) = new - old, (new * new).sum(1), new.shape

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        v = batch["v"].flatten().to_numpy().astype(np.int64).reshape(n, width)
        if np.abs(v).max() > LIMIT:
            raise ArithmeticError(f"components beyond {LIMIT} could take a squared distance out of 64 bits")
        dots = batch["dots"].flatten().to_numpy().reshape(n, count) if "dots" in batch.schema.names else np.zeros((n, count), np.int64)
        dots = changed(dots, v, step)
        apart = norms - 2 * dots
        cluster = apart.argmin(1)  # the smaller number where two are as near
        distance = apart[np.arange(n), cluster] + (v * v).sum(1)

        def lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
            return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))

        return pa.RecordBatch.from_arrays([batch["vec_id"], lists(v, pa.int32()), lists(dots, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance)], ["vec_id", "v", "dots", "cluster", "distance"])

    return map_arrow(state, work, STATE)


def cluster_vectors(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", width: int = 64, scale: int = 256, clusters: int = 40, rounds: int = 5, seed: str = "2:",
) -> DataFrame:
    """One row per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors of ``width`` finite components become integers floor(``scale`` * x); others have no row. The first centroids
    are the vectors with the smallest sha256 of ``seed`` and their id. A round replaces every centroid that has
    vectors by the floor of their mean and assigns all vectors again, ties to the smaller number; the result is the
    assignment after the last round. All arithmetic is on 64-bit integers; components beyond 2^27 raise ArithmeticError.

    A table in the shared folder keeps each vector with its dot products. A round adds what the changed components of
    the centroids change, so centroids that stand still cost nothing. No vector moves between executors: only sums per
    cluster are shuffled, and ``clusters`` rows of them reach the driver. A round's table goes when the next is whole.

    Repeated rows are vectors each (their order as first centroids goes by their components); null ids are clustered but come last
    as first centroids. With fewer vectors than ``clusters`` each is a first centroid. Other columns are ignored;
    an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ints = integer_vectors(vectors, id_column, vector_column, width, scale)
    ranked = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    first = ints.orderBy(ranked.asc_nulls_last(), "v").limit(clusters).collect()
    if not first:
        return spark.createDataFrame([], RESULT)
    centroids = np.array([row["v"] for row in first], np.int64)

    def stored(state: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, "clusters")
        state.write.parquet(path)
        return spark.read.schema(STATE).parquet(path), path

    state, path = stored(_advanced(ints, np.zeros_like(centroids), centroids))
    for _ in range(rounds):
        sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(width)]).collect()
        new = centroids.copy()
        for row in sums:
            new[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
        (state, following), done = stored(_advanced(state, centroids, new)), path
        forget(spark, done)
        centroids, path = new, following

    spread = {row["cluster"]: row["s"] for row in state.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(spread.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    known = small_frame(spark, [(k, spread[k], total, digests[k]) for k in sorted(spread)], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(known), "cluster").select(*[f.split(" ")[0] for f in RESULT.split(", ")])
