"""Exact most frequent values without shuffling every distinct value."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tablecraft.functions.columns import col
from tablecraft.session import small_frame

#: Hash buckets of all columns together (a column has 1024 at least), and the fullest buckets that are counted first.
BUCKETS, LEAST_BUCKETS, PROBED = 1 << 16, 1024, 256


def most_frequent(df: DataFrame, columns: Sequence[str], n: int, as_type: str | None = None) -> dict[str, list[tuple]]:
    """Of each column the ``n`` most frequent values as (value, count), equal counts by value; missing values left out.

    The columns share a type, or are cast to ``as_type``. The first pass counts rows per hash bucket of the values: a
    summary of fixed size that merges exactly, in which no value is more frequent than its bucket is full. The second
    counts the values of the fullest buckets. Buckets with fewer rows than the n-th count found hold none of the
    answer; if others are left, a third pass counts the values of all buckets that are full enough. Where no value
    stands out, these are all buckets, and the pass is a plain count of all values. Only n values a column are collected.
    """
    columns = list(columns)
    if not columns or n < 1:
        return {c: [] for c in columns}
    per = max(LEAST_BUCKETS, BUCKETS // len(columns))
    cells = [F.struct(F.lit(i).alias("idx"), (col(c).cast(as_type) if as_type else col(c)).alias("value")) for i, c in enumerate(columns)]
    rows = df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())
    real = isinstance(rows.schema["value"].dataType, (T.FloatType, T.DoubleType))
    key = F.xxhash64(F.col("value") + F.lit(0.0) if real else F.col("value"))  # both zeros are one value
    rows = rows.withColumn("bucket", F.pmod(key, F.lit(per)) + F.col("idx") * per)

    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).toArrow()
    buckets, full = sizes["bucket"].to_numpy(), sizes["n"].to_numpy()
    owner = buckets // per

    def counted(chosen: np.ndarray) -> list[list[tuple]]:
        listed = rows
        if not chosen.all():  # at most one row a bucket
            listed = rows.join(F.broadcast(small_frame(df.sparkSession, [(b,) for b in buckets[chosen].tolist()], "bucket bigint")), "bucket", "left_semi")
        counts = listed.groupBy("idx", "value").agg(F.count(F.lit(1)).alias("n"))
        order = [F.desc("n"), F.asc("value")]
        if len(columns) == 1:
            first = counts.orderBy(*order).limit(n)
        else:
            first = counts.withColumn("rank", F.row_number().over(Window.partitionBy("idx").orderBy(*order))).where(F.col("rank") <= n).orderBy("idx", "rank")
        found: list[list[tuple]] = [[] for _ in columns]
        for row in first.collect():
            found[row["idx"]].append((row["value"], row["n"]))
        return found

    probed, needed = np.zeros(len(buckets), bool), np.zeros(len(buckets), bool)
    for i in range(len(columns)):
        mine = np.flatnonzero(owner == i)
        probed[mine[np.argsort(-full[mine], kind="stable")[: max(4 * n, PROBED)]]] = True
    best = counted(probed)
    for i, found in enumerate(best):
        needed |= (owner == i) & (full >= (found[-1][1] if len(found) == n else 1))
    if (needed & ~probed).any():
        best = counted(needed)
    return dict(zip(columns, best))
