"""Order-dependent work without moving a whole table into one task.

A table is cut into buckets that follow the wanted order. Split points come from a small
hash sample, so a bucket number is a plain expression of the row: it is the same after a
task is rerun, and no partition id or cached frame is involved. Windows run inside a
bucket; what a bucket needs from earlier ones (a few rows, a running sum, a last value)
is one small row per bucket.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablecraft.functions.columns import col, kind, micros
from tablecraft.session import freeze, small_frame

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 4096
SAMPLE_PER_BUCKET = 48
#: Types whose values JSON keeps as they are.
PLAIN = (T.IntegerType, T.LongType, T.DoubleType, T.StringType)
BUCKET, HALO, PIECE = "__bucket", "__halo", "__piece"


def bucket_total(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(1, min(MAX_BUCKETS, -(-rows // rows_per_bucket)))


def order_fields(df: DataFrame, order_by: Sequence[str]) -> list[Column]:
    """Comparable fields, missing values last (NULL flag first, then the value)."""
    out = []
    for i, name in enumerate(order_by):
        dtype = df.schema[name].dataType
        value = micros(col(name), dtype) if kind(dtype) == "datetime" else col(name)
        out += [F.isnull(col(name)).cast("int").alias(f"n{i}"), value.alias(f"v{i}")]
    return out


def sort_columns(order_by: Sequence[str]) -> list[Column]:
    return [col(n).asc_nulls_last() for n in order_by]


def split_points(df: DataFrame, order_by: Sequence[str], rows: int, buckets: int) -> list:
    """About ``buckets - 1`` evenly spread order tuples, from a bounded hash sample."""
    fields = order_fields(df, order_by)
    step = max(1, rows // (buckets * SAMPLE_PER_BUCKET))
    picked = (
        df.select(*fields)
        .where(F.pmod(F.xxhash64(*[F.col(f) for f in _names(order_by)]), F.lit(step)) == 0)
        .orderBy(*_names(order_by))
        .collect()
    )
    stride = max(1, len(picked) // buckets)
    return picked[stride::stride][: buckets - 1]


def _names(order_by: Sequence[str]) -> list[str]:
    return [f"{p}{i}" for i in range(len(order_by)) for p in ("n", "v")]


def bucket_column(df: DataFrame, order_by: Sequence[str], splits: list) -> Column:
    """Number of split points at or below the row's order tuple, by halving; the tuple is made once a row."""
    if not splits:
        return F.lit(0)
    fields = order_fields(df, order_by)
    types = df.select(*fields).schema

    def point(row) -> Column:
        return F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in types.fields])

    if all(isinstance(f.dataType, PLAIN) for f in types.fields) and all(map(math.isfinite, (v for r in splits for v in r if isinstance(v, float)))):
        # one literal for thousands of points, which are slow to make one by one
        points = F.from_json(F.lit(json.dumps([{f.name: r[f.name] for f in types.fields} for r in splits])), T.ArrayType(types))
    else:
        points = F.array(*[point(r) for r in splits])
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(splits).bit_length()))])

    def search(here: Column) -> Column:
        def further(at, step):
            # beyond the last point there is nothing, and a comparison with nothing is not true
            return F.when(F.get(points, at + step - 1) <= here, at + step).otherwise(at)

        return F.aggregate(steps, F.lit(0), further)

    return F.get(F.transform(F.array(F.struct(*fields)), search), F.lit(0))


def over_sorted(
    df: DataFrame,
    order_by: Sequence[str],
    build: Callable[[object], list[Column]],
    reach: int,
    partition_by: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add the columns of ``build(window)``; each may look back up to ``reach`` rows.

    ``order_by`` must end in a unique key. Without groups, or with a group that holds a
    large share of the rows, the sorted table is cut into buckets and every bucket is
    given the ``reach`` rows that precede it.
    """
    rows = df.count()
    buckets = bucket_total(rows, rows_per_bucket)
    if buckets == 1:
        groups = [col(c) for c in partition_by] or [F.lit(0)]
        window = Window.partitionBy(*groups).orderBy(*sort_columns(order_by))
        return df.select("*", *build(window))

    sequence = [*partition_by, *order_by]
    cut = df.withColumn(BUCKET, bucket_column(df, sequence, split_points(df, sequence, rows, buckets)))
    sizes = {r[0]: r[1] for r in cut.groupBy(BUCKET).count().collect()}
    # last `reach` rows of each bucket; the per-bucket limit is applied before the shuffle
    backwards = Window.partitionBy(BUCKET).orderBy(*[col(n).desc_nulls_first() for n in sequence])
    tails = cut.withColumn(PIECE, F.row_number().over(backwards)).where(F.col(PIECE) <= reach)
    needs = []
    ordered = sorted(sizes)
    for at, target in enumerate(ordered):
        wanted = reach
        for source in reversed(ordered[:at]):
            if wanted <= 0:
                break
            needs.append((source, min(wanted, sizes[source]), target))
            wanted -= sizes[source]
    if reach <= 0 or not needs:
        halo = None
    else:
        plan = small_frame(df.sparkSession, needs, "source int, take bigint, target int")
        halo = (
            tails.join(F.broadcast(plan), (F.col(BUCKET) == plan.source) & (F.col(PIECE) <= plan["take"]))
            .select(*[col(c) for c in df.columns], F.col("target").alias(BUCKET), F.lit(True).alias(HALO))
        )
    own = cut.withColumn(HALO, F.lit(False))
    work = own if halo is None else own.unionByName(halo)
    window = Window.partitionBy(BUCKET, *[col(c) for c in partition_by]).orderBy(*sort_columns(order_by))
    return work.select("*", *build(window)).where(~F.col(HALO)).drop(BUCKET, HALO)


def carry_fill(
    df: DataFrame,
    name: str,
    order_by: Sequence[str],
    forward: bool = True,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> Column | DataFrame:
    """Fill missing values of ``name`` with the nearest earlier (or later) one in order.

    A backward fill is a forward fill in reverse order: a frame that runs from a row to the end would be read again for every row.
    """
    rows = df.count()
    buckets = bucket_total(rows, rows_per_bucket)
    upto = (Window.unboundedPreceding, 0)
    sequence = sort_columns(order_by) if forward else [col(n).desc_nulls_first() for n in order_by]

    def filled(window) -> Column:
        return F.last(col(name), ignorenulls=True).over(window.rowsBetween(*upto))

    if buckets == 1:
        window = Window.partitionBy(F.lit(0)).orderBy(*sequence)
        return df.select(*[filled(window).alias(c) if c == name else col(c) for c in df.columns])

    cut = df.withColumn(BUCKET, bucket_column(df, order_by, split_points(df, order_by, rows, buckets)))
    place = F.struct(*order_fields(df, order_by))
    edge = F.max_by if forward else F.min_by
    known = F.when(col(name).isNotNull(), place)
    per_bucket = cut.groupBy(BUCKET).agg(edge(col(name), known).alias(PIECE))
    across = Window.partitionBy(F.lit(0)).orderBy(BUCKET if forward else F.desc(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    # at most MAX_BUCKETS rows, so this window and the broadcast stay small
    carried = per_bucket.select(BUCKET, F.last(F.col(PIECE), ignorenulls=True).over(across).alias(PIECE))
    window = Window.partitionBy(BUCKET).orderBy(*sequence)
    joined = cut.join(F.broadcast(carried), BUCKET)
    return joined.select(*[
        F.coalesce(filled(window), F.col(PIECE)).alias(c) if c == name else col(c) for c in df.columns
    ])


def running_sums(
    rows_frame: DataFrame,
    order: str,
    sums: Sequence[str],
    keys: Sequence[str] = (),
    at_most: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``upto_<s>`` (inclusive running sum in ``order``) and ``all_<s>`` (total) per key.

    ``rows_frame`` holds one row per (keys, order). ``at_most`` is a known bound on its
    size, which saves counting it. Any key may own most rows: cells are (key, bucket).
    """
    bound = at_most if at_most is not None else None
    if bound is None or bound > rows_per_bucket:
        rows_frame = freeze(rows_frame)
        bound = rows_frame.count()
    buckets = bucket_total(bound, rows_per_bucket)
    groups = [col(k) for k in keys]
    if buckets == 1:
        whole = Window.partitionBy(*(groups or [F.lit(0)]))
        window = whole.orderBy(col(order)).rowsBetween(Window.unboundedPreceding, 0)
        return rows_frame.select(
            "*",
            *[F.sum(col(s)).over(window).alias(f"upto_{s}") for s in sums],
            *[F.sum(col(s)).over(whole).alias(f"all_{s}") for s in sums],
        )
    splits = split_points(rows_frame, [order], bound, buckets)
    cut = rows_frame.withColumn(BUCKET, bucket_column(rows_frame, [order], splits))
    cells = cut.groupBy(*groups, BUCKET).agg(*[F.sum(col(s)).alias(s) for s in sums])
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    before = whole.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    carry = cells.select(
        *groups, BUCKET,
        *[F.coalesce(F.sum(col(s)).over(before), F.lit(0)).cast(cells.schema[s].dataType).alias(f"in_{s}") for s in sums],
        *[F.sum(col(s)).over(whole).alias(f"all_{s}") for s in sums],
        F.lit(0).alias(PIECE),
    )
    own = cut.select("*", *[col(s).cast(cells.schema[s].dataType).alias(f"in_{s}") for s in sums], F.lit(1).alias(PIECE))
    cell = Window.partitionBy(*groups, BUCKET).orderBy(F.col(PIECE), col(order))
    work = own.unionByName(carry, allowMissingColumns=True)
    upto = cell.rowsBetween(Window.unboundedPreceding, 0)
    out = work.select(
        *[col(c) for c in rows_frame.columns], F.col(PIECE),
        *[F.sum(F.col(f"in_{s}")).over(upto).alias(f"upto_{s}") for s in sums],
        *[F.first(F.col(f"all_{s}"), ignorenulls=True).over(upto).alias(f"all_{s}") for s in sums],
    )
    return out.where(F.col(PIECE) == 1).drop(PIECE)


def value_ranks(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    weight: str | None = None,
    rows: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per (keys, distinct value): ``n``, ``upto_n``, ``all_n``; NULL values left out.

    Counting first means repeated values are combined before the shuffle.
    """
    count = F.count(F.lit(1)) if weight is None else F.sum(col(weight))
    counted = df.where(col(value).isNotNull()).groupBy(*[col(k) for k in keys], col(value)).agg(count.alias("n"))
    return running_sums(counted, value, ["n"], keys, rows if rows is not None else df.count(), rows_per_bucket)
