"""Exact k nearest neighbours as a partitioned join.

Training rows are assigned to the nearest of a bounded set of pivots. For a query row the
pivot distances and cell radii bound the distance of its k-th neighbour, so only cells that
can hold a nearer row are visited (triangle inequality: nothing is lost). Small cells share a
page, so that a query that reaches many cells is sent to few pages; a page with many rows is
split into blocks of bounded size, as are its queries. Each task compares one block with one
chunk of queries and passes on k candidates per query, which travel as numbers without their vectors.

Within a task products in single precision, whose error is bounded, tell which rows may be among
the k nearest; only their distances are taken, in double precision from the differences.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window, functions as F

from tablecraft.session import freeze, scratch_path

MAX_PIVOTS = 512
#: Rows and bytes of a block, and of a chunk of queries; a chunk is shorter where cores would idle.
BLOCK_ROWS, BLOCK_BYTES = 65_536, 2**25
LEAST_CHUNK, GROUPS_PER_CORE = 2048, 4
#: A task compares so many pairs at a time: queries by rows, and as many in double precision.
SOME_QUERIES, SOME_ROWS, PAIRS = 1024, 4096, 4_000_000
#: Half the distance between 1 and the next number in single precision; candidates per neighbour that are worth sorting out.
ULP, MOST_CANDIDATES = 2.0**-24, 64


MOST_TASKS = 2000
FOUND = {"id": pa.int64(), "distance": pa.float64(), "label": pa.float64(), "h": pa.int64(), "n": pa.int64()}


class _Shared(Params):
    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    task = Param(Params._dummy(), "task", "classification or regression", TypeConverters.toString)
    table = Param(Params._dummy(), "table", "where the training vectors were written", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)


class NearestNeighbours(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, k: int = 5, task: str = "classification"):
        super().__init__()
        self._setDefault(k=5, task="classification", table="", classes=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "NearestNeighboursModel":
        path = scratch_path(dataset.sparkSession, "neighbours")
        # copies of a row are kept once with their number, so no value can flood a task
        rows = dataset.select(vector_to_array("features").alias("v"), F.col("label").cast("double").alias("label"))
        rows.groupBy("v", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("v", "label")).write.parquet(path)
        classes = 0
        if self.getOrDefault("task") == "classification":
            classes = int(dataset.agg(F.max("label")).head()[0]) + 1
        model = NearestNeighboursModel()
        model._set(table=path, classes=classes)
        return self._copyValues(model)


class NearestNeighboursModel(Model, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self):
        super().__init__()
        self._setDefault(k=5, task="classification", table="", classes=0)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark = dataset.sparkSession
        # equal vectors have equal neighbours, so they are searched once and joined back by value
        queries = dataset.select(vector_to_array("features").alias("q")).distinct()
        queries = numbered(queries)
        near = nearest_of(spark.read.parquet(self.getOrDefault("table")), queries, self.getOrDefault("k"))
        if self.getOrDefault("task") == "regression":
            found = near.groupBy("id").agg((F.sum(F.col("label") * F.col("n")) / F.sum("n")).alias("prediction"))
        else:
            votes = near.groupBy("id", "label").agg(F.sum("n").alias("n"))
            best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("label").alias("label")))
            shares = F.map_from_entries(F.collect_list(F.struct(F.col("label").cast("int"), "n")))
            total = F.sum("n")
            found = votes.groupBy("id").agg(best.alias("best"), shares.alias("shares"), total.alias("total")).select(
                "id", F.col("best.label").alias("prediction"),
                F.transform(F.sequence(F.lit(0), F.lit(max(0, self.getOrDefault("classes") - 1))),
                            lambda c: F.coalesce(F.try_element_at("shares", c), F.lit(0)) / F.col("total")).alias("probability"))
        found = found.join(queries, "id").drop("id").withColumnRenamed("q", "__query")
        return dataset.withColumn("__query", vector_to_array("features")).join(found, "__query", "left").drop("__query")


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)


def _in_order(row: np.ndarray, to: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k smallest of each row, earlier ones first where they are equal to 12 digits."""
    d = np.round(d, 12)
    order = np.lexsort((to, d, row))
    row, to, d = row[order], to[order], d[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], to[kept], d[kept]


def _closest_plain(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All distances in double precision."""
    squares = _squares(a, b)
    squares = np.where(np.isnan(squares), np.inf, np.maximum(squares, 0.0, out=squares)) if np.isnan(squares).any() else np.maximum(squares, 0.0, out=squares)
    if k < len(b):
        # rounded distances are equal within 1e-12, so a little more than the k-th distance is let through
        limit = (np.sqrt(np.partition(squares, k - 1, axis=1)[:, k - 1:k]) + 2e-12) ** 2 * (1 + 1e-12)
        row, to = np.nonzero(squares <= limit)
    else:
        row, to = (x.ravel() for x in np.indices(squares.shape))
    return _in_order(row, to, np.sqrt(squares[row, to]), k)


def _candidates(a: np.ndarray, tiles: list[np.ndarray], scale: float, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(row of ``a``, row of all tiles): pairs that may be among the k nearest. None if there are too many to be worth it.

    A tile holds rows shifted and divided by ``scale``, at most 1 long, and their squared lengths, so that one product with (-2 a, 1) is
    the squared distance less that of ``a``.
    """
    length = np.sqrt((a * a).sum(1))
    sides = np.concatenate([-2.0 * a, np.ones((len(a), 1))], axis=1).astype(np.float32)
    # rounded entries and the sum of their products are off by at most this
    off = (a.shape[1] + 8) * ULP * (2.0 * length + 1.0) * 1.01 + 1e-30

    def limit_of(kth: np.ndarray) -> np.ndarray:
        """Where a row whose rounded distance is not beyond the k-th may be in single precision, given one at most as near as the k-th."""
        far = (np.sqrt(np.maximum(kth + off + length * length, 0.0)) + 2e-12 / scale) ** 2 * (1 + 1e-12)
        return far - length * length + off + 1e-12

    limit, found, seen = None, [], 0
    for number, tile in enumerate(tiles):
        near = sides @ tile.T
        if limit is None:
            limit = limit_of(np.partition(near, k - 1, axis=1)[:, k - 1].astype(float))
            bar = np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None]
        at = np.flatnonzero(near <= bar)
        seen += len(at)
        if seen > MOST_CANDIDATES * len(tiles) * k * len(a):
            return None
        row, to = np.divmod(at, near.shape[1])
        found.append((row, to + number * SOME_ROWS, near.ravel()[at].astype(float)))
    row, to, near = (np.concatenate(part) for part in zip(*found))
    order = np.lexsort((near, row))
    row, to, near = row[order], to[order], near[order]
    # every row of ``a`` has k candidates at least, those of the first tile
    kept = near <= limit_of(near[np.searchsorted(row, np.arange(len(a))) + k - 1])[row]
    row, to = row[kept], to[kept]
    return (row, to) if len(row) <= MOST_CANDIDATES * k * len(a) else None


def _closest(a: np.ndarray, b: np.ndarray, k: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the row of ``a``, from ``first`` on, row of ``b``, distance to 12 digits) of the k nearest, earlier rows of ``b`` first."""
    parts, tiles = [], []
    known = np.isfinite(b).all(axis=1)
    if k <= min(int(known.sum()), SOME_ROWS) // 4:
        with np.errstate(all="ignore"):
            shift = b[known].mean(axis=0)
            scale = float(np.sqrt(((b[known] - shift) ** 2).sum(1).max()))
        if 1e-100 < scale < 1e100:
            moved = np.where(known[:, None], (b - shift) / scale, 0.0)
            # a row with a missing or infinite number is nearer than none
            moved = np.concatenate([moved, np.where(known, (moved * moved).sum(1), np.inf)[:, None]], axis=1).astype(np.float32)
            tiles = [moved[i : i + SOME_ROWS] for i in range(0, len(b), SOME_ROWS)]
    at = 0
    while at < len(a):
        size = min(SOME_QUERIES, len(a) - at)
        some, pairs = a[at : at + size], None
        if tiles:
            sides = (some - shift) / scale
            if (np.abs(sides) < 1e6).all():
                pairs = _candidates(sides, tiles, scale, k)
        if pairs is None:
            size = min(size, max(1, PAIRS // max(1, len(b))))
            row, to, d = _closest_plain(a[at : at + size], b, k)
        else:
            # equal vectors are at distance 0, which lengths and products give but roughly
            apart = some[pairs[0]] - b[pairs[1]]
            row, to, d = _in_order(*pairs, np.sqrt((apart * apart).sum(1)), k)
        parts.append((row + at + first, to, d))
        at += size
    return tuple(np.concatenate(part) for part in zip(*parts))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; missing numbers are nan."""
    lists = column.combine_chunks()
    lengths = pc.unique(pc.list_value_length(lists))
    if len(lengths) != 1 or lengths[0].as_py() is None:
        raise ValueError("vectors of different lengths")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def numbered(queries: DataFrame) -> DataFrame:
    """(id, q) of distinct query vectors, kept, so that the numbers stay what they are."""
    return freeze(queries.select(F.monotonically_increasing_id().alias("id"), "q"))


def nearest(train: DataFrame, queries: DataFrame, k: int, block_rows: int | None = None, query_chunk: int | None = None) -> DataFrame:
    """(q, distance, label, n): the k nearest training rows of every distinct query vector, see :func:`nearest_of`."""
    queries = numbered(queries)
    return nearest_of(train, queries, k, block_rows, query_chunk).join(queries, "id").select("q", "distance", "label", "n")


def nearest_of(train: DataFrame, queries: DataFrame, k: int, block_rows: int | None = None, query_chunk: int | None = None) -> DataFrame:
    """(id, distance, label, n): the k nearest training rows of every query (id, q).

    ``train`` holds (h, v, label, n): distinct rows with the number of their copies.
    """
    spark = train.sparkSession
    size = train.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("copies")).head()
    rows = size["rows"]
    if size["copies"] < k:
        raise ValueError(f"{k} neighbours need as many training rows, got {size['copies']}")
    wanted = int(min(MAX_PIVOTS, max(1, math.sqrt(rows) // 4)))
    picked = train.orderBy(F.xxhash64("h", F.lit(7)), "h").limit(wanted) if rows < 5_000_000 else train.where(
        F.pmod(F.xxhash64("h", F.lit(7)), F.lit(rows // (wanted * 4))) == 0).limit(wanted)
    pivots = np.unique(np.array([r["v"] for r in picked.select("v").collect()], dtype=float), axis=0)
    shared = spark.sparkContext.broadcast(pivots)  # at most MAX_PIVOTS vectors
    most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(1, pivots.shape[-1]))))
    block_rows = block_rows or most

    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(_squares(a, b), 0.0))

    @F.pandas_udf("cell int, away double")
    def cell_of(v: pd.Series) -> pd.DataFrame:
        d = distances(np.array(v.tolist(), dtype=float), shared.value)
        at = d.argmin(1)
        return pd.DataFrame({"cell": at.astype("int32"), "away": d[np.arange(len(at)), at]})

    placed = freeze(train.withColumn("c", cell_of("v")).select("h", "v", "label", "n", "c.cell", "c.away"))
    sizes = {r["cell"]: (r["n"], r["radius"], r["rows"]) for r in placed.groupBy("cell").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("away").alias("radius")).collect()}
    cells = np.array(sorted(sizes))
    counts = np.array([sizes[c][0] for c in cells])
    radius = np.array([sizes[c][1] for c in cells])

    pages, filled = [], block_rows  # neighbouring cells fill a page one after the other
    for c in cells:
        if not pages or filled + sizes[c][2] > block_rows:
            pages.append([])
            filled = 0
        pages[-1].append(int(c))
        filled += sizes[c][2]
    page_of = np.array([i for i, page in enumerate(pages) for _ in page], dtype="int32")

    @F.pandas_udf("array<int>")
    def reachable(q: pd.Series) -> pd.Series:
        d = distances(np.array(q.tolist(), dtype=float), shared.value[cells])
        far, close = d + radius, d - radius
        order = far.argsort(1)
        enough = (counts[order].cumsum(1) >= k).argmax(1)
        line = np.arange(len(d))
        limit = far[line, order[line, enough]] * (1 + 1e-9) + 1e-9
        return pd.Series([np.unique(page_of[c <= m]).tolist() for c, m in zip(close, limit)])

    blocks = {i: max(1, -(-sum(sizes[c][2] for c in page) // block_rows)) for i, page in enumerate(pages)}
    page_map = F.create_map(*[F.lit(x) for i, page in enumerate(pages) for c in page for x in (c, i)])
    block_map = F.create_map(*[F.lit(x) for item in blocks.items() for x in item])
    searches = queries.select("id", "q", F.explode(reachable("q")).alias("page"))
    asked = {r["page"]: r["count"] for r in searches.groupBy("page").count().collect()}
    cores = spark.sparkContext.defaultParallelism
    if query_chunk is None:
        query_chunk = max(LEAST_CHUNK, min(most, -(-sum(asked.get(i, 0) * n for i, n in blocks.items()) // (GROUPS_PER_CORE * cores))))
    parts = {i: max(1, -(-asked.get(i, 0) // query_chunk)) for i in blocks}
    chunks = F.create_map(*[F.lit(x) for item in parts.items() for x in item])[F.col("page")]
    left = searches.withColumn("chunk", F.pmod(F.xxhash64("q"), chunks).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), block_map[F.col("page")] - 1)))
    paged = placed.withColumn("page", page_map[F.col("cell")])
    right = paged.withColumn("block", F.pmod(F.col("h"), block_map[F.col("page")]).cast("int")).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), chunks - 1))).select("page", "block", "chunk", "h", "v", "label", "n")

    def compare(q: pa.Table, t: pa.Table) -> pa.Table:
        if not (q.num_rows and t.num_rows):
            return pa.table({c: pa.array([], kind) for c, kind in FOUND.items()})
        h = t["h"].to_numpy()
        order = np.argsort(h, kind="stable")  # of rows equally far, the first are those with the smallest h
        at, to, d = _closest(_vectors(q["q"]), _vectors(t["v"])[order], k, 0)
        to = order[to]
        return pa.table([q["id"].to_numpy()[at], d, *(t[c].to_numpy()[to] for c in ("label", "h", "n"))], schema=pa.schema(list(FOUND.items())))

    grouping = ["page", "block", "chunk"]
    # more tasks than groups, so that few tasks get two
    tasks = min(MOST_TASKS, 4 * sum(n * parts[i] for i, n in blocks.items()))
    found = left.repartition(tasks, *grouping).groupBy(*grouping).cogroup(right.repartition(tasks, *grouping).groupBy(*grouping)).applyInArrow(
        compare, "id bigint, distance double, label double, h bigint, n bigint")
    nearer = Window.partitionBy("id").orderBy("distance", "h").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(nearer), F.lit(0))
    return found.withColumn("before", before).where(F.col("before") < k).select(
        "id", "distance", "label", F.least(F.col("n"), k - F.col("before")).alias("n"))
