"""Forests and boosting over cells: trees see bins of the features only, so rows in the same bins are summed to one row.

Split points come from a sample of rows as in Spark's own trees, which also cut a feature into at most 32 bins. The bins then
name a cell, and the trees are Spark's, fitted to the cells with their weight. Boosting is the same by this: the score of a
row depends on its cell, and a regression's gains on the cell's mean. A forest's bootstrap is still drawn for each row and tree.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, TaskContext, keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml import classification as C, regression as R
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from tablecraft.session import scratch_path

#: Bins of a feature and rows that choose their limits, as in Spark's trees.
BINS, SAMPLED = 32, 10_000
#: Smaller tables are left to Spark's trees, as are those with fewer rows to a possible cell.
MANY_ROWS, ROWS_A_CELL = 1_000_000, 16
#: Possible cells of a regression forest, and sums that a task keeps at a time (two for each cell and tree).
MOST_CELLS, TASK_SUMS = 131_072, 2**23
#: Rows that are drawn together; trees that grow at the same time.
PART_ROWS, TOGETHER = 131_072, 8


def limits_of(values: np.ndarray, weights: np.ndarray) -> list[float]:
    """Between all values where they are few, else at about equal shares of the weight."""
    found, place = np.unique(values, return_inverse=True)
    middle = ((found[1:] + found[:-1]) / 2).tolist()
    if len(middle) < BINS:
        return middle
    seen, step = np.cumsum(np.bincount(place, weights)), weights.sum() / BINS
    out, aim = [], step
    for i, limit in enumerate(middle):
        if abs(seen[i] - aim) < abs(seen[i + 1] - aim):
            out.append(limit)
            aim += step
    return out


def binned(df: DataFrame, limits: list[list[float]]) -> tuple[DataFrame, list[Column]]:
    """``df`` with column ``__values`` as bin numbers: a value at a limit is below it, as it goes left in a tree."""
    places = [i for i, each in enumerate(limits) if each]
    wide = df.select("*", *[F.col("__values")[i].alias(f"__v{i}") for i in places])
    if places:
        splits = [[-math.inf, *(np.nextafter(each, math.inf).tolist()), math.inf] for each in (limits[i] for i in places)]
        wide = Bucketizer(splitsArray=splits, inputCols=[f"__v{i}" for i in places], outputCols=[f"__b{i}" for i in places], handleInvalid="keep").transform(wide)
    return wide, [F.col(f"__b{i}") if each else F.lit(0.0) for i, each in enumerate(limits)]


class Bins(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A vector of bin numbers from the vector of features."""

    limits = Param(Params._dummy(), "limits", "upper limits of each feature's bins but the last, as JSON", TypeConverters.toString)
    inputCol = Param(Params._dummy(), "inputCol", "vector of features", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "vector of bin numbers", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, limits: str = "[]", inputCol: str = "features", outputCol: str = "__bins"):
        super().__init__()
        self._setDefault(limits="[]", inputCol="features", outputCol="__bins")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns = dataset.columns
        wide, numbers = binned(dataset.withColumn("__values", vector_to_array(self.getOrDefault("inputCol"))), json.loads(self.getOrDefault("limits")))
        return wide.select(*[F.col(f"`{c}`") for c in columns], array_to_vector(F.array(*numbers)).alias(self.getOrDefault("outputCol")))


@dataclass
class Cells:
    """Limits of the bins of each feature; a cell's number is made of its bins."""

    limits: list[list[float]]
    features: str

    @property
    def possible(self) -> int:
        return math.prod(len(x) + 1 for x in self.limits)

    def numbered(self, dataset: DataFrame, *columns: Column) -> DataFrame:
        names = [f"__c{i}" for i in range(len(columns))]
        wide, numbers = binned(dataset.select(vector_to_array(self.features).alias("__values"), *[c.alias(n) for c, n in zip(columns, names)]), self.limits)
        cell = F.lit(0).cast("bigint")
        for each, number in zip(self.limits, numbers):
            # a missing number has a bin of its own in Spark's bucketing; here it shares the last
            cell = cell * (len(each) + 1) + F.least(number, F.lit(float(len(each)))).cast("bigint")
        return wide.select(cell.alias("cell"), *names)

    def bins(self) -> Column:
        """The vector of bins of column ``cell``."""
        parts, left = [], self.possible
        for each in self.limits:
            left //= len(each) + 1
            parts.append((F.floor(F.col("cell") / left) % (len(each) + 1)).cast("double"))
        return array_to_vector(F.array(*parts))

    def model(self, made) -> PipelineModel:
        return PipelineModel([Bins(limits=json.dumps(self.limits), inputCol=self.features), made.setFeaturesCol("__bins")])

    @property
    def tree(self) -> dict:
        """So many bins that Spark looks at all cells for the limits between them."""
        return {"featuresCol": "__bins", "maxBins": max(BINS, min(1000, math.isqrt(self.possible) + 1))}


def cells_of(dataset: DataFrame, rows: int, classes: int = 1, features: str = "features", most: int | None = None, weight: str | None = None) -> Cells | None:
    """None where the rows are too few for the possible cells to be much fewer."""
    if rows < MANY_ROWS:
        return None
    w = F.col(weight) if weight else F.lit(1.0)
    sample = dataset.select(vector_to_array(features).alias("v"), w.cast("double").alias("w")).sample(min(1.0, SAMPLED / rows), seed=42).collect()
    weights = np.array([r["w"] for r in sample])
    limits = [limits_of(np.array(x), weights) for x in zip(*(r["v"] for r in sample))]
    made = Cells(limits, features)
    return made if limits and made.possible * classes <= min(rows / ROWS_A_CELL, most or rows) else None


def boosted_cells(dataset: DataFrame, cells: Cells, task: str, weight: str | None, **settings) -> PipelineModel:
    """Spark's boosting, fitted to one row for each cell (and class) with its weight."""
    w = F.col(weight) if weight else F.lit(1.0)
    numbered = cells.numbered(dataset, F.col("label"), w.cast("double")).toDF("cell", "label", "w")
    if task == "classification":
        alike = numbered.groupBy("cell", "label").agg(F.sum("w").alias("w"))
        made = C.GBTClassifier(weightCol="w", **cells.tree, **settings)
    else:
        alike = numbered.groupBy("cell").agg((F.sum(F.col("label") * F.col("w")) / F.sum("w")).alias("label"), F.sum("w").alias("w"))
        made = R.GBTRegressor(weightCol="w", **cells.tree, **settings)
    return cells.model(made.fit(_stored(alike, "boosted").select(cells.bins().alias("__bins"), "label", "w")))


def forest_of_cells(dataset: DataFrame, cells: Cells, task: str, weight: str | None, trees: int, seed: int, classes: int = 0, label: str = "label", **tree) -> PipelineModel:
    """A forest whose trees are fitted one by one to the cells, each with the weights of its own bootstrap."""
    if task == "classification":
        w = F.col(weight) if weight else F.lit(1.0)
        counts = cells.numbered(dataset, F.col(label).cast("double"), w.cast("double")).toDF("cell", "label", "w").groupBy("cell", "label").agg(F.count("*").alias("n"), F.avg("w").alias("w"))
        tables = [_stored(_drawn_classes(counts, trees, seed), "drawn")]
        per_table = trees
    else:
        passes = -(-2 * trees * cells.possible // TASK_SUMS)
        per_table = -(-trees // passes)
        values = cells.numbered(dataset, F.col(label).cast("double")).toDF("cell", "label")
        tables = [_stored(_drawn_sums(values, cells.possible, min(per_table, trees - first), seed + first), "drawn") for first in range(0, trees, per_table)]

    def grow(number: int):
        table, t = tables[number // per_table], number % per_table
        if task == "classification":
            # the classes are told, since a rare one may not be drawn
            aim = table.select(cells.bins().alias("__bins"), F.col("label").alias("label", metadata={"ml_attr": {"type": "nominal", "name": "label", "num_vals": classes}}), F.col(f"w{t}").alias("w"))
            made = C.RandomForestClassifier(featureSubsetStrategy="sqrt", numTrees=1, bootstrap=False, weightCol="w", seed=seed + number, **cells.tree, **tree)
        else:
            aim = table.select(cells.bins().alias("__bins"), (F.col(f"y{t}") / F.col(f"w{t}")).alias("label"), F.col(f"w{t}").alias("w"))
            made = R.RandomForestRegressor(featureSubsetStrategy="onethird", numTrees=1, bootstrap=False, weightCol="w", seed=seed + number, **cells.tree, **tree)
        return made.fit(aim.filter("w > 0")).trees[0]

    with ThreadPoolExecutor(TOGETHER) as pool:
        grown = list(pool.map(grow, range(trees)))
    return cells.model(_together(grown, len(cells.limits), classes))


def _together(grown: list, width: int, classes: int):
    """The trees as one forest of Spark's."""
    context = SparkContext.getOrCreate()
    ml = context._jvm.org.apache.spark.ml
    kind = ml.classification.DecisionTreeClassificationModel if classes else ml.regression.DecisionTreeRegressionModel
    trees = context._gateway.new_array(kind, len(grown))
    for i, one in enumerate(grown):
        trees[i] = one._java_obj
    if classes:
        return C.RandomForestClassificationModel(ml.classification.RandomForestClassificationModel("forest", trees, width, classes))._set(numTrees=len(grown))
    # the mean over the trees divides by this parameter
    return R.RandomForestRegressionModel(ml.regression.RandomForestRegressionModel("forest", trees, width))._set(numTrees=len(grown))


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _drawn_classes(counts: DataFrame, trees: int, seed: int) -> DataFrame:
    """(cell, label, w0, w1, ...): weight of the rows drawn for each tree. A sum of n Poisson draws is one draw of n times the mean."""
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            n, w = (batch[x].to_numpy() for x in ("n", "w"))
            drawn = rng.poisson(n, (trees, len(n))) * w
            yield pa.RecordBatch.from_arrays([batch["cell"], batch["label"], *map(pa.array, drawn)], ["cell", "label", *(f"w{t}" for t in range(trees))])

    return counts.sortWithinPartitions("cell", "label").mapInArrow(draw, "cell bigint, label double, " + ", ".join(f"w{t} double" for t in range(trees)))


def _summed(cells: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(cells, kind="stable")
    found, starts = np.unique(cells[order], return_index=True)
    return found, np.add.reduceat(values[order], starts, axis=0)


def _long_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells and labels of some 100,000 rows at a time, so that rows of a cell meet."""
    held: list[pa.RecordBatch] = []

    def part() -> tuple[np.ndarray, np.ndarray]:
        whole = pa.Table.from_batches(held)
        held.clear()
        return whole["cell"].to_numpy(), whole["label"].to_numpy()

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PART_ROWS:
            yield part()
    if sum(b.num_rows for b in held):
        yield part()


def _drawn_sums(values: DataFrame, possible: int, trees: int, seed: int) -> DataFrame:
    """(cell, w0, y0, w1, y1, ...): for each tree the rows drawn and the sum of their labels; every row is drawn Poisson(1) times."""
    names = [f"{x}{t}" for x in "wy" for t in range(trees)]
    schema = "cell bigint, " + ", ".join(f"{n} double" for n in names)

    def batches_of(cells: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(cells), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(cells[i : i + 4096]), *map(pa.array, np.ascontiguousarray(sums[i : i + 4096].T))], ["cell", *names])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        sums = np.zeros((2 * trees, possible))
        for numbers, labels in _long_parts(batches):
            order = np.argsort(numbers, kind="stable")
            found, at = np.unique(numbers[order], return_inverse=True)
            labels = labels[order]
            for t in range(trees):
                drawn = rng.poisson(1.0, len(at)).astype(np.float64)
                sums[t, found] += np.bincount(at, drawn)
                sums[trees + t, found] += np.bincount(at, drawn * labels)
        seen = np.flatnonzero(sums[:trees].any(axis=0))
        for i in range(0, len(seen), 4096):
            yield from batches_of(seen[i : i + 4096], sums[:, seen[i : i + 4096]].T)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, sums = np.zeros(0, np.int64), np.zeros((0, 2 * trees))
        for batch in batches:
            more = np.column_stack([batch[n].to_numpy() for n in names])
            cells, sums = _summed(np.concatenate([cells, batch["cell"].to_numpy()]), np.concatenate([sums, more])) if batch.num_rows else (cells, sums)
        yield from batches_of(cells, sums)

    return values.mapInArrow(draw, schema).repartition(values.sparkSession.sparkContext.defaultParallelism, "cell").mapInArrow(add, schema)
