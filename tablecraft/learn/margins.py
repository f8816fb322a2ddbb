"""Support vector machines with a Gaussian kernel and probabilities: random Fourier features, linear machines, Platt scaling."""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml import classification as C
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from tablecraft.session import dealt

KERNELS = ("rbf", "linear")
#: A sigmoid is fitted on margins of each of so many folds, from machines that were fitted without it.
PLATT_FOLDS = 2
#: Up to so many bytes of mapped rows, the fits of a machine run at the same time.
TOGETHER_BYTES = 2**29
#: Rows that are mapped together when margins are taken.
MAPPED_ROWS = 2048


def fourier(rows: np.ndarray, gamma: float, count: int, seed: int) -> np.ndarray:
    """``count`` numbers for each row, see :class:`FourierFeatures`."""
    half = count // 2
    angles = rows @ (np.random.default_rng(seed).normal(size=(rows.shape[1], half)) * np.sqrt(2 * gamma))
    return np.concatenate([np.cos(angles), np.sin(angles)], axis=1) / np.sqrt(half)


class FourierFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Maps ``features`` to ``count`` numbers whose inner products estimate the kernel exp(-gamma |x - y|^2).

    Pairs cos(w x), sin(w x) for count / 2 directions w drawn from a normal distribution of variance 2 gamma. The estimate has no bias
    and, for kernel value k, a standard error of at most (1 - k^2) / sqrt(count). Directions follow from the seed.
    """

    gamma = Param(Params._dummy(), "gamma", "width of the kernel", TypeConverters.toFloat)
    count = Param(Params._dummy(), "count", "number of features made", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the directions", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, gamma: float = 1.0, count: int = 512, seed: int = 42):
        super().__init__()
        self._setDefault(gamma=1.0, count=512, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma, count, seed = self.getOrDefault("gamma"), self.getOrDefault("count"), self.getOrDefault("seed")

        def mapped(x: pd.Series) -> pd.Series:
            return pd.Series(list(fourier(np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1)), gamma, count, seed)))

        made = F.pandas_udf(mapped, "array<double>")(vector_to_array("features"))
        return dataset.withColumn("__kernel", array_to_vector(made))


class Margins(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``rawPrediction`` (a margin per class), ``probability`` (Platt's sigmoid, scaled to sum to 1) and ``prediction`` (largest margin)."""

    machines = Param(Params._dummy(), "machines", "weights, intercept and sigmoid of each class as JSON", TypeConverters.toString)
    source = Param(Params._dummy(), "source", "column of the vectors", TypeConverters.toString)
    kernel = Param(Params._dummy(), "kernel", "gamma, count and seed of the Fourier features that the weights are for as JSON, empty for none", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, machines: str = "[]", source: str = "features", kernel: str = ""):
        super().__init__()
        self._setDefault(machines="[]", source="features", kernel="")
        self._set(**self._input_kwargs)

    @property
    def coefficientMatrix(self) -> DenseMatrix:
        if self.getOrDefault("source") != "features" or self.getOrDefault("kernel"):
            raise AttributeError("a kernel machine has no weight per feature")
        w = np.array([m["w"] for m in json.loads(self.getOrDefault("machines"))])
        return DenseMatrix(*w.shape, w.ravel().tolist(), True)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        machines, source = json.loads(self.getOrDefault("machines")), self.getOrDefault("source")
        w, b = np.array([m["w"] for m in machines]), np.array([m["b"] for m in machines])
        kernel = json.loads(self.getOrDefault("kernel") or "null")

        def margins(x: pd.Series) -> pd.Series:
            found = []
            for i in range(0, len(x), MAPPED_ROWS):
                # mapped rows are long, so they stay in the task and are few at a time
                rows = np.stack(x.iloc[i : i + MAPPED_ROWS].to_numpy())
                found.extend((fourier(rows, **kernel) if kernel else rows) @ w.T + b)
            return pd.Series(found, dtype=object)

        raw = dataset.withColumn("rawPrediction", F.pandas_udf(margins, "array<double>")(vector_to_array(source)))
        # two classes share one machine: its margin is that of the second class
        each = F.col("rawPrediction") if len(machines) > 1 else F.array(-F.col("rawPrediction")[0], F.col("rawPrediction")[0])
        slopes, shifts = [m["slope"] for m in machines], [m["shift"] for m in machines]
        if len(machines) == 1:
            slopes, shifts = [slopes[0]] * 2, [-shifts[0], shifts[0]]
        raw = raw.withColumn("rawPrediction", each)
        sure = F.array(*[1 / (1 + F.exp(-(F.col("rawPrediction")[k] * slope + shift))) for k, (slope, shift) in enumerate(zip(slopes, shifts))])
        scored = raw.withColumn("probability", sure)
        total = F.aggregate("probability", F.lit(0.0), lambda t, p: t + p)
        scored = scored.withColumn("probability", F.transform("probability", lambda p: F.when(total > 0, p / total).otherwise(1.0 / len(slopes))))
        best = (F.array_position("rawPrediction", F.array_max("rawPrediction")) - 1).cast("double")
        return scored.withColumn("prediction", best).drop("__kernel")


def scale_gamma(dataset: DataFrame, n: str | None = None) -> float:
    """1 / (number of features * variance of all their values). Column ``n`` holds numbers of equal rows, if given."""
    each = F.col(n).cast("double") if n else F.lit(1.0)
    row = dataset.select(Summarizer.metrics("mean", "variance").summary(F.col("features"), each).alias("s"), F.sum(each).alias("n"), F.sum(each * each).alias("n2")).head()
    mean, rows = row["s"]["mean"].toArray(), row["n"]
    # the summary divides by rows - n2 / rows
    second = row["s"]["variance"].toArray() * (rows - row["n2"] / rows) / rows + mean**2
    variance = second.mean() - mean.mean() ** 2
    return float(1 / (len(mean) * variance)) if variance > 0 else 1.0


def _sigmoid(margins: DataFrame) -> tuple[float, float]:
    """Slope and shift of Platt's sigmoid over (margin, hit, n equal rows), with his smoothed targets."""
    hit, n = F.col("hit") == 1, F.col("n")
    rows = margins.agg(F.coalesce(F.sum(F.when(hit, n)), F.lit(0)).alias("pos"), F.coalesce(F.sum(F.when(~hit, n)), F.lit(0)).alias("neg")).head()
    high, low = (rows["pos"] + 1) / (rows["pos"] + 2), 1 / (rows["neg"] + 2)
    target = F.when(hit, high).otherwise(low)
    both = margins.select(F.array("margin").alias("m"), F.inline(F.array(F.struct(F.lit(1.0).alias("hit"), (n * target).alias("w")), F.struct(F.lit(0.0).alias("hit"), (n * (1 - target)).alias("w")))))
    fitted = C.LogisticRegression(featuresCol="v", labelCol="hit", weightCol="w", maxIter=50).fit(both.select(array_to_vector("m").alias("v"), "hit", "w"))
    return float(fitted.coefficients[0]), float(fitted.intercept)


def support_vectors(dataset: DataFrame, classes: int, weight: str | None, C_: float, rows: int, max_iter: int, kernel: str, gamma: str | float, components: int, seed: int) -> PipelineModel:
    """A fitted machine: one linear SVM for two classes, else one per class against the rest.

    The sigmoids are fitted on margins of rows that the machine did not see: ``PLATT_FOLDS`` further fits per machine.
    With a kernel the given features are kept, equal rows once with their sum of weights, and mapped in the passes that need
    them: a mapped row takes ``components`` numbers, and the solver keeps those of one fit, of all three where they are few.
    """
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}")
    mapped = ""
    vector, w = vector_to_array("features"), F.col(weight) if weight else F.lit(1.0)
    fold = F.pmod(F.xxhash64(vector, F.lit(seed)), F.lit(PLATT_FOLDS))
    kept, together = [], 1
    try:
        if kernel == "rbf":
            alike = dataset.groupBy(vector.alias("v"), "label").agg(F.sum(w).alias("w"), F.count(F.lit(1)).alias("n")).persist()
            kept.append(alike)
            size = alike.count() * 8 * components
            spread = dealt(alike, size // (8 * components), 8 * components, "v", "label").select(array_to_vector("v").alias("features"), "label", "w", "n").persist()
            kept.append(spread)
            width = scale_gamma(spread, "n") if gamma == "scale" else float(gamma)
            mapped = json.dumps({"gamma": width, "count": components, "seed": seed})
            # the solver keeps the mapped rows of each fit under way
            together = PLATT_FOLDS + 1 if size <= TOGETHER_BYTES else 1
            data = FourierFeatures(gamma=width, count=components, seed=seed).transform(spread.withColumn("fold", fold)).withColumnRenamed("__kernel", "x")
        else:
            data = dataset.select(F.col("features").alias("x"), "label", w.alias("w"), F.lit(1).alias("n"), fold.alias("fold")).persist()
            kept.append(data)
        machines = []
        for k in range(classes) if classes > 2 else [1]:
            hit = data.withColumn("hit", (F.col("label") == k).cast("double"))
            maker = C.LinearSVC(featuresCol="x", labelCol="hit", weightCol="w", regParam=1.0 / (C_ * rows), standardization=False, maxIter=max_iter)

            def fit(part, hit=hit, maker=maker):
                return maker.fit(hit if part is None else hit.where(F.col("fold") != part))

            with ThreadPoolExecutor(together) as pool:
                *parts, fitted = pool.map(fit, [*range(PLATT_FOLDS), None])
            held = None
            for part, made in enumerate(parts):
                one = made.transform(hit.where(F.col("fold") == part)).select(vector_to_array("rawPrediction")[1].alias("margin"), "hit", "n")
                held = one if held is None else held.unionByName(one)
            slope, shift = _sigmoid(held)
            machines.append({"w": fitted.coefficients.toArray().tolist(), "b": fitted.intercept, "slope": slope, "shift": shift})
    finally:
        for frame in kept:
            frame.unpersist()
    return PipelineModel([Margins(machines=json.dumps(machines), kernel=mapped)])
