"""Gradient boosting of several classes: softmax over scores, one regression tree per class and round."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

from pyspark import SparkContext, keyword_only
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml import regression as R
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tablecraft.session import dealt, freeze

#: Least curvature of a row, so that sure rows do not get huge steps.
CURVE = 1e-3
#: A row's score state takes about so many bytes beside its features; trees of so many classes grow at the same time.
STATE_BYTES, TOGETHER = 256, 4


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    parts = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(parts, lambda p: p / F.aggregate(parts, F.lit(0.0), lambda t, q: t + q))


class Softmax(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``probability`` and ``prediction`` from the columns of the classes' scores, which it takes away."""

    scores = Param(Params._dummy(), "scores", "columns, one per class", TypeConverters.toListString)
    starts = Param(Params._dummy(), "starts", "score of each class before the first round", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, scores: list[str] | None = None, starts: list[float] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = self.getOrDefault("scores")
        sums = F.array(*[F.col(n) + F.lit(s) for n, s in zip(names, self.getOrDefault("starts"))])
        scored = dataset.withColumn("probability", softmax(sums))
        best = (F.array_position("probability", F.array_max("probability")) - 1).cast("double")
        return scored.withColumn("prediction", best).drop(*names)


def log_loss(df: DataFrame, label: str = "label", probability: str = "probability") -> float:
    """Mean negative logarithm of the probability given to each row's own class."""
    own = F.get(F.col(probability), F.col(label).cast("int"))
    return df.agg(F.avg(-F.log(F.greatest(own, F.lit(1e-15))))).head()[0]


def boosted_classes(dataset: DataFrame, classes: int, weight: str | None, rate: float, rounds: int, tree: dict) -> PipelineModel:
    """``rounds`` of ``classes`` trees. A tree is fitted to gradient over curvature, weighted by curvature, so that a leaf's value is
    the Newton step of its rows: sum of gradients by sum of curvatures. Scores are checkpointed once a round. Equal rows of
    a class have equal scores in every round, so they are one row with their sum of weights; the trees of a round grow together.
    """
    names = [f"__score{k}" for k in range(classes)]
    w = F.col(weight) if weight else F.lit(1.0)
    sums = {r["label"]: r["n"] for r in dataset.groupBy("label").agg(F.sum(w).alias("n")).collect()}
    total = sum(sums.values())
    starts = [float(math.log(max(sums.get(float(k), 0.0), 1e-9) / total)) for k in range(classes)]
    alike = freeze(dataset.groupBy(vector_to_array("features").alias("v"), F.col("label").cast("int").alias("label")).agg(F.sum(w.cast("double")).alias("w")))
    width = len((alike.select("v").head() or [[]])[0])
    state = freeze(dealt(alike, alike.count(), STATE_BYTES + 8 * width, "v", "label").select(
        array_to_vector("v").alias("features"), "label", "w", F.array(*[F.lit(s) for s in starts]).alias("scores")))
    grown: list[list] = [[] for _ in names]
    for _ in range(rounds):
        judged = state.withColumn("p", softmax(F.col("scores")))

        def grow(k: int) -> R.DecisionTreeRegressionModel:
            p = F.col("p")[k]
            curve = F.greatest(p * (1 - p), F.lit(CURVE))
            aim = judged.select("features", (((F.col("label") == k).cast("double") - p) / curve).alias("aim"), (F.col("w") * curve).alias("cw"))
            return R.DecisionTreeRegressor(labelCol="aim", weightCol="cw", predictionCol=f"__step{k}", **tree).fit(aim)

        with ThreadPoolExecutor(min(classes, TOGETHER)) as pool:
            fitted = list(pool.map(grow, range(classes)))
        moved, steps = judged, []
        for k, one in enumerate(fitted):
            grown[k].append(one)
            moved = one.transform(moved)
            steps.append((F.col("scores")[k] + F.lit(rate) * F.col(f"__step{k}")).alias(f"s{k}"))
        state = freeze(moved.select("features", "label", "w", F.array(*steps).alias("scores")))
    return PipelineModel([*[_summed(trees, rate, name) for trees, name in zip(grown, names)], Softmax(scores=names, starts=starts)])


def _summed(trees: list, rate: float, name: str) -> R.GBTRegressionModel:
    """The trees of a class as one Spark model, whose prediction is their weighted sum."""
    context = SparkContext.getOrCreate()
    kinds = context._jvm.org.apache.spark.ml.regression
    made = context._gateway.new_array(kinds.DecisionTreeRegressionModel, len(trees))
    rates = context._gateway.new_array(context._jvm.double, len(trees))
    for i, t in enumerate(trees):
        made[i], rates[i] = t._java_obj, float(rate)
    return R.GBTRegressionModel(kinds.GBTRegressionModel(f"boosted{name}", made, rates)).setPredictionCol(name)
