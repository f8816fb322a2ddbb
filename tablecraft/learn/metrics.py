"""Evaluation frames from predictions; nothing is collected that grows with the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablecraft.functions.columns import col
from tablecraft.functions.ordering import ROWS_PER_BUCKET, running_sums
from tablecraft.functions.sampling import seeded_sample
from tablecraft.operators.distributions import histogram
from tablecraft.session import small_frame


def _rows(n: str | None, test: Column | None = None) -> Column:
    """Rows (that pass ``test``): each counts once, or as often as column ``n`` says."""
    if n is None:
        return F.count(F.lit(1)) if test is None else F.count_if(test)
    return F.sum(col(n) if test is None else F.when(test, col(n)).otherwise(F.lit(0)))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", n: str | None = None) -> DataFrame:
    """(label, prediction, n, share of the label's rows) for all pairs of seen classes. Column ``n`` holds numbers of equal rows, if given."""
    counted = df.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(_rows(n).alias("n"))
    # one entry per class: the set of classes is what a classifier tells apart
    classes = counted.select(F.explode(F.array("label", "prediction")).alias("c")).agg(F.array_sort(F.collect_set("c")).alias("cs"))
    grid = classes.select(F.explode("cs").alias("label"), "cs").select("label", F.explode("cs").alias("prediction"))
    full = grid.join(counted, ["label", "prediction"], "left").select("label", "prediction", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("label"))
    return full.select("label", "prediction", "n", F.coalesce(F.try_divide(F.col("n").cast("double"), total), F.lit(0.0)).alias("share"))


def _per_class(matrix: DataFrame) -> DataFrame:
    seen = matrix.select("label", "prediction", "n")
    cells = seen.select(F.inline(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0)).alias("hits")),
        F.struct(F.col("prediction").alias("class"), F.lit(0).cast("bigint").alias("actual"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")),
    )))
    sums = cells.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("actual", "predicted", "hits")])

    def ratio(a, b):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))

    with_rates = sums.select("class", "actual", "hits", ratio("hits", "predicted").alias("precision"), ratio("hits", "actual").alias("recall"))
    both = F.col("precision") + F.col("recall")
    return with_rates.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), both), F.lit(0.0)))


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted averages."""
    classes = _per_class(confusion(df, label, prediction))
    rates = ("precision", "recall", "f1")
    lines = classes.select(F.col("class").cast("string").alias("class"), *rates, F.col("actual").alias("support"))
    total = F.sum("actual")
    accuracy = classes.agg(F.lit("accuracy").alias("class"), *[(F.sum("hits") / total).alias(r) for r in rates], total.alias("support"))
    macro = classes.agg(F.lit("macro avg").alias("class"), *[F.avg(r).alias(r) for r in rates], total.alias("support"))
    weighted = classes.agg(F.lit("weighted avg").alias("class"), *[(F.sum(F.col(r) * F.col("actual")) / total).alias(r) for r in rates], total.alias("support"))
    return lines.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction", n: str | None = None) -> DataFrame:
    """accuracy and support-weighted precision, recall, F1 in one row."""
    total = F.sum("actual")
    return _per_class(confusion(df, label, prediction, n)).agg(
        (F.sum("hits") / total).alias("accuracy"),
        *[(F.sum(F.col(r) * F.col("actual")) / total).alias(r) for r in ("precision", "recall", "f1")],
    )


def score_steps(df: DataFrame, label: str, score: str, keys: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET, n: str | None = None) -> DataFrame:
    """Per distinct score: positives and negatives, with their running and total counts. Column ``n`` holds numbers of equal rows, if given."""
    counted = df.where(col(score).isNotNull()).groupBy(*[col(k) for k in keys], col(score).alias("score")).agg(
        _rows(n, col(label) == 1).alias("pos"), _rows(n, col(label) != 1).alias("neg"))
    return running_sums(counted, "score", ["pos", "neg"], keys, df.count(), rows_per_bucket)


def roc_auc(df: DataFrame, label: str, score: str, keys: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET, n: str | None = None) -> DataFrame:
    """Area under the ROC curve: share of (positive, negative) pairs in the right order, ties half."""
    steps = score_steps(df, label, score, keys, rows_per_bucket, n)
    below = F.col("upto_neg") - F.col("neg")
    won = F.sum(F.col("pos") * (below + F.col("neg") / 2.0))
    pairs = F.max("all_pos").cast("double") * F.max("all_neg")
    return steps.groupBy(*[col(k) for k in keys]).agg(F.try_divide(won, pairs).alias("roc_auc"))


def roc_auc_multiclass(df: DataFrame, label: str, probabilities: str, classes: Sequence[int], keys_present_only: bool = True, n: str | None = None) -> DataFrame:
    """Macro one-vs-rest area over the classes present, probabilities rescaled to those classes."""
    present = [r[0] for r in df.select(col(label).cast("int").alias("c")).distinct().collect()]
    used = [c for c in classes if c in present] if keys_present_only else list(classes)
    if len(used) < 2:
        return small_frame(df.sparkSession, [(None,)], "roc_auc double")
    p = col(probabilities)
    total = sum((p[c] for c in used), F.lit(0.0))
    cells = F.array(*[
        F.struct(F.lit(c).alias("class"), (col(label).cast("int") == c).cast("int").alias("hit"),
                 (p[c] / F.when(total == 0, 1.0).otherwise(total)).alias("p")) for c in used
    ])
    kept = [] if n is None else [col(n).alias("__n")]
    return roc_auc(df.select(*kept, F.inline(cells)), "hit", "p", ["class"], n=n and "__n").agg(F.avg("roc_auc").alias("roc_auc"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """fpr, tpr per threshold, all points kept; starts at (0, 0) with an infinite threshold."""
    steps = score_steps(df, label, score)
    tp = F.col("all_pos") - F.col("upto_pos") + F.col("pos")
    fp = F.col("all_neg") - F.col("upto_neg") + F.col("neg")
    points = steps.select(F.col("score").alias("threshold"), F.try_divide(fp.cast("double"), F.col("all_neg")).alias("fpr"),
                          F.try_divide(tp.cast("double"), F.col("all_pos")).alias("tpr"))
    origin = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def precision_recall_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    steps = score_steps(df, label, score)
    tp = F.col("all_pos") - F.col("upto_pos") + F.col("pos")
    fp = F.col("all_neg") - F.col("upto_neg") + F.col("neg")
    return steps.select(F.col("score").alias("threshold"), (tp / (tp + fp)).alias("precision"),
                        F.try_divide(tp.cast("double"), F.col("all_pos")).alias("recall"), "pos", F.col("all_pos").alias("positives"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Sum of precision times the step in recall."""
    curve = precision_recall_curve(df, label, score)
    return curve.agg(F.sum(F.col("precision") * F.try_divide(F.col("pos").cast("double"), F.col("positives"))).alias("average_precision"))


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """mse, rmse, mae and r2 in one pass."""
    y, error = col(label).cast("double"), col(label).cast("double") - col(prediction).cast("double")
    mse = F.avg(error * error)
    return df.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
                  (F.lit(1.0) - F.try_divide(F.sum(error * error), F.var_pop(y) * F.count(y))).alias("r2"))


def residuals(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.withColumn("residual", col(label).cast("double") - col(prediction).cast("double"))


def residual_histogram(df: DataFrame, label: str = "label", prediction: str = "prediction", bins: int = 30) -> DataFrame:
    return histogram(residuals(df, label, prediction), "residual", bins)


def fit_points(df: DataFrame, key: Sequence[str], label: str = "label", prediction: str = "prediction", points: int = 5000) -> DataFrame:
    """Actual, predicted and residual for a seeded sample of rows."""
    named = residuals(df, label, prediction).select(*[col(k) for k in key], col(label).alias("actual"), col(prediction).alias("predicted"), "residual")
    return seeded_sample(named, points, key)


def fit_diagonal(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.least(F.min(col(label).cast("double")), F.min(col(prediction).cast("double"))).alias("low"),
                  F.greatest(F.max(col(label).cast("double")), F.max(col(prediction).cast("double"))).alias("high"))


def compare_models(results: DataFrame, metric: str) -> DataFrame:
    """Rank (model, metric columns...) rows; smaller is better for errors. roc_auc must be known for all."""
    if metric == "roc_auc" and not results.where(col(metric).isNull()).isEmpty():
        raise ValueError("roc_auc is not known for every model")
    direction = F.asc_nulls_last if metric in ("rmse", "mae", "mse") else F.desc_nulls_last
    # one row per model
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(direction(metric), "model"))
    return results.withColumn("place", place).withColumn("best", F.col("place") == 1)
