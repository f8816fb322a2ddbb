"""Feature choice by F statistic, mutual information or forest importance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window, functions as F

from tablecraft.functions.columns import col, columns_of
from tablecraft.functions.quantiles import exact_quantiles
from tablecraft.functions.stats import pearson, to_long
from tablecraft.learn import cells
from tablecraft.learn.information import neighbour_information
from tablecraft.operators.numeric import right_closed_bin

MI_BINS = 10


def _complete(df: DataFrame, features: Sequence[str], target: str) -> tuple[DataFrame, list[str]]:
    numeric = [c for c in features if c in columns_of(df, "numeric") and c != target]
    if not numeric:
        raise ValueError("no numeric features to choose from")
    return df.dropna(subset=[*numeric, target]), numeric


def f_scores(df: DataFrame, features: Sequence[str], target: str, task: str = "classification") -> DataFrame:
    """(feature, f): between-class against within-class variance, or r2 / (1 - r2) * (n - 2)."""
    work, numeric = _complete(df, features, target)
    if task == "regression":
        wide = work.agg(F.count(F.lit(1)).alias("n"), *[pearson(col(c), col(target)).alias(f"r{i}") for i, c in enumerate(numeric)])
        return to_long(wide, [{
            "feature": F.lit(c),
            "f": F.try_divide(F.col(f"r{i}") * F.col(f"r{i}") * (F.col("n") - 2), 1 - F.col(f"r{i}") * F.col(f"r{i}")),
        } for i, c in enumerate(numeric)])
    per_class = work.groupBy(col(target)).agg(F.count(F.lit(1)).alias("n"), *[
        e.alias(f"{t}{i}") for i, c in enumerate(numeric) for t, e in (("m", F.avg(col(c))), ("v", F.var_pop(col(c))))])
    aggs = [F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes")]
    for i in range(len(numeric)):
        m, n = F.col(f"m{i}"), F.col("n")
        aggs += [F.sum(n * F.col(f"v{i}")).alias(f"w{i}"), F.sum(n * m).alias(f"s{i}"), F.sum(n * m * m).alias(f"q{i}")]
    wide = per_class.agg(*aggs)
    return to_long(wide, [{
        "feature": F.lit(c),
        "f": F.try_divide(
            F.try_divide(F.col(f"q{i}") - F.col(f"s{i}") * F.col(f"s{i}") / F.col("rows"), F.col("classes") - 1),
            F.try_divide(F.col(f"w{i}"), F.col("rows") - F.col("classes"))),
    } for i, c in enumerate(numeric)])


def k_best(df: DataFrame, features: Sequence[str], target: str, k: int = 10, task: str = "classification") -> DataFrame:
    return f_scores(df, features, target, task).orderBy(F.desc_nulls_last("f"), "feature").limit(k)


def mutual_information(df: DataFrame, features: Sequence[str], target: str, task: str = "classification", bins: int = MI_BINS, method: str = "neighbours") -> DataFrame:
    """(feature, mi) of complete rows.

    ``neighbours`` compares distances to the third neighbour (see ``neighbour_information``); it needs classes. ``bins``, and a
    numeric target, take counts of quantile bins against the class or against bins of the target.
    """
    if method not in ("neighbours", "bins"):
        raise ValueError(f"unknown method {method!r}")
    work, numeric = _complete(df, features, target)
    if method == "neighbours" and task == "classification":
        return neighbour_information(work, numeric, target)
    spots = [i / bins for i in range(bins + 1)]
    wanted = {c: (col(c), spots) for c in (*numeric, *([target] if task == "regression" else []))}
    edges = {c: sorted({e for e in q if e is not None}) for c, q in exact_quantiles(work, wanted).items()}

    def binned(c):
        return right_closed_bin(col(c).cast("double"), edges[c]) if len(edges[c]) > 1 else F.lit(1)

    label = binned(target).cast("string") if task == "regression" else col(target).cast("string")
    cells = F.array(*[F.struct(F.lit(i).alias("idx"), binned(c).alias("bin")) for i, c in enumerate(numeric)])
    counted = work.select(label.alias("y"), F.inline(cells)).groupBy("idx", "bin", "y").agg(F.count(F.lit(1)).alias("n"))
    # features x bins x classes rows from here on
    total = F.sum("n").over(Window.partitionBy("idx"))
    x_total = F.sum("n").over(Window.partitionBy("idx", "bin"))
    y_total = F.sum("n").over(Window.partitionBy("idx", "y"))
    share = F.col("n") / F.col("t")
    names = F.array(*[F.lit(c) for c in numeric])
    sums = counted.select("idx", "n", total.alias("t"), x_total.alias("tx"), y_total.alias("ty")).groupBy("idx").agg(
        F.sum(share * F.ln(F.col("n") * F.col("t") / (F.col("tx").cast("double") * F.col("ty")))).alias("mi"))
    return sums.select(F.get(names, F.col("idx")).alias("feature"), F.greatest("mi", F.lit(0.0)).alias("mi"))


def best_by_information(df: DataFrame, features: Sequence[str], target: str, k: int = 10, task: str = "classification", method: str = "neighbours") -> DataFrame:
    return mutual_information(df, features, target, task, method=method).orderBy(F.desc("mi"), "feature").limit(k)


def recursive_elimination(
    df: DataFrame, features: Sequence[str], target: str, n: int = 10, task: str = "classification", step: int = 1, trees: int = 100,
) -> list[str]:
    """Drop the ``step`` features a forest values least until ``n`` remain."""
    work, left = _complete(df, features, target)
    if task == "classification":
        work = StringIndexer(inputCol=target, outputCol="__label", stringOrderType="alphabetAsc").fit(work).transform(work)
        forest = RandomForestClassifier(numTrees=trees, seed=42, labelCol="__label", featuresCol="__x")
    else:
        work = work.withColumn("__label", col(target).cast("double"))
        forest = RandomForestRegressor(numTrees=trees, seed=42, labelCol="__label", featuresCol="__x")
    rows = work.count()
    while len(left) > n:
        vectors = VectorAssembler(inputCols=left, outputCol="__x").transform(work).select("__x", "__label")
        weights = _forest(vectors, forest, rows, task, trees).featureImportances.toArray()
        worst = sorted(range(len(left)), key=lambda i: (weights[i], left[i]))[: min(step, len(left) - n)]
        left = [c for i, c in enumerate(left) if i not in worst]
    return left


def _forest(vectors: DataFrame, forest: RandomForestClassifier | RandomForestRegressor, rows: int, task: str, trees: int):
    """The forest, grown on cells of equal bins where rows are many."""
    classes = int(vectors.agg(F.max("__label")).head()[0]) + 1 if task == "classification" and rows >= cells.MANY_ROWS else 1
    made = cells.cells_of(vectors, rows, classes, "__x", None if task == "classification" else cells.MOST_CELLS)
    if made is None:
        return forest.fit(vectors)
    return cells.forest_of_cells(vectors, made, task, None, trees, 42, classes if task == "classification" else 0, "__label", maxDepth=forest.getMaxDepth()).stages[-1]


def choose_features(
    df: DataFrame, target: str, mode: str = "all", chosen: Sequence[str] = (), k: int = 10, task: str = "classification", method: str = "f",
) -> list[str]:
    """all, manual or automatic; automatic falls back to the first ``k`` when it cannot decide."""
    features = [c for c in df.columns if c != target]
    if mode == "all":
        return features
    if mode == "manual":
        return [c for c in chosen if c in features]
    if mode != "automatic":
        raise ValueError(f"unknown mode {mode!r}")
    try:
        if method == "rfe":
            return recursive_elimination(df, features, target, k, task)
        best = k_best(df, features, target, k, task) if method == "f" else best_by_information(df, features, target, k, task)
        return [r["feature"] for r in best.collect()] or features[:k]
    except ValueError:
        return features[:k]
