"""Deterministic splits and folds by hashing a key: no shuffle, exact sizes per class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tablecraft.functions.columns import col, kind, require
from tablecraft.functions.sampling import rank_cuts, with_piece

# Fixed value: more distinct numbers than this mean a regression target.
REGRESSION_DISTINCT = 10
STRATA_CAP = 1000


def suggest_task(df: DataFrame, target: str) -> str:
    """regression for a number with more than ten distinct values, else classification."""
    require(df, target)
    if kind(df.schema[target].dataType) != "numeric":
        return "classification"
    seen = df.where(col(target).isNotNull()).select(col(target)).distinct().limit(REGRESSION_DISTINCT + 1).count()
    return "regression" if seen > REGRESSION_DISTINCT else "classification"


def class_counts(df: DataFrame, target: str) -> dict:
    """{class: rows}; an error for more classes than a classifier can be asked to tell apart."""
    rows = df.where(col(target).isNotNull()).groupBy(col(target).alias("c")).count().limit(STRATA_CAP + 1).collect()
    if len(rows) > STRATA_CAP:
        raise ValueError(f"target {target} has more than {STRATA_CAP} classes")
    return {r["c"]: r["count"] for r in rows}


def _with_piece(df, name, key, seed, sizes, label, ranks) -> DataFrame:
    cuts = rank_cuts(df, key, seed, {c: ranks(n) for c, n in sizes.items()}, sizes, label)
    return with_piece(df, name, key, seed, cuts, label)


def prepare_split(
    df: DataFrame, target: str, key: Sequence[str], task: str = "classification", test_size: float = 0.2, seed: int = 42,
) -> DataFrame:
    """Rows with a target plus ``is_test``; each class gives ``round(n * test_size)`` test rows.

    Stratified when every class has two or more rows, as in a classification split.
    """
    require(df, target, *key)
    usable = df.where(col(target).isNotNull())
    if task == "regression" and kind(df.schema[target].dataType) != "numeric":
        raise ValueError("the target of a regression must be numeric")
    sizes, label = {0: None}, None
    if task == "classification":
        counted = class_counts(usable, target)
        if not counted:
            raise ValueError("no rows with a target")
        if min(counted.values()) >= 2:
            sizes, label = counted, target
        else:
            sizes = {0: sum(counted.values())}
    else:
        sizes = {0: usable.count()}
        if not sizes[0]:
            raise ValueError("no rows with a target")
    marked = _with_piece(usable, "is_test", key, seed, sizes, label, lambda n: [int(n * test_size + 0.5)])
    return marked.withColumn("is_test", F.col("is_test") == 0)


def train_test(df: DataFrame, *args, **kwargs) -> tuple[DataFrame, DataFrame]:
    marked = prepare_split(df, *args, **kwargs)
    return marked.where(~F.col("is_test")).drop("is_test"), marked.where(F.col("is_test")).drop("is_test")


def safe_folds(df: DataFrame, target: str, folds: int, task: str = "classification") -> int | None:
    """Folds clamped to the rows and the smallest class; None when fewer than two remain."""
    counts = class_counts(df, target) if task == "classification" else {0: df.where(col(target).isNotNull()).count()}
    cap = min(int(folds), min(counts.values(), default=0))
    return cap if cap >= 2 else None


def with_folds(df: DataFrame, target: str, key: Sequence[str], folds: int, task: str = "classification", seed: int = 42) -> DataFrame:
    """Add ``fold`` 0..folds-1, equally large within each class (within all rows for regression)."""
    usable = df.where(col(target).isNotNull())
    if task == "classification":
        sizes, label = class_counts(usable, target), target
    else:
        sizes, label = {0: usable.count()}, None
    return _with_piece(usable, "fold", key, seed, sizes, label, lambda n: [round(n * i / folds) for i in range(1, folds)])


def nested_subset(df: DataFrame, key: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """The first ``fraction`` of the rows in hash order; larger fractions contain smaller ones."""
    if fraction >= 1:
        return df
    rows = df.count()
    cuts = rank_cuts(df, key, seed, {0: [max(1, int(rows * fraction))]}, {0: rows})
    return with_piece(df, "__piece", key, seed, cuts).where(F.col("__piece") == 0).drop("__piece")


def balanced_weights(df: DataFrame, target: str) -> DataFrame:
    """(class, n, weight) with weight = rows / (classes * n)."""
    counted = df.where(col(target).isNotNull()).groupBy(col(target).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    whole = counted.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("classes"))
    return counted.join(F.broadcast(whole), F.lit(True)).select(
        "class", "n", (F.col("rows") / (F.col("classes") * F.col("n"))).alias("weight"))
