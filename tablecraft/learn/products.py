"""Linear models of many folds, fractions and penalties from sums of products, gathered in one pass."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from tablecraft.functions.columns import col, columns_of
from tablecraft.functions.quantiles import exact_quantiles
from tablecraft.functions.sampling import rank_cuts, with_piece
from tablecraft.learn.models import REGRESSORS

#: Models whose fit and squared error follow from sums of products.
SUMMED = ("Linear Regression", "Ridge Regression", "Lasso Regression", "Elastic Net")
SUMMED_SCALERS, SUMMED_METRICS = ("standard", "minmax"), ("r2", "mse", "rmse")
#: More numeric features than this are fitted part by part: a sum holds the square of their number.
MOST_FEATURES = 200
STEPS, SETTLED = 100_000, 1e-13


def summed(df: DataFrame, features: Sequence[str], task: str, model: str, settings: dict | None, scaler: str, metric: str) -> bool:
    """Whether scores follow from sums; they are then the same as those of separate fits."""
    used = [c for c in columns_of(df, "numeric", "text", "boolean") if c in set(features)]
    numeric = set(columns_of(df, "numeric"))
    return (task == "regression" and model in SUMMED and scaler in SUMMED_SCALERS and metric in SUMMED_METRICS
            and 0 < len(used) <= MOST_FEATURES and numeric.issuperset(used) and set(settings or {}) <= set(REGRESSORS[model]))


@dataclass
class Sums:
    """Rows, products of all pairs of (1, features, holes, target), and the range of every feature."""

    n: int
    products: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __add__(self, other: "Sums") -> "Sums":
        return Sums(self.n + other.n, self.products + other.products, np.fmin(self.low, other.low), np.fmax(self.high, other.high))


@dataclass
class Line:
    """A fitted model as weights of (1, features, holes, target): the product with a row is its error."""

    weights: np.ndarray

    def scores(self, part: Sums) -> dict[str, float | None]:
        """mse, rmse and r2 on the rows of ``part``; r2 is None for a constant target, as in the row-wise metrics."""
        wrong = max(0.0, float(self.weights @ part.products @ self.weights))
        around = float(part.products[-1, -1] - part.products[0, -1] ** 2 / part.n)
        level = around > 1e-12 * max(float(part.products[-1, -1]), 1e-300)
        return {"mse": wrong / part.n, "rmse": (wrong / part.n) ** 0.5, "r2": 1 - wrong / around if level else None}


class FoldSums:
    """Sums of every (fold, segment) of a table, and fits on any union of them.

    Features are shifted by their mean first, so that products lose no digits. A missing cell is a zero and a mark
    of its own; the median that fills it is put in when fitting, since every part of the rows has its own. A pass
    finds shifts and marks, a second one all products; columns with missing cells cost a quantile pass a part.
    ``rows`` holds ``fold`` and ``segment``; rows without a target must be gone. Nulls and NaN are missing.
    """

    def __init__(self, rows: DataFrame, target: str, features: Sequence[str]):
        self.rows = rows
        self.names = [c for c in columns_of(rows, "numeric") if c in set(features)]
        y, size = col(target).cast("double"), len(self.names)
        whole = rows.agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("y"), *[
            e.alias(f"{t}{i}") for i, c in enumerate(self.names) for t, e in (("m", F.avg(_number(c))), ("n", F.count(_number(c))))]).head()
        self.shift = np.array([whole[f"m{i}"] or 0.0 for i in range(size)])
        self.holes = [i for i in range(size) if whole[f"n{i}"] < whole["n"]]
        entries = [F.lit(1.0), *[F.coalesce(_number(c) - F.lit(float(s)), F.lit(0.0)) for c, s in zip(self.names, self.shift)],
                   *[_number(self.names[i]).isNull().cast("double") for i in self.holes], y - F.lit(whole["y"] or 0.0)]
        self.width = len(entries)
        entry = F.col("__entry")
        pairs = F.flatten(F.transform(entry, lambda a, i: F.transform(F.slice(entry, i + 1, self.width), lambda b: a * b)))
        ranged = [e.alias(f"{t}{i}") for i in range(size) for t, e in (("a", F.min(f"__x{i}")), ("b", F.max(f"__x{i}")))]
        listed = rows.select(F.col("fold").alias("__fold"), F.col("segment").alias("__segment"), F.array(*entries).alias("__entry"),
                             *[_number(c).alias(f"__x{i}") for i, c in enumerate(self.names)])
        cells = listed.withColumn("__pairs", array_to_vector(pairs)).groupBy("__fold", "__segment").agg(
            F.count(F.lit(1)).alias("n"), vector_to_array(Summarizer.sum(F.col("__pairs"))).alias("pairs"), *ranged)
        self.cells = {(r["__fold"], r["__segment"]): self._sums(r) for r in cells.collect()}  # folds x segments rows

    def _sums(self, row) -> Sums:
        upper = np.zeros((self.width, self.width))
        upper[np.triu_indices(self.width)] = row["pairs"]
        low, high = (np.array([np.nan if row[f"{t}{i}"] is None else row[f"{t}{i}"] for i in range(len(self.names))], float) for t in "ab")
        return Sums(row["n"], upper + np.triu(upper, 1).T, low, high)

    def part(self, keys: Iterable[tuple[int, int]]) -> Sums:
        first, *rest = [self.cells[k] for k in sorted(keys)]
        return sum(rest, first)

    def test(self, fold: int) -> Sums:
        return self.part(k for k in self.cells if k[0] == fold)

    def training(self, fold: int, upto: int | None = None) -> tuple[Sums, dict[str, float]]:
        """Sums of the rows outside a fold, up to a segment if one is given, and the medians that fill their holes."""
        part = self.part(k for k in self.cells if k[0] != fold and (upto is None or k[1] <= upto))
        chosen = self.rows.where((F.col("fold") != fold) & (F.lit(True) if upto is None else F.col("segment") <= upto))
        wanted = {self.names[i]: (_number(self.names[i]), [0.5]) for i in self.holes}
        return part, {c: m[0] for c, m in exact_quantiles(chosen, wanted).items()} if wanted else {}

    def fit(self, training: tuple[Sums, dict[str, float]], model: str, settings: dict | None = None, scaler: str = "standard") -> Line:
        """Weights of the model on features scaled by the training rows; constant and empty ones stay out."""
        part, medians = training
        kept = [i for i in range(len(self.names)) if part.low[i] < part.high[i]]
        if not kept:
            raise ValueError("no usable feature is left")
        turn = np.zeros((len(kept), self.width))  # entries of a row to its filled features
        for k, i in enumerate(kept):
            turn[k, 1 + i] = 1.0
            if i in self.holes:
                turn[k, 1 + len(self.names) + self.holes.index(i)] = medians[self.names[i]] - self.shift[i]
        means = turn @ part.products[:, 0] / part.n
        turn[:, 0] -= means
        spread = np.sqrt(np.maximum(np.einsum("ki,ij,kj->k", turn, part.products, turn) / part.n, 0.0))
        scale = part.high[kept] - part.low[kept] if scaler == "minmax" else np.where(spread > 0, spread, 1.0)
        turn /= scale[:, None]
        inner = turn @ part.products @ turn.T / part.n
        level = part.products[0, -1] / part.n
        outer = turn @ part.products[:, -1] / part.n
        slopes = _solved(inner, outer, *_penalties(model, {**REGRESSORS[model], **(settings or {})}, part.n))
        weights = turn.T @ slopes
        weights[0] += level
        weights[-1] -= 1.0
        return Line(weights)


def _number(name: str) -> Column:
    x = col(name).cast("double")
    return F.when(~F.isnan(x), x)


def _penalties(model: str, s: dict, n: int) -> tuple[float, float]:
    """Weights of the absolute and of half the squared slopes beside half the mean squared error."""
    if model == "Ridge Regression":
        return 0.0, s["alpha"] / n
    if model == "Lasso Regression":
        return s["alpha"], 0.0
    return (s["alpha"] * s["l1_ratio"], s["alpha"] * (1 - s["l1_ratio"])) if model == "Elastic Net" else (0.0, 0.0)


def _solved(inner: np.ndarray, outer: np.ndarray, absolute: float, squared: float) -> np.ndarray:
    """Slopes by a linear system; by coordinate steps where the absolute penalty asks for them."""
    system = inner + squared * np.eye(len(outer))
    if not absolute:
        return np.linalg.lstsq(system, outer, rcond=1e-13)[0]
    slopes, diagonal = np.zeros(len(outer)), np.diag(system)
    for _ in range(STEPS):
        moved = 0.0
        for j in np.flatnonzero(diagonal > 0):
            pull = outer[j] - system[j] @ slopes + diagonal[j] * slopes[j]
            new = np.sign(pull) * max(abs(pull) - absolute, 0.0) / diagonal[j]
            moved, slopes[j] = max(moved, abs(new - slopes[j])), new
        if moved <= SETTLED * max(1.0, np.abs(slopes).max()):
            break
    return slopes


def fold_scores(marked: DataFrame, target: str, features: Sequence[str], folds: int, model: str, options: Sequence[dict], scaler: str, metric: str) -> list[list[float]]:
    """Per setting, the score of every fold; the table is read the same number of times however many settings there are."""
    sums = FoldSums(marked.withColumn("segment", F.lit(0)), target, features)
    parts = [(sums.training(i), sums.test(i)) for i in range(folds)]
    return [[sums.fit(train, model, o, scaler).scores(test)[metric] for train, test in parts] for o in options]


def curve_scores(marked: DataFrame, target: str, features: Sequence[str], key: Sequence[str], folds: int, model: str, settings: dict | None,
                 fractions: Sequence[float], metric: str, seed: int = 42) -> list[tuple[float, list[float], list[float]]]:
    """(fraction, training scores, test scores) over nested parts of each fold's training rows.

    Each fold has its own cuts in the hash order of the key. All cuts together part the table into segments, and
    a training part is some segments of the other folds.
    """
    sizes = {r["fold"]: r["n"] for r in marked.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, points = sum(sizes.values()), {}
    partial = [f for f in fractions if f < 1]
    for i in range(folds):
        left = total - sizes[i]
        cuts = rank_cuts(marked.where(F.col("fold") != i), key, seed, {0: [max(1, int(left * f)) for f in partial]}, {0: left})[0] if partial else []
        points.update({(i, f): tuple(c) for f, c in zip(partial, cuts)})
    order = sorted(set(points.values()))
    pieces = with_piece(marked, "segment", key, seed, {0: order}) if order else marked.withColumn("segment", F.lit(0))
    sums, lines = FoldSums(pieces, target, features), []
    for f in fractions:
        pairs = []
        for i in range(folds):
            train = sums.training(i, order.index(points[i, f]) if f < 1 else None)
            line = sums.fit(train, model, settings)
            pairs.append((line.scores(train[0])[metric], line.scores(sums.test(i))[metric]))
        lines.append((f, *map(list, zip(*pairs))))
    return lines
