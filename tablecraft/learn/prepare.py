"""Preprocessing as one pipeline stage, fitted on the training rows only."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablecraft.functions.columns import col, columns_of
from tablecraft.functions.quantiles import exact_quantiles
from tablecraft.functions.stats import value_counts
from tablecraft.session import freeze, scratch_path

# Scaler names, width of a one-hot block, name of the block's rare column.
SCALERS = ("standard", "robust", "minmax", "power")
MAX_CATEGORIES = 50
RARE = "__infrequent__"
#: Rare values up to so many are kept within the model, more of them as a table in the shared folder.
KNOWN_VALUES = 10_000
LAMBDA_GRID, LAMBDA_ROUNDS, LAMBDA_REACH = 21, 5, 4.0
#: Bins of the logarithm of a column, powers summed in each, and the most that a bin's width times a lambda may be.
LAMBDA_BINS, POWERS, NARROW = 4096, 10, 0.25


def yeo_johnson(x: Column, lam: float) -> Column:
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / F.lit(lam)
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / F.lit(2 - lam)
    return F.when(x >= 0, up).otherwise(down)


class _Shared(Params):
    numericCols = Param(Params._dummy(), "numericCols", "numeric inputs", TypeConverters.toListString)
    categoricalCols = Param(Params._dummy(), "categoricalCols", "text or boolean inputs", TypeConverters.toListString)
    scaler = Param(Params._dummy(), "scaler", "standard, robust, minmax or power", TypeConverters.toString)
    maxCategories = Param(Params._dummy(), "maxCategories", "widest one-hot block", TypeConverters.toInt)
    outputCol = Param(Params._dummy(), "outputCol", "vector column", TypeConverters.toString)
    state = Param(Params._dummy(), "state", "fitted values as JSON", TypeConverters.toString)


class TabularPrep(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Median fill, constant columns out, scaling; mode fill and capped one-hot; one vector."""

    @keyword_only
    def __init__(self, *, numericCols: list | None = None, categoricalCols: list | None = None, scaler: str = "standard",
                 maxCategories: int = MAX_CATEGORIES, outputCol: str = "features"):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[], scaler="standard", maxCategories=MAX_CATEGORIES, outputCol="features", state="{}")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "TabularPrepModel":
        scaler = self.getOrDefault("scaler")
        if scaler not in SCALERS:
            raise ValueError(f"unknown scaler {scaler!r}")
        state = {
            "numeric": _fit_numeric(dataset, self.getOrDefault("numericCols"), scaler),
            "categorical": _fit_categorical(dataset, self.getOrDefault("categoricalCols"), self.getOrDefault("maxCategories")),
        }
        if not state["numeric"] and not state["categorical"]:
            raise ValueError("no usable feature is left")
        model = TabularPrepModel()
        model._set(outputCol=self.getOrDefault("outputCol"), state=json.dumps(state))
        return self._copyValues(model)


class TabularPrepModel(Model, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    def __init__(self):
        super().__init__()
        self._setDefault(numericCols=[], categoricalCols=[], scaler="standard", maxCategories=MAX_CATEGORIES, outputCol="features", state="{}")

    @property
    def fitted(self) -> dict:
        return json.loads(self.getOrDefault("state"))

    @property
    def feature_names(self) -> list[str]:
        fitted = self.fitted
        names = [n["column"] for n in fitted["numeric"]]
        for c in fitted["categorical"]:
            names += [f"{c['column']}_{v}" for v in c["kept"]] + ([f"{c['column']}_{RARE}"] if c["rare"] is not None else [])
        return names

    def _transform(self, dataset: DataFrame) -> DataFrame:
        fitted, parts, looked_up = self.fitted, [], []
        for n in fitted["numeric"]:
            x = F.coalesce(_number(n["column"]), F.lit(n["median"]))
            if n.get("lam") is not None:
                x = yeo_johnson(x, n["lam"])
            parts.append((x - F.lit(n["center"])) / F.lit(n["scale"]))
        for c in fitted["categorical"]:
            value = F.coalesce(col(c["column"]).cast("string"), F.lit(c["mode"]))
            parts += [F.when(value == F.lit(v), 1.0).otherwise(0.0) for v in c["kept"]]
            if c.get("levels"):
                dataset, is_rare = _looked_up(dataset, c, value, [n["column"] for n in (*fitted["numeric"], *fitted["categorical"])], f"__level{len(looked_up)}")
                looked_up.append(f"__level{len(looked_up)}")
                parts.append(F.when(is_rare, 1.0).otherwise(0.0))
            elif c["rare"] is not None:
                parts.append(F.when(value.isin(c["rare"]), 1.0).otherwise(0.0))
        return dataset.withColumn(self.getOrDefault("outputCol"), array_to_vector(F.array(*parts))).drop(*looked_up)


def _looked_up(dataset: DataFrame, entry: dict, value: Column, inputs: Sequence[str], name: str) -> tuple[DataFrame, Column]:
    """Join the table of rare values; a value that is neither there nor kept was not seen in fitting.

    Kept values are the frequent ones. They need no lookup and get a key spread by the other inputs instead, so that
    no task has to take most of the rows.
    """
    levels = dataset.sparkSession.read.schema("level string").parquet(entry["levels"]).select(F.col("level").alias(name))
    kept = value.isin(entry["kept"])
    spread = F.concat(F.lit("\0"), F.xxhash64(*[col(c) for c in inputs]).cast("string"))
    return dataset.join(levels, F.when(kept, spread).otherwise(value) == F.col(name), "left"), ~kept & F.col(name).isNotNull()


def _number(name: str) -> Column:
    x = col(name).cast("double")
    return F.when(~F.isnan(x), x)


def _fit_numeric(df: DataFrame, columns: Sequence[str], scaler: str) -> list[dict]:
    if not columns:
        return []
    medians = {c: m[0] for c, m in exact_quantiles(df, {c: (_number(c), [0.5]) for c in columns}).items()}
    columns = [c for c in columns if medians[c] is not None]
    filled = {c: F.coalesce(_number(c), F.lit(medians[c])) for c in columns}
    if not columns:
        return []
    row = df.agg(*[
        f(filled[c]).alias(f"{t}{i}") for i, c in enumerate(columns)
        for t, f in (("a", F.min), ("b", F.max), ("m", F.avg), ("s", F.stddev_pop))
    ]).head()
    kept = [(i, c) for i, c in enumerate(columns) if row[f"a{i}"] != row[f"b{i}"]]
    out = []
    if scaler == "robust":
        spread = exact_quantiles(df, {c: (filled[c], [0.25, 0.5, 0.75]) for _, c in kept})
    if scaler == "power":
        lambdas = _best_lambdas(df, {c: filled[c] for _, c in kept})
        after = df.agg(*[
            f(yeo_johnson(filled[c], lambdas[c])).alias(f"{t}{i}") for i, c in kept for t, f in (("m", F.avg), ("s", F.stddev_pop))
        ]).head() if kept else None
    for i, c in kept:
        entry = {"column": c, "median": medians[c], "lam": None}
        if scaler == "standard":
            entry.update(center=row[f"m{i}"], scale=row[f"s{i}"] or 1.0)
        elif scaler == "minmax":
            entry.update(center=row[f"a{i}"], scale=row[f"b{i}"] - row[f"a{i}"])
        elif scaler == "robust":
            q1, q2, q3 = spread[c]
            entry.update(center=q2, scale=(q3 - q1) or 1.0)
        else:
            entry.update(lam=lambdas[c], center=after[f"m{i}"], scale=after[f"s{i}"] or 1.0)
        out.append(entry)
    return out


def _best_lambdas(df: DataFrame, columns: dict[str, Column]) -> dict[str, float]:
    """Likelihood of a grid of lambdas, one aggregate per round, the grid closing in on the best.

    While the best is an edge of the grid, the grid moves there and doubles; it ends, as far out powers overflow. The rows are
    read once: with u = log(1 + |x|) the transform is an exponential of u, whose mean and spread within a narrow bin of u
    follow to rounding from the sums of powers of its distances to the bin's middle. Rounds read the bins.
    """
    if not columns:
        return {}
    names = list(columns)
    reach, left, inner = [LAMBDA_REACH] * len(names), [LAMBDA_ROUNDS] * len(names), [False] * len(names)
    weight = df.agg(*[
        e.alias(f"{t}{i}") for i, x in enumerate(columns.values())
        for t, e in (("n", F.count(x)), ("g", F.sum(F.signum(x) * F.log1p(F.abs(x)))), ("a", F.max(F.log1p(F.abs(x)))))
    ]).head()
    middle = [1.0] * len(names)
    cells = F.array(*[F.struct(F.lit(i).alias("idx"), x.alias("x")) for i, x in enumerate(columns.values())])
    long = df.select(F.inline(cells)).where(F.col("x").isNotNull())
    widths = [max((weight[f"a{i}"] or 0.0) / LAMBDA_BINS, 1e-300) for i in range(len(names))]
    even = [i for i, w in enumerate(widths) if math.isfinite(w)]
    binned = freeze(_log_bins(long.where(F.col("idx").isin(even)), widths))
    while any(left):
        grids = [[m - r + 2 * r * j / (LAMBDA_GRID - 1) for j in range(LAMBDA_GRID)] for m, r in zip(middle, reach)]
        active = [i for i in range(len(names)) if left[i]]
        table = F.array(*[F.array(*[F.lit(v) for v in g]) for g in grids])
        # bins are too wide only for powers that nearly overflow on the largest value
        narrow = [i for i in active if i in even and widths[i] * max(max(abs(v), abs(2 - v)) for v in grids[i]) <= NARROW]
        found: dict = {}
        for group, moments in ((narrow, _binned_moments(binned, table)), ([i for i in active if i not in narrow], _row_moments(long, table))):
            if group:
                found.update({(r["idx"], r["j"]): r["v"] for r in moments.where(F.col("idx").isin(group)).collect()})
        for i in active:
            def score(j):
                v = found.get((i, j))
                if v is None or not (0 < v < math.inf):
                    return -math.inf
                return -weight[f"n{i}"] / 2 * math.log(v) + (grids[i][j] - 1) * weight[f"g{i}"]
            best = max(range(LAMBDA_GRID), key=score)
            if score(best) == -math.inf:
                left[i] = 0
                continue
            middle[i] = grids[i][best]
            inner[i] = inner[i] or 0 < best < LAMBDA_GRID - 1
            if inner[i]:
                reach[i], left[i] = 2 * reach[i] / (LAMBDA_GRID - 1) * 1.5, left[i] - 1
            else:
                reach[i] *= 2
    return dict(zip(names, middle))


def _row_moments(long: DataFrame, table: Column) -> DataFrame:
    """(idx, j, v): variance of each column's values under lambda j of its grid, LAMBDA_GRID cells per value."""
    x, lam = F.col("x"), F.col("lam")
    up = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / F.when(F.abs(lam) < 1e-12, 1.0).otherwise(lam))
    down = F.when(F.abs(lam - 2) < 1e-12, -F.log1p(-x)).otherwise(
        -(F.pow(1 - x, 2 - lam) - 1) / F.when(F.abs(lam - 2) < 1e-12, 1.0).otherwise(2 - lam))
    spread = long.select("idx", "x", F.posexplode(F.get(table, F.col("idx"))).alias("j", "lam"))
    return spread.groupBy("idx", "j").agg(F.var_pop(F.when(x >= 0, up).otherwise(down)).alias("v"))


def _log_bins(long: DataFrame, widths: Sequence[float]) -> DataFrame:
    """(idx, sign, mid, n, d1, d2, ...): rows of each bin of log(1 + |x|) and sums of powers of their distance to its middle."""
    width = F.get(F.array(*[F.lit(w) for w in widths]), F.col("idx"))
    placed = long.select("idx", F.when(F.col("x") >= 0, 1).otherwise(-1).alias("sign"), F.log1p(F.abs("x")).alias("u"), width.alias("w"))
    cell = placed.select("idx", "sign", "u", ((F.floor(F.col("u") / F.col("w")) + 0.5) * F.col("w")).alias("mid")).withColumn("d", F.col("u") - F.col("mid"))
    power, sums = F.lit(1.0), [F.count(F.lit(1)).alias("n")]
    for k in range(1, POWERS + 1):
        power = power * F.col("d")
        sums.append(F.sum(power).alias(f"d{k}"))
    return cell.groupBy("idx", "sign", "mid").agg(*sums)


def _binned_moments(binned: DataFrame, table: Column) -> DataFrame:
    """The same as :func:`_row_moments`, from bins: a value is sign * (exp(p * u) - 1) / p with power p = lambda, or 2 - lambda below zero.

    Within a bin it is the value at the middle plus exp(p * mid) * f, with f the sum of p^(k-1) d^k / k! over k from 1.
    """
    spread = binned.select("*", F.posexplode(F.get(table, F.col("idx"))).alias("j", "lam"))
    p = F.when(F.col("sign") > 0, F.col("lam")).otherwise(2 - F.col("lam"))
    zero = F.abs("p") < 1e-12
    at = F.when(zero, F.col("mid")).otherwise(F.expm1(F.col("p") * F.col("mid")) / F.when(zero, 1.0).otherwise(F.col("p")))
    once = sum((F.pow("p", F.lit(float(k - 1))) * F.col(f"d{k}") / float(math.factorial(k)) for k in range(1, POWERS + 1)), F.lit(0.0))
    twice = sum((F.pow("p", F.lit(float(k - 2))) * F.col(f"d{k}") * float(2**k - 2) / float(math.factorial(k)) for k in range(2, POWERS + 1)), F.lit(0.0))
    shifts = spread.withColumn("p", p).select("idx", "j", "n", F.col("sign").alias("s"), at.alias("at"), F.exp(F.col("p") * F.col("mid")).alias("e"), (once / F.col("n")).alias("m1"), (twice / F.col("n")).alias("m2"))
    # mean and spread of each bin, then around the mean of all
    own = shifts.select("idx", "j", "n", (F.col("s") * (F.col("at") + F.col("e") * F.col("m1"))).alias("m"), (F.col("e") * F.col("e") * F.greatest(F.col("m2") - F.col("m1") * F.col("m1"), F.lit(0.0))).alias("v"))
    whole = own.groupBy("idx", "j").agg(F.collect_list(F.struct("n", "m", "v")).alias("bins"), F.sum(F.col("n") * F.col("m")).alias("t"), F.sum("n").alias("rows"))
    mean = F.col("t") / F.col("rows")
    parts = F.transform("bins", lambda b: b["n"] * (b["v"] + (b["m"] - F.col("mean")) * (b["m"] - F.col("mean"))))
    return whole.withColumn("mean", mean).select("idx", "j", (F.aggregate(parts, F.lit(0.0), lambda t, q: t + q) / F.col("rows")).alias("v"))


def _fit_categorical(df: DataFrame, columns: Sequence[str], cap: int) -> list[dict]:
    if not columns:
        return []
    # the row_number filter becomes a group limit, so each task passes on a bounded list
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    counts = value_counts(df, columns)
    listed = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= KNOWN_VALUES + 1).collect()
    out = []
    for c in columns:
        seen = sorted((r["r"], r["value"], r["n"]) for r in listed if r["column"] == c)
        if not seen:
            continue
        mode = seen[0][1]
        values = [v for _, v, _ in seen]
        if len(values) <= cap:
            out.append({"column": c, "mode": mode, "kept": sorted(values), "rare": None})
        else:
            entry = {"column": c, "mode": mode, "kept": sorted(values[: cap - 1]), "rare": values[cap - 1:]}
            if len(values) > KNOWN_VALUES:
                entry.update(rare=[], levels=scratch_path(df.sparkSession, "levels"))
                counts.where((F.col("column") == c) & ~F.col("value").isin(entry["kept"])).select(F.col("value").alias("level")).write.parquet(entry["levels"])
            out.append(entry)
    return out


def prep_for(df: DataFrame, features: Sequence[str], scaler: str = "standard") -> TabularPrep:
    """Stage for the numeric, text and boolean features; dates are left out."""
    numeric = [c for c in columns_of(df, "numeric") if c in set(features)]
    categorical = [c for c in columns_of(df, "text", "boolean") if c in set(features)]
    return TabularPrep(numericCols=numeric, categoricalCols=categorical, scaler=scaler)
