"""Frames behind distribution charts: histograms, boxes, densities, shares."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablecraft.functions.columns import as_double, col, percent, require
from tablecraft.functions.frequent import most_frequent
from tablecraft.functions.ordering import value_ranks
from tablecraft.functions.quantiles import grouped_quantiles
from tablecraft.functions.stats import to_long
from tablecraft.operators.rows import keep_tops
from tablecraft.session import looked_up, small_frame

MISSING_LABEL = "Missing/NaN"
KDE_POINTS = 200
FENCE = 1.5
#: Terms of a density's series, and the distance in bandwidths beyond which a cell adds nothing.
TERMS, FAR = 20, 40.0


def _ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    aggs = [f(as_double(df, c)).alias(f"{t}{i}") for i, c in enumerate(columns) for t, f in (("a", F.min), ("b", F.max))]
    row = df.agg(*aggs).head()
    return {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(columns)}


def even_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """0-based left-closed bin of equal width; the last one holds its upper edge."""
    if low is None:
        return F.lit(None).cast("int")
    if low == high:
        return F.when(x.isNotNull(), F.lit(0))
    width = (high - low) / bins
    return F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")


def _edges(low, high, bins) -> list[Column]:
    width = 0.0 if low is None else (high - low) / bins
    start = F.lit(low if low is not None else 0.0) + F.col("bin") * F.lit(width)
    return [start.alias("lower"), (start + F.lit(width)).alias("upper")]


def histogram(df: DataFrame, x: str, bins: int = 20, color: str | None = None) -> DataFrame:
    """Non-empty bins with their edges and counts, optionally per category."""
    require(df, x)
    low, high = _ranges(df, [x])[x]
    keys = [col(color)] if color else []
    counted = df.select(*keys, even_bin(as_double(df, x), low, high, bins).alias("bin")).where(F.col("bin").isNotNull())
    return counted.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n")).select(*keys, "bin", *_edges(low, high, bins), "n")


def histogram_overlay(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """Histograms of several columns, each over its own range, from one scan."""
    require(df, *columns)
    ranges = _ranges(df, columns)
    cells = F.array(*[
        F.struct(F.lit(i).alias("idx"), even_bin(as_double(df, c), *ranges[c], bins).alias("bin")) for i, c in enumerate(columns)
    ])
    counted = df.select(F.inline(cells)).where(F.col("bin").isNotNull()).groupBy("idx", "bin").agg(F.count(F.lit(1)).alias("n"))
    lows = F.array(*[F.lit(float(ranges[c][0] or 0.0)) for c in columns])
    widths = F.array(*[F.lit(0.0 if ranges[c][0] is None else (ranges[c][1] - ranges[c][0]) / bins) for c in columns])
    names = F.array(*[F.lit(c) for c in columns])
    lower = F.get(lows, F.col("idx")) + F.col("bin") * F.get(widths, F.col("idx"))
    return counted.select(F.get(names, F.col("idx")).alias("column"), "bin", lower.alias("lower"),
                          (lower + F.get(widths, F.col("idx"))).alias("upper"), "n")


def histogram_per_category(df: DataFrame, x: str, category: str, top: int | None = None, bins: int = 20) -> DataFrame:
    return histogram(keep_tops(df, [(category, top)]), x, bins, category)


def box(df: DataFrame, y: str, groups: Sequence[str] = (), tops: Sequence[int | None] = ()) -> DataFrame:
    """Quartiles, whisker ends (values within 1.5 IQR) and outlier count per group; ``tops`` cuts to the most frequent groups."""
    require(df, y, *groups)
    df = keep_tops(df, list(zip(groups, tops)))
    work = df.select(*[col(g) for g in groups], as_double(df, y).alias("__y")).where(F.col("__y").isNotNull())
    keys = list(groups) or ["__all"]
    if not groups:
        work = work.withColumn("__all", F.lit(0))
    quartiles = grouped_quantiles(work, keys, "__y", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = FENCE * (F.col("q3") - F.col("q1"))
    inside = F.col("__y").between(F.col("q1") - reach, F.col("q3") + reach)
    if groups:
        with_quartiles = looked_up(work, quartiles, keys, "inner")
    else:  # one row of figures, put in as constants
        row = quartiles.head()
        with_quartiles = work.withColumns({c: F.lit(row[c] if row else None).cast("double") for c in ("q1", "median", "q3")})
    figures = with_quartiles.groupBy(*[col(k) for k in keys]).agg(
        *[F.first(c).alias(c) for c in ("q1", "median", "q3")],
        F.min(F.when(inside, F.col("__y"))).alias("whisker_low"), F.max(F.when(inside, F.col("__y"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"), F.count(F.lit(1)).alias("n"),
    )
    return figures if groups else figures.drop("__all")


def density(df: DataFrame, x: str, points: int = KDE_POINTS, group: str | None = None) -> DataFrame:
    """Gaussian density on an even grid, Scott bandwidth, from all rows.

    A fast Gauss sum: the axis is cut into cells one bandwidth wide, of which the scan keeps the first ``TERMS`` power sums
    of the offsets v from the cell's middle, in bandwidths. A cell adds to the grid point at distance u

        exp(-(u - v)^2 / 2) = exp(-u^2 / 2) * sum over n of He_n(u) v^n / n!

    with He_n the Hermite polynomials. By Cramer's bound the terms left out are below 1.09 |v|^p / sqrt(p!) for a row, 7e-16
    with |v| <= 1/2 and p = 20. So what leaves the scan depends on the range in bandwidths, not on the
    number of distinct values. Points more than ``FAR`` bandwidths away get less than a double can hold. Groups with
    fewer than two distinct values are left out.
    """
    require(df, x)
    keys = [col(group).alias("__g")] if group else [F.lit(0).alias("__g")]
    rows = df.select(*keys, as_double(df, x).alias("__x")).where(F.col("__x").isNotNull())
    shape = rows.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__a"), F.max("__x").alias("__b"),
                                    F.stddev_samp("__x").alias("__s"))
    shape = shape.where(F.col("__a") < F.col("__b")).withColumn("__h", F.col("__s") * F.pow(F.col("__n").cast("double"), F.lit(-0.2))).drop("__s")
    shared = ("__n", "__a", "__b", "__h")
    if group:
        with_shape = looked_up(rows, shape, "__g", "inner")
    else:
        row = shape.head()
        if row is None:
            return small_frame(df.sparkSession, [], "point int, x double, density double")
        with_shape = rows.select("*", *[F.lit(row[c]).alias(c) for c in shared])
    scaled = with_shape.withColumn("__y", (F.col("__x") - F.col("__a")) / F.col("__h")).withColumn("__cell", F.floor("__y")).withColumn("__v", F.col("__y") - F.col("__cell") - 0.5)
    power, sums = F.lit(1.0), []
    for n in range(TERMS):
        sums.append((F.sum(power) / F.lit(float(math.factorial(n)))).alias(f"__m{n}"))
        power = power * F.col("__v")
    cells = scaled.groupBy("__g", "__cell").agg(*sums, *[F.first(c).alias(c) for c in shared])

    step = (F.col("__b") - F.col("__a")) / F.lit(float(points - 1))
    middle = F.col("__a") + (F.col("__cell") + 0.5) * F.col("__h")
    low = F.greatest(F.lit(0.0), F.ceil((middle - FAR * F.col("__h") - F.col("__a")) / step).cast("double")).cast("int")
    high = F.least(F.lit(points - 1.0), F.floor((middle + FAR * F.col("__h") - F.col("__a")) / step).cast("double")).cast("int")
    at = F.col("__a") + F.col("point") * step
    terms = F.array(*[F.struct(F.lit(float(n)).alias("n"), F.col(f"__m{n}").alias("c")) for n in reversed(range(TERMS))])
    spread = cells.select("__g", *shared, terms.alias("__terms"), middle.alias("__mid"), F.explode(F.when(low <= high, F.sequence(low, high))).alias("point")).withColumn(
        "__u", (at - F.col("__mid")) / F.col("__h"))
    # Clenshaw's recurrence, from the last term: b = c_n + u * (b before) - (n + 1) * (b before that)
    start = F.struct(F.lit(0.0).alias("one"), F.lit(0.0).alias("two"))
    series = F.aggregate("__terms", start, lambda b, t: F.struct((t["c"] + F.col("__u") * b["one"] - (t["n"] + 1.0) * b["two"]).alias("one"), b["one"].alias("two")))["one"]
    total = spread.groupBy("__g", "point").agg(F.sum(F.exp(F.lit(-0.5) * F.col("__u") * F.col("__u")) * series).alias("__sum"), *[F.first(c).alias(c) for c in shared])
    if group:
        grid = shape.select("__g", *shared, F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point")).join(total.select("__g", "point", "__sum"), ["__g", "point"], "left")
    else:
        grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point"), *[F.lit(row[c]).alias(c) for c in shared]).join(total.select("point", "__sum"), "point", "left")
    found = F.greatest(F.coalesce("__sum", F.lit(0.0)), F.lit(0.0)) / (F.col("__n") * F.col("__h") * F.lit(math.sqrt(2 * math.pi)))
    return grid.select(*([F.col("__g").alias(group)] if group else []), "point", at.alias("x"), found.alias("density"))


def violin(df: DataFrame, y: str, group: str | None = None, top: int | None = None) -> DataFrame:
    """Density per group with the box figures of the group on every point."""
    if group is None:
        return density(df, y).join(F.broadcast(box(df, y)), F.lit(True))  # one row of figures
    limited = keep_tops(df, [(group, top)])
    return density(limited, y, group=group).join(box(limited, y, [group]), group)


def ecdf(df: DataFrame, x: str) -> DataFrame:
    """One row per distinct value: share of values at or below it."""
    require(df, x)
    ranked = value_ranks(df.select(as_double(df, x).alias("value")), "value")
    return ranked.select("value", "n", (F.col("upto_n") / F.col("all_n")).alias("share"))


def value_bars(df: DataFrame, x: str, sort: str = "freq_desc", top: int | None = None) -> DataFrame:
    """Counts by value, missing shown under a label; sort is value, freq_asc or freq_desc."""
    require(df, x)
    orders = {"value": [F.asc("value")], "freq_asc": [F.asc("n"), F.asc("value")], "freq_desc": [F.desc("n"), F.asc("value")]}
    if sort not in orders:
        raise ValueError(f"unknown sort {sort!r}")
    label = F.coalesce(col(x).cast("string"), F.lit(MISSING_LABEL)).alias("value")
    if sort == "freq_desc" and top is not None:
        return small_frame(df.sparkSession, most_frequent(df.select(label), ["value"], top)["value"], "value string, n bigint").orderBy(*orders[sort])
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(*orders[sort])
    return counts if top is None else counts.limit(top)


def pie_with_other(df: DataFrame, x: str, top: int = 10) -> DataFrame:
    """The ``top`` values and the rest summed to Other, when there is a rest."""
    require(df, x)
    label = F.coalesce(col(x).cast("string"), F.lit(MISSING_LABEL)).alias("value")
    shown = most_frequent(df.select(label), ["value"], top)["value"]
    rest = df.agg((F.count(F.lit(1)) - F.lit(sum(n for _, n in shown))).cast("bigint").alias("n")).select(F.lit("Other").alias("value"), "n")
    return small_frame(df.sparkSession, shown, "value string, n bigint").unionByName(rest.where(F.col("n") > 0))


def shares(df: DataFrame, x: str) -> DataFrame:
    """Count and percentage of every non-missing value."""
    require(df, x)
    present = df.where(col(x).isNotNull())
    total = present.count()
    return present.groupBy(col(x).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(
        "value", "n", F.round(percent(F.col("n"), F.lit(total)), 2).alias("percentage")).orderBy(F.desc("n"), "value")


def crosstab(df: DataFrame, rows: str, columns: str, tops: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """Counts and column percentages for every pair of kept categories, zero cells included; ``tops`` cuts to the most frequent."""
    require(df, rows, columns)
    df = keep_tops(df, [(rows, tops[0]), (columns, tops[1])]).where(col(rows).isNotNull() & col(columns).isNotNull())
    counted = df.groupBy(col(rows).alias("row"), col(columns).alias("col")).agg(F.count(F.lit(1)).alias("n"))
    # zero cells make the result as large as both key lists together; callers cut long ones by tops
    pairs = counted.select("row").distinct().crossJoin(counted.select("col").distinct())
    full = pairs.join(counted, ["row", "col"], "left").select("row", "col", F.coalesce("n", F.lit(0)).alias("n"))
    per_column = F.sum("n").over(Window.partitionBy("col"))
    return full.select("row", "col", "n", F.round(percent(F.col("n"), per_column), 2).alias("percentage"))


def range_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = df.agg(*[f(col(c)).alias(f"{t}{i}") for i, c in enumerate(columns) for t, f in (("a", F.min), ("b", F.max))])
    return to_long(wide, [{"column": F.lit(c), "low": F.col(f"a{i}"), "high": F.col(f"b{i}")} for i, c in enumerate(columns)])
