"""Exact quantiles (linear interpolation) that hold at any size.

Small inputs use Spark's exact ``percentile``, whose buffer then has a known bound. Larger
ones narrow a bracket around each wanted rank by histogram passes that send only bin
counts over the network, until the value is known or few values are left.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablecraft.functions.columns import col
from tablecraft.functions.ordering import ROWS_PER_BUCKET, value_ranks

DIRECT_ROWS = 100_000
BINS = 1024
SKETCH_ACCURACY = 10_000
Wanted = Mapping[str, tuple[Column, Sequence[float]]]


def exact_quantiles(df: DataFrame, wanted: Wanted, rows: int | None = None, direct: int = DIRECT_ROWS) -> dict[str, list]:
    """``{name: (column, [p, ...])}`` -> ``{name: [value or None, ...]}``."""
    if not wanted:
        return {}
    rows = df.count() if rows is None else rows
    if rows <= direct:
        row = df.agg(*[
            F.percentile(expr.cast("double"), F.array(*[F.lit(float(p)) for p in ps])).alias(name)
            for name, (expr, ps) in wanted.items()
        ]).head()
        return {n: list(row[n]) if row[n] is not None else [None] * len(ps) for n, (_, ps) in wanted.items()}
    return _narrowing(df, wanted, direct)


def _narrowing(df: DataFrame, wanted: Wanted, direct: int) -> dict[str, list]:
    values = {n: e.cast("double") for n, (e, _) in wanted.items()}
    first = df.agg(*[
        f(values[n]).alias(f"{tag}{i}")
        for i, n in enumerate(wanted) for tag, f in (("n", F.count), ("a", F.min), ("b", F.max))
    ]).head()
    out: dict[str, list] = {n: [None] * len(ps) for n, (_, ps) in wanted.items()}
    still: list[dict] = []
    for i, (name, (_, ps)) in enumerate(wanted.items()):
        n = first[f"n{i}"]
        for j, p in enumerate(ps):
            if n:
                place = p * (n - 1)
                k = min(int(math.floor(place)), n - 1)
                still.append(dict(name=name, j=j, k=k, k2=min(k + 1, n - 1), part=place - k, before=math.inf,
                                  lo=first[f"a{i}"], hi=first[f"b{i}"], below=0, inside=n))

    def settle(q, low, high):
        out[q["name"]][q["j"]] = low + (high - low) * q["part"]

    while still:
        for q in [q for q in still if q["lo"] == q["hi"]]:
            settle(q, q["lo"], q["hi"])
        still = [q for q in still if q["lo"] != q["hi"]]
        small = [q for q in still if q["inside"] <= direct]
        if small:
            _finish(df, values, small, settle)
        still = [q for q in still if q["inside"] > direct]
        # a histogram pass that hardly helped (values bunched in one bin) is followed by a sketch
        even = [q for q in still if q["inside"] <= q["before"] / 4 and math.isfinite(BINS / (q["hi"] - q["lo"])) and q["hi"] - q["lo"] < math.inf]
        bunched = [q for q in still if q not in even]
        still = (_histogram(df, values, even, settle) if even else []) + (_sketch(df, values, bunched) if bunched else [])
    return out


def _inside(values, q) -> Column:
    x = values[q["name"]]
    return F.when(x.between(q["lo"], q["hi"]), x)


def _finish(df, values, final, settle) -> None:
    """Few values are left in each bracket: read the two neighbours of the rank exactly."""
    def share(q, k):
        return F.lit((k - q["below"]) / max(1, q["inside"] - 1))

    row = df.agg(*[
        F.percentile(_inside(values, q), F.array(share(q, q["k"]), share(q, q["k2"]))).alias(f"q{i}")
        for i, q in enumerate(final)
    ]).head()
    for i, q in enumerate(final):
        settle(q, *row[f"q{i}"])


def _histogram(df, values, asks, settle) -> list[dict]:
    """Count each bracket in equal-width bins and keep the bin that holds the rank.

    Bins are told apart by the smallest and largest value seen in them, so rounding in the
    bin number cannot shift a rank. At most BINS rows per bracket reach the driver.
    """
    brackets = sorted({(q["name"], q["lo"], q["hi"]) for q in asks})
    cells = []
    for i, (name, lo, hi) in enumerate(brackets):
        x = values[name]
        place = F.least(F.floor((x - F.lit(lo)) * F.lit(BINS / (hi - lo))), F.lit(BINS - 1)).cast("int")
        cells.append(F.when(x.between(lo, hi), F.struct(F.lit(i).alias("ask"), place.alias("bin"), x.alias("x"))))
    counted = df.select(F.inline(F.array(*cells))).where(F.col("ask").isNotNull()).groupBy("ask", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    bins: dict[int, list] = {}
    for r in counted.collect():
        bins.setdefault(r["ask"], []).append((r["bin"], r["n"], r["lo"], r["hi"]))
    out = []
    for q in asks:
        below, low, high, kept = q["below"], None, None, None
        for _, n, lo, hi in sorted(bins[brackets.index((q["name"], q["lo"], q["hi"]))]):
            if below <= q["k"] < below + n:
                kept = (below, n, lo, hi)
            if q["k"] == below + n - 1 or lo == hi and below <= q["k"] < below + n:
                low = hi                      # last of its bin, or a bin of equal values
            if q["k2"] == below or lo == hi and below <= q["k2"] < below + n:
                high = lo                     # first of its bin, or a bin of equal values
            below += n
        if low is not None and high is not None:
            settle(q, low, high)
        else:
            start, n, lo, hi = kept
            if q["k2"] >= start + n:          # only when k is the last of the bin: settled above
                raise AssertionError("rank left its bin")
            out.append({**q, "before": q["inside"], "below": start, "inside": n, "lo": lo, "hi": hi})
    return out


def _sketch(df, values, asks) -> list[dict]:
    """Narrow by a mergeable sketch, whose proposal is checked by counting."""
    slack = 2.0 / SKETCH_ACCURACY
    spots = []
    for i, q in enumerate(asks):
        at, at2 = ((k - q["below"]) / q["inside"] for k in (q["k"], q["k2"]))
        wanted = F.array(F.lit(max(0.0, at - slack)), F.lit(min(1.0, at2 + slack)))
        spots.append(F.percentile_approx(_inside(values, q), wanted, F.lit(SKETCH_ACCURACY)).alias(f"s{i}"))
    sketch = df.agg(*spots).head()
    counts = []
    for i, q in enumerate(asks):
        x, (lo, hi) = values[q["name"]], sketch[f"s{i}"]
        counts += [F.count_if(x < lo).alias(f"b{i}"), F.count_if(x <= hi).alias(f"u{i}")]
    seen = df.agg(*counts).head()
    out = []
    for i, q in enumerate(asks):
        (lo, hi), below, upto = sketch[f"s{i}"], seen[f"b{i}"], seen[f"u{i}"]
        new, edge = {**q, "before": math.inf}, q["below"] + q["inside"]
        if below <= q["k"]:                   # the sketch really lies at or below the rank
            new["lo"], new["below"] = lo, below
        if upto > q["k2"]:
            new["hi"], edge = hi, upto
        new["inside"] = edge - new["below"]
        out.append(new)
    return out


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ps: Mapping[str, float],
    rows: int | None = None,
    direct: int = DIRECT_ROWS,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per key with an exact quantile column for each entry of ``ps``."""
    rows = df.count() if rows is None else rows
    groups = [col(k) for k in keys]
    if rows <= direct:
        spots = F.array(*[F.lit(float(p)) for p in ps.values()])
        return df.groupBy(*groups).agg(F.percentile(col(value).cast("double"), spots).alias("__q")).select(
            *groups, *[F.col("__q")[i].alias(n) for i, n in enumerate(ps)]
        )
    ranked = value_ranks(df.select(*groups, col(value).cast("double").alias("__v")), "__v", keys, None, rows, rows_per_bucket)
    start, upto, total = F.col("upto_n") - F.col("n"), F.col("upto_n"), F.col("all_n")
    picks = []
    for i, p in enumerate(ps.values()):
        low = F.floor(F.lit(float(p)) * (total - 1))
        high = F.least(low + 1, total - 1)
        for tag, k in (("lo", low), ("hi", high)):
            picks.append(F.max(F.when((start <= k) & (k < upto), F.col("__v"))).alias(f"{tag}{i}"))
    picked = ranked.groupBy(*groups).agg(F.max("all_n").alias("__n"), *picks)
    out = []
    for i, (name, p) in enumerate(ps.items()):
        place = F.lit(float(p)) * (F.col("__n") - 1)
        part = place - F.floor(place)
        out.append((F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * part).alias(name))
    return picked.select(*groups, *out)
