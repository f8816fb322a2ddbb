"""Seeded, repeatable row choice by hashing a key. No shuffle of the table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablecraft.functions.columns import col

SPACE = 1 << 52
PREFILTER_ROWS = 10_000_000
PLAIN_CUTS = 64
#: Bins counted in one pass over all brackets; so many rows of a bracket may be ranked.
BINS, NEAR_ROWS = 65_536, 50_000


def row_hash(key: Sequence[str], seed: int) -> Column:
    """Uniform integer in [0, 2**52), exact as a double."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(int(seed)), *[col(k) for k in key]), 12)


def seeded_sample(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows: those with the smallest hash of ``key``."""
    rows = df.count()
    if rows <= n:
        return df
    chosen, h = df, row_hash(key, seed)
    if rows > PREFILTER_ROWS:
        # keep slightly more than needed so that the top-n merge sees about n rows, not n per task
        limit = int(SPACE * min(1.0, (n + 8 * n ** 0.5 + 64) / rows))
        narrowed = df.where(h < F.lit(limit))
        chosen = narrowed if narrowed.count() >= n else df
    return chosen.orderBy(h, *[col(k) for k in key]).limit(n)


def rank_cuts(
    df: DataFrame, key: Sequence[str], seed: int, wanted: Mapping[object, Sequence[int]],
    sizes: Mapping[object, int], label: str | None = None,
) -> dict[object, list]:
    """For each class, the (hash, key) tuple found at each 1-based rank in hash order.

    ``wanted`` lists equally many ranks for every class. Hashes are uniform, so a narrow
    bracket around each rank is known beforehand; one pass counts what lies below it and
    only the rows in it are ranked. Where it missed (rows already chosen by the same hash are not
    uniform) passes that count bins close in on the rank, so that never many rows are ranked.
    """
    base = df.select(
        (col(label) if label else F.lit(0)).alias("__class"), row_hash(key, seed).alias("__h"),
        *[col(k).alias(f"__k{i}") for i, k in enumerate(key)],
    )
    order = ["__h", *[f"__k{i}" for i in range(len(key))]]
    width = max((len(ranks) for ranks in wanted.values()), default=0)
    todo = {(c, j) for c, ranks in wanted.items() for j, r in enumerate(ranks) if 0 < r <= sizes[c]}
    found: dict = {}
    brackets: dict = {}
    for c, ranks in wanted.items():
        n = max(1, sizes[c])
        slack = (8 * n ** 0.5 + 16) / n
        for j, r in enumerate(ranks):
            brackets[(c, j)] = (int(max(0.0, r / n - slack) * SPACE), int(min(1.0, r / n + slack) * SPACE))
    below = {r["__class"]: r["b"] for r in base.groupBy("__class").agg(
        F.array(*[F.count_if(F.col("__h") < _bounds(wanted, brackets, todo, 0)[j]) for j in range(width)]).alias("b")).collect()} if todo else {}
    skipped = {(c, j): below[c][j] for c, j in todo if c in below}
    while todo:
        # a class gives a few numbers, so these tables stay small
        at = _by_class({c: [ranks[j] - skipped.get((c, j), 0) for j in range(width)] for c, ranks in wanted.items()})
        near = _hits(base, wanted, brackets, todo, width)
        rank = F.row_number().over(Window.partitionBy("__class", "__j").orderBy(*order))
        for row in near.withColumn("__r", rank).where(F.col("__r") == F.get(at, F.col("__j"))).collect():
            found[(row["__class"], row["__j"])] = [row[o] for o in order]
        todo -= set(found)
        if todo:
            brackets, skipped = _closed_in(base, wanted, sizes, todo, width)
    return {c: [found.get((c, j)) for j in range(len(ranks))] for c, ranks in wanted.items()}


def _bounds(wanted, brackets, todo, side: int) -> Column:
    """For the row's class, the lower or upper ends of its brackets; -1 where nothing is asked."""
    return _by_class({c: [brackets[(c, j)][side] if (c, j) in todo else -1 for j in range(len(ranks))] for c, ranks in wanted.items()})


def _hits(base: DataFrame, wanted, brackets, todo, width: int) -> DataFrame:
    """Each row once for every bracket ``__j`` of its class that it lies in."""
    lows, highs = (_bounds(wanted, brackets, todo, side) for side in (0, 1))
    hits = F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.col("__h").between(F.get(lows, j), F.get(highs, j)))
    return base.select("*", F.explode(hits).alias("__j"))


def _closed_in(base: DataFrame, wanted, sizes, todo, width: int) -> tuple[dict, dict]:
    """Brackets that hold the ranks and few rows (or one hash), and how many rows of the class lie before each."""
    bins = max(16, BINS // len(todo))
    brackets, skipped = {k: (0, SPACE - 1) for k in todo}, dict.fromkeys(todo, 0)
    wide = {k for k in todo if sizes[k[0]] > NEAR_ROWS}
    while wide:
        steps = {k: -(-(hi - lo + 1) // bins) for k, (lo, hi) in brackets.items()}
        step = F.get(_by_class({c: [steps.get((c, j), 1) for j in range(width)] for c in wanted}), F.col("__j"))
        low = F.get(_bounds(wanted, brackets, wide, 0), F.col("__j"))
        start = (F.col("__h") - F.pmod(F.col("__h") - low, step)).alias("start")
        counted: dict = {}
        for r in _hits(base, wanted, brackets, wide, width).groupBy("__class", "__j", start).count().collect():
            counted.setdefault((r["__class"], r["__j"]), []).append((r["start"], r["count"]))
        for c, j in list(wide):
            for at, n in sorted(counted[(c, j)]):
                if skipped[(c, j)] + n >= wanted[c][j]:
                    break
                skipped[(c, j)] += n
            brackets[(c, j)] = (at, at + steps[(c, j)] - 1)
            if n <= NEAR_ROWS or steps[(c, j)] == 1:
                wide.remove((c, j))
    return brackets, skipped


def _by_class(values: Mapping[object, Sequence[int]]) -> Column:
    """The row's class turned into its list of numbers."""
    items = [part for c, numbers in values.items() for part in (F.lit(c), F.array(*[F.lit(v).cast("bigint") for v in numbers]))]
    return F.try_element_at(F.create_map(*items), F.col("__class"))


def with_piece(
    df: DataFrame, name: str, key: Sequence[str], seed: int, cuts: Mapping[object, Sequence], label: str | None = None,
) -> DataFrame:
    """Add the 0-based piece of every row: how many of its class's cut tuples lie before it."""
    hashed = df.withColumn("__h", row_hash(key, seed))
    few = sum(len(points) for points in cuts.values()) <= PLAIN_CUTS
    piece = _piece_by_tests(key, cuts, label) if few else _piece_by_table(df, key, cuts, label)
    return hashed.withColumn(name, piece).drop("__h")


def _piece_by_tests(key, cuts, label) -> Column:
    """Plain comparisons, which compile well; for few classes and cuts."""
    parts = [F.col("__h"), *[col(k) for k in key]]

    def at_or_before(cut) -> Column:
        test = parts[-1] <= F.lit(cut[-1])
        for part, value in list(zip(parts, cut))[-2::-1]:
            test = (part < F.lit(value)) | ((part == F.lit(value)) & test)
        return test

    piece = F.lit(None).cast("int")
    for c, points in cuts.items():
        inside = F.lit(len(points))
        for i in reversed(range(len(points))):
            # a rank of zero has no tuple: every row lies after that cut
            if points[i] is not None:
                inside = F.when(at_or_before(points[i]), i).otherwise(inside)
        piece = inside if label is None else F.when(col(label) == F.lit(c), inside).otherwise(piece)
    return piece


def _piece_by_table(df, key, cuts, label) -> Column:
    """Look the class's cut tuples up in a literal map; for many classes."""
    kinds = [df.schema[k].dataType for k in key]

    def tuple_of(values) -> Column:
        return F.struct(F.lit(values[0]).cast("bigint").alias("h"), *[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(values[1:], kinds))])

    here = F.struct(F.col("__h").alias("h"), *[col(k).cast(t).alias(f"k{i}") for i, (k, t) in enumerate(zip(key, kinds))])
    items = []
    for c, points in cuts.items():
        known = [tuple_of(p) for p in points if p is not None]
        points_column = F.array(*known) if known else F.filter(F.array(here), lambda p: F.lit(False))
        items += [F.lit(c), F.struct(F.lit(len(points) - len(known)).alias("skipped"), points_column.alias("points"))]
    mine = F.try_element_at(F.create_map(*items), col(label) if label else F.lit(0))
    return mine["skipped"] + F.size(F.filter(mine["points"], lambda p: p < here))
