"""Frames behind charts of several columns: correlation, pivots, radar, hierarchies."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tablecraft.functions.columns import as_double, col, columns_of, quoted, require
from tablecraft.functions.ordering import ROWS_PER_BUCKET, running_sums, value_ranks
from tablecraft.functions.sampling import seeded_sample
from tablecraft.functions.stats import pearson, to_long
from tablecraft.operators.rows import keep_tops
from tablecraft.session import freeze, small_frame

PAIRS_PER_PASS = 300
AGGREGATES = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}


def _pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i:]]


def _mirrored(half: DataFrame) -> DataFrame:
    other = half.where(F.col("column_a") != F.col("column_b")).select(
        F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "correlation")
    return half.unionByName(other)


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """Long form (column_a, column_b, correlation); rows complete in both columns count."""
    columns = list(columns or columns_of(df, "numeric"))
    require(df, *columns)
    pairs = _pairs(columns)
    if method == "pearson":
        return _mirrored(_pearson_pairs(df, pairs))
    if method not in ("spearman", "kendall"):
        raise ValueError(f"unknown method {method!r}")
    if method == "spearman":
        return _mirrored(_spearman_pairs(df, columns))
    return _mirrored(_one_by_one(df, pairs, kendall))


def _one_by_one(df: DataFrame, pairs: Sequence[tuple[str, str]], one: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    frames = [one(df, a, b).select(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col("correlation")) for a, b in pairs]
    return reduce(DataFrame.unionByName, frames)


def _spearman_pairs(df: DataFrame, columns: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Rank correlations of all pairs. Columns without missing values are ranked together, once each.

    One unpivoted pass counts and ranks the distinct values of all these columns, each is looked up once by the rows, and
    one aggregate sums the products. Ranks of a pair with missing values depend on both columns, so such pairs are ranked by themselves.
    """
    numbers = df.select(*[as_double(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    known = numbers.agg(F.count(F.lit(1)).alias("rows"), *[F.count(f"x{i}").alias(f"x{i}") for i in range(len(columns))]).head()
    whole = [i for i in range(len(columns)) if known[f"x{i}"] == known["rows"]]
    shared = [(columns[i], columns[j], i, j) for a, i in enumerate(whole) for j in whole[a:]]
    apart = [(a, b) for a, b in _pairs(columns) if (a, b) not in {(a, b) for a, b, *_ in shared}]
    frames = [_one_by_one(df, apart, spearman)] if apart else []
    if shared:
        values = F.array(*[F.struct(F.lit(i).alias("idx"), F.col(f"x{i}").alias("x")) for i in whole])
        ranked = value_ranks(numbers.select(F.inline(values)), "x", ("idx",), rows=known["rows"] * len(whole), rows_per_bucket=rows_per_bucket)
        ranks = freeze(ranked.select("idx", "x", (F.col("upto_n") - (F.col("n") - 1) / 2.0 - (F.col("all_n") + 1) / 2.0).alias("r")))
        rows = numbers
        for i in whole:
            rows = rows.join(ranks.where(F.col("idx") == i).select(F.col("x").alias(f"x{i}"), F.col("r").alias(f"r{i}")), f"x{i}")
        rows = rows.select(*[f"r{i}" for i in whole])
        rows = freeze(rows) if len(shared) > PAIRS_PER_PASS else rows
        for start in range(0, len(shared), PAIRS_PER_PASS):
            part = shared[start:start + PAIRS_PER_PASS]
            length = {i: F.sqrt(F.sum(F.col(f"r{i}") * F.col(f"r{i}"))) for i in whole}
            wide = rows.agg(*[F.try_divide(F.sum(F.col(f"r{i}") * F.col(f"r{j}")), length[i] * length[j]).alias(f"c{k}") for k, (_, _, i, j) in enumerate(part)])
            frames.append(to_long(wide, [{"column_a": F.lit(a), "column_b": F.lit(b), "correlation": F.col(f"c{k}")} for k, (a, b, *_) in enumerate(part)]))
    return reduce(DataFrame.unionByName, frames)


def _pearson_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    out = None
    for start in range(0, len(pairs), PAIRS_PER_PASS):
        part = pairs[start:start + PAIRS_PER_PASS]
        wide = df.agg(*[pearson(as_double(df, a), as_double(df, b)).alias(f"c{i}") for i, (a, b) in enumerate(part)])
        frame = to_long(wide, [
            {"column_a": F.lit(a), "column_b": F.lit(b), "correlation": F.col(f"c{i}")} for i, (a, b) in enumerate(part)])
        out = frame if out is None else out.unionByName(frame)
    return out


def _joint(df: DataFrame, a: str, b: str) -> DataFrame:
    """(x, y, n): distinct value pairs of complete rows."""
    x, y = as_double(df, a).alias("x"), as_double(df, b).alias("y")
    return df.select(x, y).where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


def _average_ranks(joint: DataFrame, axis: str, rows: int, rows_per_bucket: int) -> DataFrame:
    """Average rank of every value, less the mean rank (m + 1) / 2."""
    ranked = value_ranks(joint, axis, (), "n", rows, rows_per_bucket)
    rank = F.col("upto_n") - (F.col("n") - 1) / 2.0
    return ranked.select(axis, (rank - (F.col("all_n") + 1) / 2.0).alias(f"r{axis}"))


def spearman(df: DataFrame, a: str, b: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Correlation of average ranks. Ranks come from running sums over distinct values."""
    rows = df.count()
    joint = _joint(df, a, b)
    full = joint.join(_average_ranks(joint, "x", rows, rows_per_bucket), "x").join(
        _average_ranks(joint, "y", rows, rows_per_bucket), "y")
    n, x, y = F.col("n").cast("double"), F.col("rx"), F.col("ry")
    return full.agg(F.try_divide(F.sum(n * x * y), F.sqrt(F.sum(n * x * x)) * F.sqrt(F.sum(n * y * y))).alias("correlation"))


def kendall(df: DataFrame, a: str, b: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Kendall's tau-b over all rows without comparing pairs of rows.

    Two rows are discordant when their y order contradicts their x order. Write the dense
    rank of y in binary: a contradicting pair first differs at exactly one bit. For every
    bit, rows sharing the higher bits are walked in x order, and each row whose bit is 0
    meets the rows before it whose bit is 1: a running sum. Rows are expanded once per
    bit, so the work grows with n log n; running sums are bucketed, so no group has to fit
    one task.
    """
    rows = df.count()
    joint = _joint(df, a, b)
    y_codes = running_sums(joint.select("y").distinct().withColumn("one", F.lit(1).cast("bigint")), "y", ["one"], (), rows, rows_per_bucket)
    coded = joint.join(y_codes.select("y", (F.col("upto_one") - 1).alias("code")), "y")
    top = coded.agg(F.max("code")).head()[0]
    if top is None:
        return small_frame(df.sparkSession, [(None,)], "correlation double")
    bits = max(1, int(top).bit_length())
    spread = coded.select("x", "n", "code", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    one = F.expr("shiftright(code, bit)")
    placed = spread.select(
        "bit", F.expr("shiftright(code, bit + 1)").alias("prefix"), "x",
        F.when(one.bitwiseAND(F.lit(1)) == 1, F.col("n")).otherwise(F.lit(0)).alias("ones"),
        F.when(one.bitwiseAND(F.lit(1)) == 0, F.col("n")).otherwise(F.lit(0)).alias("zeros"),
    )
    # rows of equal x never contradict each other: they are summed first and meet only smaller x
    steps = placed.groupBy("bit", "prefix", "x").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    run = running_sums(steps, "x", ["ones"], ("bit", "prefix"), rows * bits, rows_per_bucket)
    discordant = run.agg(F.sum((F.col("upto_ones") - F.col("ones")).cast("decimal(38,0)") * F.col("zeros")).alias("dis"))

    def tied(frame: DataFrame, axis: Sequence[str]) -> DataFrame:
        m = F.col("m").cast("decimal(38,0)")
        return frame.groupBy(*axis).agg(F.sum("n").alias("m")).agg(F.sum(m * (m - 1) / 2).alias("t"))

    total = df.sparkSession.range(1).select()  # one row to attach the figures to
    parts = total.join(discordant, F.lit(True))
    for name, axis in (("tx", ["x"]), ("ty", ["y"]), ("txy", ["x", "y"])):
        parts = parts.join(tied(joint, axis).select(F.col("t").cast("double").alias(name)), F.lit(True))
    everything = joint.agg(F.sum("n").cast("double").alias("m"))
    parts = parts.join(everything, F.lit(True))
    pairs = F.col("m") * (F.col("m") - 1) / 2
    dis = F.col("dis").cast("double")
    concordant = pairs - F.col("tx") - F.col("ty") + F.col("txy") - dis
    return parts.select(F.try_divide(concordant - dis, F.sqrt(pairs - F.col("tx")) * F.sqrt(pairs - F.col("ty"))).alias("correlation"))


def strongest_pairs(df: DataFrame, columns: Sequence[str] | None = None, n: int = 10, method: str = "pearson") -> DataFrame:
    """Pairs of different columns by absolute correlation, each once."""
    matrix = correlation_matrix(df, columns, method)
    return matrix.where((F.col("column_a") < F.col("column_b")) & F.col("correlation").isNotNull()).orderBy(
        F.desc(F.abs("correlation")), "column_a", "column_b").limit(n)


def scatter(
    df: DataFrame, x: str, ys: Sequence[str], key: Sequence[str], color: str | None = None, size: str | None = None,
    points: int = 5000, seed: int = 42, colors: int | None = None,
) -> DataFrame:
    """Points (x, column, value) of a seeded sample; ``colors`` limits the categories to the most frequent."""
    require(df, x, *ys, *key)
    if color:
        df = keep_tops(df, [(color, colors)])
    extra = [col(c) for c in (color, size) if c]
    chosen = seeded_sample(df.select(*{c: col(c) for c in (*key, x, *ys, *[c for c in (color, size) if c])}.values()), points, key, seed)
    cells = F.array(*[F.struct(F.lit(y).alias("column"), as_double(df, y).alias("value")) for y in ys])
    return chosen.select(*[col(k) for k in key], col(x).alias("x"), *extra, F.inline(cells))


def pair_plot(df: DataFrame, columns: Sequence[str], key: Sequence[str], points: int = 1000, seed: int = 42) -> DataFrame:
    """Every ordered pair of the columns for the rows of a seeded sample."""
    columns = list(columns)
    chosen = seeded_sample(df.select(*[col(c) for c in dict.fromkeys([*key, *columns])]), points, key, seed)
    cells = F.array(*[
        F.struct(F.lit(a).alias("column_x"), F.lit(b).alias("column_y"), as_double(df, a).alias("x"), as_double(df, b).alias("y"))
        for a in columns for b in columns if a != b
    ])
    return chosen.select(*[col(k) for k in key], F.inline(cells))


def raw_points(df: DataFrame, columns: Sequence[str], key: Sequence[str], points: int = 1000, seed: int = 42) -> DataFrame:
    """Rows for parallel coordinates or a 3D scatter: a seeded sample of the named columns."""
    require(df, *columns)
    return seeded_sample(df.select(*[col(c) for c in dict.fromkeys([*key, *columns])]), points, key, seed)


def parallel_coordinates(df: DataFrame, columns: Sequence[str], key: Sequence[str], color: str | None = None) -> DataFrame:
    if len(columns) < 3:
        raise ValueError("parallel coordinates need three or more columns")
    return raw_points(df, [*columns, *([color] if color else [])], key)


def pivot_long(df: DataFrame, x: str, y: str, values: str, how: str = "sum") -> DataFrame:
    """(y, x, value) cells of a pivot table; missing keys are left out."""
    require(df, x, y, values)
    f = AGGREGATES[how if how in ("sum", "mean", "count") else "sum"]
    return df.where(col(x).isNotNull() & col(y).isNotNull()).groupBy(col(y), col(x)).agg(f(col(values)).alias("value"))


def pivot_wide(df: DataFrame, x: str, y: str, values: str, how: str = "sum", cap: int = 1000) -> DataFrame:
    """One column per value of ``x``; refused when there are more than ``cap``."""
    names = [r[0] for r in df.where(col(x).isNotNull()).select(col(x)).distinct().limit(cap + 1).collect()]
    if len(names) > cap:
        raise ValueError(f"{x} has more than {cap} values; use the long form")
    f = AGGREGATES[how if how in ("sum", "mean", "count") else "sum"]
    return df.where(col(y).isNotNull()).groupBy(col(y)).pivot(quoted(x), sorted(names)).agg(f(col(values)))


def grouped_counts(df: DataFrame, a: str, b: str, tops: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """Counts per pair of categories; ``tops`` cuts to the most frequent ones of the whole table."""
    require(df, a, b)
    df = keep_tops(df, [(a, tops[0]), (b, tops[1])]).where(col(a).isNotNull() & col(b).isNotNull())
    return df.groupBy(col(a), col(b)).agg(F.count(F.lit(1)).alias("n"))


def radar(df: DataFrame, category: str, columns: Sequence[str], categories: Sequence | None = None) -> DataFrame:
    """Mean per category and variable, scaled 0..1 over all categories, then cut to the wanted ones."""
    require(df, category, *columns)
    means = df.where(col(category).isNotNull()).groupBy(col(category)).agg(*[F.avg(col(c)).alias(f"m{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"m{i}").alias("mean")) for i, c in enumerate(columns)])
    long = means.select(col(category), F.inline(cells))
    ends = long.groupBy("variable").agg(F.min("mean").alias("low"), F.max("mean").alias("high"))
    scaled = F.when(F.col("high") > F.col("low"), (F.col("mean") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.col("mean"))
    # ends has one row per variable, a list given by the caller
    out = long.join(F.broadcast(ends), "variable").select(col(category), "variable", "mean", scaled.alias("scaled"))
    return out.where(col(category).isin(list(categories))) if categories is not None else out


def sunburst(df: DataFrame, path: Sequence[str], value: str | None = None) -> DataFrame:
    """Count or sum for every node of a category path, from the root down."""
    require(df, *path)
    measure = F.sum(col(value)) if value else F.count(F.lit(1))
    present = df
    for p in path:
        present = present.where(col(p).isNotNull())
    depth = F.lit(len(path)).cast("bigint") - sum((F.grouping(col(p)).cast("bigint") for p in path), F.lit(0).cast("bigint"))
    return present.rollup(*[col(p) for p in path]).agg(depth.alias("depth"), measure.alias("value"))

