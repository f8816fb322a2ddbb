"""Statistic formulas as plain aggregate expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablecraft.functions.columns import col, columns_of, kind
from tablecraft.functions.frequent import most_frequent
from tablecraft.functions.quantiles import exact_quantiles


def sample_skewness(x: Column) -> Column:
    """Bias-corrected skewness (G1); NULL below three values."""
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.skewness(x) * F.try_divide(F.sqrt(n * (n - 1)), n - 2))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis (G2); NULL below four values."""
    n = F.count(x).cast("double")
    return F.when(n >= 4, F.try_divide(((n + 1) * F.kurtosis(x) + 6) * (n - 1), (n - 2) * (n - 3)))


def pearson(x: Column, y: Column) -> Column:
    """Pairwise-complete correlation; NULL for a constant column instead of an error."""
    a, b = F.when(y.isNotNull(), x.cast("double")), F.when(x.isNotNull(), y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def missing(x: Column) -> Column:
    return F.count_if(x.isNull())


def to_long(wide: DataFrame, records: Sequence[Mapping[str, Column]]) -> DataFrame:
    """Turn a one-row frame into one row per record; records share their field names."""
    return wide.select(F.inline(F.array(*[
        F.struct(*[expr.alias(name) for name, expr in record.items()]) for record in records
    ])))


def unpivot(df: DataFrame, columns: Sequence[str], as_type: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value): one row per cell of ``columns``."""
    return df.select(
        *[col(k) for k in keep],
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), col(c).cast(as_type).alias("value")) for c in columns
        ])),
    )


def _counted(df: DataFrame, columns: Sequence[str], as_type: str) -> DataFrame:
    """(idx, value, n): counts per column position, the compact form that is shuffled."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("idx"), col(c).cast(as_type).alias("value")) for i, c in enumerate(columns)
    ])
    return df.select(F.inline(cells)).where(F.col("value").isNotNull()).groupBy("idx", "value").agg(F.count(F.lit(1)).alias("n"))


def _named(columns: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in columns]), F.col("idx")).alias("column")


def value_counts(df: DataFrame, columns: Sequence[str], as_type: str = "string") -> DataFrame:
    """(column, value, n) over all of ``columns`` in one shuffle; missing values left out."""
    return _counted(df, columns, as_type).select(_named(columns), "value", "n")


def top_values(
    df: DataFrame, columns: Sequence[str], as_type: str = "string", tests: Mapping[str, Callable[[Sequence[str]], Column]] | None = None,
) -> DataFrame:
    """Most frequent value per column; the smallest value wins a tie. Merges map-side.

    ``tests`` add the number of rows whose value passes: a costly test then runs once per
    distinct value. Each gets the column names and refers to ``idx`` and ``value``.
    """
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value")))
    passed = {name: F.sum(F.when(test(columns), F.col("n")).otherwise(F.lit(0))) for name, test in (tests or {}).items()}
    return _counted(df, columns, as_type).groupBy("idx").agg(
        best.alias("best"), F.count(F.lit(1)).alias("distinct"), *[e.alias(name) for name, e in passed.items()]
    ).select(_named(columns), F.col("best.value").alias("value"), (-F.col("best.neg")).alias("n"), "distinct", *passed)


def value_class(df: DataFrame, name: str) -> str:
    """A type that holds the column's values without loss, shared by as many columns as possible."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.IntegralType):
        return "bigint"
    if isinstance(dtype, T.FractionalType):
        return "string" if isinstance(dtype, T.DecimalType) else "double"
    return "timestamp_ntz" if kind(dtype) == "datetime" else "string"


def distinct_and_top(
    df: DataFrame, columns: Sequence[str], tests: Mapping[str, Callable[[Sequence[str]], Column]] | None = None,
) -> DataFrame:
    """(column, unique_count, most_common, most_common_count) for columns that have values.

    Values are counted per (column, value), combined map-side, so neither a wide column
    nor a dominant value lands in one task. Each type class reads only its own columns.
    ``tests`` (see :func:`top_values`) apply to text.
    """
    classes: dict[str, list[str]] = {}
    for c in columns:
        classes.setdefault(value_class(df, c), []).append(c)
    parts = []
    for as_type, names in sorted(classes.items()):
        used = tests if as_type == "string" else None
        top = top_values(df, names, as_type, used)
        parts.append(top.select(
            "column", F.col("distinct").alias("unique_count"), F.col("value").cast("string").alias("most_common"),
            F.col("n").alias("most_common_count"),
            *[F.col(t) if used else F.lit(None).cast("bigint").alias(t) for t in tests or {}]))
    return reduce(DataFrame.unionByName, parts)


@dataclass
class Needs:
    """Statistics a transform wants from its input; needs of several transforms add up."""

    aggs: dict[str, Column] = field(default_factory=dict)
    quantiles: dict[str, tuple[Column, list[float]]] = field(default_factory=dict)
    modes: set[str] = field(default_factory=set)
    levels: dict[str, int] = field(default_factory=dict)
    date_medians: set[str] = field(default_factory=set)

    def keys(self) -> set[str]:
        """Names under which :func:`gather` returns them."""
        listed = (("mode", self.modes), ("levels", self.levels), ("median", self.date_medians))
        return {*self.aggs, *self.quantiles, *(f"{what}:{n}" for what, names in listed for n in names)}

    def __add__(self, other: "Needs") -> "Needs":
        return Needs(
            {**self.aggs, **other.aggs}, {**self.quantiles, **other.quantiles},
            self.modes | other.modes, {**self.levels, **other.levels}, self.date_medians | other.date_medians,
        )


def _buckets_by_type(df: DataFrame, names) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for n in sorted(names):
        as_type = {"numeric": "double", "datetime": "timestamp_ntz"}.get(kind(df.schema[n].dataType), "string")
        out.setdefault(as_type, []).append(n)
    return out


def gather(df: DataFrame, needs: Needs) -> dict:
    """Compute all needed statistics: one aggregate job, plus one for value counts if asked."""
    stats: dict = {}
    if needs.aggs:
        row = df.agg(*[e.alias(k) for k, e in needs.aggs.items()]).head()
        stats.update({k: row[k] for k in needs.aggs})
    stats.update(exact_quantiles(df, needs.quantiles))
    for as_type, names in _buckets_by_type(df, needs.modes).items():
        stats.update({f"mode:{n}": best[0][0] if best else None for n, best in most_frequent(df, names, 1, as_type).items()})
    for as_type, names in _buckets_by_type(df, needs.levels).items():
        seen = unpivot(df, names, as_type).where(F.col("value").isNotNull()).distinct()
        listed: dict[str, list] = {n: [] for n in names}
        # more rows than all caps together mean that some column is above its own
        for r in seen.limit(sum(needs.levels[n] for n in names) + 1).collect():
            listed[r["column"]].append(r["value"])
        for n in names:
            if len(listed[n]) > needs.levels[n]:
                raise ValueError(f"column {n} has more than {needs.levels[n]} distinct values")
            stats[f"levels:{n}"] = sorted(listed[n])
    stats.update({f"median:{n}": upper_median(df, n) for n in sorted(needs.date_medians)})
    return stats


def upper_median(df: DataFrame, column: str):
    """Element n // 2 of the sorted values (the later one of the two middle values)."""
    from tablecraft.functions.ordering import value_ranks

    ranked = value_ranks(df, column)
    middle = F.floor(F.col("all_n") / 2)
    row = ranked.where((F.col("upto_n") - F.col("n") <= middle) & (middle < F.col("upto_n"))).select(col(column).alias("v")).head()
    return row["v"] if row else None


def numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    return list(columns) if columns else columns_of(df, "numeric")

