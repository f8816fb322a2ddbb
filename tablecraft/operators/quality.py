"""Column profiles and severity-ranked quality findings over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tablecraft.functions.columns import col, columns_of, kind, nan_to_null, percent
from tablecraft.functions.frequent import most_frequent
from tablecraft.functions.quantiles import exact_quantiles
from tablecraft.functions.stats import (
    distinct_and_top, missing, pearson, sample_skewness, to_long, value_counts,
)
from tablecraft.sources.typing import parsed_date
from tablecraft.session import small_frame

# Thresholds of the quality rules.
OUTLIER_SHARE, OUTLIER_MEDIUM_PCT = 0.05, 10
SKEW_LOW, SKEW_MEDIUM = 1, 2
CARDINALITY_COUNT, CARDINALITY_PCT = 50, 25
IMBALANCE_PCT = 90
CONVERT_DISTINCT, CONVERT_SHARE = 10, 0.8
MISSING_LOW_PCT, MISSING_MEDIUM_PCT = 5, 20
FENCE = 1.5

FINDING = "column string, issue string, severity string, detail string"


def table_summary(df: DataFrame) -> DataFrame:
    """Rows, columns and rows that repeat an earlier one (missing values compare equal)."""
    return df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n")).agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicated_rows"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    return table_summary(df).select("duplicated_rows")


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns, df = list(columns or df.columns), nan_to_null(df)
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *[missing(col(c)).alias(f"m{i}") for i, c in enumerate(columns)])
    return to_long(wide, [{
        "column": F.lit(c), "missing_count": F.col(f"m{i}"),
        "missing_percentage": F.round(percent(F.col(f"m{i}"), F.col("rows")), 2),
    } for i, c in enumerate(columns)])


def columns_with_missing(df: DataFrame) -> DataFrame:
    return missing_report(df).where(F.col("missing_count") > 0)


def missing_table(df: DataFrame) -> DataFrame:
    return columns_with_missing(df).orderBy(F.desc("missing_percentage"), "column")


def distinct_report(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct non-missing values per column; exact unless ``approximate``."""
    columns, df = list(columns or df.columns), nan_to_null(df)
    counts = [F.approx_count_distinct(col(c)).alias(f"u{i}") for i, c in enumerate(columns)] if approximate else []
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *counts)
    if approximate:
        per_column = to_long(wide, [{"column": F.lit(c), "rows": F.col("rows"), "unique_count": F.col(f"u{i}")} for i, c in enumerate(columns)])
    else:
        names = to_long(wide, [{"column": F.lit(c), "rows": F.col("rows")} for c in columns])
        per_column = names.join(distinct_and_top(df, columns), "column", "left")
    unique = F.coalesce("unique_count", F.lit(0))
    return per_column.select("column", unique.alias("unique_count"), F.round(percent(unique, F.col("rows")), 2).alias("unique_percentage"))


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """min, max, mean, median, std (n-1) and bias-corrected skewness per numeric column."""
    columns, df = list(columns or columns_of(df, "numeric")), nan_to_null(df)
    medians = exact_quantiles(df, {c: (col(c), [0.5]) for c in columns})
    aggs = [
        f(col(c).cast("double")).alias(f"{tag}{i}")
        for i, c in enumerate(columns)
        for tag, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp), ("skew", sample_skewness))
    ]
    return to_long(df.agg(*aggs), [{
        "column": F.lit(c), "min": F.col(f"min{i}"), "max": F.col(f"max{i}"), "mean": F.col(f"mean{i}"),
        "median": F.lit(medians[c][0]).cast("double"), "std": F.col(f"std{i}"), "skewness": F.col(f"skew{i}"),
    } for i, c in enumerate(columns)])


def iqr_fences(df: DataFrame, columns: Sequence[str], rows: int | None = None) -> dict[str, tuple]:
    """{column: (q1, q3, lower, upper)}; all None for a column without values."""
    quartiles = exact_quantiles(df, {c: (col(c), [0.25, 0.75]) for c in columns}, rows)
    out = {}
    for c, (q1, q3) in quartiles.items():
        reach = None if q1 is None else FENCE * (q3 - q1)
        out[c] = (q1, q3, None if q1 is None else q1 - reach, None if q1 is None else q3 + reach)
    return out


def outlier_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or columns_of(df, "numeric"))
    fences = iqr_fences(df, columns)
    aggs = []
    for i, c in enumerate(columns):
        _, _, lo, hi = fences[c]
        outside = F.lit(False) if lo is None else ((col(c) < lo) | (col(c) > hi))
        aggs += [F.count_if(outside).alias(f"o{i}"), F.count(col(c)).alias(f"n{i}")]
    return to_long(df.agg(*aggs), [{
        "column": F.lit(c),
        "lower_bound": F.lit(fences[c][2]).cast("double"), "upper_bound": F.lit(fences[c][3]).cast("double"),
        "outliers_count": F.col(f"o{i}"),
        "outliers_percentage": F.coalesce(F.round(percent(F.col(f"o{i}"), F.col(f"n{i}")), 2), F.lit(0.0)),
        "outliers_share": F.coalesce(F.try_divide(F.col(f"o{i}").cast("double"), F.col(f"n{i}")), F.lit(0.0)),
    } for i, c in enumerate(columns)])


def categorical_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Most common value with its count and share of all rows; columns without values stay, empty."""
    columns = list(columns or columns_of(df, "text", "boolean"))
    rows = df.count()
    top = [(c, *best[0]) for c, best in most_frequent(df, columns, 1, "string").items() if best]
    found = small_frame(df.sparkSession, top, "column string, value string, n bigint").select(
        "column", F.col("value").alias("most_common"), F.col("n").alias("most_common_count"),
        F.round(percent(F.col("n"), F.lit(rows)), 2).alias("most_common_percentage"),
    )
    names = to_long(df.sparkSession.range(1), [{"column": F.lit(c)} for c in columns])
    return names.join(found, "column", "left").select(
        "column", "most_common", F.coalesce("most_common_count", F.lit(0)).alias("most_common_count"),
        F.coalesce("most_common_percentage", F.lit(0.0)).alias("most_common_percentage"),
    )


def datetime_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or columns_of(df, "datetime"))
    wide = df.agg(*[f(col(c)).cast("timestamp_ntz").alias(f"{t}{i}") for i, c in enumerate(columns) for t, f in (("a", F.min), ("b", F.max))])
    return to_long(wide, [{
        "column": F.lit(c), "min": F.col(f"a{i}"), "max": F.col(f"b{i}"),
        "range_days": F.timestamp_diff("DAY", F.col(f"a{i}"), F.col(f"b{i}")),
    } for i, c in enumerate(columns)])


def quality_profile(df: DataFrame, approximate_distinct: bool = False) -> DataFrame:
    """One row per column with everything the rules look at.

    Three passes: quartiles, one wide aggregate, and value counts for the distinct
    figures. With ``approximate_distinct`` the last one covers text columns only.
    """
    rows = df.count()
    numeric, dates = columns_of(df, "numeric"), columns_of(df, "datetime")
    text = columns_of(df, "text", "boolean")
    fences = iqr_fences(df, numeric, rows) if rows else {c: (None,) * 4 for c in numeric}
    aggs: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        aggs.append(missing(col(c)).alias(f"m{i}"))
        if approximate_distinct and c not in text:
            aggs.append(F.approx_count_distinct(col(c)).alias(f"u{i}"))
        if c in numeric:
            lo, hi = fences[c][2:]
            outside = F.lit(False) if lo is None else ((col(c) < lo) | (col(c) > hi))
            aggs += [F.count_if(outside).alias(f"o{i}"), sample_skewness(col(c)).alias(f"k{i}")]
    no_count = F.lit(None).cast("bigint")
    wide = to_long(df.agg(*aggs), [{
        "column": F.lit(c),
        "type": F.lit("numeric" if c in numeric else "datetime" if c in dates else "categorical" if c in text else "other"),
        "row_count": F.col("rows"),
        "missing_count": F.col(f"m{i}"),
        "missing_percentage": F.coalesce(F.round(percent(F.col(f"m{i}"), F.col("rows")), 2), F.lit(0.0)),
        "outliers_count": F.col(f"o{i}") if c in numeric else no_count,
        "skewness": F.col(f"k{i}") if c in numeric else F.lit(None).cast("double"),
        "sketched": F.col(f"u{i}") if approximate_distinct and c not in text else no_count,
    } for i, c in enumerate(df.columns)])
    counted = [c for c in df.columns if c in text or not approximate_distinct]
    if counted:
        wide = wide.join(distinct_and_top(df, counted, TEXT_TESTS), "column", "left")
    else:
        wide = wide.select("*", *[no_count.alias(c) for c in ("unique_count", "most_common_count", *TEXT_TESTS)], F.lit(None).cast("string").alias("most_common"))
    unique = F.coalesce("unique_count", "sketched", F.lit(0))
    dated = [c for c in text if _date_in_name(c)]
    return wide.withColumns({
        "bad_date_count": F.when(F.col("column").isin(dated), F.coalesce("bad_date_count", F.lit(0))),
        "unique_count": unique,
        "unique_percentage": F.coalesce(F.round(percent(unique, F.col("row_count")), 2), F.lit(0.0)),
    }).drop("sketched")


def _date_in_name(name: str) -> bool:
    return any(word in name.lower() for word in ("date", "time"))


def _is_number(columns: Sequence[str]) -> Column:
    """Text that reads as a number; the pattern spares the cast of plain words."""
    number = F.trim("value").try_cast("double")
    return F.col("value").rlike(r"(?i)^\s*[-+]?(inf|[0-9.])") & number.isNotNull()


def _is_no_date(columns: Sequence[str]) -> Column:
    dated = [i for i, c in enumerate(columns) if _date_in_name(c)]
    return F.col("idx").isin(dated) & parsed_date(F.col("value")).isNull() if dated else F.lit(False)


TEXT_TESTS = {"numeric_text_count": _is_number, "bad_date_count": _is_no_date}


def _rule(when: Column, issue: str, severity: Column | str, detail: Column) -> Column:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(when, F.struct(F.lit(issue).alias("issue"), severity.alias("severity"), detail.alias("detail")))


def rule_findings(profile: DataFrame) -> DataFrame:
    """Apply every column rule to a :func:`quality_profile` frame."""
    f = F.col
    present = f("row_count") - f("missing_count")
    outlier_pct = F.round(percent(f("outliers_count"), present), 2)
    top_pct = F.round(percent(f("most_common_count"), f("row_count")), 2)
    number, text = f("type") == "numeric", f("type") == "categorical"
    rules = [
        _rule(number & (F.try_divide(f("outliers_count").cast("double"), present) > OUTLIER_SHARE), "outliers",
              F.when(outlier_pct > OUTLIER_MEDIUM_PCT, "medium").otherwise("low"),
              F.format_string("%d values (%s%%) lie outside the IQR fences", f("outliers_count"), outlier_pct.cast("string"))),
        _rule(number & (F.abs("skewness") > SKEW_LOW), "skewness",
              F.when(F.abs("skewness") > SKEW_MEDIUM, "medium").otherwise("low"),
              F.format_string("skewness is %.2f", f("skewness"))),
        _rule(number & (f("unique_count") == 1), "constant", "high", F.lit("only one distinct value")),
        _rule(text & (f("unique_count") > CARDINALITY_COUNT) & (f("unique_percentage") > CARDINALITY_PCT), "high_cardinality", "medium",
              F.format_string("%d distinct values", f("unique_count"))),
        _rule(text & (top_pct > IMBALANCE_PCT), "imbalanced", "medium",
              F.format_string("%s fills %s%% of rows", f("most_common"), top_pct.cast("string"))),
        _rule(text & (f("unique_count") > CONVERT_DISTINCT) & (F.try_divide(f("numeric_text_count").cast("double"), f("row_count")) > CONVERT_SHARE),
              "type_conversion", "medium", F.lit("text holds numbers")),
        _rule(text & (f("bad_date_count") == 0), "type_conversion", "medium", F.lit("text holds dates")),
        _rule(f("type") == "datetime", "feature_extraction", "low", F.lit("date parts can be derived")),
        _rule(f("missing_percentage") > 0, "missing_values",
              F.when(f("missing_percentage") < MISSING_LOW_PCT, "low").when(f("missing_percentage") < MISSING_MEDIUM_PCT, "medium").otherwise("high"),
              F.format_string("%s%% of values are missing", f("missing_percentage").cast("string"))),
    ]
    hits = F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull()))
    return profile.select("column", hits.alias("r")).select("column", "r.issue", "r.severity", "r.detail")


def ranked(findings: DataFrame) -> DataFrame:
    """High before medium before low, then by column and issue."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return findings.orderBy(rank, F.col("column").asc_nulls_first(), "issue", "detail")


def quality_findings(df: DataFrame, approximate_distinct: bool = False) -> DataFrame:
    """All findings of a table, most severe first."""
    spark = df.sparkSession
    if df.isEmpty():
        return small_frame(spark, [(None, "empty_dataset", "high", "the table has no rows")], FINDING)
    repeats = table_summary(df).where(F.col("duplicated_rows") > 0).select(
        F.lit(None).cast("string").alias("column"), F.lit("duplicated_rows").alias("issue"), F.lit("medium").alias("severity"),
        F.format_string("%d rows repeat another (%s%%)", "duplicated_rows",
                        F.round(percent(F.col("duplicated_rows"), F.col("row_count")), 2).cast("string")).alias("detail"),
    )
    return ranked(rule_findings(quality_profile(df, approximate_distinct)).unionByName(repeats))


def search_findings(findings: DataFrame, text: str) -> DataFrame:
    return findings.where(F.lower(F.col("column")).contains(text.lower()))


def findings_by_severity(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count(F.lit(1)).alias("findings"))


def simple_assessment(df: DataFrame) -> DataFrame:
    """Missing, distinct and basic numeric figures of every column."""
    numeric = columns_of(df, "numeric")
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        aggs.append(missing(col(c)).alias(f"m{i}"))
        if c in numeric:
            aggs += [f(col(c).cast("double")).alias(f"{t}{i}") for t, f in (("a", F.min), ("b", F.max), ("e", F.avg), ("s", F.stddev_samp))]
    none = F.lit(None).cast("double")
    wide = to_long(df.agg(*aggs), [{
        "column": F.lit(c), "row_count": F.col("rows"), "missing_count": F.col(f"m{i}"),
        **{n: (F.col(f"{t}{i}") if c in numeric else none) for n, t in (("min", "a"), ("max", "b"), ("mean", "e"), ("std", "s"))},
    } for i, c in enumerate(df.columns)])
    unique = F.coalesce("unique_count", F.lit(0))
    return wide.join(distinct_and_top(df, df.columns), "column", "left").select(
        "column", "missing_count", unique.alias("unique_count"),
        F.round(percent(unique, F.col("row_count")), 2).alias("unique_percentage"), "min", "max", "mean", "std")


def missingness_correlation(df: DataFrame) -> DataFrame:
    """Correlation of the missing flags of every two columns that have missing values."""
    columns = [r["column"] for r in columns_with_missing(df).collect()]
    flags = {c: F.isnull(col(c)).cast("double") for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    if not pairs:
        return small_frame(df.sparkSession, [], "column_a string, column_b string, correlation double")
    wide = df.agg(*[pearson(flags[a], flags[b]).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return to_long(wide, [{"column_a": F.lit(a), "column_b": F.lit(b), "correlation": F.col(f"c{i}")} for i, (a, b) in enumerate(pairs)])


def missing_context(df: DataFrame, target: str, few: int = 10) -> DataFrame:
    """Value distribution of the other columns among the rows where ``target`` is missing.

    Text columns, and others with fewer than ``few`` distinct values in that subset.
    """
    others = [f.name for f in df.schema.fields if f.name != target and kind(f.dataType) != "other"]
    subset = df.where(col(target).isNull())
    text = [c for c in others if kind(df.schema[c].dataType) == "text"]
    rest = [c for c in others if c not in text]
    if rest:
        # columns that clearly have too many values are not counted; the exact limit is applied below
        near = subset.agg(*[F.approx_count_distinct(col(c)).alias(f"u{i}") for i, c in enumerate(rest)]).head()
        rest = [c for i, c in enumerate(rest) if near[f"u{i}"] < 10 * few]
    others = [c for c in others if c in text or c in rest]
    counts = value_counts(subset, others)
    totals = counts.groupBy("column").agg(F.sum("n").alias("present"), F.count(F.lit(1)).alias("distinct"))
    wide_enough = F.col("column").isin(text) | (F.col("distinct") < few)
    # totals hold one row per column, so this join is settled by that small side
    return counts.join(F.broadcast(totals.where(wide_enough)), "column").select(
        "column", "value", "n", F.round(percent(F.col("n"), F.col("present")), 2).alias("percentage")
    )


