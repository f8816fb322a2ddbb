"""One entry point for chart frames: ``chart_data(df, spec)``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from tablecraft.functions.columns import col, require
from tablecraft.operators import distributions, relations, series, summaries
from tablecraft.operators.quality import missing_table
from tablecraft.operators.rows import preview

AGGREGATES = {"sum": F.sum, "mean": F.avg, "count": F.count}


def group_aggregate(df: DataFrame, x: str | Sequence[str], y: str, how: str | None = "sum") -> DataFrame:
    """sum / mean / count of ``y`` per ``x``; missing keys are left out. ``none`` returns the rows."""
    keys = [x] if isinstance(x, str) else list(x)
    require(df, *keys, y)
    if how in (None, "none"):
        return df.select(*[col(c) for c in (*keys, y)])
    if how not in AGGREGATES:
        raise ValueError(f"unknown aggregation {how!r}")
    present = df
    for k in keys:
        present = present.where(col(k).isNotNull())
    return present.groupBy(*[col(k) for k in keys]).agg(AGGREGATES[how](col(y)).alias(y))


def bar(df: DataFrame, x: str, y: str, aggregation: str = "sum", color: str | None = None) -> DataFrame:
    return group_aggregate(df, [x, *([color] if color else [])], y, aggregation)


def line(df: DataFrame, x: str, y: str, aggregation: str = "none", color: str | None = None) -> DataFrame:
    return bar(df, x, y, aggregation, color).orderBy(col(x).asc_nulls_last(), *([col(color)] if color else []))


def pie(df: DataFrame, names: str, values: str) -> DataFrame:
    return group_aggregate(df, names, values, "sum")


def table(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], max_rows: int = 10) -> DataFrame:
    return preview(df, order_by, max_rows).select(*[col(c) for c in columns])


# Chart type -> frame builder; the keyword arguments are the chart's settings.
CHARTS: dict[str, Callable[..., DataFrame]] = {
    "bar": bar, "line": line, "pie": pie, "table": table,
    "scatter": relations.scatter, "pair_plot": relations.pair_plot, "scatter_3d": relations.raw_points,
    "parallel_coordinates": relations.parallel_coordinates, "heatmap": relations.pivot_long,
    "correlation": relations.correlation_matrix, "strongest_pairs": relations.strongest_pairs,
    "grouped_bar": relations.grouped_counts, "radar": relations.radar, "sunburst": relations.sunburst,
    "histogram": distributions.histogram, "histogram_overlay": distributions.histogram_overlay,
    "distribution_grid": distributions.histogram_per_category, "box": distributions.box, "violin": distributions.violin,
    "kde": distributions.density, "ecdf": distributions.ecdf, "value_bars": distributions.value_bars,
    "pie_other": distributions.pie_with_other, "shares": distributions.shares, "crosstab": distributions.crosstab,
    "time_series": series.time_series, "resample": series.resample, "seasonality": series.seasonality,
    "numeric_summary": summaries.numeric_summary, "categorical_summary": summaries.categorical_summary,
    "group_statistics": summaries.group_statistics, "metric": summaries.metric, "missing": missing_table,
}
DRAWING_ONLY = frozenset({"title", "height", "width", "orientation", "opacity", "color_scale", "text_auto", "label"})

# Names of views and dashboard components, and of their settings, in saved specs.
NAMES = {
    "Histogram": "histogram", "Box Plot": "box", "Violin Plot": "violin", "KDE Plot": "kde",
    "Bar Chart": "value_bars", "Pie Chart": "pie_other", "Count Plot": "value_bars", "Percentage Distribution": "shares",
    "Scatter Plot": "scatter", "Correlation Matrix": "correlation", "Pair Plot": "pair_plot", "Grouped Bar Chart": "grouped_bar", "Grouped Box Plot": "box",
    "Compare Numeric Distributions": "histogram_overlay", "Category Distribution in Groups": "crosstab", "Distribution Grid": "distribution_grid",
    "Time Series Plot": "time_series", "Resampled Trends": "resample", "Seasonality Analysis": "seasonality",
    "Numeric Summary": "numeric_summary", "Categorical Summary": "categorical_summary", "Group Statistics": "group_statistics", "Missing Value Analysis": "missing",
    "Parallel Coordinates": "parallel_coordinates", "Radar Chart": "radar", "3D Scatter Plot": "scatter_3d", "Sunburst Chart": "sunburst",
    "custom_parallel": "parallel_coordinates", "custom_radar": "radar", "custom_3d": "scatter_3d", "custom_sunburst": "sunburst",
    "custom_grid": "pair_plot", "custom_time": "time_series", "custom_summary": "numeric_summary",
}
SETTINGS = {
    "parallel_coordinates": {"dimensions": "columns"}, "radar": {"variables": "columns"}, "pair_plot": {"variables": "columns"},
    "sunburst": {"values": "value"}, "time_series": {"date_column": "date", "value_column": "values", "group_column": "category"},
    "violin": {"x": "group"}, "box": {"x": "groups"}, "scatter": {"y": "ys"}, "heatmap": {"aggregation": "how"},
}
LISTS = {"scatter": ("ys",), "box": ("groups",), "time_series": ("values",)}
SAMPLED = ("scatter", "pair_plot", "scatter_3d", "parallel_coordinates")


def _settings(df: DataFrame, name: str, config: dict) -> dict:
    """Settings under the builder's own names; sampled charts are keyed by all columns unless told otherwise."""
    renamed = SETTINGS.get(name, {})
    out = {renamed.get(k, k): v for k, v in config.items() if k not in DRAWING_ONLY and v is not None}
    for k in LISTS.get(name, ()):
        if isinstance(out.get(k), str):
            out[k] = [out[k]]
    if name == "scatter_3d" and "columns" not in out:
        out["columns"] = [out.pop(k) for k in ("x", "y", "z", "color", "size") if k in out]
    if name in SAMPLED:
        out.setdefault("key", df.columns)
    if name == "table":
        out.setdefault("order_by", df.columns[:1])
        out["columns"] = out.get("columns") or df.columns
    return out


def chart_data(df: DataFrame, spec: dict) -> DataFrame:
    """``{"chart_type": name, "config": {...}}`` -> the frame the chart draws."""
    name = NAMES.get(spec.get("chart_type"), spec.get("chart_type"))
    if name not in CHARTS:
        raise ValueError(f"unknown chart type {name!r}")
    try:
        return CHARTS[name](df, **_settings(df, name, spec.get("config") or {}))
    except TypeError as problem:
        raise ValueError(f"settings do not fit a {name} chart: {problem}") from problem
