"""Dashboards as specs: shared filters, then one chart frame per component."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from tablecraft.operators.charts import chart_data
from tablecraft.operators.rows import filter_range, filter_values


def apply_filters(df: DataFrame, filters: Mapping[str, Mapping]) -> DataFrame:
    """``{column: {"low":, "high":} | {"values": [...]}}``; filters on absent columns are passed over."""
    for column, wanted in filters.items():
        if column not in df.columns:
            continue
        if "values" in wanted:
            df = filter_values(df, column, wanted["values"])
        else:
            df = filter_range(df, column, wanted["low"], wanted["high"])
    return df


def read_spec(text: str) -> tuple[dict, list[str]]:
    """A dashboard spec from JSON; components that are not usable are named, the rest is kept."""
    raw = json.loads(text)
    if not isinstance(raw, dict):
        raise ValueError("a dashboard spec is a JSON object")
    kept, problems = [], []
    for i, c in enumerate(raw.get("components") or []):
        if isinstance(c, dict) and isinstance(c.get("chart_type"), str) and isinstance(c.get("config", {}), dict):
            kept.append(c)
        else:
            problems.append(f"component {i} is malformed")
    return {**raw, "components": kept}, problems


def dashboard_frames(df: DataFrame, spec: Mapping) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """{title: frame} and {title: error}; one bad component does not stop the others."""
    filtered = apply_filters(df, spec.get("filters") or {})
    frames, errors = {}, {}
    for i, component in enumerate(spec.get("components") or []):
        title = component.get("title") or f"component_{i + 1}"
        if title in frames or title in errors:
            title = f"{title} ({i + 1})"
        try:
            frames[title] = chart_data(filtered, component)
        except Exception as problem:
            errors[title] = f"{type(problem).__name__}: {problem}"
    return frames, errors


def export_dashboard(df: DataFrame, spec: Mapping, folder: str) -> dict[str, str]:
    """Write every component frame as Parquet below ``folder``; returns the errors.

    The filtered table feeds several jobs, so it is kept (spilling to disk) meanwhile.
    """
    filtered = apply_filters(df, spec.get("filters") or {}).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        frames, errors = dashboard_frames(filtered, {**spec, "filters": {}})
        for title, frame in frames.items():
            try:
                frame.write.mode("errorifexists").parquet(os.path.join(folder, title.replace("/", "_")))
            except Exception as problem:
                errors[title] = f"{type(problem).__name__}: {problem}"
    finally:
        filtered.unpersist()
    return errors
