"""Recipes: named steps recorded as JSON and replayed on other tables.

A replay first collects the statistics of every step whose input columns are still those
of the current table, in one aggregate, then applies these steps lazily; a step that reads
a column made by an earlier pending step opens the next round.
"""

from __future__ import annotations

import datetime as dt
import difflib
import inspect
import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from tablecraft.functions.stats import Needs, gather
from tablecraft.operators import encode, features, impute, numeric, rows, temporal
from tablecraft.session import scratch_path

# Fixed value: least similarity of two names that are taken for the same column.
SIMILARITY = 0.7
COLUMN_PARAMS = ("column", "column1", "column2", "group_col", "agg_col", "date_col", "value_col", "x_column", "y_column")
#: Under this name the kept statistics of a step list the paths of its tables.
TABLES = "tables"
COLUMN_LIST_PARAMS = ("columns", "key", "partition_by", "order_by", "group_by")


@dataclass(frozen=True)
class Allowed:
    """A transform that recipes may name, and what it asks of the data.

    ``needs`` are single values and short lists; ``tables`` grow with the data, so fitting
    writes them as Parquet and the recipe keeps their paths.
    """

    fn: Callable[..., DataFrame]
    needs: Callable[..., Needs] | None = None
    drops_rows: bool = False
    tables: Callable[..., dict[str, DataFrame]] | None = None


STEPS: dict[str, Allowed] = {
    "fill_missing": Allowed(impute.fill_missing, impute.fill_needs),
    "fill_dates": Allowed(impute.fill_dates),
    "fill_many": Allowed(impute.fill_many, impute.fill_many_needs),
    "normalize": Allowed(numeric.normalize, numeric.range_needs),
    "standardize": Allowed(numeric.standardize, numeric.spread_needs),
    "binning": Allowed(numeric.binning, numeric.binning_needs),
    "log_transform": Allowed(numeric.log_transform),
    "handle_outliers": Allowed(numeric.handle_outliers, None, True),
    "batch_numeric": Allowed(numeric.batch_numeric, numeric.batch_needs),
    "one_hot": Allowed(encode.one_hot, encode.levels_needs),
    "label_encode": Allowed(encode.label_encode_step, tables=encode.label_tables),
    "merge_categories": Allowed(encode.merge_categories),
    "encode_many": Allowed(encode.encode_many, encode.encode_many_needs, tables=encode.encode_many_tables),
    "date_parts": Allowed(temporal.date_parts),
    "days_since": Allowed(temporal.days_since, temporal.earliest_needs),
    "dates_many": Allowed(temporal.dates_many, temporal.dates_many_needs),
    "polynomial": Allowed(features.polynomial),
    "interaction": Allowed(features.interaction),
    "group_features": Allowed(features.group_features, tables=features.group_tables),
    "rolling": Allowed(features.rolling),
    "lags": Allowed(features.lags),
    "cyclic": Allowed(features.cyclic),
    "text_features": Allowed(features.text_features),
    "drop_columns": Allowed(rows.drop_columns),
    "drop_rows_missing": Allowed(rows.drop_rows_missing, None, True),
}


def register_step(
    name: str, fn: Callable[..., DataFrame], needs: Callable[..., Needs] | None = None, drops_rows: bool = False,
    tables: Callable[..., dict[str, DataFrame]] | None = None,
) -> None:
    """Let recipes use another DataFrame function; see :class:`Allowed`."""
    if name in STEPS:
        raise ValueError(f"step {name!r} is already registered")
    STEPS[name] = Allowed(fn, needs, drops_rows, tables)


@dataclass
class Step:
    function: str
    params: dict
    name: str = ""
    description: str = ""
    depends_on: list[int] = field(default_factory=list)
    timestamp: str = ""


@dataclass
class Recipe:
    name: str
    steps: list[Step] = field(default_factory=list)
    fitted: dict[str, dict] = field(default_factory=dict)

    def record(self, function: str, *args, depends_on: Iterable[int] = (), **kwargs) -> "Recipe":
        """Append a step; all arguments are kept under their names."""
        if function not in STEPS:
            raise ValueError(f"{function!r} is not an allowed step")
        signature = inspect.signature(STEPS[function].fn)
        bound = signature.bind(None, *args, **kwargs).arguments
        params = {k: v for k, v in list(bound.items())[1:] if k not in ("stats", "tables")}
        now = dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")
        self.steps.append(Step(function, params, f"Step {len(self.steps) + 1}", "", list(depends_on), now))
        return self

    def remove(self, index: int) -> None:
        """Drop a step; later dependency numbers follow."""
        del self.steps[index]
        for s in self.steps:
            s.depends_on = [d - (d > index) for d in s.depends_on if d != index]
        self.fitted = {}

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "steps": [asdict(s) for s in self.steps], "fitted": self.fitted},
                          default=_plain, indent=1)

    @classmethod
    def from_json(cls, text: str) -> "Recipe":
        raw = json.loads(text)
        return cls(raw["name"], [Step(**s) for s in raw["steps"]], raw.get("fitted") or {})

    def check(self) -> None:
        """Every step must be allowed, and dependencies must exist without a cycle."""
        order(self.steps)
        for s in self.steps:
            if s.function not in STEPS:
                raise ValueError(f"{s.function!r} is not an allowed step")

    def fit(self, df: DataFrame, folder: str | None = None) -> "Recipe":
        """Keep the statistics of ``df`` so that streams and single batches can be treated alike.

        Those that grow with the data are written below ``folder``; it must outlive the recipe,
        so name one unless the recipe is used in this session only.
        """
        collected: dict[str, dict] = {}
        _, report = replay(self, df, collect=collected, folder=folder or scratch_path(df.sparkSession, "recipe"))
        failed = [r for r in report if r["status"] == "failed"]
        if failed:
            raise ValueError(f"steps failed while fitting: {failed}")
        self.fitted = collected
        return self

    def apply(self, df: DataFrame, column_map: dict | None = None, mode: str = "recompute") -> tuple[DataFrame, list[dict]]:
        """Replay on ``df``: statistics of ``df`` itself (recompute) or those kept by fit (fitted)."""
        if mode not in ("recompute", "fitted"):
            raise ValueError(f"unknown mode {mode!r}")
        return replay(self, df, column_map, self.fitted if mode == "fitted" else None)


def _plain(value):
    return str(value)  # dates and times in the form that a cast reads


def order(steps: list[Step]) -> list[int]:
    """Indexes in replay order; an error for a cycle or an unknown dependency."""
    done: list[int] = []
    state: dict[int, int] = {}

    def visit(i: int) -> None:
        if state.get(i) == 2:
            return
        if state.get(i) == 1:
            raise ValueError("the steps depend on each other in a circle")
        if not 0 <= i < len(steps):
            raise ValueError(f"step {i} does not exist")
        state[i] = 1
        for d in steps[i].depends_on:
            visit(d)
        state[i] = 2
        done.append(i)

    for i in range(len(steps)):
        visit(i)
    return done


def map_columns(wanted: Iterable[str], present: Iterable[str]) -> dict[str, str]:
    """Recorded name -> name in the new table. Equal names come first, then the most similar pair of all that are left."""
    wanted, present = list(dict.fromkeys(wanted)), list(present)
    likeness = {(w, p): 2.0 if w == p else difflib.SequenceMatcher(None, w.lower(), p.lower()).ratio() for w in wanted for p in present}
    found: dict[str, str] = {}
    for w, p in sorted(likeness, key=likeness.get, reverse=True):
        if likeness[w, p] > SIMILARITY and w not in found and p not in found.values():
            found[w] = p
    return found


def columns_used(params: dict) -> list[str]:
    used = [v for k, v in params.items() if k in COLUMN_PARAMS and isinstance(v, str)]
    for k, v in params.items():
        if k in COLUMN_LIST_PARAMS and isinstance(v, (list, tuple)):
            used += [c for c in v if isinstance(c, str)]
        if k == "strategies" and isinstance(v, dict):
            used += list(v)
    return used


def _renamed(params: dict, names: dict[str, str]) -> dict:
    out = dict(params)
    for k, v in params.items():
        if k in COLUMN_PARAMS and isinstance(v, str):
            out[k] = names.get(v, v)
        elif k in COLUMN_LIST_PARAMS and isinstance(v, (list, tuple)):
            out[k] = [names.get(c, c) for c in v]
        elif k == "strategies" and isinstance(v, dict):
            out[k] = {names.get(c, c): s for c, s in v.items()}
    return out


def _made_columns(steps: list[Step], start: list[str]) -> set[str]:
    """Names that steps create, so that they are not taken for columns of the new table."""
    stems = {c for s in steps for c in columns_used(s.params)}
    return {c for c in stems if any(c != o and (c.startswith(f"{o}_") or c.startswith(f"{o}^")) and c not in start for o in stems)}


def replay(
    recipe: Recipe, df: DataFrame, column_map: dict | None = None, fitted: dict | None = None, collect: dict | None = None,
    folder: str | None = None,
) -> tuple[DataFrame, list[dict]]:
    """Apply all steps; a failed one is reported and the rest still run unless they depend on it."""
    sequence = order(recipe.steps)
    if column_map is None:
        made = _made_columns(recipe.steps, df.columns)
        used = [c for s in recipe.steps for c in columns_used(s.params) if c not in made]
        column_map = map_columns(used, df.columns)
    report: dict[int, dict] = {}
    pending, out = list(sequence), df
    while pending:
        stats, batch, rest = _stats_for(recipe, out, pending, column_map, fitted, report)
        for i in batch:
            kept = dict(fitted.get(str(i), {}).get(TABLES, {})) if fitted is not None else {}
            out = _apply_one(recipe.steps[i], i, out, column_map, stats, report, fitted is not None, kept, folder)
            if collect is not None and (stats or kept):
                collect[str(i)] = stats | ({TABLES: kept} if kept else {})
        pending = rest
    return out, [report[i] for i in sorted(report)]


def _stats_for(recipe, table, pending, column_map, fitted, report):
    """Take the longest run of pending steps whose statistics can come from ``table`` at once."""
    needs, batch, touched, drops = [], [], set(), False
    if fitted is not None:
        i = pending[0]
        return {k: v for k, v in fitted.get(str(i), {}).items() if k != TABLES}, [i], pending[1:]
    for at, i in enumerate(pending):
        step = recipe.steps[i]
        allowed = STEPS.get(step.function)
        params = _renamed(step.params, column_map)
        used = set(columns_used(params))
        depends = drops or bool(used & touched) or not used <= set(table.columns)
        wants = None
        if allowed is not None and allowed.needs is not None and not depends:
            try:
                wants = allowed.needs(table, **params)
            except Exception:  # reported when the step itself is applied
                wants = Needs()
        if batch and depends and allowed is not None and (allowed.needs is not None or allowed.tables is not None):
            return _gather_or_none(table, needs), batch, pending[at:]
        if wants is not None:
            needs.append(wants)
        batch.append(i)
        touched |= used
        drops = drops or (allowed is not None and allowed.drops_rows)
    return _gather_or_none(table, needs), batch, []


def _gather_or_none(table, needs: list[Needs]) -> dict:
    """Statistics of all steps at once; if that fails, step by step, so that one bad request costs only its own."""
    wanted = [n for n in needs if n.keys()]
    if not wanted:
        return {}
    total = Needs()
    for n in wanted:
        total += n
    try:
        return gather(table, total)
    except Exception:
        stats: dict = {}
        for n in wanted:
            try:
                stats |= gather(table, n)
            except Exception:  # reported when the step itself is applied
                pass
        return stats


def _kept_tables(allowed: Allowed, step: int, df: DataFrame, params: dict, fitted: bool, kept: dict[str, str], folder: str | None) -> dict[str, DataFrame]:
    """The step's tables: those kept when fitted, written and noted in ``kept`` when fitting; none when recomputing."""
    if fitted:
        missing = set(allowed.tables(df.limit(0), **params)) - set(kept)
        if missing:
            raise ValueError(f"fitted tables are missing: {sorted(missing)}")
    elif folder is not None:
        for at, (key, table) in enumerate(allowed.tables(df, **params).items()):
            table.write.parquet(path := f"{folder}/step-{step}-{at}")
            kept[key] = path
    return {key: df.sparkSession.read.parquet(path) for key, path in kept.items()}


def _apply_one(step: Step, i: int, df: DataFrame, column_map, stats, report, fitted: bool, kept: dict[str, str], folder: str | None) -> DataFrame:
    entry = {"step": i, "function": step.function, "status": "applied", "error": None}
    report[i] = entry
    try:
        blocked = [d for d in step.depends_on if report.get(d, {}).get("status") != "applied"]
        if blocked:
            raise ValueError(f"waits for steps {blocked}")
        if step.function not in STEPS:
            raise ValueError(f"{step.function!r} is not an allowed step")
        allowed = STEPS[step.function]
        params, more = _renamed(step.params, column_map), {}
        missing = [c for c in columns_used(params) if c not in df.columns]
        if missing:
            raise ValueError(f"columns not in the table: {missing}")
        if allowed.needs is not None and (stats or fitted):
            keys = allowed.needs(df, **params).keys()
            if keys <= set(stats):
                more["stats"] = stats
            elif fitted:
                raise ValueError(f"fitted statistics are missing: {sorted(keys - set(stats))}")
        if allowed.tables is not None and (found := _kept_tables(allowed, i, df, params, fitted, kept, folder)):
            more["tables"] = found
        result = allowed.fn(df, **params, **more)
        if not isinstance(result, DataFrame):
            raise TypeError(f"{step.function} returned {type(result).__name__}, not a DataFrame")
        return result
    except Exception as problem:
        entry.update(status="failed", error=f"{type(problem).__name__}: {problem}")
        return df


def changes(before: DataFrame, after: DataFrame) -> dict[str, list[str]]:
    """Columns that a step added and removed."""
    return {"added": [c for c in after.columns if c not in before.columns],
            "removed": [c for c in before.columns if c not in after.columns]}
