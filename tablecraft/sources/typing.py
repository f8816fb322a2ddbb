"""Giving messy text columns a type: numbers, serial dates, dates, logical kinds.

Every decision for all columns of a table is taken from one or two aggregate passes over
all its rows, then applied as plain casts in a single projection.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablecraft.functions.columns import col, columns_of, kind

# Texts, patterns and formats that decide a column's type.
NUMBER_TEXT = r"^[-+]?[0-9]*\.?[0-9]+$"
INTEGER_TEXT = r"^[-+]?[0-9]{1,18}$"
DATE_WORDS = ("date", "day", "month", "year", "time", "dt", "created", "updated", "modified", "birth", "start", "end", "timestamp")
KIND_DATE_WORDS = ("date", "day", "month", "year", "time", "birth", "created", "modified")
DATE_PATTERNS = (
    r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$",
    r"^\d{4}[/-]\d{1,2}[/-]\d{1,2}$",
    r"^\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\s\d{1,2}:\d{1,2}(:\d{1,2})?$",
    r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}\s\d{1,2}:\d{1,2}(:\d{1,2})?$",
    r"^\d{1,2}[-\s]\w{3,9}[-\s]\d{2,4}$",
    r"^\w{3,9}[-\s]\d{1,2}[-\s]\d{2,4}$",
    r"^\d{8}$",
    r"^\d{1,2}:\d{1,2}(:\d{1,2})?(\s[AP]M)?$",
    r"^[A-Za-z]{3}\s\d{1,2},?\s\d{4}$",
)
KIND_DATE_PATTERNS = (
    r"^\d{1,2}/\d{1,2}/\d{2,4}", r"^\d{1,2}-\d{1,2}-\d{2,4}", r"^\d{4}/\d{1,2}/\d{1,2}", r"^\d{4}-\d{1,2}-\d{1,2}",
)
DATE_FORMATS = (
    "M/d/yyyy", "d/M/yyyy", "yyyy/M/d", "yyyy-M-d", "d-M-yyyy", "M-d-yyyy",
    "d/M/yyyy H:m:s", "M/d/yyyy H:m:s", "yyyy-M-d H:m:s", "yyyy/M/d H:m:s",
    "d MMM yyyy", "d MMMM yyyy", "MMM d yyyy", "MMMM d yyyy",
    "yyyyMMdd", "ddMMyyyy", "H:m:s", "h:m:s a", "MMM d, yyyy",
)
#: Shapes that the patterns accept beside the formats above; month first where both readings fit.
MORE_FORMATS = (
    "M/d/yyyy H:m", "d/M/yyyy H:m", "yyyy-M-d H:m", "yyyy/M/d H:m",
    "M-d-yyyy H:m:s", "d-M-yyyy H:m:s", "M-d-yyyy H:m", "d-M-yyyy H:m",
    "d-MMM-yyyy", "d-MMMM-yyyy", "MMM-d-yyyy", "MMMM-d-yyyy",
    "M/d/yy", "d/M/yy", "M-d-yy", "d-M-yy", "d-MMM-yy", "d MMM yy", "H:m", "h:m a",
)
#: Two-digit years reach from 1969 to 2068.
LAST_SHORT_YEAR = 2068
CLOCK_ONLY = ("H:m:s", "h:m:s a", "H:m", "h:m a")
CLOCK_DAY = "1900-01-01"
PATTERN_SHARE, PARSE_SHARE = 0.6, 0.5
SERIAL_LOW, SERIAL_HIGH, SERIAL_SHARE = 20000, 60000, 0.9
SERIAL_TEST_LOW, SERIAL_TEST_HIGH, SERIAL_TEST_SHARE = 1, 73500, 0.8
SERIAL_ORIGIN = "1899-12-30"
ISO = "iso"
LONGEST_DATE = 64


def date_named(name: str, words: Sequence[str] = DATE_WORDS) -> bool:
    """A date word among the name's parts (``order_date``, ``orderDate``), not inside one (``width``)."""
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)
    return any(p.lower() in words for p in parts) or any(
        p.lower().endswith(w) for p in parts for w in words if len(w) > 3
    )


def shape_of(fmt: str) -> str:
    """Regular expression of the texts a format can fit; far cheaper to test than a failed parse."""
    def part(run: str) -> str:
        letter, n = run[0], len(run)
        if letter == "y":
            return rf"\d{{{n}}}"
        if letter == "M" and n > 2:
            return "[A-Za-z]{3,9}"
        if letter == "a":
            return "[AaPp][Mm]"
        return r"\d{2}" if n == 2 else r"\d{1,2}"
    return "^" + re.sub(r"([A-Za-z])\1*", lambda m: part(m.group()), fmt) + "$"


def parse_with(text: Column, fmt: str) -> Column:
    """Text to TIMESTAMP_NTZ by one format; NULL where it does not fit."""
    if fmt == ISO:
        return text.try_cast("timestamp_ntz")
    fits = text.rlike(shape_of(fmt))
    if fmt in CLOCK_ONLY:
        text, fmt = F.concat(F.lit(f"{CLOCK_DAY} "), text), f"yyyy-MM-dd {fmt}"
    parsed = F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
    if "yy" in fmt and "yyyy" not in fmt:
        parsed = F.when(F.year(parsed) > LAST_SHORT_YEAR, parsed - F.make_ym_interval(F.lit(100))).otherwise(parsed)
    return F.when(fits, parsed)


def parsed_date(text: Column) -> Column:
    """First reading that fits, ISO first. Long texts and texts without a digit are not tried."""
    trimmed = F.trim(text)
    readings = [parse_with(trimmed, f) for f in (ISO, *DATE_FORMATS, *MORE_FORMATS)]
    return F.when((F.length(trimmed) <= LONGEST_DATE) & trimmed.rlike("[0-9]"), F.coalesce(*readings))


def safe_datetime(df: DataFrame, column: str) -> DataFrame:
    """Cast to a timestamp; refuse when more than half of the values end up missing."""
    if kind(df.schema[column].dataType) == "datetime":
        return df
    cast = parsed_date(col(column).cast("string"))
    lost = df.agg(F.avg(F.isnull(cast).cast("double"))).head()[0]
    if lost is not None and lost > 0.5:
        raise ValueError(f"column {column}: {lost:.0%} of the values are not dates")
    return df.select(*[cast.alias(c) if c == column else col(c) for c in df.columns])


def coerce_numbers(df: DataFrame, columns: Sequence[str] | None = None, pattern: str = NUMBER_TEXT) -> DataFrame:
    """Cast a text column when every non-missing trimmed value is a number."""
    text = [c for c in (columns or columns_of(df, "text")) if kind(df.schema[c].dataType) == "text"]
    if not text:
        return df
    row = df.agg(*[
        e.alias(f"{t}{i}") for i, c in enumerate(text) for t, e in (
            ("n", F.bool_and(F.trim(col(c)).rlike(pattern))), ("i", F.bool_and(F.trim(col(c)).rlike(INTEGER_TEXT))),
        )
    ]).head()
    target = {c: "bigint" if row[f"i{i}"] else "double" for i, c in enumerate(text) if row[f"n{i}"]}
    return df.select(*[F.trim(col(c)).try_cast(target[c]).alias(c) if c in target else col(c) for c in df.columns])


def date_choices(df: DataFrame) -> dict[str, str]:
    """{column: format} for the text columns that hold dates.

    Two aggregate passes at most: the first counts patterns and the formats' shapes, the second
    parses with those formats only whose shape enough values have.
    """
    text = columns_of(df, "text")
    if not text:
        return {}
    formats = (ISO, *DATE_FORMATS, *MORE_FORMATS)
    shapes = list(dict.fromkeys(shape_of(f) for f in formats[1:]))
    row = df.agg(*[
        F.avg(F.trim(col(c)).rlike(p).cast("double")).alias(f"{what}{i}_{j}")
        for i, c in enumerate(text) for what, tests in (("p", DATE_PATTERNS), ("s", shapes)) for j, p in enumerate(tests)
    ]).head()
    likely = [
        c for i, c in enumerate(text)
        if date_named(c) or max((row[f"p{i}_{j}"] or 0) for j in range(len(DATE_PATTERNS))) > PATTERN_SHARE
    ]
    if not likely:
        return {}
    possible = {
        c: [f for f in formats if f == ISO or (row[f"s{text.index(c)}_{shapes.index(shape_of(f))}"] or 0) >= PARSE_SHARE] for c in likely
    }
    shares = df.agg(*[
        F.avg(parse_with(F.trim(col(c)), f).isNotNull().cast("double")).alias(f"f{i}_{j}")
        for i, c in enumerate(likely) for j, f in enumerate(possible[c])
    ]).head()
    chosen = {}
    for i, c in enumerate(likely):
        best = max(range(len(possible[c])), key=lambda j: (shares[f"f{i}_{j}"] or 0, -j))
        if (shares[f"f{i}_{best}"] or 0) >= PARSE_SHARE:
            chosen[c] = possible[c][best]
    return chosen


def convert_dates(df: DataFrame) -> DataFrame:
    chosen = date_choices(df)
    return df.select(*[
        parse_with(F.trim(col(c)), chosen[c]).alias(c) if c in chosen else col(c) for c in df.columns
    ])


def from_serial(x: Column) -> Column:
    """Spreadsheet serial day number to a timestamp."""
    return F.timestamp_add("MICROSECOND", F.round(x.cast("double") * 86400e6).cast("bigint"), F.lit(SERIAL_ORIGIN).cast("timestamp_ntz"))


def serial_dates(df: DataFrame) -> DataFrame:
    """Numeric columns with a date-like name and nearly all values in the serial range become dates."""
    named = [c for c in columns_of(df, "numeric") if date_named(c)]
    if not named:
        return df
    row = df.agg(*[
        F.avg(((col(c) > SERIAL_LOW) & (col(c) < SERIAL_HIGH)).cast("double")).alias(f"s{i}") for i, c in enumerate(named)
    ]).head()
    turn = {c for i, c in enumerate(named) if (row[f"s{i}"] or 0) >= SERIAL_SHARE}
    return df.select(*[from_serial(col(c)).alias(c) if c in turn else col(c) for c in df.columns])


def serial_date_test(df: DataFrame, column: str) -> DataFrame:
    """Do at least 80% of the values look like serial dates?"""
    share = F.coalesce(F.avg(col(column).between(SERIAL_TEST_LOW, SERIAL_TEST_HIGH).cast("double")), F.lit(0.0))
    return df.agg(share.alias("share")).select("share", (F.col("share") >= SERIAL_TEST_SHARE).alias("is_serial_date"))


def logical_types(df: DataFrame) -> dict[str, str]:
    """numeric / datetime / categorical per column; text is judged by its content."""
    out = {f.name: {"numeric": "numeric", "boolean": "numeric", "datetime": "datetime"}.get(kind(f.dataType), "categorical")
           for f in df.schema.fields}
    text = columns_of(df, "text")
    if not text:
        return out
    aggs = []
    for i, c in enumerate(text):
        x = F.trim(col(c))
        looks = x.rlike("|".join(f"(?:{p})" for p in KIND_DATE_PATTERNS))
        aggs += [F.bool_and(x.rlike(NUMBER_TEXT)).alias(f"n{i}"), F.bool_or(looks).alias(f"l{i}"),
                 F.bool_and(F.when(x.isNotNull(), parsed_date(x).isNotNull())).alias(f"d{i}")]
    row = df.agg(*aggs).head()
    for i, c in enumerate(text):
        if row[f"n{i}"]:
            out[c] = "numeric"
        elif row[f"d{i}"] and (row[f"l{i}"] or date_named(c, KIND_DATE_WORDS)):
            out[c] = "datetime"
    return out


def unique_names(names: Sequence) -> list[str]:
    """``x, x`` -> ``x, x.1``; a suffix that is itself taken is skipped."""
    texts = [str(n) for n in names]
    taken, used, out = set(texts), set(), []
    for name in texts:
        new, i = name, 0
        while new in used or (i and new in taken):
            i += 1
            new = f"{name}.{i}"
        used.add(new)
        out.append(new)
    return out


def finalize(df: DataFrame) -> DataFrame:
    """Unique names, then numbers, then dates."""
    return convert_dates(coerce_numbers(df.toDF(*unique_names(df.columns))))


def table_kinds(df: DataFrame) -> DataFrame:
    kinds = logical_types(df)
    return df.sparkSession.createDataFrame(list(kinds.items()), T.StructType([
        T.StructField("column", T.StringType()), T.StructField("kind", T.StringType()),
    ]))
