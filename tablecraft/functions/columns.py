"""Column helpers: quoting, type tests, NaN handling and plain literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Reference a column whose name may hold dots, carets or blanks."""
    return F.col(quoted(name))


def kind(dtype: T.DataType) -> str:
    """numeric / boolean / datetime / text / other."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, TEMPORAL):
        return "datetime"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    return "other"


def columns_of(df: DataFrame, *kinds: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind(f.dataType) in kinds]


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {missing}; it has {df.columns[:8]}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing: floating NaN becomes NULL."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    return df.select(*[
        F.when(~F.isnan(col(n)), col(n)).alias(n) if n in floats else col(n) for n in df.columns
    ])


def as_double(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE; text that is not a number becomes NULL."""
    k = kind(df.schema[name].dataType)
    if k == "text":
        return F.trim(col(name)).try_cast("double")
    return col(name).cast("double")


def literal(value, dtype: T.DataType) -> Column:
    return F.lit(value).cast(dtype)


def rounded(expr: Column, digits: int, name: str) -> Column:
    return F.round(expr, digits).alias(name)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; NULL where the whole is zero."""
    return F.try_divide(part * F.lit(100.0), whole)


def micros(expr: Column, dtype: T.DataType) -> Column:
    """Microseconds since 1970-01-01 without any time-zone step."""
    moment = expr.cast("timestamp_ntz") if not isinstance(dtype, T.TimestampNTZType) else expr
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), moment)
