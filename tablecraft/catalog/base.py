"""Registering queries: a name, a DataFrame function and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
        def keep(fn: Callable[["Tables"], DataFrame]) -> Callable:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = lambda spark, folder: fn(Tables(spark, folder))
            if sql is not None:
                self.oracles[name] = sql
            return fn
        return keep


class Tables:
    """The tables of one data folder, read on demand, plus derived forms with gaps."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def gaps(self) -> DataFrame:
        """lineitem with missing quantities and return flags (see GAPS)."""
        return self.lineitem.withColumns({
            "qty": F.when(F.col("l_linenumber") != 3, F.col("l_quantity")),
            "flag": F.when(F.col("l_linenumber") != 5, F.col("l_returnflag")),
        })

    @property
    def event_gaps(self) -> DataFrame:
        """events with missing times (see EVENT_GAPS)."""
        return self.events.withColumn("seen_at", F.when(F.col("event_id") % 7 != 0, F.col("ts")))

    @property
    def texts(self) -> DataFrame:
        """Columns of orders as text, as a delimited file would hold them (see TEXTS)."""
        return self.orders.select(
            F.col("o_orderkey").cast("string").alias("key_text"),
            F.format_string("%.2f", "o_totalprice").alias("price_text"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
            F.date_format("o_orderdate", "MM/dd/yyyy").alias("us_date"),
            F.col("o_orderpriority").alias("priority"),
        )


ITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
GAPS = """gaps AS (SELECT *, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS qty,
  CASE WHEN l_linenumber = 5 THEN NULL ELSE l_returnflag END AS flag FROM lineitem)"""
EVENT_GAPS = "event_gaps AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ts END AS seen_at FROM events)"
TEXTS = """texts AS (SELECT CAST(o_orderkey AS VARCHAR) AS key_text, printf('%.2f', o_totalprice) AS price_text,
  strftime(o_orderdate, '%Y-%m-%d') AS order_date, strftime(o_orderdate, '%m/%d/%Y') AS us_date,
  o_orderpriority AS priority FROM orders)"""


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits})"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, so that the order of additions does not show."""
    return df.select(*[
        F.round(F.col(f"`{n}`"), digits).alias(n) if t in ("double", "float") else F.col(f"`{n}`") for n, t in df.dtypes
    ])
