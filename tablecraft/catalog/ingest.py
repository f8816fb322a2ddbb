"""Queries of reading, typing and writing (A)."""

from pyspark.sql import functions as F

from tablecraft.catalog.base import GAPS, TEXTS, Catalog
from tablecraft.functions.sampling import seeded_sample
from tablecraft.operators.rows import overview, preview
from tablecraft.session import scratch_path
from tablecraft.sources import typing
from tablecraft.sources.delimited import read_delimited, write_delimited, write_parquet

catalog = Catalog()
TYPED = "SELECT o_orderkey AS key, CAST(o_totalprice AS DOUBLE) AS price, CAST(o_orderdate AS TIMESTAMP) AS order_date, o_orderpriority AS priority FROM orders"


def written(t, sep: str, encoding: str = "UTF-8", header: bool = True, accent: bool = False, path: str | None = None, orders=None) -> str:
    """orders as a delimited file of text in the shared folder."""
    priority = F.concat(F.col("o_orderpriority"), F.lit(" é")) if accent else F.col("o_orderpriority")
    path = path or scratch_path(t.spark, "delimited")
    (orders or t.orders).select(
        F.col("o_orderkey").alias("key"), F.format_string("%.2f", "o_totalprice").alias("price"),
        F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss").alias("order_date"), priority.alias("priority"),
    ).write.csv(path, sep=sep, header=header, encoding=encoding)
    return path


@catalog.add("a01_read_semicolons", TYPED)
def read_semicolons(t):
    return read_delimited(t.spark, written(t, ";"))


@catalog.add("a01_read_latin1", TYPED.replace("o_orderpriority AS", "o_orderpriority || ' é' AS"))
def read_latin1(t):
    return read_delimited(t.spark, written(t, "\t", "ISO-8859-1", accent=True))


@catalog.add("a01_read_unlike_files", """SELECT o_orderkey AS key, CAST(o_totalprice AS DOUBLE) AS price, CAST(o_orderdate AS TIMESTAMP) AS order_date,
  o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' é' END AS priority FROM orders""")
def read_unlike_files(t):
    folder = scratch_path(t.spark, "unlike")
    for i, (sep, encoding) in enumerate(((";", "UTF-8"), (",", "UTF-8"), ("\t", "ISO-8859-1"))):
        written(t, sep, encoding, accent=i > 0, path=f"{folder}/part={i}", orders=t.orders.where(F.col("o_orderkey") % 3 == i))
    return read_delimited(t.spark, f"{folder}/*")


@catalog.add("a02_read_without_header", 'SELECT o_orderkey AS "0", CAST(o_totalprice AS DOUBLE) AS "1", CAST(o_orderdate AS TIMESTAMP) AS "2", o_orderpriority AS "3" FROM orders')
def read_without_header(t):
    return read_delimited(t.spark, written(t, ",", header=False), header=False)


@catalog.add("a03_unique_names", 'SELECT r_regionkey AS x, r_name AS y, r_regionkey AS "x.2", r_name AS "x.1" FROM region')
def unique_names(t):
    df = t.region.select(F.col("r_regionkey"), F.col("r_name"), F.col("r_regionkey").alias("again"), F.col("r_name").alias("other"))
    return df.toDF(*typing.unique_names(["x", "y", "x", "x.1"]))


@catalog.add("a04_coerce_numbers", f"WITH {TEXTS} SELECT CAST(key_text AS BIGINT) AS key_text, CAST(price_text AS DOUBLE) AS price_text, priority FROM texts")
def coerce_numbers(t):
    return typing.coerce_numbers(t.texts.select("key_text", "price_text", "priority"))


@catalog.add("a05_serial_dates", "SELECT o_orderkey, TIMESTAMP '1899-12-30' + to_days(CAST(30000 + o_orderkey % 2000 AS INTEGER)) AS order_date, CAST(30000 + o_orderkey % 2000 AS DOUBLE) AS price FROM orders")
def serial_dates(t):
    days = (30000 + F.col("o_orderkey") % 2000).cast("double")
    return typing.serial_dates(t.orders.select("o_orderkey", days.alias("order_date"), days.alias("price")))


@catalog.add("a06_serial_date_test", "SELECT avg((o_totalprice BETWEEN 1 AND 73500)::INT) AS share, avg((o_totalprice BETWEEN 1 AND 73500)::INT) >= 0.8 AS is_serial_date FROM orders")
def serial_date_test(t):
    return typing.serial_date_test(t.orders, "o_totalprice")


@catalog.add("a07_convert_dates", f"WITH {TEXTS} SELECT CAST(strptime(order_date, '%Y-%m-%d') AS TIMESTAMP) AS order_date, CAST(strptime(us_date, '%m/%d/%Y') AS TIMESTAMP) AS us_date, priority FROM texts")
def convert_dates(t):
    return typing.convert_dates(t.texts.select("order_date", "us_date", "priority"))


@catalog.add("a07_more_date_shapes", """WITH d AS (SELECT o_orderkey, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS day, to_hours(o_orderkey % 24) + to_minutes(o_orderkey % 60) AS clock FROM orders)
  SELECT o_orderkey, day + clock AS us_minutes, day + clock + to_seconds(7) AS us_dashes, day AS short_month, day AS short_year, day AS month_first, TIMESTAMP '1900-01-01' + clock AS clock_time FROM d""")
def more_date_shapes(t):
    clock = F.format_string("%02d:%02d", F.col("o_orderkey") % 24, F.col("o_orderkey") % 60)
    day = {f: F.date_format("o_orderdate", f) for f in ("MM/dd/yyyy", "MM-dd-yyyy", "d-MMM-yyyy", "M/d/yy", "MMM-dd-yyyy")}
    return typing.convert_dates(t.orders.select(
        "o_orderkey", F.concat_ws(" ", day["MM/dd/yyyy"], clock).alias("us_minutes"), F.concat(day["MM-dd-yyyy"], F.lit(" "), clock, F.lit(":07")).alias("us_dashes"),
        day["d-MMM-yyyy"].alias("short_month"), day["M/d/yy"].alias("short_year"), day["MMM-dd-yyyy"].alias("month_first"), clock.alias("clock_time")))


@catalog.add("a08_logical_types", f"""WITH {TEXTS}, v AS (SELECT bool_and(regexp_full_match(key_text, '[-+]?[0-9]*\\.?[0-9]+')) AS k, bool_and(regexp_full_match(price_text, '[-+]?[0-9]*\\.?[0-9]+')) AS p,
  bool_and(TRY_STRPTIME(order_date, '%Y-%m-%d') IS NOT NULL) AS d, bool_and(regexp_full_match(priority, '[-+]?[0-9]*\\.?[0-9]+')) AS t FROM texts)
  SELECT 'key_text' AS "column", CASE WHEN k THEN 'numeric' ELSE 'categorical' END AS kind FROM v UNION ALL SELECT 'price_text', CASE WHEN p THEN 'numeric' ELSE 'categorical' END FROM v
  UNION ALL SELECT 'order_date', CASE WHEN d THEN 'datetime' ELSE 'categorical' END FROM v UNION ALL SELECT 'us_date', 'datetime' FROM v UNION ALL SELECT 'priority', CASE WHEN t THEN 'numeric' ELSE 'categorical' END FROM v""")
def logical_types(t):
    return typing.table_kinds(t.texts)


@catalog.add("a09_finalize", f"""WITH {TEXTS} SELECT CAST(key_text AS BIGINT) AS key_text, CAST(price_text AS DOUBLE) AS price_text, CAST(strptime(order_date, '%Y-%m-%d') AS TIMESTAMP) AS order_date,
  CAST(strptime(us_date, '%m/%d/%Y') AS TIMESTAMP) AS us_date, priority FROM texts""")
def finalize(t):
    return typing.finalize(t.texts)


@catalog.add("a11_overview", f"""WITH {GAPS} SELECT count(*) AS row_count, CAST(4 AS BIGINT) AS column_count, CAST(2 * count(*) - count(qty) - count(flag) AS BIGINT) AS missing_cells, CAST(2 AS BIGINT) AS numeric_columns,
  CAST(1 AS BIGINT) AS datetime_columns, CAST(1 AS BIGINT) AS categorical_columns, 100 - round((2 * count(*) - count(qty) - count(flag)) * 100.0 / (4 * count(*)), 6) AS completeness FROM gaps""")
def table_overview(t):
    df = overview(t.gaps.select("qty", "flag", "l_tax", "l_shipdate"))
    return df.withColumn("completeness", 100 - F.round(100 - F.col("completeness"), 6))


@catalog.add("a12_preview", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def table_preview(t):
    return preview(t.orders, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@catalog.add("a13_write_delimited", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def write_and_read(t):
    path = scratch_path(t.spark, "written")
    write_delimited(t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), path)
    return read_delimited(t.spark, path)


@catalog.add("a13_write_parquet", "SELECT c_custkey, c_acctbal FROM customer")
def write_columns(t):
    path = scratch_path(t.spark, "written")
    write_parquet(t.customer.select("c_custkey", "c_acctbal"), path)
    return t.spark.read.parquet(path)


@catalog.add("a14_seeded_sample", "SELECT CAST(least(5000, count(*)) AS BIGINT) AS sampled FROM lineitem")
def sample_size(t):
    return seeded_sample(t.lineitem, 5000, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).agg(F.count(F.lit(1)).alias("sampled"))
