"""Queries of filters, projections and fills (C, D)."""

from pyspark.sql import functions as F

from tablecraft.catalog.base import EVENT_GAPS, GAPS, ITEM_KEY, Catalog, r, rounded
from tablecraft.operators import impute, rows

catalog = Catalog()
K = ", ".join(ITEM_KEY)


@catalog.add("c01_rows_missing", f"WITH {GAPS} SELECT {K}, flag FROM gaps WHERE qty IS NULL")
def rows_missing(t):
    return rows.rows_missing(t.gaps, "qty").select(*ITEM_KEY, "flag")


@catalog.add("c02_drop_rows_by_key", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def drop_rows_by_key(t):
    keys = t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return rows.drop_rows_by_key(t.orders, "o_orderkey", keys).select("o_orderkey", "o_totalprice")


@catalog.add("c02_drop_listed_rows", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (1, 5, 7, 100, 1500)")
def drop_listed_rows(t):
    return rows.drop_rows_by_key(t.orders, "o_orderkey", [1, 5, 7, 100, 1500]).select("o_orderkey", "o_custkey")


@catalog.add("c03_drop_rows_missing", f"WITH {GAPS} SELECT {K}, qty FROM gaps WHERE qty IS NOT NULL")
def drop_rows_missing(t):
    return rows.drop_rows_missing(t.gaps, "qty").select(*ITEM_KEY, "qty")


@catalog.add("c04_drop_columns", "SELECT p_partkey, p_type, p_size, p_retailprice FROM part")
def drop_columns(t):
    return rows.drop_columns(t.part, ["p_name", "p_brand"])


@catalog.add("c05_choose_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def choose_columns(t):
    return rows.choose_columns(t.customer, ["c_custkey", "c_mktsegment"])


@catalog.add("c06_filter_range", f"WITH {GAPS} SELECT {K}, qty FROM gaps WHERE qty BETWEEN 10 AND 20")
def filter_range(t):
    return rows.filter_range(t.gaps, "qty", 10, 20).select(*ITEM_KEY, "qty")


@catalog.add("c07_filter_values", "SELECT p_partkey, p_size FROM part WHERE CAST(p_size AS VARCHAR) IN ('3', '14', '15')")
def filter_values(t):
    return rows.filter_values(t.part, "p_size", [3, 14, "15"]).select("p_partkey", "p_size")


@catalog.add("c08_filter_options_text", "SELECT DISTINCT p_brand AS value FROM part")
def filter_options_text(t):
    return rows.filter_options(t.part, "p_brand")


@catalog.add("c08_filter_options_number", "SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem")
def filter_options_number(t):
    return rows.filter_options(t.lineitem, "l_extendedprice")


@catalog.add("c09_keep_top", """SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 15)""")
def keep_top(t):
    return rows.keep_top(t.part, "p_brand", 15).select("p_partkey", "p_brand")


@catalog.add("c10_numeric_only", "SELECT p_partkey, p_size, p_retailprice FROM part")
def numeric_only(t):
    return rows.numeric_only(t.part)


@catalog.add("c11_complete_cases", f"WITH {GAPS} SELECT {K}, qty, flag FROM gaps WHERE qty IS NOT NULL AND flag IS NOT NULL")
def complete_cases(t):
    return rows.complete_cases(t.gaps, ["qty", "flag"]).select(*ITEM_KEY, "qty", "flag")


def filled(name: str, value: str) -> str:
    return f"WITH {GAPS} SELECT {K}, {r(f'coalesce(qty, {value})')} AS {name} FROM gaps"


@catalog.add("d01_fill_literal", filled("qty_filled", "99.5"))
def fill_literal(t):
    return rounded(impute.fill_missing(t.gaps, "qty", 99.5, inplace=False).select(*ITEM_KEY, "qty_filled"))


@catalog.add("d02_fill_mean", filled("qty", "(SELECT avg(qty) FROM gaps)"))
def fill_mean(t):
    return rounded(impute.fill_missing(t.gaps, "qty", strategy="mean").select(*ITEM_KEY, "qty"))


@catalog.add("d03_fill_median", filled("qty", "(SELECT median(qty) FROM gaps)"))
def fill_median(t):
    return rounded(impute.fill_missing(t.gaps, "qty", strategy="median").select(*ITEM_KEY, "qty"))


@catalog.add("d04_fill_mode", filled("qty", "(SELECT qty FROM gaps WHERE qty IS NOT NULL GROUP BY qty ORDER BY count(*) DESC, qty LIMIT 1)"))
def fill_mode(t):
    return rounded(impute.fill_missing(t.gaps, "qty", strategy="mode").select(*ITEM_KEY, "qty"))


@catalog.add("d05_fill_zero", filled("qty", "0"))
def fill_zero(t):
    return rounded(impute.fill_missing(t.gaps, "qty", strategy="zero").select(*ITEM_KEY, "qty"))


@catalog.add("d06_fill_most_frequent", f"""WITH {GAPS} SELECT {K}, coalesce(flag, (SELECT flag FROM gaps WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag FROM gaps""")
def fill_most_frequent(t):
    return impute.fill_missing(t.gaps, "flag", strategy="most_frequent").select(*ITEM_KEY, "flag")


@catalog.add("d07_date_fill_values", f"""WITH {EVENT_GAPS} SELECT event_id, coalesce(seen_at, (SELECT seen_at FROM (SELECT seen_at, row_number() OVER (ORDER BY seen_at) AS i, count(*) OVER () AS n FROM event_gaps WHERE seen_at IS NOT NULL) WHERE i = n // 2 + 1)) AS by_median,
  coalesce(seen_at, (SELECT min(seen_at) FROM event_gaps)) AS by_min, coalesce(seen_at, (SELECT max(seen_at) FROM event_gaps)) AS by_max FROM event_gaps""")
def date_fill_values(t):
    df = t.event_gaps.withColumns({f"by_{s}": F.col("seen_at") for s in ("median", "min", "max")})
    for s in ("median", "min", "max"):
        df = impute.fill_missing(df, f"by_{s}", strategy=s)
    return df.select("event_id", "by_median", "by_min", "by_max")


@catalog.add("d08_date_fill_literal", f"WITH {EVENT_GAPS} SELECT event_id, coalesce(seen_at, TIMESTAMP '2024-02-03 04:05:06') AS seen_at FROM event_gaps")
def date_fill_literal(t):
    return impute.fill_dates(t.event_gaps, "seen_at", "fill_na", "2024-02-03 04:05:06").select("event_id", "seen_at")


@catalog.add("d09_forward_fill", f"WITH {EVENT_GAPS} SELECT event_id, last_value(seen_at IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen_at FROM event_gaps")
def forward_fill(t):
    return impute.fill_dates(t.event_gaps, "seen_at", "forward_fill", order_by=["event_id"]).select("event_id", "seen_at")


@catalog.add("d10_backward_fill", f"WITH {EVENT_GAPS} SELECT event_id, first_value(seen_at IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS seen_at FROM event_gaps")
def backward_fill(t):
    return impute.fill_dates(t.event_gaps, "seen_at", "backward_fill", order_by=["event_id"]).select("event_id", "seen_at")


@catalog.add("d11_fill_many", f"""WITH {GAPS} SELECT {K}, {r('coalesce(qty, (SELECT median(qty) FROM gaps))')} AS qty,
  coalesce(flag, (SELECT flag FROM gaps WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag FROM gaps""")
def fill_many(t):
    return rounded(impute.fill_many(t.gaps, {"qty": "median", "flag": "mode"}).select(*ITEM_KEY, "qty", "flag"))


@catalog.add("d12_before_after", f"""WITH {GAPS}, a AS (SELECT coalesce(qty, (SELECT avg(qty) FROM gaps)) AS x FROM gaps)
  SELECT 'before' AS stage, count(qty) AS count, {r('avg(qty)')} AS mean, {r('stddev_samp(qty)')} AS std, min(qty) AS "min", max(qty) AS "max" FROM gaps
  UNION ALL SELECT 'after', count(x), {r('avg(x)')}, {r('stddev_samp(x)')}, min(x), max(x) FROM a""")
def before_after(t):
    gaps = t.gaps
    return rounded(impute.before_after(gaps, impute.fill_missing(gaps, "qty", strategy="mean"), "qty"))


@catalog.add("d13_fill_report", f"""WITH {GAPS} SELECT 'qty' AS "column", count(*) - count(qty) AS missing_count, 'median' AS strategy, CAST(median(qty) AS VARCHAR) AS fill_value FROM gaps
  UNION ALL SELECT 'flag', count(*) - count(flag), 'mode', (SELECT flag FROM gaps WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1) FROM gaps""")
def fill_report(t):
    return impute.fill_report(t.gaps, {"qty": "median", "flag": "mode", "l_tax": "mean"})


@catalog.add("d14_fill_target", filled("qty", "(SELECT avg(qty) FROM gaps)"))
def fill_target(t):
    return rounded(impute.fill_target(t.gaps, "qty", "regression").select(*ITEM_KEY, "qty"))
