"""Queries of numeric, categorical, date and derived columns (E, F, G, H)."""

from pyspark.sql import functions as F

from tablecraft.catalog.base import GAPS, ITEM_KEY, Catalog, r, rounded
from tablecraft.operators import encode, features, numeric, temporal
from tablecraft.sources.typing import safe_datetime

catalog = Catalog()
K = ", ".join(ITEM_KEY)
EDGES5 = "s AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 5 AS w, max(l_extendedprice) AS hi FROM lineitem)"


@catalog.add("e01_basic_statistics", f"""WITH {GAPS} SELECT count(qty) AS count, {r('avg(qty)')} AS mean, {r('stddev_samp(qty)')} AS std, min(qty) AS "min", {r('quantile_cont(qty, 0.25)')} AS q25,
  {r('median(qty)')} AS median, {r('quantile_cont(qty, 0.75)')} AS q75, max(qty) AS "max", {r('skewness(qty)')} AS skewness, {r('kurtosis(qty)')} AS kurtosis FROM gaps""")
def basic_statistics(t):
    return rounded(numeric.basic_statistics(t.gaps, "qty"))


@catalog.add("e02_normalize", f"WITH {GAPS}, s AS (SELECT min(qty) AS lo, max(qty) AS hi FROM gaps) SELECT {K}, {r('(qty - lo) / (hi - lo)')} AS qty_normalized FROM gaps, s")
def normalize(t):
    return rounded(numeric.normalize(t.gaps, "qty").select(*ITEM_KEY, "qty_normalized"))


@catalog.add("e03_standardize", f"WITH {GAPS}, s AS (SELECT avg(qty) AS m, stddev_samp(qty) AS d FROM gaps) SELECT {K}, {r('(qty - m) / d')} AS qty_standardized FROM gaps, s")
def standardize(t):
    return rounded(numeric.standardize(t.gaps, "qty").select(*ITEM_KEY, "qty_standardized"))


@catalog.add("e04_bin_edges", f"WITH {EDGES5} SELECT CAST(i AS INTEGER) AS edge, {r('lo + i * w')} AS value FROM s, range(0, 6) t(i)")
def bin_edges(t):
    return rounded(numeric.bin_edges(t.lineitem, "l_extendedprice", 5))


@catalog.add("e05_equal_width_bins", f"""WITH {EDGES5} SELECT {K}, CAST(1 + (lo + w < l_extendedprice)::INT + (lo + 2 * w < l_extendedprice)::INT + (lo + 3 * w < l_extendedprice)::INT + (lo + 4 * w < l_extendedprice)::INT AS INTEGER) AS l_extendedprice_binned FROM lineitem, s""")
def equal_width_bins(t):
    return numeric.binning(t.lineitem, "l_extendedprice", 5).select(*ITEM_KEY, "l_extendedprice_binned")


@catalog.add("e06_equal_frequency_bins", f"""WITH s AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS e FROM lineitem)
  SELECT {K}, CAST(1 + (e[1] < l_quantity)::INT + (e[2] < l_quantity)::INT + (e[3] < l_quantity)::INT AS INTEGER) AS l_quantity_binned FROM lineitem, s""")
def equal_frequency_bins(t):
    return numeric.binning(t.lineitem, "l_quantity", 4, "equal_frequency").select(*ITEM_KEY, "l_quantity_binned")


@catalog.add("e07_log_transform", f"WITH {GAPS} SELECT {K}, CASE WHEN qty IS NOT NULL THEN {r('ln(greatest(qty - 10, 1e-9))')} END AS qty_log FROM gaps")
def log_transform(t):
    return rounded(numeric.log_transform(t.gaps, "qty", -10).select(*ITEM_KEY, "qty_log"))


@catalog.add("e08_log_offset", "SELECT CASE WHEN min(l_tax) <= 0 THEN abs(min(l_tax)) + 1 ELSE 0 END AS tax_offset FROM lineitem")
def log_offset(t):
    return t.spark.range(1).select(F.lit(numeric.log_offset(t.lineitem, "l_tax")).alias("tax_offset"))


@catalog.add("e09_outlier_bounds", f"""SELECT {r('q1')} AS q1, {r('q3')} AS q3, {r('q3 - q1')} AS iqr, {r('q1 - 1.5 * (q3 - q1)')} AS lower_bound, {r('q3 + 1.5 * (q3 - q1)')} AS upper_bound
  FROM (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem)""")
def outlier_bounds(t):
    return rounded(numeric.outlier_bounds(t.lineitem, "l_extendedprice"))


@catalog.add("e10_list_outliers", f"SELECT {K} FROM lineitem WHERE l_extendedprice < 2000 OR l_extendedprice > 100000")
def list_outliers(t):
    return numeric.list_outliers(t.lineitem, "l_extendedprice", 2000, 100000).select(*ITEM_KEY)


@catalog.add("e11_cap_outliers", f"WITH {GAPS} SELECT {K}, CASE WHEN qty IS NOT NULL THEN least(greatest(qty, 5), 40) END AS qty_capped FROM gaps")
def cap_outliers(t):
    return numeric.handle_outliers(t.gaps, "qty", 5.0, 40.0, "cap").select(*ITEM_KEY, "qty_capped")


@catalog.add("e12_remove_outliers", f"WITH {GAPS} SELECT {K}, qty FROM gaps WHERE qty >= 5 AND qty <= 40")
def remove_outliers(t):
    return numeric.handle_outliers(t.gaps, "qty", 5.0, 40.0, "remove").select(*ITEM_KEY, "qty")


@catalog.add("e13_null_outliers", f"WITH {GAPS} SELECT {K}, CASE WHEN qty BETWEEN 5 AND 40 THEN qty END AS qty_no_outliers FROM gaps")
def null_outliers(t):
    return numeric.handle_outliers(t.gaps, "qty", 5.0, 40.0, "null").select(*ITEM_KEY, "qty_no_outliers")


@catalog.add("e14_batch_numeric", f"""WITH {GAPS}, s AS (SELECT avg(qty) AS m1, stddev_samp(qty) AS d1, avg(l_tax) AS m2, stddev_samp(l_tax) AS d2 FROM gaps)
  SELECT {K}, {r('(qty - m1) / d1')} AS qty_standardized, {r('(l_tax - m2) / d2')} AS l_tax_standardized FROM gaps, s""")
def batch_numeric(t):
    return rounded(numeric.batch_numeric(t.gaps, ["qty", "l_tax", "absent"], "standardize").select(*ITEM_KEY, "qty_standardized", "l_tax_standardized"))


@catalog.add("f01_frequency", f"WITH {GAPS} SELECT flag AS value, count(*) AS n FROM gaps WHERE flag IS NOT NULL GROUP BY flag")
def frequency(t):
    return encode.frequency(t.gaps, "flag")


@catalog.add("f02_one_hot", f"WITH {GAPS} SELECT {K}, coalesce(flag = 'A', false) AS \"flag_A\", coalesce(flag = 'N', false) AS \"flag_N\", coalesce(flag = 'R', false) AS \"flag_R\" FROM gaps")
def one_hot(t):
    return encode.one_hot(t.gaps, "flag").select(*ITEM_KEY, "flag_A", "flag_N", "flag_R")


@catalog.add("f03_label_mapping", "SELECT p_brand AS value, row_number() OVER (ORDER BY p_brand) - 1 AS code FROM (SELECT DISTINCT p_brand FROM part)")
def label_mapping(t):
    return encode.label_mapping(t.part, "p_brand")


@catalog.add("f04_label_encode", f"WITH {GAPS} SELECT {K}, CASE WHEN flag IS NOT NULL THEN dense_rank() OVER (ORDER BY flag NULLS LAST) - 1 END AS flag_encoded FROM gaps")
def label_encode(t):
    return encode.label_encode(t.gaps, "flag").select(*ITEM_KEY, "flag_encoded")


@catalog.add("f05_merge_categories", "SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'NOT LARGE' ELSE p_type END AS p_type_merged FROM part")
def merge_categories(t):
    return encode.merge_categories(t.part, "p_type", ["SMALL", "MEDIUM"], "NOT LARGE").select("p_partkey", "p_type_merged")


@catalog.add("f06_encode_many", f"""SELECT {K}, dense_rank() OVER (ORDER BY l_returnflag) - 1 AS l_returnflag_encoded, dense_rank() OVER (ORDER BY l_linestatus) - 1 AS l_linestatus_encoded FROM lineitem""")
def encode_many(t):
    return encode.encode_many(t.lineitem, ["l_returnflag", "l_linestatus"], "label").select(*ITEM_KEY, "l_returnflag_encoded", "l_linestatus_encoded")


PARTS = "CAST(year({c}) AS INTEGER) AS {c}_year, CAST(month({c}) AS INTEGER) AS {c}_month, CAST(day({c}) AS INTEGER) AS {c}_day, CAST(isodow({c}) - 1 AS INTEGER) AS {c}_weekday, CAST(quarter({c}) AS INTEGER) AS {c}_quarter"


@catalog.add("g01_date_parts", f"SELECT o_orderkey, {PARTS.format(c='o_orderdate')} FROM orders")
def date_parts(t):
    return temporal.date_parts(t.orders.select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate")


@catalog.add("g02_days_since", f"SELECT event_id, (epoch_us(ts) - epoch_us((SELECT min(ts) FROM events))) / 86400e6 AS ts_days_since FROM events")
def days_since(t):
    return temporal.days_since(t.events, "ts").select("event_id", "ts_days_since")


@catalog.add("g03_safe_date", "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS day FROM orders")
def safe_date(t):
    return safe_datetime(t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss").alias("day")), "day")


@catalog.add("g04_dates_many", f"""SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400e6 AS ts_days_since, (epoch_us(ts + INTERVAL 36 HOUR) - epoch_us(TIMESTAMP '2024-01-01')) / 86400e6 AS later_days_since FROM events""")
def dates_many(t):
    df = t.events.withColumn("later", F.col("ts") + F.expr("interval 36 hours"))
    return temporal.dates_many(df, ["ts", "later"], "days_since", "2024-01-01").select("event_id", "ts_days_since", "later_days_since")


@catalog.add("h01_polynomial", f"SELECT {K}, {r('pow(l_tax, 2)')} AS \"l_tax^2\", {r('pow(l_tax, 3)')} AS \"l_tax^3\" FROM lineitem")
def polynomial(t):
    return rounded(features.polynomial(t.lineitem, "l_tax", 3).select(*ITEM_KEY, "`l_tax^2`", "`l_tax^3`"))


@catalog.add("h02_interaction", f"""SELECT {K}, {r('CASE WHEN l_discount <> 0 THEN l_quantity / l_discount END')} AS l_quantity_div_l_discount, {r('l_quantity * l_discount')} AS l_quantity_x_l_discount,
  {r('l_quantity + l_discount')} AS l_quantity_plus_l_discount, {r('l_quantity - l_discount')} AS l_quantity_minus_l_discount FROM lineitem""")
def interaction(t):
    df = t.lineitem
    for operation in ("divide", "multiply", "add", "subtract"):
        df = features.interaction(df, "l_quantity", "l_discount", operation)
    return rounded(df.select(*ITEM_KEY, *df.columns[-4:]))


@catalog.add("h03_binned_feature", f"""WITH s AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS e FROM lineitem)
  SELECT {K}, ['low', 'mid', 'high', 'top'][1 + (e[1] < l_extendedprice)::INT + (e[2] < l_extendedprice)::INT + (e[3] < l_extendedprice)::INT] AS l_extendedprice_binned FROM lineitem, s""")
def binned_feature(t):
    return numeric.binning(t.lineitem, "l_extendedprice", 4, "equal_frequency", ["low", "mid", "high", "top"]).select(*ITEM_KEY, "l_extendedprice_binned")


@catalog.add("h04_group_features", f"""WITH {GAPS}, g AS (SELECT flag AS k, avg(qty) AS a, median(qty) AS m, min(qty) AS lo, max(qty) AS hi, stddev_samp(qty) AS s FROM gaps WHERE flag IS NOT NULL GROUP BY flag)
  SELECT {K}, {r('a')} AS qty_mean_by_flag, {r('m')} AS qty_median_by_flag, lo AS qty_min_by_flag, hi AS qty_max_by_flag, {r('s')} AS qty_std_by_flag FROM gaps LEFT JOIN g ON flag = k""")
def group_features(t):
    df = features.group_features(t.gaps, "flag", "qty")
    return rounded(df.select(*ITEM_KEY, *df.columns[-5:]))


def rolled(part: str) -> str:
    cols = []
    for w in (3, 7, 30):
        over = f"OVER ({part} ORDER BY ts, event_id ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        for f, d in (("mean", "avg"), ("std", "stddev_samp")):
            cols.append(f"CASE WHEN count(value) {over} = {w} THEN {r(f'{d}(value) {over}')} END AS value_rolling_{w}_{f}")
    return f"SELECT event_id, {', '.join(cols)} FROM events"


@catalog.add("h05_rolling", rolled(""))
def rolling(t):
    return rounded(features.rolling(t.events, "ts", "value", ["event_id"]).drop("ts", "user_id", "event_type", "value", "props"))


@catalog.add("h05_rolling_by_group", rolled("PARTITION BY event_type"))
def rolling_by_group(t):
    return rounded(features.rolling(t.events, "ts", "value", ["event_id"], partition_by=["event_type"]).drop("ts", "user_id", "event_type", "value", "props"))


def lagged(part: str) -> str:
    return "SELECT event_id, " + ", ".join(f"lag(value, {k}) OVER ({part} ORDER BY ts, event_id) AS value_lag_{k}" for k in (1, 7, 30)) + " FROM events"


@catalog.add("h06_lags", lagged(""))
def lags(t):
    return features.lags(t.events, "ts", "value", ["event_id"]).drop("ts", "user_id", "event_type", "value", "props")


@catalog.add("h06_lags_by_group", lagged("PARTITION BY user_id"))
def lags_by_group(t):
    return features.lags(t.events, "ts", "value", ["event_id"], partition_by=["user_id"]).drop("ts", "user_id", "event_type", "value", "props")


@catalog.add("h07_cyclic", f"SELECT event_id, {r('sin(2 * pi() * hour(ts) / 24)')} AS hour_sin, {r('cos(2 * pi() * hour(ts) / 24)')} AS hour_cos FROM events")
def cyclic(t):
    return rounded(features.cyclic(t.events.select("event_id", F.hour("ts").alias("hour")), "hour").drop("hour"))


@catalog.add("h08_text_features", f"""SELECT doc_id, CAST(length(text) AS INTEGER) AS text_length, CAST(len(regexp_extract_all(text, '[^\\t\\n\\x0B\\f\\r ]+')) AS INTEGER) AS text_word_count,
  {r("CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) / length(text) ELSE 0 END")} AS text_capital_ratio FROM documents""")
def text_features(t):
    return rounded(features.text_features(t.documents, "text").select("doc_id", "text_length", "text_word_count", "text_capital_ratio"))


@catalog.add("h09_text_columns", f"""SELECT * FROM (SELECT 'text' AS "column", {r('avg(length(text))')} AS mean_length FROM documents UNION ALL SELECT 'lang', {r('avg(length(lang))')} FROM documents
  UNION ALL SELECT 'source', {r('avg(length(source))')} FROM documents) WHERE mean_length > 10""")
def text_columns(t):
    return rounded(features.text_columns(t.documents))
