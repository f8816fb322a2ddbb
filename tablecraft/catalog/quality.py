"""Queries of profiles and quality rules (B)."""

from pyspark.sql import functions as F

from tablecraft.catalog.base import GAPS, TEXTS, Catalog, r, rounded
from tablecraft.functions.sampling import seeded_sample
from tablecraft.operators import quality
from tablecraft.session import freeze

catalog = Catalog()
NUMBERS = ["qty", "l_extendedprice", "l_discount", "l_tax"]
ITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate")


def union(template: str, names) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in names)


@catalog.add("b01_table_summary", """SELECT CAST(sum(n) AS BIGINT) AS row_count, CAST(8 AS BIGINT) AS column_count,
  CAST(sum(n - 1) AS BIGINT) AS duplicated_rows FROM
  (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)""")
def table_summary(t):
    return quality.table_summary(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_suppkey"))


@catalog.add("b02_duplicate_rows", f"""WITH {GAPS}, g AS (SELECT flag, l_linestatus, l_linenumber, qty, count(*) AS n FROM gaps GROUP BY ALL)
  SELECT CAST(sum(n - 1) AS BIGINT) AS duplicated_rows FROM g""")
def duplicate_rows(t):
    return quality.duplicate_rows(t.gaps.select("flag", "l_linestatus", "l_linenumber", "qty"))


MISSING = union("SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_percentage FROM gaps", [*NUMBERS, "flag"])


@catalog.add("b03_missing_counts", f"WITH {GAPS} {MISSING}")
def missing_counts(t):
    return quality.missing_report(t.gaps, [*NUMBERS, "flag"])


@catalog.add("b04_distinct_counts", union("SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) * 100.0 / count(*), 2) AS unique_percentage FROM lineitem", ITEM))
def distinct_counts(t):
    return quality.distinct_report(t.lineitem)


@catalog.add("b05_numeric_profile", f"WITH {GAPS} " + union(
    "SELECT '{c}' AS \"column\", min({c}) AS \"min\", max({c}) AS \"max\", round(avg({c}), 9) AS mean, round(median({c}), 9) AS median, round(stddev_samp({c}), 9) AS std FROM gaps", NUMBERS))
def numeric_profile(t):
    return rounded(quality.numeric_profile(t.gaps, NUMBERS).drop("skewness"), 9)


@catalog.add("b06_skewness", f"WITH {GAPS} " + union("SELECT '{c}' AS \"column\", round(skewness({c}), 6) AS skewness FROM gaps", NUMBERS))
def skewness(t):
    return rounded(quality.numeric_profile(t.gaps, NUMBERS).select("column", "skewness"))


OUTLIERS = """SELECT '{c}' AS "column", CAST(count_if(x < lo OR x > hi) AS BIGINT) AS outliers_count, round(count_if(x < lo OR x > hi) * 100.0 / count(x), 2) AS outliers_percentage
  FROM (SELECT {e} AS x, quantile_cont({e}, 0.25) OVER () - 1.5 * (quantile_cont({e}, 0.75) OVER () - quantile_cont({e}, 0.25) OVER ()) AS lo,
  quantile_cont({e}, 0.75) OVER () + 1.5 * (quantile_cont({e}, 0.75) OVER () - quantile_cont({e}, 0.25) OVER ()) AS hi FROM {t})"""


@catalog.add("b07_iqr_outliers", " UNION ALL ".join(OUTLIERS.format(c=c, e=e, t="lineitem") for c, e in (
    ("cubed", "pow(l_extendedprice / 1000, 3)"), ("l_quantity", "l_quantity"), ("l_tax", "l_tax"))))
def iqr_outliers(t):
    df = t.lineitem.withColumn("cubed", F.pow(F.col("l_extendedprice") / 1000, F.lit(3.0)))
    return quality.outlier_report(df, ["cubed", "l_quantity", "l_tax"]).select("column", "outliers_count", "outliers_percentage")


TOP = """SELECT '{c}' AS "column", {c} AS most_common, n AS most_common_count, round(n * 100.0 / total, 2) AS most_common_percentage
  FROM (SELECT {c}, count(*) AS n, (SELECT count(*) FROM gaps) AS total FROM gaps WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, {c} LIMIT 1)"""


@catalog.add("b08_categorical_profile", f"WITH {GAPS} " + " UNION ALL ".join(f"(SELECT * FROM ({TOP.format(c=c)}))" for c in ("flag", "l_linestatus")))
def categorical_profile(t):
    return quality.categorical_profile(t.gaps, ["flag", "l_linestatus"])


@catalog.add("b09_datetime_profile", """SELECT 'ts' AS "column", min(ts) AS "min", max(ts) AS "max", date_sub('day', min(ts), max(ts)) AS range_days FROM events""")
def datetime_profile(t):
    return quality.datetime_profile(t.events, ["ts"])


@catalog.add("b10_empty_table", """SELECT CAST(NULL AS VARCHAR) AS "column", 'empty_dataset' AS issue, 'high' AS severity, 'the table has no rows' AS detail
  WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_quantity < 0)""")
def empty_table(t):
    return quality.quality_findings(t.lineitem.where(F.col("l_quantity") < 0))


@catalog.add("b11_rule_outliers", f"""WITH q AS ({OUTLIERS.format(c='x', e='pow(l_extendedprice / 1000, 5)', t='lineitem')}), s AS (SELECT outliers_count / (SELECT count(*) FROM lineitem) AS share, outliers_percentage FROM q)
  SELECT 'fifth' AS "column", 'outliers' AS issue, CASE WHEN outliers_percentage > 10 THEN 'medium' ELSE 'low' END AS severity FROM s WHERE share > 0.05""")
def rule_outliers(t):
    df = t.lineitem.select(F.pow(F.col("l_extendedprice") / 1000, F.lit(5.0)).alias("fifth"))
    return quality.quality_findings(df).where("issue = 'outliers'").select("column", "issue", "severity")


@catalog.add("b12_rule_skewness", " UNION ALL ".join(
    f"""SELECT '{n}' AS "column", 'skewness' AS issue, CASE WHEN abs(s) > 2 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT skewness({e}) AS s FROM lineitem) WHERE abs(s) > 1"""
    for n, e in (("p3", "pow(l_extendedprice / 1000, 4)"), ("p9", "pow(l_extendedprice / 1000, 9)"), ("q", "l_quantity"))))
def rule_skewness(t):
    x = F.col("l_extendedprice") / 1000
    df = t.lineitem.select(F.pow(x, F.lit(4.0)).alias("p3"), F.pow(x, F.lit(9.0)).alias("p9"), F.col("l_quantity").alias("q"))
    return quality.quality_findings(df).where("issue = 'skewness'").select("column", "issue", "severity")


@catalog.add("b13_rule_constant", """SELECT 'one' AS "column", 'constant' AS issue, 'high' AS severity FROM (SELECT count(DISTINCT l_quantity * 0 + 1) AS u FROM lineitem) WHERE u = 1""")
def rule_constant(t):
    df = t.lineitem.select((F.col("l_quantity") * 0 + 1).alias("one"), "l_quantity")
    return quality.quality_findings(df).where("issue = 'constant'").select("column", "issue", "severity")


@catalog.add("b14_rule_high_cardinality", union(
    """SELECT '{c}' AS "column", 'high_cardinality' AS issue, 'medium' AS severity FROM (SELECT count(DISTINCT {c}) AS u, count(*) AS n FROM customer) WHERE u > 50 AND round(u * 100.0 / n, 2) > 25""",
    ("c_name", "c_mktsegment")))
def rule_high_cardinality(t):
    return quality.quality_findings(t.customer).where("issue = 'high_cardinality'").select("column", "issue", "severity")


@catalog.add("b15_rule_imbalanced", """SELECT 'rare' AS "column", 'imbalanced' AS issue, 'medium' AS severity
  FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS total FROM (SELECT CASE WHEN l_quantity > 46 THEN 'big' ELSE 'usual' END AS rare FROM lineitem) GROUP BY rare ORDER BY n DESC LIMIT 1)
  WHERE round(n * 100.0 / total, 2) > 90""")
def rule_imbalanced(t):
    df = t.lineitem.select(F.when(F.col("l_quantity") > 46, "big").otherwise("usual").alias("rare"), "l_linestatus")
    return quality.quality_findings(df).where("issue = 'imbalanced'").select("column", "issue", "severity")


@catalog.add("b16_rule_numeric_text", f"""WITH {TEXTS} """ + union("""SELECT '{c}' AS "column", 'type_conversion' AS issue, 'medium' AS severity
  FROM (SELECT count(DISTINCT {c}) AS u, avg(CASE WHEN TRY_CAST({c} AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0 END) AS s FROM texts) WHERE u > 10 AND s > 0.8""", ("key_text", "price_text", "priority")))
def rule_numeric_text(t):
    return quality.quality_findings(t.texts.drop("order_date", "us_date")).where("issue = 'type_conversion'").select("column", "issue", "severity")


@catalog.add("b17_rule_date_text", f"""WITH {TEXTS} """ + union("""SELECT '{c}' AS "column", 'type_conversion' AS issue, 'medium' AS severity
  FROM (SELECT count_if({c} IS NOT NULL AND TRY_STRPTIME({c}, ['%Y-%m-%d', '%m/%d/%Y']) IS NULL) AS bad FROM texts) WHERE bad = 0""", ("order_date", "us_date")))
def rule_date_text(t):
    return quality.quality_findings(t.texts.select("order_date", "us_date")).where("issue = 'type_conversion'").select("column", "issue", "severity")


@catalog.add("b18_rule_feature_extraction", """SELECT 'ts' AS "column", 'feature_extraction' AS issue, 'low' AS severity WHERE EXISTS (SELECT 1 FROM events)""")
def rule_feature_extraction(t):
    return quality.quality_findings(t.events).where("issue = 'feature_extraction'").select("column", "issue", "severity")


@catalog.add("b19_rule_missing", f"""WITH {GAPS}, v AS (SELECT *, CASE WHEN l_quantity = 7 THEN NULL ELSE l_tax END AS few, CASE WHEN l_quantity > 20 THEN NULL ELSE l_tax END AS many FROM gaps) """ + union(
    """SELECT '{c}' AS "column", 'missing_values' AS issue, CASE WHEN p < 5 THEN 'low' WHEN p < 20 THEN 'medium' ELSE 'high' END AS severity
  FROM (SELECT round((count(*) - count({c})) * 100.0 / count(*), 2) AS p FROM v) WHERE p > 0""", ("few", "qty", "many", "flag", "l_tax")))
def rule_missing(t):
    df = t.gaps.select("qty", "flag", "l_tax", F.when(F.col("l_quantity") != 7, F.col("l_tax")).alias("few"),
                       F.when(F.col("l_quantity") <= 20, F.col("l_tax")).alias("many"))
    return quality.quality_findings(df).where("issue = 'missing_values'").select("column", "issue", "severity")


@catalog.add("b20_rule_duplicates", """SELECT CAST(NULL AS VARCHAR) AS "column", 'duplicated_rows' AS issue, 'medium' AS severity
  FROM (SELECT sum(n - 1) AS d FROM (SELECT l_suppkey, l_quantity, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)) WHERE d > 0""")
def rule_duplicates(t):
    return quality.quality_findings(t.lineitem.select("l_suppkey", "l_quantity", "l_linestatus")).where("issue = 'duplicated_rows'").select("column", "issue", "severity")


@catalog.add("b21_profile_sample")
def profile_sample(t):
    # the bounded sample is drawn once; the profile passes over it several times
    return quality.quality_profile(freeze(seeded_sample(t.lineitem, 50000, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])))


FINDINGS_SQL = f"""WITH {GAPS}, v AS (SELECT qty, flag, l_linestatus, l_shipdate, pow(l_extendedprice / 1000, 9) AS ninth FROM gaps),
  d AS (SELECT sum(n - 1) AS d FROM (SELECT qty, flag, l_linestatus, l_shipdate, ninth, count(*) AS n FROM v GROUP BY ALL)),
  s AS (SELECT skewness(ninth) AS s, quantile_cont(ninth, 0.25) AS q1, quantile_cont(ninth, 0.75) AS q3 FROM v),
  o AS (SELECT count_if(ninth < q1 - 1.5 * (q3 - q1) OR ninth > q3 + 1.5 * (q3 - q1)) / count(*) AS share FROM v, s),
  m AS (SELECT round((count(*) - count(qty)) * 100.0 / count(*), 2) AS p, round((count(*) - count(flag)) * 100.0 / count(*), 2) AS f FROM v)
  SELECT 'ninth' AS "column", 'skewness' AS issue, CASE WHEN abs(s) > 2 THEN 'medium' ELSE 'low' END AS severity FROM s WHERE abs(s) > 1
  UNION ALL SELECT 'ninth', 'outliers', CASE WHEN round(share * 100, 2) > 10 THEN 'medium' ELSE 'low' END FROM o WHERE share > 0.05
  UNION ALL SELECT 'qty', 'missing_values', CASE WHEN p < 5 THEN 'low' WHEN p < 20 THEN 'medium' ELSE 'high' END FROM m WHERE p > 0
  UNION ALL SELECT 'flag', 'missing_values', CASE WHEN f < 5 THEN 'low' WHEN f < 20 THEN 'medium' ELSE 'high' END FROM m WHERE f > 0
  UNION ALL SELECT 'l_shipdate', 'feature_extraction', 'low'
  UNION ALL SELECT NULL, 'duplicated_rows', 'medium' FROM d WHERE d > 0"""


def findings_frame(t):
    return quality.quality_findings(t.gaps.select(
        "qty", "flag", "l_linestatus", "l_shipdate", F.pow(F.col("l_extendedprice") / 1000, F.lit(9.0)).alias("ninth")))


@catalog.add("b22_findings_by_rank", FINDINGS_SQL)
def findings_by_rank(t):
    return findings_frame(t).select("column", "issue", "severity")


@catalog.add("b23_findings_grouped", f"SELECT severity, count(*) AS findings FROM ({FINDINGS_SQL}) GROUP BY severity")
def findings_grouped(t):
    return quality.findings_by_severity(findings_frame(t))


@catalog.add("b23_findings_search", f"SELECT * FROM ({FINDINGS_SQL}) WHERE lower(\"column\") LIKE '%nin%'")
def findings_search(t):
    return quality.search_findings(findings_frame(t), "NIN").select("column", "issue", "severity")


@catalog.add("b24_simple_assessment", f"WITH {GAPS} " + union(
    """SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count, count(DISTINCT {c}) AS unique_count,
  round(count(DISTINCT {c}) * 100.0 / count(*), 2) AS unique_percentage, min({c}) AS "min", max({c}) AS "max", round(avg({c}), 9) AS mean, round(stddev_samp({c}), 9) AS std FROM gaps""", NUMBERS)
    + """ UNION ALL SELECT 'flag', count(*) - count(flag), count(DISTINCT flag), round(count(DISTINCT flag) * 100.0 / count(*), 2), NULL, NULL, NULL, NULL FROM gaps""")
def simple_assessment(t):
    return rounded(quality.simple_assessment(t.gaps.select(*NUMBERS, "flag")), 9)


@catalog.add("b25_columns_with_missing", f"WITH {GAPS} SELECT * FROM ({MISSING}) WHERE missing_count > 0")
def columns_with_missing(t):
    return quality.columns_with_missing(t.gaps)


@catalog.add("b26_missing_table", f"WITH {GAPS} SELECT * FROM ({MISSING}) WHERE missing_count > 0 ORDER BY missing_percentage DESC, \"column\"")
def missing_table(t):
    return quality.missing_table(t.gaps)


@catalog.add("b27_missingness_correlation", f"""WITH {GAPS}, v AS (SELECT CAST(qty IS NULL AS INT) AS a, CAST(flag IS NULL AS INT) AS b, CAST(l_quantity > 40 OR l_linenumber = 3 AS INT) AS c FROM gaps)
  SELECT 'flag' AS column_a, 'other' AS column_b, {r('corr(b, c)')} AS correlation FROM v UNION ALL SELECT 'qty', 'flag', {r('corr(a, b)')} FROM v UNION ALL SELECT 'qty', 'other', {r('corr(a, c)')} FROM v""")
def missingness_correlation(t):
    df = t.gaps.select("qty", "flag", F.when((F.col("l_quantity") <= 40) & (F.col("l_linenumber") != 3), F.col("l_tax")).alias("other"), "l_tax")
    return rounded(quality.missingness_correlation(df))


@catalog.add("b28_missing_context", f"WITH {GAPS}, s AS (SELECT flag, l_linestatus, l_tax FROM gaps WHERE qty IS NULL) " + union(
    """SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percentage FROM s WHERE {c} IS NOT NULL GROUP BY {c}""",
    ("flag", "l_linestatus", "l_tax")))
def missing_context(t):
    return quality.missing_context(t.gaps.select("qty", "flag", "l_linestatus", "l_tax", "l_extendedprice"), "qty")
