"""Queries of chart and dashboard frames (J)."""

from pyspark.sql import functions as F

from tablecraft.catalog.base import GAPS, ITEM_KEY, Catalog, r, rounded
from tablecraft.operators import charts, distributions, relations, series, summaries
from tablecraft.plans.dashboard import dashboard_frames, read_spec

catalog = Catalog()
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
K = ", ".join(ITEM_KEY)


def span(column: str, bins: int, table: str = "lineitem") -> str:
    return f"s AS (SELECT min({column}) AS lo, max({column}) AS hi, (max({column}) - min({column})) / {bins} AS w FROM {table})"


def bin_of(column: str, bins: int) -> str:
    return f"CAST(least(floor(({column} - lo) / w), {bins - 1}) AS INTEGER)"


@catalog.add("j01_group_aggregate", f"WITH {GAPS} SELECT flag, {r('avg(qty)')} AS qty FROM gaps WHERE flag IS NOT NULL GROUP BY flag")
def group_aggregate(t):
    return rounded(charts.group_aggregate(t.gaps, "flag", "qty", "mean"))


@catalog.add("j02_bar", f"SELECT o_orderpriority, o_orderstatus, {r('sum(o_totalprice)', 2)} AS o_totalprice FROM orders GROUP BY ALL")
def bar(t):
    return rounded(charts.bar(t.orders, "o_orderpriority", "o_totalprice", "sum", "o_orderstatus"), 2)


@catalog.add("j03_line", f"SELECT o_orderdate, count(o_totalprice) AS o_totalprice FROM orders GROUP BY o_orderdate")
def line(t):
    return charts.line(t.orders, "o_orderdate", "o_totalprice", "count")


@catalog.add("j04_scatter")
def scatter(t):
    return relations.scatter(t.lineitem, "l_quantity", ["l_tax", "l_discount"], ITEM_KEY, "l_returnflag")


@catalog.add("j05_pie", f"SELECT p_type, {r('sum(p_retailprice)', 2)} AS p_retailprice FROM part GROUP BY p_type")
def pie(t):
    return rounded(charts.pie(t.part, "p_type", "p_retailprice"), 2)


@catalog.add("j06_histogram", f"""WITH {span('l_extendedprice', 20)}, b AS (SELECT l_returnflag, {bin_of('l_extendedprice', 20)} AS bin, lo, w FROM lineitem, s)
  SELECT l_returnflag, bin, {r('lo + bin * w')} AS lower, {r('lo + bin * w + w')} AS upper, count(*) AS n FROM b GROUP BY l_returnflag, bin, lo, w""")
def histogram(t):
    return rounded(distributions.histogram(t.lineitem, "l_extendedprice", 20, "l_returnflag"))


@catalog.add("j07_histogram_overlay", " UNION ALL ".join(
    f"""(WITH {span(c, 30)}, b AS (SELECT {bin_of(c, 30)} AS bin, lo, w FROM lineitem, s) SELECT '{c}' AS "column", bin, {r('lo + bin * w')} AS lower, {r('lo + bin * w + w')} AS upper, count(*) AS n FROM b GROUP BY bin, lo, w)"""
    for c in ("l_quantity", "l_extendedprice")))
def histogram_overlay(t):
    return rounded(distributions.histogram_overlay(t.lineitem, ["l_quantity", "l_extendedprice"]))


@catalog.add("j08_box", f"""WITH q AS (SELECT l_returnflag AS k, quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS m, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY k)
  SELECT l_returnflag, {r('q1')} AS q1, {r('m')} AS median, {r('q3')} AS q3,
  min(CASE WHEN l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN l_extendedprice END) AS whisker_low,
  max(CASE WHEN l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN l_extendedprice END) AS whisker_high,
  CAST(count_if(NOT l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers, count(*) AS n FROM lineitem JOIN q ON l_returnflag = k GROUP BY l_returnflag, q1, m, q3""")
def box(t):
    return rounded(distributions.box(t.lineitem, "l_extendedprice", ["l_returnflag"]))


@catalog.add("j09_violin", f"""WITH c AS (SELECT l_returnflag AS k, l_quantity AS x, count(*) AS m FROM lineitem GROUP BY ALL),
  s AS (SELECT l_returnflag AS k, min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n, stddev_samp(l_quantity) * pow(count(*), -0.2) AS h, quantile_cont(l_quantity, 0.25) AS q1, median(l_quantity) AS md, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY 1),
  g AS (SELECT k, CAST(i AS INTEGER) AS point, lo + i * (hi - lo) / 199.0 AS gx FROM s, range(0, 200) t(i)),
  w AS (SELECT k, min(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS low, max(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS high,
    coalesce(sum(m) FILTER (NOT x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 0) AS outliers FROM c JOIN s USING (k) GROUP BY k)
  SELECT k AS l_returnflag, point, {r('gx')} AS x, {r('sum(m * exp(-0.5 * ((gx - x) / h) * ((gx - x) / h))) / (n * h * sqrt(2 * pi()))', 9)} AS density, {r('q1')} AS q1, {r('md')} AS median, {r('q3')} AS q3,
    low AS whisker_low, high AS whisker_high, CAST(outliers AS BIGINT) AS outliers, n FROM g JOIN c USING (k) JOIN s USING (k) JOIN w USING (k) GROUP BY k, point, gx, n, h, q1, md, q3, low, high, outliers""")
def violin(t):
    df = distributions.violin(t.lineitem, "l_quantity", "l_returnflag")
    return rounded(df.withColumn("density", F.round("density", 9)).select("l_returnflag", "point", "x", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "whisker_low", "whisker_high", "outliers", "n", "density"), 9).withColumn("x", F.round("x", 6))


@catalog.add("j10_density_price", """WITH c AS (SELECT l_extendedprice AS x, count(*) AS m FROM lineitem GROUP BY x), s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n, stddev_samp(l_extendedprice) * pow(count(*), -0.2) AS h FROM lineitem),
  g AS (SELECT CAST(i AS INTEGER) AS point, lo + i * (hi - lo) / 199.0 AS gx, n, h FROM s, range(0, 200) t(i))
  SELECT point, round(gx, 6) AS x, round(1000 * sum(m * exp(-0.5 * ((gx - x) / h) * ((gx - x) / h))) / (n * h * sqrt(2 * pi())), 9) AS density_per_1000 FROM g, c GROUP BY point, gx, n, h""")
def density_price(t):
    df = distributions.density(t.lineitem, "l_extendedprice")
    return df.select("point", F.round("x", 6).alias("x"), F.round(1000 * F.col("density"), 9).alias("density_per_1000"))


@catalog.add("j10_density", """WITH c AS (SELECT l_quantity AS x, count(*) AS m FROM lineitem GROUP BY x), s AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, count(*) AS n, stddev_samp(l_quantity) * pow(count(*), -0.2) AS h FROM lineitem),
  g AS (SELECT CAST(i AS INTEGER) AS point, lo + i * (hi - lo) / 199.0 AS gx, n, h FROM s, range(0, 200) t(i))
  SELECT point, round(gx, 6) AS x, round(sum(m * exp(-0.5 * ((gx - x) / h) * ((gx - x) / h))) / (n * h * sqrt(2 * pi())), 9) AS density FROM g, c GROUP BY point, gx, n, h""")
def density(t):
    df = distributions.density(t.lineitem, "l_quantity")
    return df.select("point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@catalog.add("j11_ecdf", f"SELECT DISTINCT l_extendedprice AS value, count(*) OVER (PARTITION BY l_extendedprice) AS n, {r('cume_dist() OVER (ORDER BY l_extendedprice)', 9)} AS share FROM lineitem")
def ecdf(t):
    return rounded(distributions.ecdf(t.lineitem, "l_extendedprice"), 9)


@catalog.add("j12_value_bars", f"WITH {GAPS} SELECT coalesce(flag, 'Missing/NaN') AS value, count(*) AS n FROM gaps GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def value_bars(t):
    return distributions.value_bars(t.gaps, "flag")


@catalog.add("j13_pie_with_other", """WITH c AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS i FROM c)
  SELECT value, n FROM k WHERE i <= 10 UNION ALL SELECT 'Other', CAST(sum(n) AS BIGINT) FROM k WHERE i > 10""")
def pie_with_other(t):
    return distributions.pie_with_other(t.part, "p_brand")


@catalog.add("j14_shares", f"WITH {GAPS} SELECT flag AS value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percentage FROM gaps WHERE flag IS NOT NULL GROUP BY flag")
def shares(t):
    return distributions.shares(t.gaps, "flag")


@catalog.add("j15_pivot_long", f"SELECT o_orderpriority, o_orderstatus, {r('avg(o_totalprice)')} AS value FROM orders GROUP BY ALL")
def pivot_long(t):
    return rounded(relations.pivot_long(t.orders, "o_orderstatus", "o_orderpriority", "o_totalprice", "mean"))


@catalog.add("j15_pivot_wide", """SELECT o_orderpriority, count(o_totalprice) FILTER (o_orderstatus = 'F') AS "F", count(o_totalprice) FILTER (o_orderstatus = 'O') AS "O", count(o_totalprice) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_orderpriority""")
def pivot_wide(t):
    return relations.pivot_wide(t.orders, "o_orderstatus", "o_orderpriority", "o_totalprice", "count")


PAIRS = [(a, b) for a in NUMBERS for b in NUMBERS]


@catalog.add("j16_correlation_pearson", " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r(f'corr({a}, {b})')} AS correlation FROM lineitem" for a, b in PAIRS))
def correlation_pearson(t):
    return rounded(relations.correlation_matrix(t.lineitem, NUMBERS))


@catalog.add("j16_correlation_spearman", f"""WITH {GAPS}, v AS (SELECT rank() OVER (ORDER BY qty) + (count(*) OVER (PARTITION BY qty) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM gaps WHERE qty IS NOT NULL)
  SELECT {r('corr(a, b)')} AS correlation FROM v""")
def correlation_spearman(t):
    return rounded(relations.spearman(t.gaps, "qty", "l_extendedprice"))


@catalog.add("j16_correlation_kendall", f"""WITH c AS (SELECT l_quantity AS x, l_discount AS y, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
  p AS (SELECT sum(a.n * b.n * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS d, sum(a.n * b.n * (a.x <> b.x)::INT) / 2 AS px, sum(a.n * b.n * (a.y <> b.y)::INT) / 2 AS py FROM c a, c b)
  SELECT {r('d / (sqrt(px) * sqrt(py))', 9)} AS correlation FROM p""")
def correlation_kendall(t):
    return rounded(relations.kendall(t.lineitem, "l_quantity", "l_discount"), 9)


@catalog.add("j17_strongest_pairs", "WITH m AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS c FROM lineitem" for a, b in PAIRS if a < b) + f") SELECT column_a, column_b, {r('c')} AS correlation FROM m ORDER BY abs(c) DESC LIMIT 10")
def strongest_pairs(t):
    return rounded(relations.strongest_pairs(t.lineitem, NUMBERS))


@catalog.add("j18_pair_plot")
def pair_plot(t):
    return relations.pair_plot(t.lineitem, NUMBERS, ITEM_KEY)


@catalog.add("j19_grouped_counts", """SELECT p_brand, p_type, count(*) AS n FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20)
  AND p_type IN (SELECT p_type FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) GROUP BY ALL""")
def grouped_counts(t):
    return relations.grouped_counts(t.part, "p_brand", "p_type", (20, 10))


@catalog.add("j20_crosstab", """WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*) AS n FROM orders GROUP BY ALL), g AS (SELECT a, b FROM (SELECT DISTINCT a FROM c), (SELECT DISTINCT b FROM c)),
  f AS (SELECT g.a AS "row", g.b AS col, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.a = c.a AND g.b = c.b) SELECT "row", col, n, round(n * 100.0 / sum(n) OVER (PARTITION BY col), 2) AS percentage FROM f""")
def crosstab(t):
    return distributions.crosstab(t.orders, "o_orderpriority", "o_orderstatus")


@catalog.add("j21_histogram_per_category", f"""WITH k AS (SELECT * FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 16)), {span('p_retailprice', 20, 'k')},
  b AS (SELECT p_brand, {bin_of('p_retailprice', 20)} AS bin FROM k, s) SELECT p_brand, bin, count(*) AS n FROM b GROUP BY ALL""")
def histogram_per_category(t):
    return distributions.histogram_per_category(t.part, "p_retailprice", "p_brand", 16).drop("lower", "upper")


@catalog.add("j22_time_series", """SELECT ts AS date, event_type, 'value' AS "column", value FROM events UNION ALL SELECT ts, event_type, 'user_id', CAST(user_id AS DOUBLE) FROM events""")
def time_series(t):
    return series.time_series(t.events, "ts", ["value", "user_id"], "event_type")


def resampled(unit: str, how: str, step: str, end: str, rows: str = "true") -> str:
    value = {"mean": "avg(value)", "sum": "sum(value)", "count": "count(value)"}[how]
    fill = f"coalesce(v, 0)" if how != "mean" else "v"
    return f"""WITH e AS (SELECT * FROM events WHERE {rows}), g AS (SELECT date_trunc('{unit}', ts)::DATE AS d, {value} AS v FROM e GROUP BY 1),
  c AS (SELECT unnest(generate_series((SELECT min(d) FROM g), (SELECT max(d) FROM g), INTERVAL '{step}'))::DATE AS d)
  SELECT ({end})::DATE AS period, {r(fill) if how != 'count' else fill} AS value FROM c LEFT JOIN g USING (d)"""


@catalog.add("j23_resample_day", resampled("day", "sum", "1 day", "d"))
def resample_day(t):
    return rounded(series.resample(t.events, "ts", "value", "day", "sum"))


@catalog.add("j23_resample_week", resampled("week", "mean", "7 days", "d + 6"))
def resample_week(t):
    return rounded(series.resample(t.events, "ts", "value", "week", "mean"))


@catalog.add("j23_resample_whole_day", resampled("day", "sum", "1 day", "d"))
def resample_whole_day(t):
    return rounded(series.resample(t.events, "ts", "value", "day", "sum"))


@catalog.add("j23_resample_whole_week", resampled("week", "mean", "7 days", "d + 6"))
def resample_whole_week(t):
    return rounded(series.resample(t.events, "ts", "value", "week", "mean"))


@catalog.add("j23_resample_day_hole", resampled("day", "sum", "1 day", "d", "day(ts) NOT BETWEEN 10 AND 12"))
def resample_day_hole(t):
    return rounded(series.resample(t.events.where("day(ts) NOT BETWEEN 10 AND 12"), "ts", "value", "day", "sum"))


@catalog.add("j23_resample_month", f"SELECT last_day(o_orderdate::DATE) AS period, {r('sum(o_totalprice)', 2)} AS value FROM orders GROUP BY 1")
def resample_month(t):
    return rounded(series.resample(t.orders, "o_orderdate", "o_totalprice", "month", "sum"), 2)


@catalog.add("j23_resample_quarter", "SELECT last_day((date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH)::DATE) AS period, count(o_totalprice) AS value FROM orders GROUP BY 1")
def resample_quarter(t):
    return series.resample(t.orders, "o_orderdate", "o_totalprice", "quarter", "count")


@catalog.add("j23_resample_year", "SELECT make_date(year(o_orderdate), 12, 31) AS period, max(o_totalprice) AS value FROM orders GROUP BY 1")
def resample_year(t):
    return series.resample(t.orders, "o_orderdate", "o_totalprice", "year", "max")


def season(part: str, name: str) -> str:
    return f"SELECT CAST({part} AS INTEGER) AS part, {name} AS name, {r('avg(value)')} AS mean, count(value) AS n FROM events GROUP BY 1, 2"


@catalog.add("j24_season_month", season("month(ts)", "monthname(ts)"))
def season_month(t):
    return rounded(series.seasonality(t.events, "ts", "value", "month"))


@catalog.add("j25_season_weekday", season("isodow(ts) - 1", "dayname(ts)"))
def season_weekday(t):
    return rounded(series.seasonality(t.events, "ts", "value", "weekday"))


@catalog.add("j26_season_quarter", season("quarter(ts)", "'Q' || quarter(ts)"))
def season_quarter(t):
    return rounded(series.seasonality(t.events, "ts", "value", "quarter"))


@catalog.add("j27_season_hour", season("hour(ts)", "CAST(hour(ts) AS VARCHAR)"))
def season_hour(t):
    return rounded(series.seasonality(t.events, "ts", "value", "hour"))


@catalog.add("j28_numeric_summary", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS count, count(*) - count({c}) AS missing, round(avg({c}), 2) AS mean, round(stddev_samp({c}), 2) AS std, min({c}) AS "min", round(quantile_cont({c}, 0.25), 2) AS q25,
  round(median({c}), 2) AS median, round(quantile_cont({c}, 0.75), 2) AS q75, max({c}) AS "max", round(skewness({c}), 2) AS skewness, round(kurtosis({c}), 2) AS kurtosis, round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_percentage FROM lineitem"""
    for c in ("l_quantity", "l_discount", "l_tax")))
def numeric_summary(t):
    return summaries.numeric_summary(t.lineitem, ["l_quantity", "l_discount", "l_tax"])


@catalog.add("j29_categorical_summary", f"WITH {GAPS} " + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count, round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_percentage, count(DISTINCT {c}) AS unique_count,
  (SELECT {c} FROM gaps WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_common, (SELECT count(*) FROM gaps WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS most_common_count,
  round((SELECT count(*) FROM gaps WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) * 100.0 / count(*), 2) AS most_common_percentage FROM gaps""" for c in ("flag", "l_linestatus")))
def categorical_summary(t):
    return summaries.categorical_summary(t.gaps, ["flag", "l_linestatus"])


@catalog.add("j29_category_table", f"WITH {GAPS} SELECT 'flag' AS \"column\", flag AS value, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM gaps), 2) AS percentage FROM gaps WHERE flag IS NOT NULL GROUP BY flag")
def category_table(t):
    return summaries.category_table(t.gaps, ["flag"])


@catalog.add("j30_group_statistics", " UNION ALL ".join(
    f"""SELECT l_returnflag, '{c}' AS "column", {r(f'avg({c})', 9)} AS mean, {r(f'median({c})', 9)} AS median, min({c}) AS "min", max({c}) AS "max", count({c}) AS count, {r(f'sum({c})', 2)} AS "sum", {r(f'stddev_samp({c})', 9)} AS std FROM lineitem GROUP BY l_returnflag"""
    for c in ("l_quantity", "l_tax")))
def group_statistics(t):
    df = summaries.group_statistics(t.lineitem, "l_returnflag", ["l_quantity", "l_tax"])
    return rounded(df.withColumn("sum", F.round("sum", 2)), 9)


@catalog.add("j31_column_outliers", f"""WITH v AS (SELECT {K}, pow(l_extendedprice / 1000, 3) AS cubed FROM lineitem), q AS (SELECT quantile_cont(cubed, 0.25) AS q1, quantile_cont(cubed, 0.75) AS q3 FROM v)
  SELECT {K} FROM v, q WHERE cubed < q1 - 1.5 * (q3 - q1) OR cubed > q3 + 1.5 * (q3 - q1) ORDER BY {K} LIMIT 10""")
def column_outliers(t):
    df = t.lineitem.withColumn("cubed", F.pow(F.col("l_extendedprice") / 1000, F.lit(3.0)))
    return summaries.column_outliers(df, "cubed", ITEM_KEY).select(*ITEM_KEY)


@catalog.add("j32_numbers_only", "SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE CAST(o_orderkey AS VARCHAR) END AS DOUBLE) AS mixed FROM orders")
def numbers_only(t):
    mixed = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderkey").cast("string"))
    return summaries.numbers_only(t.orders.select("o_orderkey", mixed.alias("mixed")), "mixed")


@catalog.add("j33_radar", f"""WITH m AS (SELECT o_orderpriority, avg(o_totalprice) AS a, avg(o_custkey) AS b FROM orders GROUP BY 1),
  l AS (SELECT o_orderpriority, 'o_totalprice' AS variable, a AS mean FROM m UNION ALL SELECT o_orderpriority, 'o_custkey', b FROM m),
  z AS (SELECT *, (mean - min(mean) OVER (PARTITION BY variable)) / (max(mean) OVER (PARTITION BY variable) - min(mean) OVER (PARTITION BY variable)) AS scaled FROM l)
  SELECT o_orderpriority, variable, {r('mean')} AS mean, {r('scaled')} AS scaled FROM z WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""")
def radar(t):
    return rounded(relations.radar(t.orders, "o_orderpriority", ["o_totalprice", "o_custkey"], ["1-URGENT", "5-LOW"]))


@catalog.add("j34_parallel_coordinates")
def parallel_coordinates(t):
    return relations.parallel_coordinates(t.lineitem, NUMBERS, ITEM_KEY, "l_returnflag")


@catalog.add("j35_scatter_3d")
def scatter_3d(t):
    return relations.raw_points(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax", "l_returnflag"], ITEM_KEY)


@catalog.add("j36_sunburst_count", """SELECT o_orderpriority, o_orderstatus, CAST(2 - grouping(o_orderpriority) - grouping(o_orderstatus) AS BIGINT) AS depth, count(*) AS value FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def sunburst_count(t):
    return relations.sunburst(t.orders, ["o_orderpriority", "o_orderstatus"])


@catalog.add("j36_sunburst_sum", f"""SELECT o_orderpriority, o_orderstatus, CAST(2 - grouping(o_orderpriority) - grouping(o_orderstatus) AS BIGINT) AS depth, {r('sum(o_totalprice)', 3)} AS value FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)""")
def sunburst_sum(t):
    return rounded(relations.sunburst(t.orders, ["o_orderpriority", "o_orderstatus"], "o_totalprice"), 3)


@catalog.add("j37_table", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def table(t):
    return charts.table(t.orders, ["o_orderkey", "o_totalprice"], ["o_orderkey"])


@catalog.add("j38_metric", f"SELECT {r('avg(l_extendedprice)')} AS value FROM lineitem")
def metric(t):
    return rounded(summaries.metric(t.lineitem, "l_extendedprice", "mean"))


SPEC = """{"filters": {"l_returnflag": {"values": ["A", "R"]}, "l_quantity": {"low": 10, "high": 40}},
  "components": [{"title": "total", "chart_type": "metric", "config": {"column": "l_extendedprice", "calculation": "count"}},
                 {"title": "bars", "chart_type": "bar", "config": {"x": "l_linestatus", "y": "l_extendedprice", "aggregation": "count"}},
                 {"title": "broken", "chart_type": "bar", "config": {"x": "nowhere", "y": "l_tax"}}]}"""


@catalog.add("j40_dashboard", """WITH f AS (SELECT * FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity BETWEEN 10 AND 40)
  SELECT 'total' AS component, 'all' AS x, count(*) AS value FROM f UNION ALL SELECT 'bars', l_linestatus, count(*) FROM f GROUP BY l_linestatus UNION ALL SELECT 'broken', 'ValueError', 0""")
def dashboard(t):
    frames, errors = dashboard_frames(t.lineitem, read_spec(SPEC)[0])
    out = frames["total"].select(F.lit("total").alias("component"), F.lit("all").alias("x"), "value").unionByName(
        frames["bars"].select(F.lit("bars").alias("component"), F.col("l_linestatus").alias("x"), F.col("l_extendedprice").alias("value")))
    for title, problem in errors.items():
        out = out.unionByName(t.spark.range(1).select(F.lit(title).alias("component"), F.lit(problem.split(":")[0]).alias("x"), F.lit(0).cast("bigint").alias("value")))
    return out
