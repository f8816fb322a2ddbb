"""Queries of recorded and replayed steps (I)."""

from pyspark.sql import functions as F

from tablecraft.catalog.base import GAPS, ITEM_KEY, Catalog, r, rounded
from tablecraft.plans.recipe import Recipe
from tablecraft.session import small_frame

catalog = Catalog()
K = ", ".join(ITEM_KEY)


@catalog.add("i02_replay_step", f"WITH {GAPS} SELECT {K}, {r('coalesce(qty, (SELECT avg(qty) FROM gaps))')} AS qty FROM gaps")
def replay_step(t):
    df, _ = Recipe("one").record("fill_missing", "qty", strategy="mean").apply(t.gaps)
    return rounded(df.select(*ITEM_KEY, "qty"))


def full_recipe() -> Recipe:
    recipe = Recipe("several")
    recipe.record("fill_missing", "qty", strategy="median").record("normalize", "qty", depends_on=[0])
    recipe.record("fill_missing", "flag", strategy="mode").record("one_hot", "flag", depends_on=[2])
    recipe.record("interaction", "l_tax", "l_discount", operation="add").record("log_transform", "l_extendedprice", 1)
    return Recipe.from_json(recipe.to_json())


@catalog.add("i03_replay_recipe", f"""WITH {GAPS}, m AS (SELECT median(qty) AS q, (SELECT flag FROM gaps WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1) AS f FROM gaps),
  v AS (SELECT {K}, coalesce(qty, q) AS x, coalesce(flag, f) AS c, l_tax + l_discount AS p FROM gaps, m)
  SELECT {K}, {r('(x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ())')} AS qty_normalized, c = 'A' AS "flag_A", c = 'N' AS "flag_N", c = 'R' AS "flag_R", {r('p')} AS l_tax_plus_l_discount, {r('ln(l_extendedprice + 1)')} AS l_extendedprice_log FROM v""")
def replay_recipe(t):
    df, report = full_recipe().apply(t.gaps)
    if any(s["status"] != "applied" for s in report):
        raise RuntimeError(report)
    return rounded(df.select(*ITEM_KEY, "qty_normalized", "flag_A", "flag_N", "flag_R", "l_tax_plus_l_discount", "l_extendedprice_log"))


@catalog.add("i03_replay_renamed_columns", f"WITH {GAPS} SELECT l_orderkey, {r('(l_extendedprice - (SELECT avg(l_extendedprice) FROM gaps)) / (SELECT stddev_samp(l_extendedprice) FROM gaps)')} AS l_extended_price_standardized FROM gaps")
def replay_renamed_columns(t):
    recipe = Recipe("mapped").record("standardize", "l_extendedprice")
    df, _ = recipe.apply(t.lineitem.withColumnRenamed("l_extendedprice", "l_extended_price"))
    return rounded(df.select("l_orderkey", "l_extended_price_standardized"))


@catalog.add("i03_replay_report", """SELECT * FROM (VALUES (0, 'applied'), (1, 'failed'), (2, 'failed'), (3, 'applied')) v(step, status) WHERE EXISTS (SELECT 1 FROM lineitem)""")
def replay_report(t):
    recipe = Recipe("partly").record("polynomial", "l_tax", 2).record("normalize", "no_such_measure").record(
        "log_transform", "l_tax", depends_on=[1]).record("standardize", "l_quantity")
    _, report = recipe.apply(t.lineitem)
    return small_frame(t.spark, [(e["step"], e["status"]) for e in report], "step int, status string")


@catalog.add("i08_fitted_statistics", f"""WITH {GAPS}, s AS (SELECT avg(qty) AS m, min(coalesce(qty, (SELECT avg(qty) FROM gaps WHERE l_linestatus = 'O'))) AS lo, max(qty) AS hi FROM gaps WHERE l_linestatus = 'O')
  SELECT {K}, {r('(coalesce(qty, m) - lo) / (hi - lo)')} AS qty_normalized FROM gaps, s WHERE l_linestatus = 'F'""")
def fitted_statistics(t):
    recipe = Recipe("kept").record("fill_missing", "qty", strategy="mean").record("normalize", "qty")
    recipe = Recipe.from_json(recipe.fit(t.gaps.where("l_linestatus = 'O'")).to_json())
    df, _ = recipe.apply(t.gaps.where(F.col("l_linestatus") == "F"), mode="fitted")
    return rounded(df.select(*ITEM_KEY, "qty_normalized"))


def refitted(recipe: Recipe, seen, new):
    """``new`` by what the recipe keeps of ``seen``, saved and read back; every step must apply."""
    df, report = Recipe.from_json(recipe.fit(seen).to_json()).apply(new, mode="fitted")
    if any(s["status"] != "applied" for s in report):
        raise RuntimeError(report)
    return df


FIGURES = {"mean": "avg", "median": "median", "min": "min", "max": "max", "std": "stddev_samp"}


@catalog.add("i08_fitted_groups", f"""WITH s AS (SELECT l_linenumber, {', '.join(f'{f}(l_quantity) AS {n}' for n, f in FIGURES.items())} FROM lineitem WHERE l_linestatus = 'O' AND l_linenumber <> 2 GROUP BY 1)
  SELECT {', '.join(f'l.{k}' for k in ITEM_KEY)}, {', '.join(f'round(CAST(s.{n} AS DOUBLE), 6) AS l_quantity_{n}_by_l_linenumber' for n in FIGURES)} FROM lineitem l LEFT JOIN s ON l.l_linenumber = s.l_linenumber WHERE l_linestatus = 'F'""")
def fitted_groups(t):
    recipe = Recipe("groups").record("group_features", "l_linenumber", "l_quantity")
    df = refitted(recipe, t.lineitem.where("l_linestatus = 'O' AND l_linenumber <> 2"), t.lineitem.where("l_linestatus = 'F'"))
    return rounded(df.select(*ITEM_KEY, *[F.col(f"l_quantity_{n}_by_l_linenumber").cast("double").alias(f"l_quantity_{n}_by_l_linenumber") for n in FIGURES]))


@catalog.add("i08_fitted_date_median", """WITH d AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS day FROM orders),
  m AS (SELECT day AS mid FROM (SELECT day, row_number() OVER (ORDER BY day) - 1 AS k, count(*) OVER () AS n FROM d WHERE day IS NOT NULL AND o_orderstatus = 'O') WHERE k = n // 2)
  SELECT o_orderkey, coalesce(day, mid) AS day FROM d, m WHERE o_orderstatus <> 'O'""")
def fitted_date_median(t):
    dated = t.orders.withColumn("day", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")))
    recipe = Recipe("dates").record("fill_missing", "day", strategy="median")
    return refitted(recipe, dated.where("o_orderstatus = 'O'"), dated.where("o_orderstatus <> 'O'")).select("o_orderkey", "day")


@catalog.add("i08_fitted_many_levels", f"""WITH {GAPS}, c AS (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey) - 1 AS code FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linestatus = 'O'))
  SELECT {', '.join(f'g.{k}' for k in ITEM_KEY)}, round(coalesce(qty, (SELECT avg(qty) FROM gaps WHERE l_linestatus = 'O')), 6) AS qty, code AS l_orderkey_encoded FROM gaps g LEFT JOIN c ON g.l_orderkey = c.l_orderkey""")
def fitted_many_levels(t):
    recipe = Recipe("codes").record("fill_missing", "qty", strategy="mean").record("label_encode", "l_orderkey")
    return rounded(refitted(recipe, t.gaps.where("l_linestatus = 'O'"), t.gaps).select(*ITEM_KEY, "qty", "l_orderkey_encoded"))
