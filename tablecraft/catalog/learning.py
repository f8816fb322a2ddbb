"""Queries of machine learning (K)."""

import json

from pyspark import StorageLevel
from pyspark.sql import functions as F

from tablecraft.catalog.base import GAPS, ITEM_KEY, Catalog, r, rounded
from tablecraft.learn import metrics, models, neighbours, select, split, workflow
from tablecraft.learn.prepare import TabularPrep
from tablecraft.plans.recipe import Recipe
from tablecraft.session import freeze, scratch_path, small_frame

catalog = Catalog()
K = ", ".join(ITEM_KEY)
FEATURES = ["l_quantity", "l_discount", "l_tax", "l_returnflag"]
# A fixed rule stands in for a model, so that SQL can score the same predictions.
SCORED = """scored AS (SELECT *, CAST(l_linestatus = 'O' AS INT) AS label, round((l_quantity + 10 * l_tax + CASE WHEN l_linestatus = 'O' THEN 7 ELSE 0 END) / 60, 4) AS score FROM lineitem),
  judged AS (SELECT *, CAST(score > 0.5 AS INT) AS prediction FROM scored)"""


def judged(t):
    score = F.round((F.col("l_quantity") + 10 * F.col("l_tax") + F.when(F.col("l_linestatus") == "O", 7).otherwise(0)) / 60, 4)
    return t.lineitem.withColumns({"label": (F.col("l_linestatus") == "O").cast("int"), "score": score}).withColumn(
        "prediction", (F.col("score") > 0.5).cast("int"))


THREE = """three AS (SELECT l_returnflag AS label, CASE WHEN l_quantity < 15 THEN 'A' WHEN l_quantity < 36 THEN l_returnflag ELSE 'R' END AS prediction FROM lineitem)"""


def three(t):
    guess = F.when(F.col("l_quantity") < 15, "A").when(F.col("l_quantity") < 36, F.col("l_returnflag")).otherwise("R")
    return t.lineitem.select(F.col("l_returnflag").alias("label"), guess.alias("prediction"))


@catalog.add("k01_suggest_task", """SELECT 'l_extendedprice' AS target, CASE WHEN count(DISTINCT l_extendedprice) > 10 THEN 'regression' ELSE 'classification' END AS task FROM lineitem
  UNION ALL SELECT 'l_linenumber', CASE WHEN count(DISTINCT l_linenumber) > 10 THEN 'regression' ELSE 'classification' END FROM lineitem UNION ALL SELECT 'l_returnflag', 'classification'""")
def suggest_task(t):
    found = [(c, split.suggest_task(t.lineitem, c)) for c in ("l_extendedprice", "l_linenumber", "l_returnflag")]
    return small_frame(t.spark, found, "target string, task string")


@catalog.add("k02_split_sizes", f"""WITH {GAPS}, c AS (SELECT flag, count(*) AS n, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS test FROM gaps WHERE flag IS NOT NULL GROUP BY flag)
  SELECT flag, true AS is_test, test AS n FROM c UNION ALL SELECT flag, false, n - test FROM c""")
def split_sizes(t):
    return split.prepare_split(t.gaps, "flag", ITEM_KEY).groupBy("flag", "is_test").agg(F.count(F.lit(1)).alias("n"))


def fitted(t, scaler):
    prep = TabularPrep(numericCols=["qty", "l_tax", "same"], scaler=scaler).fit(t.gaps.withColumn("same", F.lit(3.0)))
    rows = [(n["column"], float(n["median"]), float(n["center"]), float(n["scale"])) for n in prep.fitted["numeric"]]
    return small_frame(t.spark, rows, "column string, median double, center double, scale double")


def fitted_sql(center: str, scale: str) -> str:
    one = """SELECT '{c}' AS "column", m AS median, round({center}, 9) AS center, round({scale}, 9) AS scale FROM (SELECT coalesce({c}, m) AS x, m FROM gaps, (SELECT median({c}) AS m FROM gaps)) GROUP BY m"""
    return f"WITH {GAPS} " + " UNION ALL ".join(one.format(c=c, center=center, scale=scale) for c in ("qty", "l_tax"))


@catalog.add("k04_standard_scaler", fitted_sql("avg(x)", "stddev_pop(x)"))
def standard_scaler(t):
    return rounded(fitted(t, "standard"), 9)


@catalog.add("k05_robust_scaler", fitted_sql("median(x)", "quantile_cont(x, 0.75) - quantile_cont(x, 0.25)"))
def robust_scaler(t):
    return rounded(fitted(t, "robust"), 9)


@catalog.add("k06_minmax_scaler", fitted_sql("min(x)", "max(x) - min(x)"))
def minmax_scaler(t):
    return rounded(fitted(t, "minmax"), 9)


@catalog.add("k03_median_and_constant", f"""WITH {GAPS} SELECT 'qty' AS "column", median(qty) AS median FROM gaps UNION ALL SELECT 'l_tax', median(l_tax) FROM gaps""")
def median_and_constant(t):
    return fitted(t, "standard").select("column", "median")


@catalog.add("k07_power_transform")
def power_transform(t):
    prep = TabularPrep(numericCols=["qty", "l_extendedprice"], scaler="power").fit(t.gaps)
    return small_frame(t.spark, [(n["column"], float(n["lam"])) for n in prep.fitted["numeric"]], "column string, lambda double")


@catalog.add("k08_one_hot_width", """WITH c AS (SELECT CAST(l_suppkey AS VARCHAR) AS v, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS i FROM c)
  SELECT 's_' || v AS feature FROM k WHERE i <= 49 UNION ALL SELECT 's___infrequent__'""")
def one_hot_width(t):
    prep = TabularPrep(categoricalCols=["s"]).fit(t.lineitem.select(F.col("l_suppkey").cast("string").alias("s")))
    return small_frame(t.spark, [(n,) for n in prep.feature_names], "feature string")


@catalog.add("k10_balanced_weights", f"WITH {GAPS} SELECT flag AS class, count(*) AS n, {r('sum(count(*)) OVER () / (count(*) OVER () * count(*))', 9)} AS weight FROM gaps WHERE flag IS NOT NULL GROUP BY flag")
def balanced_weights(t):
    return rounded(split.balanced_weights(t.gaps, "flag"), 9)


def classifier(name: str, settings: dict | None = None):
    """Held-out metrics of one model: is an order line open, judged by price and shipping?"""
    def run(t):
        df = t.lineitem.withColumn("dear", F.when(F.col("l_extendedprice") * (1 - F.col("l_discount")) > 45000, "yes").otherwise("no"))
        train, test = split.train_test(df, "dear", ITEM_KEY)
        return workflow.evaluate(workflow.train(train, "dear", FEATURES, "classification", name, settings), test)
    return run


def regressor(name: str, settings: dict | None = None):
    def run(t):
        train, test = split.train_test(t.lineitem, "l_extendedprice", ITEM_KEY, task="regression")
        return workflow.evaluate(workflow.train(train, "l_extendedprice", FEATURES, "regression", name, settings), test)
    return run


catalog.add("k11_logistic_regression")(classifier("Logistic Regression"))
catalog.add("k12_decision_tree")(classifier("Decision Tree"))
catalog.add("k13_random_forest")(classifier("Random Forest"))
catalog.add("k14_linear_svm")(classifier("SVM", {"kernel": "linear"}))
catalog.add("k14_rbf_svm")(classifier("SVM"))
catalog.add("k15_naive_bayes")(classifier("Naive Bayes"))
catalog.add("k17_gradient_boosting")(classifier("Gradient Boosting"))
catalog.add("k12_decision_tree_regressor")(regressor("Decision Tree Regressor"))
catalog.add("k13_random_forest_regressor")(regressor("Random Forest Regressor"))
catalog.add("k17_gradient_boosting_regressor")(regressor("Gradient Boosting"))


@catalog.add("k17_multiclass_boosting")
def multiclass_boosting(t):
    train, test = split.train_test(t.lineitem, "l_returnflag", ITEM_KEY)
    return workflow.evaluate(workflow.train(train, "l_returnflag", FEATURES, "classification", "Gradient Boosting"), test)


@catalog.add("k09_model_registry")
def model_registry(t):
    """Held-out figures of every registered classifier with its own settings."""
    df = t.lineitem.withColumn("dear", F.when(F.col("l_extendedprice") * (1 - F.col("l_discount")) > 45000, "yes").otherwise("no"))
    # the models read the same columns of the same rows
    train, test = (part.select("dear", *FEATURES).persist(StorageLevel.DISK_ONLY) for part in split.train_test(df, "dear", ITEM_KEY))
    rows = []
    for name in models.CLASSIFIERS:
        found = workflow.evaluate(workflow.train(train, "dear", FEATURES, "classification", name), test).head()
        rows.append((name, json.dumps(models.CLASSIFIERS[name]), *[float(found[c]) for c in ("accuracy", "f1", "roc_auc")]))
    train.unpersist()
    test.unpersist()
    return small_frame(t.spark, rows, "model string, settings string, accuracy double, f1 double, roc_auc double")


@catalog.add("k18_regressor_registry")
def regressor_registry(t):
    """Held-out error of every registered regressor with its own settings."""
    train, test = split.train_test(t.lineitem, "l_extendedprice", ITEM_KEY, task="regression")
    rows = [(name, float(workflow.evaluate(workflow.train(train, "l_extendedprice", ["l_quantity", "l_tax"], "regression", name), test).head()["rmse"]))
            for name in models.REGRESSORS]
    return small_frame(t.spark, rows, "model string, rmse double")


@catalog.add("k22_train")
def train_pipeline(t):
    """Preprocessing and model fitted together, then applied to the rows held out."""
    train, test = split.train_test(t.lineitem, "l_returnflag", ITEM_KEY)
    trained = workflow.train(train, "l_returnflag", ["l_quantity", "l_tax", "l_linestatus"], "classification", "Naive Bayes")
    return trained.predict(test).groupBy("l_returnflag", "prediction").agg(F.count(F.lit(1)).alias("n"))


# Least squares of two features in closed form.
TWO_FEATURES = """m AS (SELECT avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_tax) AS m2, var_pop(l_quantity) AS s11, var_pop(l_tax) AS s22, covar_pop(l_quantity, l_tax) AS s12,
  covar_pop(l_extendedprice, l_quantity) AS c1, covar_pop(l_extendedprice, l_tax) AS c2 FROM lineitem),
  b AS (SELECT *, (c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) AS b1, (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM m)"""


@catalog.add("k41_model_round_trip", f"WITH {TWO_FEATURES} SELECT l_orderkey, l_linenumber, round(my + b1 * (l_quantity - m1) + b2 * (l_tax - m2), 4) AS prediction FROM lineitem, b")
def model_round_trip(t):
    from pyspark.ml import PipelineModel

    trained = workflow.train(t.lineitem, "l_extendedprice", ["l_quantity", "l_tax"], "regression", "Linear Regression")
    folder = scratch_path(t.spark, "model")
    trained.model.write().save(folder)
    again = workflow.Trained(PipelineModel.load(folder), "regression", "l_extendedprice", trained.features, trained.name)
    return again.predict(t.lineitem).select("l_orderkey", "l_linenumber", F.round("prediction", 4).alias("prediction"))


NEIGHBOURS = """d AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS i FROM embeddings a, embeddings b)"""


def five_nearest(t):
    """Every vector against all vectors, itself included."""
    df = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("q"), F.col("label").cast("double").alias("label"))
    train = df.groupBy(F.col("q").alias("v"), "label").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("v", "label"))
    queries = neighbours.numbered(df.select("q").distinct())
    return df, queries, neighbours.nearest_of(freeze(train), queries, 5)


@catalog.add("k16_nearest_neighbours", f"""WITH {NEIGHBOURS}, v AS (SELECT vec_id, label, count(*) AS n FROM d WHERE i <= 5 GROUP BY ALL),
  w AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY n DESC, label) AS i FROM v) SELECT vec_id, CAST(label AS DOUBLE) AS prediction FROM w WHERE i = 1""")
def nearest_neighbours(t):
    df, queries, near = five_nearest(t)
    votes = near.groupBy("id", "label").agg(F.sum("n").alias("n"))
    best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("neg"), F.col("label").alias("label"))).alias("best"))
    return df.join(queries.join(best, "id"), "q").select("vec_id", F.col("best.label").alias("prediction"))


@catalog.add("k16_nearest_neighbours_mean", f"WITH {NEIGHBOURS} SELECT vec_id, round(avg(label), 6) AS prediction FROM d WHERE i <= 5 GROUP BY vec_id")
def nearest_neighbours_mean(t):
    df, queries, near = five_nearest(t)
    mean = near.groupBy("id").agg(F.round(F.sum(F.col("label") * F.col("n")) / F.sum("n"), 6).alias("prediction"))
    return df.join(queries.join(mean, "id"), "q").select("vec_id", "prediction")


def coefficient(name: str, settings: dict | None = None):
    def run(t):
        trained = workflow.train(t.lineitem, "l_extendedprice", ["l_quantity"], "regression", name, settings)
        model = trained.model.stages[-1]
        return small_frame(t.spark, [(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double").select(
            F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept"))
    return run


LINE = "SELECT round({slope}, 3) AS slope, round(avg(l_extendedprice), 3) AS intercept FROM lineitem"
COV = "covar_pop(l_quantity, l_extendedprice) / stddev_pop(l_quantity)"
catalog.add("k19_linear_regression", LINE.format(slope=f"regr_slope(l_extendedprice, l_quantity) * stddev_pop(l_quantity)"))(coefficient("Linear Regression"))
catalog.add("k19_ridge_regression", LINE.format(slope=f"count(*) * {COV} / (count(*) + 5000)"))(coefficient("Ridge Regression", {"alpha": 5000.0}))
catalog.add("k20_lasso_regression", LINE.format(slope=f"sign({COV}) * greatest(abs({COV}) - 30, 0)"))(coefficient("Lasso Regression", {"alpha": 30.0}))
catalog.add("k20_elastic_net", LINE.format(slope=f"sign({COV}) * greatest(abs({COV}) - 10, 0) / (1 + 10)"))(coefficient("Elastic Net", {"alpha": 20.0, "l1_ratio": 0.5}))


@catalog.add("k23_safe_folds", """SELECT 'o_orderpriority' AS target, CAST(min(least(50000, n)) AS INTEGER) AS folds FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority)""")
def safe_folds(t):
    return small_frame(t.spark, [("o_orderpriority", split.safe_folds(t.orders, "o_orderpriority", 50000))], "target string, folds int")


@catalog.add("k24_fold_sizes", """WITH c AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT l_returnflag, CAST(i AS INTEGER) AS fold, CAST(round_even((i + 1) * n / 5.0, 0) - round_even(i * n / 5.0, 0) AS BIGINT) AS n FROM c, range(0, 5) t(i)""")
def fold_sizes(t):
    return split.with_folds(t.lineitem, "l_returnflag", ITEM_KEY, 5).groupBy("l_returnflag", "fold").agg(F.count(F.lit(1)).alias("n"))


@catalog.add("k24_cross_validate")
def cross_validate(t):
    scores = workflow.cross_validate(t.lineitem, "l_extendedprice", ["l_quantity", "l_tax"], ITEM_KEY, "regression", "Linear Regression")
    return small_frame(t.spark, [(i, float(s)) for i, s in enumerate(scores)], "fold int, r2 double")


@catalog.add("k25_tune")
def tune(t):
    _, best = workflow.tune(t.lineitem, "l_extendedprice", ["l_quantity", "l_tax"], ITEM_KEY, "regression", "Ridge Regression", metric="rmse")
    return small_frame(t.spark, [(k, float(v)) for k, v in best.items()], "setting string, value double")


WEIGHTED = """cm AS (SELECT label, prediction, count(*) AS n FROM {t} GROUP BY ALL), cl AS (SELECT DISTINCT label AS c FROM {t} UNION SELECT DISTINCT prediction FROM {t}),
  pc AS (SELECT c, coalesce((SELECT sum(n) FROM cm WHERE label = c), 0) AS actual, coalesce((SELECT sum(n) FROM cm WHERE prediction = c), 0) AS predicted, coalesce((SELECT sum(n) FROM cm WHERE label = c AND prediction = c), 0) AS hits FROM cl),
  rt AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE hits / predicted END AS p, CASE WHEN actual = 0 THEN 0 ELSE hits / actual END AS q FROM pc), f AS (SELECT *, CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END AS f1 FROM rt)"""


@catalog.add("k26_classification_metrics", f"""WITH {THREE}, {WEIGHTED.format(t='three')} SELECT {r('sum(hits) / sum(actual)', 9)} AS accuracy, {r('sum(p * actual) / sum(actual)', 9)} AS precision,
  {r('sum(q * actual) / sum(actual)', 9)} AS recall, {r('sum(f1 * actual) / sum(actual)', 9)} AS f1 FROM f""")
def classification_metrics(t):
    return rounded(metrics.classification_metrics(three(t)), 9)


AUC = """SELECT {keys} round((sum(CASE WHEN label = 1 THEN rk END) - count_if(label = 1) * (count_if(label = 1) + 1) / 2.0) / (count_if(label = 1)::DOUBLE * count_if(label = 0)), 9) AS roc_auc
  FROM (SELECT *, rank() OVER ({part} ORDER BY score) + (count(*) OVER (PARTITION BY {peer} score) - 1) / 2.0 AS rk FROM judged) {group}"""


@catalog.add("k26_roc_auc", f"WITH {SCORED} " + AUC.format(keys="", part="", peer="", group=""))
def roc_auc(t):
    return rounded(metrics.roc_auc(judged(t), "label", "score"), 9)


@catalog.add("k26_roc_auc_by_group", f"WITH {SCORED} " + AUC.format(keys="l_returnflag,", part="PARTITION BY l_returnflag", peer="l_returnflag,", group="GROUP BY l_returnflag"))
def roc_auc_by_group(t):
    return rounded(metrics.roc_auc(judged(t), "label", "score", ["l_returnflag"]), 9)


PRICED = "priced AS (SELECT *, l_quantity * 2100.0 AS guess FROM lineitem)"


def priced(t):
    return t.lineitem.withColumn("guess", F.col("l_quantity") * 2100.0)


@catalog.add("k27_regression_metrics", f"""WITH {PRICED} SELECT {r('avg(pow(l_extendedprice - guess, 2))', 2)} AS mse, {r('sqrt(avg(pow(l_extendedprice - guess, 2)))')} AS rmse, {r('avg(abs(l_extendedprice - guess))')} AS mae,
  {r('1 - sum(pow(l_extendedprice - guess, 2)) / (var_pop(l_extendedprice) * count(*))')} AS r2 FROM priced""")
def regression_metrics(t):
    df = metrics.regression_metrics(priced(t), "l_extendedprice", "guess")
    return rounded(df.withColumn("mse", F.round("mse", 2)))


@catalog.add("k28_classification_report", f"""WITH {THREE}, {WEIGHTED.format(t='three')}, x AS (SELECT c AS class, p, q, f1, CAST(actual AS BIGINT) AS support FROM f
  UNION ALL SELECT 'accuracy', sum(hits) / sum(actual), sum(hits) / sum(actual), sum(hits) / sum(actual), CAST(sum(actual) AS BIGINT) FROM f UNION ALL SELECT 'macro avg', avg(p), avg(q), avg(f1), CAST(sum(actual) AS BIGINT) FROM f
  UNION ALL SELECT 'weighted avg', sum(p * actual) / sum(actual), sum(q * actual) / sum(actual), sum(f1 * actual) / sum(actual), CAST(sum(actual) AS BIGINT) FROM f)
  SELECT class, {r('p', 9)} AS precision, {r('q', 9)} AS recall, {r('f1', 9)} AS f1, support FROM x""")
def classification_report(t):
    return rounded(metrics.classification_report(three(t)), 9)


@catalog.add("k29_confusion_matrix", f"""WITH {THREE}, cm AS (SELECT label, prediction, count(*) AS n FROM three GROUP BY ALL), cl AS (SELECT DISTINCT label AS c FROM three UNION SELECT DISTINCT prediction FROM three),
  g AS (SELECT a.c AS label, b.c AS prediction FROM cl a, cl b) SELECT label, prediction, coalesce(n, 0) AS n, {r('coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY label)', 9)} AS share FROM g LEFT JOIN cm USING (label, prediction)""")
def confusion_matrix(t):
    return rounded(metrics.confusion(three(t)), 9)


CURVE = """c AS (SELECT score, sum(label) AS p, count(*) - sum(label) AS m FROM scored GROUP BY score), u AS (SELECT score, p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(m) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS ap, sum(m) OVER () AS an FROM c)"""


@catalog.add("k30_roc_curve", f"WITH {SCORED}, {CURVE} SELECT score AS threshold, {r('fp / an', 9)} AS fpr, {r('tp / ap', 9)} AS tpr FROM u UNION ALL SELECT CAST('inf' AS DOUBLE), 0, 0")
def roc_curve(t):
    df = metrics.roc_curve(judged(t), "label", "score")
    return df.select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@catalog.add("k31_precision_recall", f"WITH {SCORED}, {CURVE} SELECT score AS threshold, {r('tp / (tp + fp)', 9)} AS precision, {r('tp / ap', 9)} AS recall FROM u")
def precision_recall(t):
    return rounded(metrics.precision_recall_curve(judged(t), "label", "score").drop("pos", "positives"), 9)


@catalog.add("k31_average_precision", f"WITH {SCORED}, {CURVE} SELECT {r('sum(p / ap * tp / (tp + fp))', 9)} AS average_precision FROM u")
def average_precision(t):
    return rounded(metrics.average_precision(judged(t), "label", "score"), 9)


@catalog.add("k32_learning_curve")
def learning_curve(t):
    return workflow.learning_curve(t.lineitem, "l_extendedprice", ["l_quantity", "l_tax"], ITEM_KEY, "regression", "Linear Regression")


@catalog.add("k33_residual_histogram", f"""WITH {PRICED}, e AS (SELECT l_extendedprice - guess AS residual FROM priced), s AS (SELECT min(residual) AS lo, (max(residual) - min(residual)) / 30 AS w FROM e)
  SELECT CAST(least(floor((residual - lo) / w), 29) AS INTEGER) AS bin, count(*) AS n FROM e, s GROUP BY 1""")
def residual_histogram(t):
    return metrics.residual_histogram(priced(t), "l_extendedprice", "guess").select("bin", "n")


@catalog.add("k44_fit_diagonal", f"WITH {PRICED} SELECT least(min(l_extendedprice), min(guess)) AS low, greatest(max(l_extendedprice), max(guess)) AS high FROM priced")
def fit_diagonal(t):
    return metrics.fit_diagonal(priced(t), "l_extendedprice", "guess")


@catalog.add("k44_fit_points")
def fit_points(t):
    return metrics.fit_points(priced(t), ITEM_KEY, "l_extendedprice", "guess")


@catalog.add("k34_feature_importance")
def feature_importance(t):
    return workflow.train(t.lineitem, "l_extendedprice", FEATURES, "regression", "Decision Tree Regressor").importance(10)


@catalog.add("k35_compare_models", f"""WITH {PRICED}, m AS (SELECT 'twice' AS model, sqrt(avg(pow(l_extendedprice - guess, 2))) AS rmse FROM priced UNION ALL SELECT 'mean', sqrt(avg(pow(l_extendedprice - 53000, 2))) FROM priced)
  SELECT model, {r('rmse')} AS rmse, CAST(row_number() OVER (ORDER BY rmse) AS INTEGER) AS place, row_number() OVER (ORDER BY rmse) = 1 AS best FROM m""")
def compare_models(t):
    def line(name, guess):
        return metrics.regression_metrics(t.lineitem.withColumn("guess", guess), "l_extendedprice", "guess").select(F.lit(name).alias("model"), "rmse")
    return rounded(metrics.compare_models(line("twice", F.col("l_quantity") * 2100.0).unionByName(line("mean", F.lit(53000.0))), "rmse"))


ANOVA = """SELECT '{c}' AS feature, round((sum(n * m * m) - pow(sum(n * m), 2) / sum(n)) / (count(*) - 1) / (sum(n * v) / (sum(n) - count(*))), 6) AS f
  FROM (SELECT l_returnflag, count(*) AS n, avg({c}) AS m, var_pop({c}) AS v FROM lineitem GROUP BY 1)"""


@catalog.add("k36_anova", " UNION ALL ".join(ANOVA.format(c=c) for c in ("l_quantity", "l_tax", "l_discount")))
def anova(t):
    return rounded(select.k_best(t.lineitem, ["l_quantity", "l_tax", "l_discount", "l_linestatus"], "l_returnflag"))


@catalog.add("k36_f_regression", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {r(f'pow(corr({c}, l_extendedprice), 2) / (1 - pow(corr({c}, l_extendedprice), 2)) * (count(*) - 2)')} AS f FROM lineitem" for c in ("l_quantity", "l_tax", "l_discount")))
def f_regression(t):
    return rounded(select.k_best(t.lineitem, ["l_quantity", "l_tax", "l_discount"], "l_extendedprice", task="regression"))


MI = """SELECT '{c}' AS feature, round(sum(n / t * ln(n * t / (tx::DOUBLE * ty))), 9) AS mi FROM (SELECT n, sum(n) OVER () AS t, sum(n) OVER (PARTITION BY b) AS tx, sum(n) OVER (PARTITION BY y) AS ty FROM
  (SELECT len(list_filter(list_distinct(e[2:10]), lambda q: q < {c})) AS b, l_returnflag AS y, count(*) AS n FROM lineitem, (SELECT quantile_cont({c}, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM lineitem) GROUP BY ALL))"""


@catalog.add("k37_mutual_information", " UNION ALL ".join(MI.format(c=c) for c in ("l_quantity", "l_extendedprice")))
def mutual_information(t):
    return rounded(select.best_by_information(t.lineitem, ["l_quantity", "l_extendedprice"], "l_returnflag", method="bins"), 9)


@catalog.add("k37_neighbour_information")
def neighbour_information(t):
    return rounded(select.mutual_information(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "l_returnflag"), 9)


@catalog.add("k38_recursive_elimination")
def recursive_elimination(t):
    left = select.recursive_elimination(t.lineitem, ["l_quantity", "l_tax", "l_discount", "l_suppkey"], "l_extendedprice", 2, "regression")
    return small_frame(t.spark, [(c,) for c in left], "feature string")


@catalog.add("k39_choose_features")
def choose_features(t):
    df = t.lineitem.drop("l_shipdate")
    rows = [(mode, ",".join(select.choose_features(df, "l_extendedprice", mode, ["l_tax", "l_linestatus"], 3, "regression"))) for mode in ("all", "manual", "automatic")]
    return small_frame(t.spark, rows, "mode string, features string")


def scoring_parts(t):
    recipe = Recipe("prices").record("fill_missing", "qty", strategy="mean").record("normalize", "qty")
    prepared, _ = recipe.fit(t.gaps).apply(t.gaps)
    trained = workflow.train(prepared, "l_extendedprice", ["qty_normalized", "l_tax"], "regression", "Linear Regression")
    return recipe, trained


@catalog.add("k40_batch_scoring")
def batch_scoring(t):
    recipe, trained = scoring_parts(t)
    return workflow.score_batch(trained, t.gaps.drop("l_extendedprice"), recipe).select("l_orderkey", "l_linenumber", "qty", F.round("prediction", 4).alias("prediction"))


@catalog.add("k42_bundle_round_trip")
def bundle_round_trip(t):
    recipe, trained = scoring_parts(t)
    folder = scratch_path(t.spark, "bundle")
    workflow.save_bundle(trained, folder, recipe, {"r2": 0.0})
    again, kept, _ = workflow.load_bundle(folder)
    return workflow.score_batch(again, t.gaps.drop("l_extendedprice"), kept, "fitted").select("l_orderkey", "l_linenumber", F.round("prediction", 4).alias("prediction"))


@catalog.add("k43_leakage_check")
def leakage_check(t):
    """Mean kept by the scaler, mean of the training rows, mean of all rows."""
    train, _ = split.train_test(t.lineitem, "l_returnflag", ITEM_KEY)
    kept = TabularPrep(numericCols=["l_extendedprice"]).fit(train).fitted["numeric"][0]["center"]
    whole = t.lineitem.agg(F.avg("l_extendedprice").alias("full_mean"))
    return train.agg(F.avg("l_extendedprice").alias("train_mean")).join(whole, F.lit(True)).select(
        F.lit(kept).alias("scaler_mean"), "train_mean", "full_mean")
