import random

import pytest
from pyspark.sql import functions as F

from tablecraft.functions import ordering, sampling
from tablecraft.functions.quantiles import exact_quantiles, grouped_quantiles
from tablecraft.operators import features, relations
from tablecraft.learn import split


def same(a, b):
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@pytest.fixture(scope="module")
def skewed(spark):
    """4,000 rows; one key and one time stamp hold a third of them."""
    return spark.range(4000).select(
        "id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).alias("g"),
        F.when(F.col("id") % 3 == 1, 500).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000))).alias("t"),
        F.when(F.col("id") % 5 != 0, F.pmod(F.xxhash64("id", F.lit(2)), F.lit(300)).cast("double")).alias("v"))


def test_bucketed_windows_equal_plain_ones(skewed):
    for groups in ((), ("g",)):
        many = features.rolling(skewed, "t", "v", ["id"], (3, 30), ("mean", "max"), groups, rows_per_bucket=50)
        one = features.rolling(skewed, "t", "v", ["id"], (3, 30), ("mean", "max"), groups)
        assert same(many.select("id", F.round("v_rolling_3_mean", 9), "v_rolling_30_max"), one.select("id", F.round("v_rolling_3_mean", 9), "v_rolling_30_max"))
        assert same(features.lags(skewed, "t", "v", ["id"], (1, 40), groups, 30), features.lags(skewed, "t", "v", ["id"], (1, 40), groups))


def test_bucketed_fill_equals_plain(skewed):
    for forward in (True, False):
        assert same(ordering.carry_fill(skewed, "v", ["t", "id"], forward, 100), ordering.carry_fill(skewed, "v", ["t", "id"], forward))


def test_backward_fill_reads_a_row_once(skewed):
    rows = sorted(skewed.collect(), key=lambda r: (r["t"], r["id"]), reverse=True)
    wanted, last = {}, None
    for r in rows:
        last = r["v"] if r["v"] is not None else last
        wanted[r["id"]] = last
    for size in (100, 10 ** 6):
        got = ordering.carry_fill(skewed, "v", ["t", "id"], False, size)
        assert {r["id"]: r["v"] for r in got.collect()} == wanted
        # a frame to the end of the partition is read again for every row
        assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()


def test_bucketed_running_sums(skewed):
    for keys in ((), ("g",)):
        assert same(ordering.value_ranks(skewed, "v", keys, rows_per_bucket=20), ordering.value_ranks(skewed, "v", keys))


def test_quantiles_by_any_route(skewed):
    values = sorted(r[0] for r in skewed.select("v").where("v is not null").collect())
    ps = [0, 0.1, 0.25, 0.5, 0.9, 1]

    def linear(p):
        at = p * (len(values) - 1)
        low = int(at)
        high = min(low + 1, len(values) - 1)
        return values[low] + (values[high] - values[low]) * (at - low)

    wanted = {"v": (F.col("v"), ps), "none": (F.lit(None).cast("double"), [0.5])}
    for direct in (10 ** 6, 200, 3):
        got = exact_quantiles(skewed, wanted, direct=direct)
        assert got["none"] == [None]
        assert got["v"] == pytest.approx([linear(p) for p in ps])


def test_quantiles_of_bunched_values(spark):
    df = spark.range(3000).select(F.exp(F.col("id") / 5.0).alias("x"))
    direct = exact_quantiles(df, {"x": (F.col("x"), [0.1, 0.5])}, direct=10 ** 6)["x"]
    assert exact_quantiles(df, {"x": (F.col("x"), [0.1, 0.5])}, direct=20)["x"] == pytest.approx(direct)


def test_grouped_quantiles_routes_agree(skewed):
    a = grouped_quantiles(skewed, ["g"], "v", {"q": 0.3, "m": 0.5})
    b = grouped_quantiles(skewed, ["g"], "v", {"q": 0.3, "m": 0.5}, direct=10, rows_per_bucket=40)
    assert same(a.select("g", F.round("q", 9), "m"), b.select("g", F.round("q", 9), "m"))


def test_kendall_and_spearman_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(float(rng.randint(0, 9)), float(rng.randint(0, 6))) for _ in range(150)]
    df = spark.createDataFrame(rows, "a double, b double")
    sign = lambda d: (d > 0) - (d < 0)
    pairs = [(sign(p[0] - q[0]), sign(p[1] - q[1])) for i, p in enumerate(rows) for q in rows[:i]]
    up = sum(x * y for x, y in pairs)
    want = up / (sum(x != 0 for x, _ in pairs) * sum(y != 0 for _, y in pairs)) ** 0.5
    for per_bucket in (10 ** 6, 7):
        assert relations.kendall(df, "a", "b", per_bucket).head()[0] == pytest.approx(want, abs=1e-12)
    pdf = df.toPandas().rank()
    for per_bucket in (10 ** 6, 4):
        assert relations.spearman(df, "a", "b", per_bucket).head()[0] == pytest.approx(pdf["a"].corr(pdf["b"]), abs=1e-12)


def test_sample_is_exact_and_repeatable(skewed):
    one = sampling.seeded_sample(skewed, 100, ["id"])
    assert one.count() == 100 and same(one, sampling.seeded_sample(skewed.repartition(7), 100, ["id"]))
    assert same(sampling.seeded_sample(skewed, 10 ** 6, ["id"]), skewed)


def test_split_sizes_are_exact(skewed):
    counts = {r["g"]: r["count"] for r in skewed.groupBy("g").count().collect()}
    marked = split.prepare_split(skewed, "g", ["id"], test_size=0.25)
    tests = {r["g"]: r["n"] for r in marked.groupBy("g").agg(F.count_if("is_test").alias("n")).collect()}
    assert tests == {g: int(n * 0.25 + 0.5) for g, n in counts.items()}
    assert marked.count() == 4000


def test_folds_and_nested_subsets(skewed):
    folds = split.with_folds(skewed, "g", ["id"], 4).groupBy("fold").count().collect()
    assert len(folds) == 4 and max(r["count"] for r in folds) - min(r["count"] for r in folds) <= 11
    small, large = split.nested_subset(skewed, ["id"], 0.1), split.nested_subset(skewed, ["id"], 0.5)
    assert small.count() == 400 and large.count() == 2000
    assert small.join(large, "id", "left_anti").isEmpty()


def test_both_ways_to_cut_agree(skewed, monkeypatch):
    plain = split.with_folds(skewed, "g", ["t", "id"], 3).select("id", "fold")
    monkeypatch.setattr(sampling, "PLAIN_CUTS", 0)
    assert same(plain, split.with_folds(skewed, "g", ["t", "id"], 3).select("id", "fold"))


def test_split_of_tiny_classes(spark):
    df = spark.createDataFrame([(i, "a" if i < 2 else "b") for i in range(12)], "id int, y string")
    marked = split.prepare_split(df, "y", ["id"], test_size=0.2)
    assert {(r["y"], r["is_test"]): r["count"] for r in marked.groupBy("y", "is_test").count().collect()} == {
        ("a", False): 2, ("b", False): 8, ("b", True): 2}


def test_bucket_numbers_are_found_by_halving(spark):
    from bisect import bisect_right

    from tablecraft.functions.ordering import bucket_column, split_points

    df = spark.range(20_000).selectExpr("IF(id % 9 = 0, NULL, CONCAT('k\"', id % 7)) AS k", "IF(id % 11 = 0, NULL, CAST(xxhash64(id) AS DOUBLE)) AS x", "id")
    splits = split_points(df, ["k", "x", "id"], 20_000, 300)
    assert len(splits) > 200
    numbered = df.withColumn("b", bucket_column(df, ["k", "x", "id"], splits))

    def place(k, x, i):
        return (k is None, k or "", x is None, x or 0.0, False, i)

    points = [place(r["v0"], r["v1"], r["v2"]) for r in splits]
    assert all(r["b"] == bisect_right(points, place(r["k"], r["x"], r["id"])) for r in numbered.collect())
    # every point is not compared with every row
    assert "filter(" not in numbered._jdf.queryExecution().optimizedPlan().toString()


def test_cuts_of_rows_chosen_by_the_same_hash_rank_few_rows(spark, monkeypatch):
    monkeypatch.setattr(sampling, "NEAR_ROWS", 200)
    df = spark.range(30_000).select(F.col("id").alias("k"), (F.col("id") % 2).cast("string").alias("g"))
    hashed = df.select("k", "g", sampling.row_hash(["k"], 42).alias("h"))
    cut = hashed.approxQuantile("h", [0.2], 0)[0]
    left = hashed.where(F.col("h") > cut)
    rows = sorted((r["h"], r["k"], r["g"]) for r in left.collect())
    mine = {g: [r[:2] for r in rows if r[2] == g] for g in "01"}
    ranks = {g: [1, len(m) // 10, len(m) // 2] for g, m in mine.items()}
    ranked = []
    plain = sampling._hits
    monkeypatch.setattr(sampling, "_hits", lambda base, wanted, brackets, *rest: ranked.append(max(hi - lo for lo, hi in brackets.values())) or plain(base, wanted, brackets, *rest))
    found = sampling.rank_cuts(left, ["k"], 42, ranks, {g: len(m) for g, m in mine.items()}, "g")
    assert {g: [tuple(c) for c in cuts] for g, cuts in found.items()} == {g: [m[r - 1] for r in ranks[g]] for g, m in mine.items()}
    assert ranked[-1] < sampling.SPACE // 50
