import numpy as np
from pyspark.sql import functions as F

from tablecraft.learn import neighbours


def test_small_cells_share_a_page_and_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    for width, grain in ((12, None), (2, 1.0)):  # far apart, then many rows equally far
        x = rng.normal(size=(1500, width)) if grain is None else rng.integers(0, 12, (1500, width)).astype(float)
        df = spark.createDataFrame([(v.tolist(), float(i % 3)) for i, v in enumerate(x)], "v array<double>, label double")
        train = df.groupBy("v", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("v", "label"))
        rows = train.collect()
        v, h, n = np.array([r.v for r in rows]), np.array([r.h for r in rows]), np.array([r.n for r in rows])
        queries = df.select(F.col("v").alias("q")).distinct()
        for block in (20_000, 100):
            got = {}
            for r in neighbours.nearest(train, queries, 4, block, 300).collect():
                got.setdefault(tuple(r.q), []).append((round(r.distance, 6), r.n))
            assert len(got) == queries.count()
            for q, found in got.items():
                d = np.sqrt(((v - np.array(q)) ** 2).sum(1))
                wanted, left = [], 4
                for i in np.lexsort((h, np.round(d, 6))):
                    wanted.append((round(float(d[i]), 6), min(int(n[i]), left)))
                    left -= wanted[-1][1]
                    if not left:
                        break
                if grain is None:
                    assert np.allclose(sorted(found), sorted(wanted), atol=2e-6)
                else:
                    assert sorted(a for a, b in found for _ in range(b)) == sorted(a for a, b in wanted for _ in range(b))



def test_closest_rows_in_order():
    a, b = np.zeros((2, 1)), np.array([[3.0], [1.0], [1.0], [-1.0], [2.0]])
    row, to, d = neighbours._closest(a, b, 2, 10)
    assert row.tolist() == [10, 10, 11, 11] and to.tolist() == [1, 2, 1, 2] and d.tolist() == [1.0] * 4
    assert len(neighbours._closest(a, b, 9, 0)[0]) == 10


def by_force(a, b, k):
    d = np.round(np.stack([np.sqrt(((x - b) ** 2).sum(1)) for x in a]), 12)
    to = np.argsort(d, axis=1, kind="stable")[:, :k]
    return to, np.take_along_axis(d, to, 1)


def test_candidates_in_single_precision_lose_no_neighbour(monkeypatch):
    rng = np.random.default_rng(11)
    plain, sure = [], neighbours._closest_plain
    monkeypatch.setattr(neighbours, "_closest_plain", lambda *a: plain.append(a) or sure(*a))
    cases = {
        "many columns": (rng.normal(size=(60, 64)), rng.normal(size=(9000, 64))),
        "ties": (rng.integers(0, 5, (60, 3)).astype(float), rng.integers(0, 5, (6000, 3)).astype(float)),
        "far from zero": (rng.normal(size=(60, 8)) + 1e6, rng.normal(size=(9000, 8)) + 1e6),
        "queries far away": (rng.normal(size=(60, 8)) * 40, rng.normal(size=(9000, 8))),
    }
    for name, (a, b) in cases.items():
        row, to, d = neighbours._closest(a, b, 5, 0)
        wanted = by_force(a, b, 5)
        assert row.tolist() == np.repeat(np.arange(60), 5).tolist(), name
        assert (to.reshape(-1, 5) == wanted[0]).all() and np.abs(d.reshape(-1, 5) - wanted[1]).max() < 1e-9, name
        assert not plain, name


def test_rows_that_single_precision_cannot_tell_apart():
    rng = np.random.default_rng(12)
    near = 1e-9 * rng.normal(size=(5000, 4))
    for a, b in ((near[:40], np.r_[near, [[1e6] * 4]]), (1e-13 * rng.normal(size=(40, 4)), 1e-13 * rng.normal(size=(5000, 4))), (np.zeros((40, 2)), np.zeros((5000, 2)))):
        row, to, d = neighbours._closest(a, b, 3, 0)
        assert row.tolist() == np.repeat(np.arange(40), 3).tolist()
        wanted = by_force(a, b, 3)[1]
        assert np.abs(d.reshape(-1, 3) - wanted).max() < 1e-7


def test_missing_and_infinite_numbers_are_nearest_to_nothing():
    rng = np.random.default_rng(13)
    a, b = rng.normal(size=(30, 3)), rng.normal(size=(5000, 3))
    wanted = by_force(a, b[2:], 4)
    b[0, 1], b[1, 2] = np.nan, np.inf
    row, to, _ = neighbours._closest(a, b, 4, 0)
    assert (to.reshape(-1, 4) - 2 == wanted[0]).all()
    a[7, 0] = np.nan
    assert len(neighbours._closest(a, b, 4, 0)[0]) == 120


def test_candidates_travel_without_vectors(spark):
    x = np.random.default_rng(6).normal(size=(300, 5))
    df = spark.createDataFrame([(v.tolist(), float(i % 3)) for i, v in enumerate(x)], "v array<double>, label double")
    train = df.select("v", "label", F.lit(1).cast("bigint").alias("n"), F.xxhash64("v", "label").alias("h"))
    queries = neighbours.numbered(df.select(F.col("v").alias("q")))
    near = neighbours.nearest_of(train, queries, 3)
    assert near.columns == ["id", "distance", "label", "n"]
    vector = {r.id: np.array(r.q) for r in queries.collect()}
    got = {}
    for r in near.collect():
        got.setdefault(r.id, []).append(r.distance)
    assert len(got) == 300
    for i, found in got.items():
        assert np.allclose(sorted(found), np.sort(np.sqrt(((x - vector[i]) ** 2).sum(1)))[:3], atol=1e-9)
