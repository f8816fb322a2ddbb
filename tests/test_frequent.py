import collections

import pytest

from tablecraft.functions import frequent
from tablecraft.functions.frequent import most_frequent


def exact(values, n):
    counts = collections.Counter(v for v in values if v is not None)
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:n]


COLUMNS = {
    "skewed": [f"v{i % 7}" if i % 3 else f"only {i}" for i in range(900)],
    "distinct": [f"id {i:04d}" for i in range(900)],
    "tied": [f"t{i // 2:04d}" for i in range(900)],
    "gaps": [None if i % 2 else f"g{i % 40}" for i in range(900)],
    "none": [None] * 900,
}


@pytest.mark.parametrize("buckets, probed", [(1 << 16, 256), (16, 1)])
def test_equals_a_full_count(spark, monkeypatch, buckets, probed):
    """Also where buckets are few, so that most hold several values and those counted first do not suffice."""
    monkeypatch.setattr(frequent, "BUCKETS", buckets)
    monkeypatch.setattr(frequent, "LEAST_BUCKETS", min(buckets, 1024))
    monkeypatch.setattr(frequent, "PROBED", probed)
    df = spark.createDataFrame(list(zip(*COLUMNS.values())), ", ".join(f"`{c}` string" for c in COLUMNS))
    for n in (1, 5):
        assert most_frequent(df, list(COLUMNS), n, "string") == {c: exact(v, n) for c, v in COLUMNS.items()}
    assert most_frequent(df, ["tied"], 1000)["tied"] == exact(COLUMNS["tied"], 1000)


def test_odd_tables(spark):
    df = spark.createDataFrame([(0.0, 1), (-0.0, 2), (2.5, 3), (2.5, 4), (0.0, 5), (None, 6)], "`a.b` double, bucket int")
    assert most_frequent(df, ["a.b"], 2) == {"a.b": [(0.0, 3), (2.5, 2)]}
    assert most_frequent(df, ["bucket"], 1) == {"bucket": [(1, 1)]}
    assert most_frequent(df.limit(0), ["a.b", "bucket"], 3, "string") == {"a.b": [], "bucket": []}
    assert most_frequent(df, ["a.b"], 0) == {"a.b": []} and most_frequent(df, [], 3) == {}
