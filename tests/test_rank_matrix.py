"""Rank correlations of many columns at once against pandas, with missing values and buckets."""

import numpy as np
import pandas as pd
import pytest

from tablecraft.operators import relations


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 150])
def test_spearman_matrix(spark, rows_per_bucket):
    rng = np.random.default_rng(4)
    n = 400
    base = rng.normal(size=n)
    table = pd.DataFrame({
        "a": base, "b": np.round(base + rng.normal(size=n), 1), "c": rng.integers(0, 3, n).astype(float), "d": -base, "one": np.ones(n),
        "gaps": np.where(rng.random(n) < 0.2, np.nan, base + rng.normal(size=n)), "more gaps": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n)),
    })
    want = table.corr(method="spearman")
    df = spark.createDataFrame([tuple(None if np.isnan(x) else float(x) for x in row) for row in table.itertuples(index=False)], ", ".join(f"`{c}` double" for c in table))
    half = relations._spearman_pairs(df, list(table), rows_per_bucket).collect()
    assert len(half) == 7 * 8 // 2
    for r in half:
        expected = want.loc[r.column_a, r.column_b]
        assert r.correlation is None if np.isnan(expected) else r.correlation == pytest.approx(expected, abs=1e-12)


def test_spearman_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert {(r.column_a, r.column_b, r.correlation) for r in relations.correlation_matrix(df, method="spearman").collect()} == {
        (x, y, None) for x in "ab" for y in "ab"}
