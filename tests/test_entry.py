import duckdb
import pytest

import __spark_entry__ as entry

QUICK = ["a04_coerce_numbers", "b07_iqr_outliers", "b22_findings_by_rank", "d09_forward_fill", "e05_equal_width_bins", "f04_label_encode",
         "h05_rolling", "i03_replay_recipe", "j10_density", "j16_correlation_kendall", "j23_resample_week", "k26_roc_auc", "k37_mutual_information", "l03_stream_resample"]


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["column", "issue", "severity", "detail"] and frame.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", QUICK)
def test_same_as_sql(spark, folder, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem", "events", "documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    frame = entry.queries()[name](spark, folder)
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(frame.columns) == sorted(names)
    got = sorted([tuple(str(r[c]) for c in sorted(names)) for r in frame.collect()])
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted(tuple(str(row[i]) for i in at) for row in result.fetchall())
