from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecraft.learn import workflow
from tablecraft.plans.recipe import Recipe
from tablecraft.operators import series
from tablecraft.streaming import jobs, keyed, sketches


def test_scoring_of_arriving_files(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    recipe = Recipe("r").record("fill_missing", "value", strategy="mean").record("standardize", "value")
    ready, _ = recipe.apply(events)
    trained = workflow.train(ready, "event_type", ["value_standardized"], "classification", "Naive Bayes")
    arriving = str(tmp_path / "in")
    events.where("event_id % 2 = 0").write.parquet(arriving)
    stream = jobs.file_stream(spark, arriving, events.schema)
    with pytest.raises(ValueError):
        jobs.score_stream(stream, trained, str(tmp_path / "out"), str(tmp_path / "cp"), recipe)
    recipe.fit(events)
    run = lambda: jobs.score_stream(stream, trained, str(tmp_path / "out"), str(tmp_path / "cp"), recipe).awaitTermination()
    run()
    events.where("event_id % 2 = 1").write.mode("append").parquet(arriving)
    run()
    scored = spark.read.parquet(str(tmp_path / "out"))
    assert scored.count() == events.count() == scored.select("event_id").distinct().count()
    batch = trained.predict(recipe.apply(events, mode="fitted")[0]).select("event_id", "prediction")
    assert scored.select("event_id", "prediction").exceptAll(batch).isEmpty()


def test_windows_do_not_depend_on_the_session_zone(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    arriving = str(tmp_path / "in")
    events.write.parquet(arriving)
    jobs.close_stream(spark, arriving, events.schema, "ts", datetime(2030, 1, 1))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        frame = jobs.quality_windows(jobs.file_stream(spark, arriving, events.schema), "ts", ["value", "event_type"])
        out = jobs.run_to_files(frame, str(tmp_path / "out"), str(tmp_path / "cp"))
        days = events.groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
        joined = out.where("column = 'value'").join(days, out.window_start == days.d)
        assert joined.count() == days.count() and joined.where("rows <> n").isEmpty()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


SEEN = "ts timestamp_ntz, who bigint, id bigint, v double"


def batches(spark, folder, parts):
    """One file per part, each a batch of its own in that order."""
    for part in parts:
        spark.createDataFrame(part, SEEN).coalesce(1).write.mode("append").parquet(folder)
    return jobs.file_stream(spark, folder, spark.createDataFrame([], SEEN).schema, files_per_trigger=1)


def at(day, hour=0, minute=0):
    return datetime(2024, 1, 1) + timedelta(days=day, hours=hour, minutes=minute)


def test_periods_of_a_stream_close_by_the_watermark(spark, tmp_path):
    parts = [
        [(at(0, 1), 1, 1, 2.0), (at(0, 2), 2, 2, 5.0), (at(1, 3), None, 3, 1.0), (None, 1, 4, 9.0)],
        [(at(4, 1), 1, 5, 4.0)],
        [(at(4, 0, 30), 1, 6, 6.0), (at(0, 5), 1, 7, 100.0)],  # the first is late but allowed, the second too late
        [(at(6, 2), 2, 8, None)],
        [(at(8, 2), None, 9, None)],
    ]
    stream = batches(spark, str(tmp_path / "in"), parts)
    frame = keyed.resample_periods(stream, "ts", "v", "day", "sum", ["who"])
    keyed.run_keyed(frame, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.who, (r.period - date(2024, 1, 1)).days): r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(1, d): 0.0 for d in range(8)} | {(2, d): 0.0 for d in range(8)} | {(None, d): 0.0 for d in range(1, 8)}
    assert got == want | {(1, 0): 2.0, (1, 4): 10.0, (2, 0): 5.0, (None, 1): 1.0}
    again = keyed.run_keyed(frame, str(tmp_path / "out"), str(tmp_path / "cp"))
    again.awaitTermination()  # nothing new: nothing more
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)
    with pytest.raises(ValueError):
        keyed.resample_periods(stream, "ts", "v", "fortnight")


@pytest.mark.parametrize("unit,how", [("week", "mean"), ("month", "max"), ("quarter", "count"), ("year", "min")])
def test_periods_of_a_stream_equal_the_batch(spark, tmp_path, unit, how):
    rng = np.random.default_rng(5)
    rows = [(at(int(d), int(h)), 1, i, float(v)) for i, (d, h, v) in enumerate(zip(rng.choice([3, 20, 40, 200, 500], 60), rng.integers(0, 24, 60), rng.normal(size=60)))]
    folder = str(tmp_path / "in")
    spark.createDataFrame(rows, SEEN).repartition(4).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    last = max(r[0] for r in rows)
    end = keyed.EPOCH + timedelta(days=keyed.following(keyed.period_start((last.date() - keyed.EPOCH).days, unit), unit))
    jobs.close_stream(spark, folder, schema, "ts", datetime(end.year, end.month, end.day, 1))
    frame = keyed.resample_periods(jobs.file_stream(spark, folder, schema), "ts", "v", unit, how)
    keyed.run_keyed(frame, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.period: r.value for r in spark.read.schema(frame.schema).parquet(str(tmp_path / "out")).collect()}
    want = {r.period: r.value for r in series.resample(spark.createDataFrame(rows, SEEN), "ts", "v", unit, how).collect()}
    assert got == pytest.approx(want) and len(got) > 1


def test_period_bounds():
    for unit in ("day", "week", "month", "quarter", "year"):
        for day in range(-800, 800):
            start = keyed.period_start(day, unit)
            assert start <= day < keyed.following(start, unit) and keyed.period_start(keyed.following(start, unit) - 1, unit) == start


def test_ordered_features_of_late_rows_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(at(0, 0, int(m)), [1, 2, None][i % 3], (1 << 60) + i, None if i % 4 == 0 else float(rng.integers(0, 50))) for i, m in enumerate(sorted(rng.integers(0, 600, 240)))]
    order = sorted(range(240), key=lambda i: i + rng.integers(0, 15))  # rows are late by less than the allowance of two hours
    parts = [[rows[i] for i in order[a : a + 40]] for a in range(0, 240, 40)]
    parts.append([(at(3), 9, 0, None)])
    stream = batches(spark, str(tmp_path / "in"), parts)
    frame = keyed.ordered_features(stream, "ts", "v", "id", ["who"], lags=(1, 4), windows=(2, 3), functions=("mean", "std", "min", "max", "sum"), fill=True, late="2 hours")
    keyed.run_keyed(frame, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.id: r.asDict() for r in spark.read.schema(frame.schema).parquet(str(tmp_path / "out")).collect()}
    assert set(got) == {r[2] for r in rows}
    for who in (1, 2, None):
        mine = sorted((r for r in rows if r[1] == who), key=lambda r: (r[0], r[2]))
        known = None
        for n, (ts, _, i, v) in enumerate(mine):
            known = v if v is not None else known
            r = got[i]
            assert (r["who"], r["ts"], r["v"], r["v_filled"]) == (who, ts, v, known)
            assert r["v_lag_1"] == (mine[n - 1][3] if n >= 1 else None) and r["v_lag_4"] == (mine[n - 4][3] if n >= 4 else None)
            for w in (2, 3):
                part = [x[3] for x in mine[max(0, n - w + 1) : n + 1]]
                full = len(part) == w and None not in part
                for f, fn in (("mean", np.mean), ("min", min), ("max", max), ("sum", sum), ("std", lambda x: np.std(x, ddof=1))):
                    assert r[f"v_rolling_{w}_{f}"] == (pytest.approx(fn(part)) if full else None)
    with pytest.raises(ValueError):
        keyed.ordered_features(stream, "ts", "v", "v", ["who"])


def test_sketches_merge_within_their_bounds(spark, tmp_path):
    rng, rows = np.random.default_rng(1), 60_000
    kinds = np.where(rng.random(rows) < 0.3, 7.0, rng.lognormal(2, 2, rows))
    data = spark.createDataFrame(
        [(at(int(i % 60)), int(i % 5003), i, None if i % 11 == 0 else float(v)) for i, v in enumerate(kinds)], SEEN).withColumn("word", F.concat(F.lit("w"), F.col("who")))
    folder = str(tmp_path / "in")
    data.repartition(6).write.parquet(folder)
    jobs.close_stream(spark, folder, data.schema, "ts", datetime(2030, 1, 1))
    days = jobs.run_to_files(sketches.sketch_windows(jobs.file_stream(spark, folder, data.schema), "ts", ["v", "word"]), str(tmp_path / "days"), str(tmp_path / "cp"))
    assert days.count() == 120
    for unit, spans in (("month", 2), ("year", 1)):
        figures = sketches.sketch_figures(sketches.merge_windows(days, unit)).collect()
        assert len(figures) == 2 * spans
        for r in figures:
            inside = [float(v) for i, v in enumerate(kinds) if i % 11 and (unit == "year" or at(i % 60).month == r.window_start.month)]
            if r.column == "v":
                x = np.sort(inside)
                assert r.rows - r.missing_count == len(x) and r["min"] == x[0] and r["max"] == x[-1]
                for name, share in sketches.SHARES.items():
                    low, high = np.searchsorted(x, r[name], "left") / len(x), np.searchsorted(x, r[name], "right") / len(x)
                    assert low - sketches.RANK_ERROR <= share <= high + sketches.RANK_ERROR
                assert r.upper_fence == pytest.approx(r.q3 + 1.5 * (r.q3 - r.q1))
                exact = len(set(inside))
            else:
                exact = len({i % 5003 for i in range(rows) if unit == "year" or at(i % 60).month == r.window_start.month})
                assert r["median"] is None
            assert abs(r.distinct_count - exact) <= 3 * sketches.DISTINCT_ERROR * exact
    none = data.where("id < 200").withColumn("v", F.lit(None).cast("double"))
    assert {r["median"] for r in sketches.sketch_figures(sketches.sketch_windows(none, "ts", ["v"])).collect()} == {None}
