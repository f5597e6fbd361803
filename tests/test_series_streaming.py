import math
import shutil

import pytest
from pyspark.sql import functions as F

from assaymill.operators import series
from assaymill.streaming import incremental


def monthly(spark, n=36):
    rows = [(s, t, base + 3.0 * t + 10 * math.sin(2 * math.pi * t / 12)) for s, base in (("a", 100.0), ("b", 50.0)) for t in range(n)]
    return spark.createDataFrame(rows, "series_id string, t int, value double"), rows


def test_scores_equal_plain_arithmetic(spark):
    df, rows = monthly(spark)
    got = {(r.series_id, r.method): (r.mase, r.mape) for r in series.scores(df, 12).collect()}
    for s in "ab":
        v = [x for k, _, x in rows if k == s]
        past, truth = v[:24], v[24:]
        scale = sum(abs(past[i] - past[i - 12]) for i in range(12, 24)) / 12
        n = len(past)
        mx, my = (n - 1) / 2, sum(past) / n
        slope = sum((i - mx) * (y - my) for i, y in enumerate(past)) / sum((i - mx) ** 2 for i in range(n))
        made = {
            "seasonal_naive": past[12:],
            "drift": [past[-1] + k * (past[-1] - past[0]) / (n - 1) for k in range(1, 13)],
            "last_value": [past[-1]] * 12,
            "linear_fit": [my + slope * (n - 1 + k - mx) for k in range(1, 13)],
        }
        for m, f in made.items():
            mase = sum(abs(a - b) for a, b in zip(f, truth, strict=True)) / 12 / scale
            mape = 100 * sum(abs(a - b) / b for a, b in zip(f, truth, strict=True)) / 12
            assert got[s, m] == pytest.approx((mase, mape))


def test_constant_series_has_no_mase(spark):
    df = spark.createDataFrame([("c", t, 5.0) for t in range(36)], "series_id string, t int, value double")
    assert {r.mase for r in series.scores(df, 12).collect()} == {None}


def test_sweep_equals_scores_of_cut_series(spark):
    df, _ = monthly(spark)
    swept = {(r.length, r.method): r.mase for r in series.history_sweep(df, [8, 12], 4).collect()}
    for n in (8, 12):
        alone = series.mean_scores(series.scores(df.where(f"t >= {36 - 4 - n}"), 4, 4))
        for r in alone.collect():
            assert swept[n, r.method] == pytest.approx(r.mase, abs=1e-4)


def test_quarter_facts(spark):
    day = "date'2024-01-01'"
    rows = [(0, 79, "x"), (1, 80, "x"), (2, 100, "x"), (3, 101, "x"), (4, 365, "x"), (5, 90, ""), (6, 90, None), (7, 90, "y"), (8, 90, "z")]
    df = spark.createDataFrame(rows, "seq int, days int, accession string").select(F.lit("e").alias("entity"), F.expr(day).alias("start"), F.expr(f"date_add({day}, days)").alias("end"), F.lit(1.0).alias("value"), "accession", "seq")
    assert sorted(r.seq for r in series.quarter_facts(df).collect()) == [1, 2, 7]


def test_first_tag_that_is_long_enough(spark):
    df = spark.createDataFrame([("e", 1)] * 23 + [("e", 2)] * 24 + [("e", 3)] * 30, "entity string, tag_priority int")
    assert {(r.entity, r.tag_priority) for r in series.first_long_enough(df).collect()} == {("e", 2)}


def test_synthetic_series(spark):
    points = spark.range(1).select(series.synthetic_monthly(F.lit(100.0), F.lit(1.01), F.lit(0.0)).alias("p")).head().p
    assert len(points) == 60 and points[47].value == 100.0


def test_cache_keeps_only_successes(spark, tmp_path):
    place = str(tmp_path / "cache")
    wanted = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, page int")
    calls = []

    def read(misses):
        calls.append(misses.count())
        return misses.select("doc_id", "page", F.when(F.col("page") == 1, "text").otherwise(" ").alias("text"), F.lit(True).alias("ok"))

    for _ in range(2):
        got = incremental.through_cache(spark, wanted, place, ["doc_id", "page"], read)
        assert [r.page for r in got.collect()] == [1]
    assert calls == [2, 1]


def test_inbox_stream_takes_each_file_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.range(5).write.parquet(source)
    run = lambda: incremental.screen_inbox(spark, source, "id long", lambda d: d.withColumn("seen", F.lit(True)), out, mark).awaitTermination()
    run()
    run()
    assert spark.read.parquet(out).count() == 5
    spark.range(5, 8).write.mode("append").parquet(source)
    run()
    assert spark.read.parquet(out).count() == 8


def test_sessions_are_appended_once(spark, tmp_path):
    place = str(tmp_path / "sessions")
    first = spark.createDataFrame([("d", 1, "x")], "doc_id string, session int, note string")
    for _ in range(2):
        incremental.append_session(first, place)
    incremental.append_session(spark.createDataFrame([("d", 2, "y")], first.schema), place)
    assert spark.read.parquet(place).count() == 2


def test_streamed_windows_equal_batch(spark, sf_dir, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", folder)
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(str(folder))
    rows = incremental.tumbling(incremental.distinct_events(stream), "1 day", late=None)
    query = rows.writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    query.awaitTermination()
    plain = lambda rows: {(r.start.replace(tzinfo=None), *tuple(r)[1:]) for r in rows}
    got = plain(spark.table("windows").withColumn("start", F.col("start").cast("timestamp_ntz")).collect())
    want = plain(incremental.tumbling(incremental.distinct_events(batch), "1 day").collect())
    assert got <= want
    last = max(r[0] for r in want)
    assert {r for r in want if r[0] < last} <= got
