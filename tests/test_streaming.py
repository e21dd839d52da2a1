from __future__ import annotations

import datetime as dt

from demandpanel.streaming import feeds


def test_daily_counts_equal_batch_on_closed_days(spark, tmp_path, rows):
    src = str(tmp_path / "in")
    data = [("a", dt.datetime(2024, 1, d, h), 1) for d in range(1, 8) for h in (0, 5, 23)]
    spark.createDataFrame(data, "node string, ts timestamp, count bigint").write.parquet(src)
    feed = spark.readStream.schema("node string, ts timestamp, count bigint").parquet(src)
    feeds.start_daily_counts(feed, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = rows(spark.read.parquet(str(tmp_path / "out")), "date")
    # Newest row 7 January 23:00, two days late allowed: days up to the 4th are closed.
    assert out == [("a", dt.date(2024, 1, d), 3) for d in range(1, 5)]


def test_later_batches_win(spark, tmp_path, rows):
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    kinds = "k int, o int, v string"
    batches = ([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], [(2, 0, "d"), (3, 1, "e")])
    for batch in batches:
        spark.createDataFrame(batch, kinds).coalesce(1).write.mode("append").parquet(src)
        feeds.start_upsert(spark.readStream.schema(kinds).parquet(src), out, state, ["k"], ["o"]).awaitTermination()
    assert rows(feeds.current_rows(spark, out, ["k"]).select("k", "v"), "k") == [(1, "b"), (2, "d"), (3, "e")]


def test_reads_touch_the_base_and_later_batches_only(spark, tmp_path, rows):
    src, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    kinds = "k int, o int, v string"

    def load(*batch):
        spark.createDataFrame(batch, kinds).coalesce(1).write.mode("append").parquet(src)
        feeds.start_upsert(spark.readStream.schema(kinds).parquet(src), out, state, ["k"], ["o"]).awaitTermination()

    def now():
        return rows(feeds.current_rows(spark, out, ["k"]).select("k", "v"), "k")

    load((1, 1, "a"), (2, 1, "b"))
    load((2, 2, "c"), (3, 1, "d"))
    assert feeds.compact(spark, out, ["k"]) == 1 and feeds.compact(spark, out, ["k"]) is None
    assert now() == [(1, "a"), (2, "c"), (3, "d")] and feeds.open_parts(spark, out) == (f"{out}/base=1", [])
    load((3, 2, "e"))
    assert feeds.open_parts(spark, out) == (f"{out}/base=1", [f"{out}/batch=2"]) and now() == [(1, "a"), (2, "c"), (3, "e")]
    assert sum(".parquet" in f for f in feeds.current_rows(spark, out, ["k"]).inputFiles()) == len(set(feeds.current_rows(spark, out, ["k"]).inputFiles()))
    assert all("base=1" in f or "batch=2" in f for f in feeds.current_rows(spark, out, ["k"]).inputFiles())


def test_a_compaction_that_breaks_off_loses_nothing(spark, tmp_path, rows, monkeypatch):
    out = str(tmp_path / "out")
    for n, batch in enumerate(([(1, "a"), (2, "b")], [(2, "c")], [(3, "d")])):
        spark.createDataFrame(batch, "k int, v string").write.parquet(f"{out}/batch={n}")

    def dies(*_):
        raise RuntimeError("lost before the mark")

    want = [(1, "a"), (2, "c"), (3, "d")]
    with monkeypatch.context() as broken:
        broken.setattr(feeds.versions, "publish", dies)
        try:
            feeds.compact(spark, out, ["k"])
        except RuntimeError:
            pass
    assert feeds.open_parts(spark, out)[0] is None and rows(feeds.current_rows(spark, out, ["k"]), "k") == want
    assert feeds.compact(spark, out, ["k"]) == 2 and rows(feeds.current_rows(spark, out, ["k"]), "k") == want
    spark.createDataFrame([(1, "z")], "k int, v string").write.parquet(f"{out}/batch=3")
    assert feeds.compact(spark, out, ["k"]) == 3 and feeds.versions.numbers(spark, out, "batch=") == [3]
    assert feeds.versions.numbers(spark, out, "base=") == [2, 3] and rows(feeds.current_rows(spark, out, ["k"]), "k") == [(1, "z"), (2, "c"), (3, "d")]


def test_hourly_upsert_keeps_canonical_columns_and_the_last_source(spark, tmp_path):
    from demandpanel.functions import fixed
    from demandpanel.sources import sinks
    path, kinds = str(tmp_path / "h"), "timestamp string, temp_c double, source_file string"
    assert sinks.hourly_table(spark, path) is None
    sinks.upsert_hourly(spark.createDataFrame([("2024-01-01 01:00:00", 1.0, "x"), ("2024-01-01 02:00:00", 2.0, "x"), (None, 9.0, "x")], kinds), path)
    sinks.upsert_hourly(spark.createDataFrame([("2024-01-01 02:00:00", 4.0, "b"), ("2024-01-01 02:00:00", 3.0, "a"), ("2024-01-01 00:00:00", None, "a")], kinds), path)
    out = sinks.hourly_table(spark, path)
    assert tuple(out.columns) == fixed.HOURLY_COLUMNS
    assert [(r.timestamp, r.temp_c) for r in out.orderBy("timestamp").collect()] == [("2024-01-01 00:00:00", None), ("2024-01-01 01:00:00", "1.0"), ("2024-01-01 02:00:00", "4.0")]
