from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandpanel.operators import economics as ec, features as ft, nodes as nd, ordered as od, panel as pn, summaries as sm


def day(n):
    return dt.date(2024, 6, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def panel(spark):
    rows = [("a", day(i), float(100 + 7 * i % 13), float(i), 1.0 * (i % 3), 20.0, 5.0, 3.0) for i in range(60)]
    return spark.createDataFrame(rows, "node string, date date, count double, intent double, precip double, temp double, sun double, wind double")


def test_feature_columns_and_ranges(panel):
    df, names = ft.build_features(panel, "intent")
    out = df.orderBy("date").collect()
    assert set(names) <= set(df.columns) and "intent_roll7" in names and len(names) == 16
    assert all(0 <= r.dow <= 6 and (r.is_weekend == 1) == (r.dow in (5, 6)) for r in out)
    assert all(0 <= r.weather_severity <= 3 for r in out)
    assert out[0].intent_lag1 is None and all(out[i].intent_lag1 == out[i - 1].intent for i in range(1, 60))
    assert all(r.intent_lag0 == r.intent for r in out)
    assert out[1].intent_roll3 == pytest.approx(0.5) and out[9].intent_roll3 == pytest.approx(8.0)
    mean = sum(r["count"] for r in out if r.dow == 0) / sum(1 for r in out if r.dow == 0)
    assert all(r.dow_mean_count == pytest.approx(mean) for r in out if r.dow == 0)


def test_lag_steps_over_removed_days(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", day(1), 0.0), ("a", day(2), 5.0)], "node string, date date, count double")
    out = ft.naive_previous(pn.drop_zero_days(df)).orderBy("date").collect()
    assert [r.pred_naive_lag1 for r in out] == [None, 1.0]


def test_shift_and_back_is_identity(panel):
    there = ft.add_shifts(panel, "count", [2]).select("node", "date", "count", F.col("count_s2").alias("x"))
    back = ft.add_shifts(there, "x", [-2]).where("x_s_2 is not null" if "x_s_2" in there.columns else "`x_s-2` is not null")
    assert back.where("`x_s-2` <> count").count() == 0 and back.count() == 58


def test_missing_intent_counts_as_zero_in_interaction(spark):
    df = spark.createDataFrame([(1, 2, None), (1, 2, 5.0)], "is_weekend_or_holiday int, weather_severity int, i double")
    assert [r.weekend_x_intent for r in ft.add_interactions(df, "i").collect()] == [0.0, 5.0]


def test_split_rounding(spark):
    df = spark.createDataFrame([("a", day(i)) for i in range(397)] + [("b", day(0))], "node string, date date")
    near = ft.mark_split(df).groupBy("node").agg(F.count_if("is_train")).collect()
    down = ft.mark_split(df, rounding="down").groupBy("node").agg(F.count_if("is_train")).collect()
    assert dict(map(tuple, near)) == {"a": 318, "b": 0} and dict(map(tuple, down)) == {"a": 317, "b": 0}


def test_gaps(spark):
    rows = [("a", day(0)), ("a", day(2)), ("a", day(2)), ("a", day(5)), ("b", day(9)), ("c", None)]
    df = spark.createDataFrame(rows, "node string, date date")
    assert sorted((r.node, r.date) for r in pn.date_gaps(df).collect()) == [("a", day(1)), ("a", day(3)), ("a", day(4))]
    assert pn.date_gaps(df.limit(0)).count() == 0


def test_upsert_rules(spark, rows):
    old = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    new = spark.createDataFrame([(2, "first", "f1"), (2, "last", "f2"), (3, "new", "f1")], "k int, v string, f string")
    once = pn.upsert(old, new, ["k"], ["f"])
    assert rows(once, "k") == [(1, "old"), (2, "last"), (3, "new")]
    assert rows(pn.upsert(once, new, ["k"], ["f"]), "k") == rows(once, "k")


def test_outlier_flag(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [10] * 5 + [11] * 5 + [500]], "node string, count double")
    assert [r["count"] for r in pn.flag_outliers(df).where("is_outlier").collect()] == [500.0]


def test_all_missing_rain_sums_to_zero(spark):
    df = spark.createDataFrame([("s", dt.datetime(2024, 1, 1, h), None, None) for h in range(3)], "station string, timestamp timestamp_ntz, precip double, temp double")
    row = pn.daily_weather(df).first()
    assert row.precip == 0.0 and row.temp is None


def test_proxy_only_when_empty(spark):
    a = spark.createDataFrame([(day(0), 1.0)], "date date, count double")
    b = spark.createDataFrame([(day(1), 9.0)], "date date, count double")
    assert [r["count"] for r in pn.choose_proxy(a, b).collect()] == [1.0]
    assert [r["count"] for r in pn.choose_proxy(a.limit(0), b).collect()] == [9.0]


def test_station_fallback(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",)], "station string")
    assert pn.one_station(df, "b").count() == 1 and pn.one_station(df, "zzz").count() == 2


def test_distributed_quantiles_match_percentile(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.rand(3) * F.pow(F.lit(10.0), F.col("id") % 9) - 50).alias("x"))
    df = df.unionByName(df.where("id % 2 = 0" if "id" in df.columns else "k = 0")).withColumn("x", F.round("x", 2)).persist()
    got = {r.k: tuple(r)[2:] for r in od.quantiles(df, "x", {"a": 0.1, "b": 0.5, "c": 0.9}, ["k"]).collect()}
    want = {r.k: tuple(r.p) for r in df.groupBy("k").agg(F.percentile("x", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("p")).collect()}
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12, abs=1e-9)


def test_ranges_split_any_distribution_evenly_and_keep_order(spark):
    """Milliseconds of one hour between two far outliers, and a constant key of many rows."""
    hour = spark.range(40000).select(F.lit("time").alias("k"), (F.lit(1.7e12) + F.col("id") * 90).alias("x"))
    df = hour.unionByName(spark.createDataFrame([("time", -1e300), ("time", 1e300)], "k string, x double")).unionByName(
        spark.range(30000).select(F.lit("flat").alias("k"), F.lit(3.0).alias("x")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cells = od.ranged(od.value_counts(df, "x", ["k"]), "x", ["k"]).persist()
        spans = cells.groupBy("k", "_cell").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("k", "_cell").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(r.n for r in spans) == 40003 and [r.n for r in spans if r.k == "flat"] == [1]
    time = [r for r in spans if r.k == "time"]
    assert len(time) == 4 and max(r.n for r in time) < 2 * 10000
    assert all(a.hi < b.lo for a, b in zip(time, time[1:]))
    last = od.running_totals(cells, "x", ["n"], ["k"]).where("k = 'time'").orderBy("x").select("cum_n", "total_n").collect()
    assert [r.cum_n for r in last] == list(range(1, 40003)) and {r.total_n for r in last} == {40002}


def test_empty_tables_give_empty_statistics(spark):
    from demandpanel.operators import correlation as co, gram as gm
    none = spark.createDataFrame([], "k string, x double, y double")
    assert od.quantiles(none, "x", {"m": 0.5}, ["k"]).count() == 0 and sm.box_numbers(none, "x", ["k"]).count() == 0
    assert sm.histogram(none, "x", 5, ["k"]).count() == 0 and co.spearman(none, "x", "y", ["k"], panel=False).count() == 0
    assert gm.gram_of_array(none.select("k", F.array("x", "y").alias("v")), "v", 2, ["k"]).count() == 0


def test_histogram_moves_no_raw_row(spark):
    df = spark.createDataFrame([("a", float(i % 10)) for i in range(100)] + [("b", None), (None, 3.0)], "k string, x double")
    h = sm.histogram(df, "x", 5, ["k"])
    assert sorted((r.k, r.bin, r.n) for r in h.collect()) == [("a", i, 20) for i in range(1, 6)]
    text = h._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_hot_value_is_combined_before_the_shuffle(spark):
    df = spark.range(90000).select(F.lit("a").alias("k"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") * 1.0).alias("x"))
    got = od.quantiles(df, "x", {"m": 0.5}, ["k"]).first()
    assert got.n == 90000 and got.m == pytest.approx(df.agg(F.median("x")).first()[0])


def test_gap_days_strict_inequalities(spark):
    df = spark.createDataFrame([("a", day(i), c, v) for i, (c, v) in enumerate([(1.0, 9.0), (5.0, 5.0), (9.0, 1.0), (2.0, 8.0), (8.0, None)])], "node string, date date, count double, intent double")
    out = {r.date: r.opportunity_gap for r in ec.flag_gap_days(df, "intent").collect()}
    assert [out[day(i)] for i in range(5)] == [1, 0, 0, 1, 0]


def test_loss_is_not_clipped(spark):
    pred = spark.createDataFrame([("a", day(0), 10.0, 12.0), ("a", day(1), 10.0, 4.0), ("a", day(2), 1.0, 9.0)], "node string, date date, count double, predicted double")
    flags = spark.createDataFrame([("a", day(0), 1), ("a", day(1), 1), ("a", day(2), 0)], "node string, date date, opportunity_gap int")
    t = ec.loss_totals(ec.lost_visitors(pred, flags)).first()
    assert (t.total_lost, t.mean_lost, t.gap_days) == (-4.0, -2.0, 2)


def test_ranking_rules(spark):
    base = ec.ranking_baseline(spark, ranks=[47] * 12, gap_k=[10] * 11 + [0])
    totals = spark.createDataFrame([("a", 120000.0)], "node string, total_lost double")
    sim = {r.month: r for r in ec.ranking_what_if(base, totals=totals, even=True).collect()}
    assert sim[1].closure_pct == pytest.approx(100.0) and sim[1].ranks_gained == 12 and sim[1].hypo_rank == 35
    assert sim[12].closure_pct == 0 and sim[12].ranks_gained == 0
    t = ec.ranking_totals(ec.ranking_what_if(base, totals=totals, even=True)).first()
    assert t.best_month == 1 and t.best_improvement == 12 and t.min_closure_pct == pytest.approx(100.0)
    monthly = spark.createDataFrame([("a", 3, 5000.0)], "node string, month int, monthly_lost double")
    sim = {r.month: r for r in ec.ranking_what_if(base, monthly=monthly).collect()}
    assert len(sim) == 12 and sim[3].ranks_gained == 6 and sim[4].monthly_lost == 0


def test_scenarios(spark):
    df = spark.createDataFrame([(42, 2036, 13811.0)], "gap_days int, visitors int, spend double")
    row = ec.scenario_losses(df).first()
    assert row.total_lost == 85512 and row.total_yen == 85512 * 13811.0


def test_wind_nudge_needs_enough_days(spark):
    rows = [(n, day(i), 100.0 + i, 12.0 if i % 2 else 3.0) for i in range(40) for n in ("c", "t", "m")]
    df = spark.createDataFrame(rows, "node string, date date, count double, wind double")
    assert nd.wind_nudge(df, "c", "t", "m").count() == 1
    assert nd.wind_nudge(df.where(F.col("date") < day(10)), "c", "t", "m").count() == 0


def test_divergence_uses_days_with_every_station(spark):
    df = spark.createDataFrame([("a", day(0), 1.0), ("b", day(0), 9.0), ("a", day(1), 4.0), ("b", day(2), None)], "station string, date date, temp double")
    out = nd.station_divergence(df).collect()
    assert [(r.date, r.max_diff, r.is_shield_day) for r in out] == [(day(0), 8.0, True)]


def test_histogram_covers_every_row(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(None,)], "x double")
    h = sm.histogram(df, "x", 10).orderBy("bin").collect()
    assert sum(r.n for r in h) == 101 and h[-1].n == 11 and h[0].left == 0.0
    flat = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [(r.bin, r.n) for r in sm.histogram(flat, "x", 10).collect()] == [(1, 2)]


def test_column_choices(spark):
    df = spark.createDataFrame([(f"a long enough text number {i}", "x", "g1" if i % 2 else "g2") for i in range(20)], "t string, c string, g string")
    assert sm.longest_text_column(df) == "t"
    assert sm.grouping_column(df, ["absent", "t", "g"]) == "g"


def test_seeded_sample_repeats(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    a, b = ([r.k for r in sm.seeded_sample(df.repartition(n), "k", 7).collect()] for n in (1, 5))
    assert a == b and len(set(a)) == 7 and a != list(range(7))
