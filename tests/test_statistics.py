from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandpanel.operators import correlation as co, quality as qu, satisfaction as sa


def test_spearman_ties_both_ways(spark):
    r = np.random.default_rng(0)
    pdf = pd.DataFrame({"node": np.where(np.arange(300) % 3 == 0, "a", "b"), "x": r.integers(0, 9, 300).astype(float), "y": r.integers(0, 40, 300).astype(float)})
    df = spark.createDataFrame(pdf)
    panel = {q.node: q for q in co.spearman(df, "x", "y").collect()}
    spread = {q.node: q for q in co.spearman(df, "x", "y", panel=False).collect()}
    for node, part in pdf.groupby("node"):
        want = part.x.rank().corr(part.y.rank())
        assert panel[node].r == pytest.approx(want, abs=1e-12) and spread[node].r == pytest.approx(want, abs=1e-10)
        assert panel[node].n == spread[node].n == len(part)


def test_correlation_p(spark):
    df = spark.createDataFrame([(0.5, 20), (1.0, 10), (0.0, 30)], "r double, n bigint")
    p = [x.p for x in co.with_p(df).collect()]
    assert p[0] == pytest.approx(0.0248, abs=2e-4) and p[1] == 0.0 and p[2] == pytest.approx(1.0)


def test_constant_side_gives_null(spark):
    df = spark.createDataFrame([("a", 1.0, float(i)) for i in range(5)], "node string, x double, y double")
    assert co.pearson_pairs(df, ["x", "y"]).first().r is None


def test_cross_correlation_finds_the_lead(spark):
    r = np.random.default_rng(2)
    lead = r.normal(size=60)
    pdf = pd.DataFrame({"node": "a", "date": [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)], "lead": lead, "count": np.roll(lead, 2)})
    prof = co.cross_correlation(spark.createDataFrame(pdf), "lead", "count")
    best = co.best_lag(prof).first()
    assert best.lag == 2 and best.r > 0.9 and prof.count() == 11
    short = co.cross_correlation(spark.createDataFrame(pdf[:10]), "lead", "count")
    assert sorted((q.lag, q.r, q.n) for q in short.collect()) == [(k, None, 10 - abs(k)) for k in range(-3, 8)]
    assert co.best_lag(short).count() == 0


def test_too_few_rows_give_null_with_their_number(spark):
    df = spark.createDataFrame([("a", float(i), float(i * i)) for i in range(5)] + [("b", 1.0, 2.0), ("b", 2.0, 5.0), ("c", None, 1.0)],
                               "node string, x double, y double")
    for out in (co.pearson_test(df, "x", "y"), co.spearman(df, "x", "y"), co.spearman(df, "x", "y", panel=False)):
        got = {q.node: q for q in out.collect()}
        assert got["a"].r > 0.9 and got["a"].n == 5 and got["b"].r is None and got["b"].n == 2
    assert {q.node: (q.r, q.n, q.p) for q in co.pearson_test(df, "x", "y").collect()}["c"] == (None, 0, None)


def test_best_lag_rules(spark):
    df = spark.createDataFrame([("a", -1, -0.9, 50), ("a", 0, 0.1, 50), ("a", 2, 0.5, 50), ("a", 3, 0.9, 50)], "node string, lag int, r double, n bigint")
    assert co.best_lag(df).first().lag == -1
    assert co.best_lag(df, by="signed").first().lag == 3 and co.best_lag(df).first().lag0_r == 0.1


def brute_ks(a, b):
    xs = np.unique(np.concatenate([a, b]))
    return max(abs((a <= x).mean() - (b <= x).mean()) for x in xs)


def test_two_sample_distance(spark):
    r = np.random.default_rng(5)
    a, b = np.round(r.normal(0, 1, 200), 1), np.round(r.normal(0.5, 2, 130), 1)
    pdf = pd.concat([pd.DataFrame({"k": 1, "x": a, "s": "a"}), pd.DataFrame({"k": 1, "x": b, "s": "b"}), pd.DataFrame({"k": 2, "x": a, "s": "a"}), pd.DataFrame({"k": 2, "x": a, "s": "b"})])
    counted = spark.createDataFrame(pdf).groupBy("k", "x").agg(F.count_if(F.col("s") == "a").alias("n_a"), F.count_if(F.col("s") == "b").alias("n_b"))
    got = {q.k: q for q in co.with_ks_p(co.ks_two_sample(counted, "x", ["k"])).collect()}
    assert got[1].ks_statistic == pytest.approx(brute_ks(a, b)) and got[1].ks_pvalue < 0.05
    assert got[2].ks_statistic == 0 and got[2].ks_pvalue == 1.0


def test_chi_square_with_correction(spark):
    # A published worked example: [[10, 20], [30, 40]] gives 0.4465 with the correction.
    df = spark.createDataFrame([(10, 20, 30, 40), (0, 0, 3, 4), (5, 5, 5, 5)], "a int, b int, c int, d int")
    got = [r[0] for r in df.select(co.chi_square_2x2(*[F.col(c) for c in "abcd"])).collect()]
    assert got[0] == pytest.approx(0.44643, abs=1e-4) and got[1] is None and got[2] == 0.0


def test_column_profile_cases(spark):
    r = np.random.default_rng(42)
    base = list(r.normal(10, 1, 100))
    cases = {"plain": [1.0, 2, 3, 4, 5], "gaps": [1.0, None, 3, None, 5], "empty": [None, None], "far": [*base, 200.0]}
    for name, values in cases.items():
        df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")
        row, s = qu.profile_columns(df, ["x"]).first(), pd.Series(values, dtype=float)
        assert row.n_total == len(values) and row.n_missing == int(s.isna().sum())
        if name == "empty":
            assert row["mean"] is None and row.q25 is None and row.n_outliers_iqr == 0
            continue
        assert row["mean"] == pytest.approx(s.mean()) and row["std"] == pytest.approx(s.std())
        assert row.q25 == pytest.approx(s.quantile(.25)) and row.q75 == pytest.approx(s.quantile(.75))
        iqr = s.quantile(.75) - s.quantile(.25)
        assert row.n_outliers_iqr == int(((s < s.quantile(.25) - 1.5 * iqr) | (s > s.quantile(.75) + 1.5 * iqr)).sum())
        assert row.n_outliers_zscore == int((((s - s.mean()).abs() / s.std()) > 3.5).sum())
    assert row.n_outliers_zscore >= 1


def test_text_numbers_are_profiled_as_numbers(spark):
    df = spark.createDataFrame([("1",), ("x",), ("3",)], "x string")
    row = qu.profile_columns(df, ["x"]).first()
    assert (row.n_missing, row["mean"], row.pct_missing) == (1, 2.0, 33.33)


def drifting(n, shift):
    r = np.random.default_rng(9)
    v = r.normal(50, 5, n)
    v[180:] += shift
    return pd.DataFrame({"d": [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(n)], "v": v})


def test_drift_found_and_not_found(spark):
    moved = qu.drift_report(spark.createDataFrame(drifting(365, 50)), "d", ["v"])
    assert moved.where("drift_detected").count() >= 1 and moved.count() == 3
    calm = qu.drift_report(spark.createDataFrame(drifting(365, 0)), "d", ["v"])
    assert calm.where("drift_detected").count() <= 2
    first = moved.orderBy("pair").first()
    pdf = drifting(365, 50)
    months = pd.to_datetime(pdf.d).dt.month
    a, b = pdf.v[months <= 3].to_numpy(), pdf.v[(months > 3) & (months <= 6)].to_numpy()
    assert first.ks_statistic == pytest.approx(brute_ks(a, b)) and first.period_a == "2024-01–2024-03"
    assert first.mean_a == pytest.approx(a.mean()) and first.std_b == pytest.approx(b.std())
    assert qu.drift(spark.createDataFrame(drifting(20, 0)), "d", ["v"]).count() == 0


def test_schema_difference(spark):
    df = spark.createDataFrame([(1, 2)], "a int, x int")
    assert qu.schema_difference(df, ["a", "b", "c"]) == (["b", "c"], ["x"])
    assert qu.schema_difference(df, ["a", "x"]) == ([], [])


def test_negative_rain_fails_the_audit(spark):
    t = [dt.datetime(2024, 1, 1, h) for h in range(3)]
    df = spark.createDataFrame([(t[0], 1.0, -1.0), (t[1], 60.0, 0.0), (t[2], None, None)], "timestamp timestamp_ntz, temp_c double, precip_1h_mm double")
    out = qu.audit_weather(df, "w", ["timestamp", "temp_c", "precip_1h_mm", "humidity_pct"])
    total = qu.audit_rollup(out).first()
    assert (total.errors, total.warnings, total.passed, total.total_rows) == (1, 2, False, 3)


def test_complaint_shares_keep_labels_without_hits(spark):
    df = spark.createDataFrame([(1, 1, "too cold here", None, ""), (2, 2, "the bus was late", "", None), (3, 5, "great", "", ""), (4, 1, "ok", None, None)],
                               "id int, satisfaction int, reason string, inconvenience string, freetext string")
    def classify(t):
        return F.when(t.contains("cold"), "weather conditions").when(t.contains("bus"), "poor transportation").otherwise("pricing")
    got = {r.label: r.pct for r in sa.complaint_drivers(df, classify, "id", max_samples=2).collect()}
    assert got["weather conditions"] == 50 and got["poor transportation"] == 50 and sum(got.values()) == 100 and len(got) == 5


def test_mining_denominators_differ(spark):
    rows = [(1, "寂しい町でした", "", ""), (2, "", None, ""), (1, "よかったです", "", ""), (5, "活気がある", "", ""), (4, None, None, None)]
    df = spark.createDataFrame(rows, "satisfaction int, reason string, inconvenience string, freetext string")
    r = sa.complaint_mining(df).first()
    assert (r.n_low, r.hits_low, r.n_high, r.hits_high) == (2, 1, 2, 1)
    assert r.pct_low == 50 and r.ratio_vs_high == 1.0 and not math.isnan(r.chi2)


def test_site_study_accepts_labels_and_numbers(spark):
    def rows(high, low):
        return [("永平寺門前", dt.date(2024, 1, 1 + i % 12), high if i % 4 else low, "混雑していた" if i % 8 == 0 else "静か", "", "") for i in range(48)]
    kinds = "location string, date date, satisfaction {}, reason string, inconvenience string, freetext string"
    a = sa.site_resilience(spark.createDataFrame(rows("満足", "不満"), kinds.format("string")), "永平寺").first()
    b = sa.site_resilience(spark.createDataFrame(rows(4.0, 2.0), kinds.format("double")), "永平寺").first()
    assert a == b and a.n_responses == 48 and a.sat_rate_pct == 75.0 and a.n_low_sat == 12 and a.congestion_low_sat_pct == 50.0 and a.n_days == 12
    assert sa.site_resilience(spark.createDataFrame(rows(4.0, 2.0)[:10], kinds.format("double")), "永平寺").count() == 0


def test_comfort_peak_bins(spark):
    r = np.random.default_rng(4)
    pdf = pd.DataFrame({"node": "a", "discomfort_index": r.uniform(40, 80, 100)})
    pdf["mean_satisfaction"] = 5 - (pdf.discomfort_index - 62).abs() / 10
    got = sa.comfort_peak(spark.createDataFrame(pdf)).first()
    bins = pd.qcut(pdf.discomfort_index, 5)
    want = pdf.groupby(bins, observed=True).mean_satisfaction.mean().idxmax()
    assert got.high == pytest.approx(want.right, abs=1e-2) and got.low == pytest.approx(want.left, abs=1e-2)
    assert got.n == int((bins == want).sum())


def test_not_a_number_is_missing_in_order_statistics(spark):
    from demandpanel.operators import ordered as od
    df = spark.createDataFrame([("k", v) for v in (-5.0, -4.0, 10.0, 20.0, float("nan"), None)], "k string, v double")
    r = od.quantiles(df, "v", {"median": 0.5}, ["k"]).first()
    assert (r["n"], r["median"]) == (4, 3.0)


def test_a_source_that_fails_is_a_finding_and_stops_nothing(spark, tmp_path):
    (tmp_path / "t.parquet").write_bytes(b"no parquet at all")
    good = spark.createDataFrame([(dt.date(2024, 1, 1), 3), (dt.date(2024, 1, 2), None), (dt.date(2024, 1, 4), 0)], "date date, count int")
    found = qu.guarded(spark, {
        "torn": lambda: qu.audit_camera(spark.read.schema("date date, count int").parquet(str(tmp_path / "t.parquet")), "torn"),
        "absent": lambda: qu.audit_camera(spark.read.parquet(str(tmp_path / "none")), "absent"),
        "good": lambda: qu.audit_camera(good, "good"),
    })
    lines = {(r.source, r.severity): r.message for r in found.collect()}
    assert lines["absent", "error"].startswith("could not be audited: ") and lines["torn", "error"].startswith("could not be audited: ")
    assert lines["good", "rows"] == "3" and lines["good", "profile"] == "count: 3 rows, 1 missing"
    total = qu.audit_rollup(found).first()
    assert (total.sources, total.total_rows, total.errors, total.passed) == (3, 3, 2, False)
