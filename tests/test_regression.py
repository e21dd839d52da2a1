from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandpanel.operators import features as ft, forest as rf, gram as gm, regression as rg


def t_two_sided(t, dof):
    """Two-sided tail of Student's t as an area under a power of the cosine."""
    low = math.atan(abs(t) / math.sqrt(dof))
    at = np.linspace(low, math.pi / 2, 20_001)
    y = np.cos(at) ** (dof - 1)
    area = (at[1] - at[0]) * (y.sum() - (y[0] + y[-1]) / 2)
    return area / (math.sqrt(math.pi) / 2 * math.exp(math.lgamma(dof / 2) - math.lgamma((dof + 1) / 2)))

X = ["intent", "precip", "temp"]


def frame(n=200, seed=42, noise=10.0):
    r = np.random.default_rng(seed)
    df = pd.DataFrame({"node": "a", "date": [dt.date(2024, 6, 1) + dt.timedelta(days=i) for i in range(n)],
                       "intent": r.uniform(10, 100, n), "precip": r.exponential(5, n), "temp": r.normal(15, 8, n)})
    df["count"] = 100 + 15 * df.intent - 5 * df.precip + 2 * df.temp + r.normal(0, noise, n)
    return df


@pytest.fixture(scope="module")
def linear(spark):
    pdf = pd.concat([frame(), frame(150, 7).assign(node="b")], ignore_index=True)
    return spark.createDataFrame(pdf).persist(), pdf


def design(pdf, cols=X):
    return np.column_stack([np.ones(len(pdf)), pdf[cols].to_numpy()])


def test_coefficients_against_lstsq(linear):
    df, pdf = linear
    got = gm.coefficients(gm.gram(df, "count", X), X).toPandas()
    for node, part in pdf.groupby("node"):
        a, y = design(part), part["count"].to_numpy()
        b, *_ = np.linalg.lstsq(a, y, rcond=None)
        e = y - a @ b
        dof = len(y) - 4
        se = np.sqrt(np.diag(np.linalg.inv(a.T @ a)) * (e @ e) / dof)
        mine = got[got.node == node].set_index("term").loc[["const", *X]]
        assert np.allclose(mine.coef, b, rtol=1e-9) and np.allclose(mine.std_err, se, rtol=1e-9)
        assert mine.p.tolist() == pytest.approx([t_two_sided(t, dof) for t in b / se], abs=1e-12)
        assert mine.coef["intent"] > 0 > mine.coef["precip"]


def test_wide_path_equals_narrow(linear, monkeypatch):
    df, _ = linear
    narrow = gm.gram(df.repartition(5), "count", X).orderBy("node").toPandas()
    monkeypatch.setattr(gm, "WIDE", 0)
    wide = gm.gram(df.repartition(5), "count", X).orderBy("node").toPandas()
    assert wide.n.tolist() == narrow.n.tolist()
    for c in ("mean", "cov"):
        assert np.allclose(np.stack(wide[c].map(np.asarray)), np.stack(narrow[c].map(np.asarray)), rtol=1e-9, atol=1e-9)
    plan = gm.gram(df, "count", X)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "FlatMapGroups" not in plan


def test_wide_moments_of_twenty_columns_and_a_missing_key(spark):
    x = np.random.default_rng(5).normal(50, 3, (300, 20))
    df = spark.createDataFrame([(None if i % 3 == 0 else "a", *map(float, r)) for i, r in enumerate(x)],
                               "node string, " + ", ".join(f"c{i} double" for i in range(20)))
    got = {r.node: r for r in gm.gram(df.repartition(4), "c19", [f"c{i}" for i in range(19)]).collect()}
    for node, part in ((None, x[::3]), ("a", np.delete(x, np.s_[::3], axis=0))):
        mean, cov = gm.unpack(got[node]["mean"], got[node]["cov"])
        assert got[node]["n"] == len(part) and np.allclose(mean, part.mean(axis=0)) and np.allclose(cov, np.cov(part.T, bias=True))


def test_moments_do_not_cancel(spark):
    r = np.random.default_rng(1)
    x = r.normal(0, 1, 400)
    df = spark.createDataFrame(pd.DataFrame({"node": "a", "x": 1e8 + x, "y": 1e8 + 2 * x}))
    c = gm.coefficients(gm.gram(df, "y", ["x"]), ["x"]).where("term = 'x'").first()
    assert c.coef == pytest.approx(2.0, rel=1e-5)


def test_summary_bounds_and_subsets(linear):
    df, pdf = linear
    s = gm.fit_summary(gm.gram(df, "count", X), X, {"full": X, "small": ["intent"]}).toPandas().set_index(["node", "model"])
    assert (s.r2[:, "full"] > 0.9).all() and (s.adj_r2 <= s.r2).all()
    part = pdf[pdf.node == "a"]
    assert s.r2["a", "small"] == pytest.approx(np.corrcoef(part.intent, part["count"])[0, 1] ** 2)


def test_rows_with_missing_values_are_dropped(spark):
    pdf = frame(50, 99)
    pdf.loc[3, "intent"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("intent", F.when(~F.isnan("intent"), F.col("intent")))
    assert gm.gram(df, "count", X).first().n == 49
    assert gm.ols(df, "count", X).count() == 49


def test_constant_target_and_constant_feature(spark):
    pdf = frame(40, 0).assign(count=100.0)
    s = gm.fit_summary(gm.gram(spark.createDataFrame(pdf), "count", X), X).first()
    assert s.r2 is None and s.n == 40
    pdf = frame(60, 5).assign(flat=3.0)
    names = ["intent", "flat"]
    c = gm.coefficients(gm.gram(spark.createDataFrame(pdf), "count", names), names).toPandas().set_index("term")
    assert c.coef["flat"] == 0.0 and c.beta_z.isna().all()
    assert c.coef["intent"] == pytest.approx(np.polyfit(pdf.intent, pdf["count"], 1)[0])


def test_variance_inflation(linear):
    df, pdf = linear
    got = gm.variance_inflation(gm.gram(df, "count", X), X).where("node = 'a'").toPandas().set_index("feature")
    inverse = np.linalg.inv(np.corrcoef(pdf[pdf.node == "a"][X].T))
    assert got.vif[X].tolist() == pytest.approx(np.diag(inverse).tolist()) and not got.is_high.any()


def test_newey_west_against_loops(linear):
    df, pdf = linear
    got = rg.newey_west(df, "count", X).toPandas()
    for node, part in pdf.groupby("node"):
        a, y = design(part), part["count"].to_numpy()
        b = np.linalg.solve(a.T @ a, a.T @ y)
        u = a * (y - a @ b)[:, None]
        lag = max(1, int(0.75 * len(y) ** (1 / 3)))
        s = u.T @ u
        for k in range(1, lag + 1):
            g = u[k:].T @ u[:-k]
            s += (1 - k / (lag + 1)) * (g + g.T)
        bread = np.linalg.inv(a.T @ a)
        se = np.sqrt(np.diag(bread @ s @ bread))
        mine = got[got.node == node].set_index("term").loc[["const", *X]]
        assert np.allclose(mine.std_err, se, rtol=1e-7) and set(mine.bandwidth) == {lag}


def brute_unit_root(y):
    n = len(y)
    dy = np.diff(y)

    def fit(lag, start):
        rows = range(start, len(dy))
        a = np.array([[1.0, y[t], *[dy[t - i] for i in range(1, lag + 1)]] for t in rows])
        z = dy[start:]
        b, *_ = np.linalg.lstsq(a, z, rcond=None)
        e = z - a @ b
        sse = e @ e
        se = math.sqrt(np.linalg.inv(a.T @ a)[1, 1] * sse / (len(z) - a.shape[1]))
        return len(z) * math.log(sse / len(z)) + 2 * a.shape[1], b[1] / se

    limit = min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))
    best = min(range(limit + 1), key=lambda k: fit(k, limit)[0])
    return best, fit(best, best)[1]


def test_unit_root_against_loops(spark):
    r = np.random.default_rng(3)
    walk, noise = np.cumsum(r.normal(size=120)), r.normal(size=90)
    ar = np.zeros(150)
    for t in range(2, 150):
        ar[t] = 0.6 * ar[t - 1] - 0.3 * ar[t - 2] + r.normal()
    parts = {"walk": walk, "noise": noise, "ar": ar, "short": r.normal(size=15)}
    pdf = pd.concat([pd.DataFrame({"node": k, "date": [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(len(v))], "y": v})
                     for k, v in parts.items()])
    got = rg.unit_root(spark.createDataFrame(pdf), "y").toPandas().set_index("node")
    assert set(got.index) == {"walk", "noise", "ar"}
    for k in got.index:
        lag, stat = brute_unit_root(parts[k])
        assert got.lag[k] == lag and got.adf[k] == pytest.approx(stat, rel=1e-7)
    assert bool(got.is_stationary["noise"]) and not bool(got.is_stationary["walk"])


def test_durbin_watson_of_noise_is_clean(linear):
    df, _ = linear
    for row in rg.residual_autocorrelation(df, "count", X).collect():
        assert 0 <= row.dw <= 4 and row.dw_clean


def test_quadratic_peak(spark):
    rows = [("a", float(x), -0.001 * x * x + 0.1 * x + 1.5) for x in (0, 10, 25, 40, 60, 80, 100)]
    out = rg.quadratic_peak(spark.createDataFrame(rows, "node string, x double, y double"), "x", "y").first()
    assert out.peak == pytest.approx(50) and out.a == pytest.approx(-0.001)


def test_accuracy_needs_two_pairs(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", None, 2.0), ("b", 1.0, 1.0), ("b", 3.0, 2.0)], "node string, y double, p double")
    got = {r.node: r for r in gm.accuracy(df, "y", "p").collect()}
    assert got["a"].mae is None and got["b"].mae == 0.5 and got["b"].rmse == pytest.approx(math.sqrt(0.5)) and got["b"].r2 == pytest.approx(0.5)


def test_families_and_removal():
    cols = ["directions", "directions_lag1", "directions_roll7", "precip", "temp", "month", "weekend_x_intent", "dow_mean_count"]
    fam = ft.feature_families(cols, "directions")
    assert fam["intent"] == ["directions", "directions_lag1", "directions_roll7", "weekend_x_intent"]
    assert fam["weather"] == ["precip", "temp"] and fam["calendar"] == ["month", "dow_mean_count"]
    assert ft.without_family(cols, "weather", fam) == [c for c in cols if c not in ("precip", "temp")]


def test_season_ratio_is_infinite_without_summer_lift(spark):
    pdf = frame(400)
    out = rg.seasonal_sensitivity(spark.createDataFrame(pdf[pdf.date.map(lambda d: d.month not in (6, 7, 8))]), "count", X).first()
    assert out.summer_lift == 0 and out.ratio == float("inf") and out.winter_lift > 0


SMALL = {"numTrees": 20, "maxDepth": 5, "minInstancesPerNode": 2}


def test_forest_bounds(linear):
    df, _ = linear
    one = df.where("node = 'a'")
    model = rf.fit_forest(one, "count", X, **SMALL)
    assert gm.accuracy(rf.score_forest(model, one, X), "count", "pred_random_forest").first().r2 > 0.9
    imp = {r.feature: r.importance for r in rf.impurity_importance(model, one, X).collect()}
    assert sum(imp.values()) == pytest.approx(1.0) and max(imp, key=imp.get) == "intent"
    perm = {r.feature: r.importance_mean for r in rf.permutation_importance(model, one, "count", X, repeats=3).collect()}
    assert max(perm, key=perm.get) == "intent" and perm["intent"] > 0.3


def test_folds_are_contiguous(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1) + dt.timedelta(days=i)) for i in range(13)], "node string, date date")
    assert [r.fold for r in rf.assign_folds(df).orderBy("date").collect()] == [1, 1, 1, 2, 2, 2, 3, 3, 3, 4, 4, 5, 5]


def test_removing_the_driver_hurts(linear):
    df, _ = linear
    split = ft.mark_split(df.where("node = 'a'"))
    out = {r.scenario: r for r in rf.family_ablation(split, "count", X, {"intent": ["intent"], "weather": ["precip", "temp"], "none": []}, **SMALL).collect()}
    assert set(out) == {"full", "no_intent", "no_weather"}
    assert out["no_intent"].mae >= out["full"].mae and out["full"].delta_mae_vs_full == 0


@pytest.mark.parametrize("cells", [1, 5, 400])
def test_a_shuffle_permutes_all_rows_of_a_group(spark, cells):
    rows = spark.createDataFrame([(i, "a" if i % 4 else "b", float(i)) for i in range(300)], "i int, g string, x double")
    got = rf.shuffled_values(rows, F.col("x"), F.col("i"), ["g"], cells=cells).collect()
    for g in "ab":
        step = {r.x: r._moved for r in got if r.g == g}
        assert sorted(step) == sorted(step.values()) and len(step) == (225 if g == "a" else 75)
        at, seen = next(iter(step)), set()
        while at not in seen:  # one cycle runs through the whole column
            seen.add(at)
            at = step[at]
        assert len(seen) == len(step)
    near = sum(abs(r.x - r._moved) < 20 for r in got)
    assert near < 90  # values don't stay near where they were
    again = {(r.i, r._moved) for r in rf.shuffled_values(rows.repartition(7), F.col("x"), F.col("i"), ["g"], cells=cells).collect()}
    assert again == {(r.i, r._moved) for r in got}


def test_solutions_hold_all_models_of_a_node_in_one_row(linear):
    df, _ = linear
    moments = gm.gram(df, "count", X)
    models = {"full": X, "small": ["intent"]}
    wide = {r["node"]: r for r in gm.solutions(moments, X, models).collect()}
    assert sorted(wide) == ["a", "b"]
    for r in gm.fit_summary(moments, X, models).collect():
        assert wide[r["node"]]["n"] == r["n"]
        assert wide[r["node"]][f"{r['model']}_r2"] == pytest.approx(r["r2"]) and wide[r["node"]][f"{r['model']}_adj_r2"] == pytest.approx(r["adj_r2"])
    for r in gm.coefficients(moments, X, models).collect():
        row = wide[r["node"]]
        assert row[f"{r['model']}_coefs"][r["position"]] == pytest.approx(r["coef"])
        if r["position"]:
            assert row[f"{r['model']}_beta_z"][r["position"] - 1] == pytest.approx(r["beta_z"])


def test_solutions_of_a_constant_column_have_no_standardised_slope(spark):
    pdf = frame().assign(precip=3.0)
    row = gm.solutions(gm.gram(spark.createDataFrame(pdf), "count", X), X, {"full": X, "one": ["intent"]}).first()
    assert row["full_beta_z"] == [None] * 3 and row["full_coefs"][2] == 0.0 and row["one_beta_z"][0] is not None


def test_comparison_table_ranks_models_and_keeps_those_without_pairs(spark):
    rows = [("a", i < 8, float(i), float(i) + (1 if i < 8 else 2), float(i * i % 7), None) for i in range(12)]
    df = spark.createDataFrame(rows, "node string, is_train boolean, count double, near double, far double, none double")
    out = {r["model"]: r for r in rg.comparison_table(df, "count", {"far": "far", "near": "near", "none": "none"}).collect()}
    assert {m: r["rank"] for m, r in out.items()} == {"near": 1, "far": 2, "none": 3}
    assert (out["near"]["n"], out["near"]["mae"], out["near"]["rmse"]) == (4, 2.0, 2.0)
    y = np.arange(12.0)
    inside, outside = 1 - 1 / y[:8].var(), 1 - 4 / y[8:].var()
    assert out["near"]["insample_r2"] == round(inside, 4) and out["near"]["r2"] == round(outside, 4) and out["near"]["gap"] == round(outside - inside, 4)
    assert out["none"]["n"] == 0 and out["none"]["rmse"] is None and out["none"]["gap"] is None
