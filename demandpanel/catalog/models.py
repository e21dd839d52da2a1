"""Regression, diagnostics, splits, benchmarks and forests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as ft, forest as rf, gram as gm, regression as rg
from ..plans import studies as pl
from . import standins as st
from .panels import FEATURES, features, features_sql
from .registry import normal_tail, q6, r6, register, rounded, t_tail
from .standins import fitted, least_squares, with_

FOUR = ["directions", "temp", "precip", "wind"]
K4 = len(FOUR) + 1
PANEL = "SELECT * FROM node_panel"
W = "OVER (PARTITION BY node ORDER BY date)"


def _complete(rel: str, columns) -> str:
    return f"SELECT * FROM {rel} WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in columns)


def _terms(fit: str, features_, extra: str = "") -> str:
    """Long coefficient rows of a swept fit: term, coef, std_err, t."""
    k = len(features_) + 1
    sigma2 = f"(sse / (n - {k}))"
    rows = [f"""SELECT node, '{c}' AS term, a[{i}][{k}] AS coef, sqrt({sigma2} * (-a[{i}][{i}]) / n) AS std_err,
        a[{i}][{k}] * sqrt(var[{i}] / var_y) AS beta, r2, n FROM {fit}""" for i, c in enumerate(features_, 1)]
    quad = " + ".join(f"mean[{i}] * mean[{j}] * (-a[{i}][{j}])" for i in range(1, k) for j in range(1, k))
    rows.append(f"SELECT node, 'const', intercept, sqrt({sigma2} * (1 + {quad}) / n), NULL, r2, n FROM {fit}")
    return " UNION ALL ".join(rows)


@register("ols_coefficients", with_("node_panel", recursive=True, body="WITH " + least_squares(PANEL, "count", FOUR, ["node"])
          + f", t AS ({_terms('fit', FOUR)}) SELECT node, term, {q6('coef')} AS coef, {q6('std_err')} AS std_err, {q6('coef / std_err')} AS t FROM t"))
def ols_coefficients(spark, folder):
    out = rg.coefficient_table(st.node_panel(spark, folder), "count", FOUR)
    return rounded(out.select("node", "term", "coef", "std_err", "t"))


_STARS = "CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END"


def _with_p_sql() -> str:
    return ("WITH " + least_squares(PANEL, "count", FOUR, ["node"]) + f", t AS ({_terms('fit', FOUR)}), "
            f"p AS (SELECT node, term, coef, {t_tail('(coef / std_err)', f'(n - {K4})')} AS p FROM t) SELECT node, term, {q6('coef')} AS coef, {q6('p')} AS p, {_STARS} AS stars FROM p")


@register("ols_coefficients_with_p", with_("node_panel", recursive=True, body=_with_p_sql()))
def ols_coefficients_with_p(spark, folder):
    """p-values and stars of the same fit."""
    return rounded(rg.coefficient_table(st.node_panel(spark, folder), "count", FOUR).select("node", "term", "coef", "p", "stars"))


@register("ols_all_features", with_("panel", recursive=True, body=features_sql("panel") + ", " + least_squares("SELECT * FROM feat", "count", FEATURES, ["node"])
          + f", t AS ({_terms('fit', FEATURES)}) SELECT node, term, {q6('coef', 5)} AS coef FROM t"))
def ols_all_features(spark, folder):
    df, names = features(spark, folder, by_node=False)
    out = gm.coefficients(gm.gram(df, "count", names), names)
    return out.select("node", "term", r6("coef", 5).alias("coef"))


@register("ols_fitted_values", with_("node_panel", recursive=True, body="WITH " + least_squares(PANEL, "count", FOUR, ["node"])
          + f" SELECT p.node, p.date, {q6(fitted('fit', FOUR))} AS predicted FROM ({_complete('node_panel', ['count', *FOUR])}) p JOIN fit USING (node)"))
def ols_fitted_values(spark, folder):
    return rounded(gm.ols(st.node_panel(spark, folder), "count", FOUR).select("node", "date", "predicted"))


@register("gram_moments", with_("node_panel", body="SELECT node, count(*) AS n, " + ", ".join(f"{q6(f'avg({c})')} AS mean_{c}" for c in FOUR)
          + f", {q6('covar_pop(temp, wind)')} AS cov_temp_wind, {q6('var_pop(wind)')} AS var_wind, {q6('covar_pop(directions, count)', 4)} AS cov_directions_count FROM node_panel WHERE "
          + " AND ".join(f"{c} IS NOT NULL" for c in [*FOUR, "count"]) + " GROUP BY 1"))
def gram_moments(spark, folder):
    g = gm.gram(st.node_panel(spark, folder), "count", FOUR)
    # Row-wise upper triangle of 5 columns: (1,3) is entry 7, (3,3) entry 12, (0,4) entry 4.
    return g.select("node", "n", *[r6(F.get("mean", F.lit(i))).alias(f"mean_{c}") for i, c in enumerate(FOUR)],
                    r6(F.get("cov", F.lit(7))).alias("cov_temp_wind"), r6(F.get("cov", F.lit(12))).alias("var_wind"),
                    r6(F.get("cov", F.lit(4)), 4).alias("cov_directions_count"))


@register("standardised_betas", with_("node_panel", recursive=True, body="WITH " + least_squares(PANEL, "count", FOUR, ["node"])
          + f""", t AS ({_terms('fit', FOUR)}) SELECT node, term, {q6('beta')} AS beta, row_number() OVER (PARTITION BY node ORDER BY abs(beta) DESC, term) AS rank
    FROM t WHERE term <> 'const'"""))
def standardised_betas(spark, folder):
    return rounded(rg.standardised_betas(st.node_panel(spark, folder), "count", FOUR))


@register("effect_size", with_("node_panel", recursive=True, body="WITH " + least_squares(PANEL, "count", FOUR, ["node"])
          + f""" SELECT node, 'full' AS model, n, CAST(4 AS BIGINT) AS k, {q6('r2')} AS r2, {q6('1 - (1 - r2) * (n - 1) / (n - 5)')} AS adj_r2, {q6('r2 / (1 - r2)')} AS f2,
    CASE WHEN r2 / (1 - r2) >= 0.35 THEN 'large (≥0.35)' WHEN r2 / (1 - r2) >= 0.15 THEN 'medium (≥0.15)' WHEN r2 / (1 - r2) >= 0.02 THEN 'small (≥0.02)'
    ELSE 'negligible (<0.02)' END AS magnitude FROM fit"""))
def effect_size(spark, folder):
    out = rg.effect_size(st.node_panel(spark, folder), "count", FOUR)
    return rounded(out.drop("sse", "sst"))


def _hold_out_sql(share: str) -> str:
    names = ["count", *FOUR]
    return f"""WITH pos AS (SELECT *, row_number() {W} AS p, count(*) OVER (PARTITION BY node) AS all_n FROM ({_complete('node_panel', names)})),
    split AS (SELECT *, p <= {share} AS is_train FROM pos), """ + least_squares("SELECT * FROM split WHERE is_train", "count", FOUR, ["node"]) + \
        f""", scored AS (SELECT split.*, {fitted('fit', FOUR)} AS yhat FROM split JOIN fit USING (node))"""


@register("hold_out_scores", with_("node_panel", recursive=True, body=_hold_out_sql("floor(all_n * 0.8)") + f"""
    SELECT node, CAST(count(*) FILTER (is_train) AS BIGINT) AS train_n, CAST(count(*) FILTER (NOT is_train) AS BIGINT) AS holdout_n,
    {q6('avg(abs(count - yhat)) FILTER (NOT is_train)')} AS mae, {q6('sqrt(avg(pow(count - yhat, 2)) FILTER (NOT is_train))')} AS rmse,
    {q6('1 - avg(pow(count - yhat, 2)) FILTER (NOT is_train) / (var_pop(count) FILTER (NOT is_train))')} AS r2 FROM scored GROUP BY 1"""))
def hold_out_scores(spark, folder):
    return rounded(rg.hold_out(st.node_panel(spark, folder), "count", FOUR))


@register("durbin_watson", with_("node_panel", recursive=True, body="WITH " + least_squares(PANEL, "count", FOUR, ["node"])
          + f""", e AS (SELECT p.node, date, count - ({fitted('fit', FOUR)}) AS e FROM ({_complete('node_panel', ['count', *FOUR])}) p JOIN fit USING (node)),
    d AS (SELECT node, e, e - lag(e, 1) {W} AS step FROM e), s AS (SELECT node, sum(step * step) / sum(e * e) AS dw FROM d GROUP BY 1)
    SELECT node, {q6('dw')} AS dw, dw BETWEEN 1.5 AND 2.5 AS dw_clean FROM s"""))
def durbin_watson(spark, folder):
    return rounded(rg.residual_autocorrelation(st.node_panel(spark, folder), "count", FOUR))


@register("weather_value", with_("node_panel", recursive=True, body="WITH " + least_squares(PANEL, "count", FOUR, ["node"])
          + ", " + least_squares("SELECT * FROM node_panel WHERE temp IS NOT NULL AND precip IS NOT NULL AND wind IS NOT NULL", "count", ["directions"], ["node"], "0")
          + f" SELECT node, {q6('fit.r2')} AS r2_full, {q6('fit0.r2')} AS r2_no_weather, {q6('fit.r2 - fit0.r2')} AS weather_value FROM fit JOIN fit0 USING (node)"))
def weather_value(spark, folder):
    return rounded(rg.weather_value(st.node_panel(spark, folder), "count", FOUR))


def _vif_sql() -> str:
    parts, rows = [], []
    for i, c in enumerate(FOUR):
        others = [f for f in FOUR if f != c]
        parts.append(least_squares("SELECT * FROM node_panel WHERE count IS NOT NULL", c, others, ["node"], str(i)))
        rows.append(f"SELECT node, '{c}' AS feature, {q6('1 / (1 - r2)')} AS vif, 1 / (1 - r2) > 10 AS is_high FROM fit{i}")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(rows)


@register("variance_inflation", with_("node_panel", recursive=True, body=_vif_sql()))
def variance_inflation(spark, folder):
    return rounded(gm.variance_inflation(gm.gram(st.node_panel(spark, folder), "count", FOUR), FOUR))


def _newey_west_sql() -> str:
    two = ["directions", "temp"]
    lags = range(1, 12)
    base = f"""res AS (SELECT p.node, p.date, fit.n, greatest(1, floor(0.75 * pow(fit.n, 1.0 / 3))) AS band, (count - ({fitted('fit', two)})) * (directions - mean[1]) AS u1,
        (count - ({fitted('fit', two)})) * (temp - mean[2]) AS u2, fit.a AS a FROM ({_complete('node_panel', ['count', *two])}) p JOIN fit USING (node))"""
    pieces = []
    for i in (1, 2):
        lagged = " + ".join(f"greatest(0, 1 - {k} / (band + 1)) * coalesce(lag(u{i}, {k}) {W}, 0)" for k in lags)
        pieces.append(f"0.5 * u{i} + {lagged} AS v{i}")
    # Both triangles are needed: half + half' over the 2 x 2 block.
    meat = ", ".join(f"sum(u{i} * v{j}) + sum(u{j} * v{i}) AS m{i}{j}" for i in (1, 2) for j in (1, 2))
    b = {(i, j): f"(-a[{i}][{j}] / n)" for i in (1, 2) for j in (1, 2)}
    rows = []
    for i, c in enumerate(two, 1):
        var = " + ".join(f"{b[i, p]} * m{p}{q} * {b[q, i]}" for p in (1, 2) for q in (1, 2))
        rows.append(f"SELECT node, '{c}' AS term, CAST(band AS BIGINT) AS bandwidth, {q6(f'a[{i}][3]')} AS coef, {q6(f'sqrt({var})')} AS std_err FROM meat")
    return ("WITH " + least_squares(PANEL, "count", two, ["node"]) + f", {base}, vs AS (SELECT *, {', '.join(pieces)} FROM res), "
            f"meat AS (SELECT node, max(n) AS n, max(band) AS band, first(a) AS a, {meat} FROM vs GROUP BY 1) " + " UNION ALL ".join(rows))


@register("newey_west_errors", with_("node_panel", recursive=True, body=_newey_west_sql()))
def newey_west_errors(spark, folder):
    out = rg.newey_west(st.node_panel(spark, folder), "count", ["directions", "temp"])
    return rounded(out.where("term <> 'const'").select("node", "term", "bandwidth", "coef", "std_err"))


def _newey_west_significance_sql() -> str:
    """Each coefficient's weight of every day's residual, and the weighted sum of its lagged products."""
    k, lags = len(FEATURES), range(1, 15)
    inner = f"-list_sum([fit.a[i][j] / fit.n * (x[j] - mean[j]) FOR j IN range(1, {k + 1})])"
    slopes = f"[e * ({inner}) FOR i IN range(1, {k + 1})]"
    rows = _complete("feat", ["count", *FEATURES])
    lagged = " + ".join(f"greatest(0, 1 - {lag} / (band + 1)) * coalesce(lag(s, {lag}) OVER w, 0)" for lag in lags)
    return (features_sql("panel") + ", " + least_squares("SELECT * FROM feat", "count", FEATURES, ["node"]) + f""",
        res AS (SELECT p.node, p.date, count - ({fitted('fit', FEATURES)}) AS e, [{', '.join(FEATURES)}] AS x FROM ({rows}) p JOIN fit USING (node)),
        infl AS (SELECT res.node, date, e / fit.n AS own, {slopes} AS s, mean[1:{k}] AS m, greatest(1, floor(0.75 * pow(fit.n, 1.0 / 3))) AS band FROM res JOIN fit USING (node)),
        terms AS (SELECT node, date, band, unnest([own - list_sum([m[i] * s[i] FOR i IN range(1, {k + 1})])] || s) AS s, unnest(range(0, {k + 1})) AS term FROM infl),
        parts AS (SELECT node, term, band, s, {lagged} AS l FROM terms WINDOW w AS (PARTITION BY node, term ORDER BY date)),
        se AS (SELECT node, term, max(band) AS band, sqrt(sum(s * s + 2 * s * l)) AS std_err FROM parts GROUP BY 1, 2),
        z AS (SELECT node, band, (CASE WHEN term = 0 THEN intercept ELSE a[term][{k + 1}] END) / std_err AS z FROM se JOIN fit USING (node))
        SELECT node, CAST(count(*) FILTER ({normal_tail('z')} < 0.05) AS BIGINT) AS significant, CAST(max(band) AS BIGINT) AS bandwidth FROM z GROUP BY 1""")


@register("newey_west_significance", with_("panel", recursive=True, body=_newey_west_significance_sql()))
def newey_west_significance(spark, folder):
    """Number of significant terms at 5 % with robust errors, full feature set."""
    df, names = features(spark, folder, by_node=False)
    out = rg.newey_west(df, "count", names)
    return rounded(out.groupBy("node").agg(F.count_if("is_significant").alias("significant"), F.max("bandwidth").alias("bandwidth")))


def _r2_dw(rows: str, features_, extra: str = "", tail: str = "") -> str:
    return "WITH " + rows + ", " + least_squares("SELECT * FROM rows_", "count", features_, ["node"]) + f""",
    e AS (SELECT p.node, date, count - ({fitted('fit', features_)}) AS e FROM ({_complete('rows_', ['count', *features_])}) p JOIN fit USING (node)),
    d AS (SELECT node, e, e - lag(e, 1) {W} AS step FROM e), s AS (SELECT node, sum(step * step) / sum(e * e) AS dw FROM d GROUP BY 1)
    SELECT node, n, {q6('r2')} AS r2, {q6('dw')} AS dw, dw BETWEEN 1.5 AND 2.5 AS dw_clean{extra} FROM fit JOIN s USING (node)"""


@register("first_difference_model", with_("node_panel", recursive=True, body=_r2_dw(
    "rows_ AS MATERIALIZED (SELECT node, date, " + ", ".join(f"{c} - lag({c}, 1) {W} AS {c}" for c in ["count", *FOUR]) + " FROM node_panel)", FOUR)))
def first_difference_model(spark, folder):
    return rounded(rg.first_difference(st.node_panel(spark, folder), "count", FOUR))


@register("lagged_target_model", with_("node_panel", recursive=True, body=_r2_dw(
    f"rows_ AS MATERIALIZED (SELECT *, lag(count, 1) {W} AS count_lag1 FROM node_panel)", [*FOUR, "count_lag1"], extra=f", {q6('a[5][6]')} AS lag_coef")))
def lagged_target_model(spark, folder):
    return rounded(rg.lagged_target(st.node_panel(spark, folder), "count", FOUR).drop("lag_p"))


@register("unit_root_no_lags", with_("node_counts", body=f"""WITH d AS (SELECT node, count - lag(count, 1) {W} AS dy, lag(count, 1) {W} AS y1 FROM node_counts),
    m AS (SELECT node, count(*) AS n, regr_slope(dy, y1) AS b, var_pop(dy) AS vy, var_pop(y1) AS vx FROM d WHERE dy IS NOT NULL GROUP BY 1)
    SELECT node, CAST(0 AS BIGINT) AS lag, {q6('b / sqrt((vy - b * b * vx) / (n - 2) / vx)')} AS adf, n + 1 AS n FROM m"""))
def unit_root_no_lags(spark, folder):
    return rounded(rg.unit_root(st.node_counts(spark, folder), "count", max_lag=0).select("node", "lag", "adf", "n"))


@register("unit_root_aic")
def unit_root_aic(spark, folder):
    """Lag chosen by AIC, statistic, p and verdict; the search is checked against brute force in tests."""
    return rounded(rg.unit_root(st.node_counts(spark, folder), "count"))


def _season_sql() -> str:
    rel = """seasonal AS MATERIALIZED (SELECT *, CASE WHEN month(date) IN (6, 7, 8) THEN 'summer' WHEN month(date) IN (12, 1, 2) THEN 'winter' END AS season
        FROM node_panel WHERE temp IS NOT NULL AND precip IS NOT NULL AND wind IS NOT NULL AND directions IS NOT NULL)"""
    rows = "SELECT * FROM seasonal WHERE season IS NOT NULL"
    return ("WITH " + rel + ", " + least_squares(rows, "count", FOUR, ["node", "season"]) + ", " + least_squares(rows, "count", ["directions"], ["node", "season"], "0")
            + f""", lift AS (SELECT node, coalesce(max(fit.r2 - fit0.r2) FILTER (season = 'summer' AND fit.n >= 15), 0) AS s, coalesce(max(fit.r2 - fit0.r2) FILTER (season = 'winter' AND fit.n >= 15), 0) AS w
            FROM fit JOIN fit0 USING (node, season) GROUP BY 1)
            SELECT node, {q6('s')} AS summer_lift, {q6('w')} AS winter_lift, {q6("CASE WHEN s > 0 THEN w / s ELSE 'infinity'::DOUBLE END")} AS ratio FROM lift""")


@register("seasonal_sensitivity", with_("node_panel", recursive=True, body=_season_sql()))
def seasonal_sensitivity(spark, folder):
    return rounded(rg.seasonal_sensitivity(st.node_panel(spark, folder), "count", FOUR))


@register("quadratic_peak", with_("node_panel", recursive=True, body="WITH sq AS (SELECT *, temp * temp AS temp2 FROM node_panel), "
          + least_squares("SELECT * FROM sq", "count", ["temp", "temp2"], ["node"])
          + f" SELECT node, {q6('a[2][3]')} AS a, {q6('a[1][3]')} AS b, {q6('intercept')} AS c, {q6('-a[1][3] / (2 * a[2][3])', 4)} AS peak FROM fit"))
def quadratic_peak(spark, folder):
    out = rg.quadratic_peak(st.node_panel(spark, folder), "temp", "count")
    return out.select("node", r6("a").alias("a"), r6("b").alias("b"), r6("c").alias("c"), r6("peak", 4).alias("peak"))


def _scores_sql(alias: str) -> str:
    return f"""{q6(f'avg(abs(count - {alias}))')} AS mae, {q6(f'sqrt(avg(pow(count - {alias}, 2)))')} AS rmse,
        {q6(f'1 - avg(pow(count - {alias}, 2)) / var_pop(count)')} AS r2"""


_BENCH_SQL = f"""WITH base AS (SELECT *, lag(count, 1) {W} AS naive, avg(count) OVER (PARTITION BY node ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rolling
    FROM ({_complete('node_panel', ['count', *FOUR])})), pos AS (SELECT *, row_number() {W} AS p, count(*) OVER (PARTITION BY node) AS all_n FROM base),
    split AS MATERIALIZED (SELECT *, p <= least(greatest(round_even(all_n * 0.8, 0), 1), all_n - 1) AS is_train FROM pos), """ + least_squares(
    "SELECT * FROM split WHERE is_train", "count", FOUR, ["node"]) + f""", scored AS (SELECT split.*, {fitted('fit', FOUR)} AS yhat FROM split JOIN fit USING (node)),
    long AS (SELECT node, 'naive_lag1' AS model, count, naive AS yhat, is_train FROM scored UNION ALL SELECT node, 'rolling_mean_7', count, rolling, is_train FROM scored
    UNION ALL SELECT node, 'ols', count, yhat, is_train FROM scored)"""


def benchmark_frame(spark, folder, panel=st.node_panel):
    """Rows with the split flag and one prediction column per simple model."""
    rows = gm.complete(panel(spark, folder), ["count", *FOUR])
    rows = ft.mark_split(ft.causal_mean(ft.naive_previous(rows)))
    coefs = gm.wide_coefficients(gm.gram(rows.where("is_train"), "count", FOUR), FOUR)
    return gm.predict(rows, coefs, FOUR, out="pred_ols")


_MODELS = {"naive_lag1": "pred_naive_lag1", "rolling_mean_7": "pred_rolling_mean_7", "ols": "pred_ols"}


@register("benchmark_simple_models", with_("node_panel", recursive=True, body=_BENCH_SQL
          + f" SELECT node, model, count(*) AS n, {_scores_sql('yhat')} FROM long WHERE NOT is_train AND yhat IS NOT NULL GROUP BY 1, 2"))
def benchmark_simple_models(spark, folder):
    return rounded(rg.compare_models(benchmark_frame(spark, folder).where("not is_train"), "count", _MODELS))


@register("generalisation_gap", with_("node_panel", recursive=True, body=_BENCH_SQL + f""",
    a AS (SELECT node, model, 1 - avg(pow(count - yhat, 2)) / var_pop(count) AS r2 FROM long WHERE is_train AND yhat IS NOT NULL GROUP BY 1, 2),
    b AS (SELECT node, model, 1 - avg(pow(count - yhat, 2)) / var_pop(count) AS r2, avg(abs(count - yhat)) AS mae FROM long WHERE NOT is_train AND yhat IS NOT NULL GROUP BY 1, 2)
    SELECT node, model, {q6('a.r2')} AS insample_r2, {q6('b.r2')} AS holdout_r2, {q6('b.mae')} AS holdout_mae, {q6('b.r2 - a.r2')} AS gap FROM a JOIN b USING (node, model)"""))
def generalisation_gap(spark, folder):
    frame = benchmark_frame(spark, folder)
    inside = rg.compare_models(frame.where("is_train"), "count", _MODELS)
    outside = rg.compare_models(frame.where("not is_train"), "count", _MODELS)
    return rounded(rg.generalisation_gap(inside, outside, ["node", "model"]))


@register("report_model_comparison", with_("node_panel", recursive=True, body=_BENCH_SQL + f""",
    s AS (SELECT node, model, is_train, count(*) AS n, avg(abs(count - yhat)) AS mae, sqrt(avg(pow(count - yhat, 2))) AS rmse, 1 - avg(pow(count - yhat, 2)) / var_pop(count) AS r2 FROM long WHERE yhat IS NOT NULL GROUP BY ALL),
    w AS (SELECT o.node, o.model, o.n, o.mae, o.rmse, o.r2, i.r2 AS insample_r2 FROM s o JOIN s i USING (node, model) WHERE NOT o.is_train AND i.is_train)
    SELECT node, model, n, {q6('mae')} AS mae, {q6('rmse')} AS rmse, {q6('r2')} AS r2, {q6('insample_r2')} AS insample_r2,
        {q6('r2 - insample_r2')} AS gap, row_number() OVER (PARTITION BY node ORDER BY rmse, model) AS rank FROM w"""))
def report_model_comparison(spark, folder):
    return rounded(pl.model_comparison(st.node_panel(spark, folder), FOUR, digits=12))


@register("benchmark_four_models")
def benchmark_four_models(spark, folder):
    """The simple models and the forest on one split, inside and outside of the training days."""
    frame = benchmark_frame(spark, folder, st.panel)
    forest = rf.fit_forest(frame.where("is_train"), "count", FOUR)
    scored = rf.score_forest(forest, frame, FOUR)
    models = {**_MODELS, "random_forest": "pred_random_forest"}
    inside, outside = (rg.compare_models(scored.where(f), "count", models) for f in ("is_train", "not is_train"))
    return rounded(rg.generalisation_gap(inside, outside, ["node", "model"]))


def _ablation_sql() -> str:
    keep = {"full": FOUR, "no_weather": ["directions"], "no_intent": ["temp", "precip", "wind"]}
    rows = _complete("node_panel", ["count", *FOUR])
    parts = [least_squares(rows, "count", f, ["node"], f"_{n}") for n, f in keep.items()]
    union = " UNION ALL ".join(
        f"SELECT node, '{n}' AS scenario, {q6(f'fit_{n}.r2')} AS r2, {q6(f'fit_{n}.r2 - f.r2')} AS delta_r2 FROM fit_{n} JOIN fit_full f USING (node)" for n in keep)
    return "WITH " + ", ".join(parts) + " " + union


@register("family_ablation_linear", with_("node_panel", recursive=True, body=_ablation_sql()))
def family_ablation_linear(spark, folder):
    families = ft.feature_families(FOUR, "directions")
    return rounded(rg.subset_ablation(st.node_panel(spark, folder), "count", FOUR, families))


def _forest_rows(spark, folder):
    df, names = features(spark, folder, by_node=False)
    return ft.mark_split(gm.complete(df, ["count", *names])), names


@register("forest_fit_and_importance")
def forest_fit_and_importance(spark, folder):
    rows, names = _forest_rows(spark, folder)
    model = rf.fit_forest(rows, "count", names)
    imp = rf.impurity_importance(model, rows, names)
    acc = gm.accuracy(rf.score_forest(model, rows, names), "count", "pred_random_forest")
    long = acc.select(F.explode(F.array(
        F.struct(F.lit("train_r2").alias("feature"), F.col("r2").alias("importance")),
        F.struct(F.lit("train_mae").alias("feature"), F.col("mae").alias("importance")))).alias("s")).select("s.*")
    return rounded(imp.unionByName(long))


@register("forest_cross_validation")
def forest_cross_validation(spark, folder):
    rows, names = _forest_rows(spark, folder)
    return rounded(rf.cross_validate(rows, "count", names))


@register("forest_folds", with_("counts", body=f"SELECT node, date, CAST(ntile(5) {W} AS BIGINT) AS fold FROM counts"))
def forest_folds(spark, folder):
    return rounded(rf.assign_folds(st.counts(spark, folder)).select("node", "date", "fold"))


@register("shuffled_column", """WITH k AS (SELECT o_orderkey, o_orderpriority, o_totalprice, md5(o_orderkey || ':' || o_orderpriority || ':42') AS key FROM orders)
    SELECT o_orderkey, o_orderpriority, o_totalprice, coalesce(lead(o_totalprice) OVER w, first(o_totalprice) OVER w) AS moved FROM k WINDOW w AS (PARTITION BY o_orderpriority ORDER BY key)""")
def shuffled_column(spark, folder):
    """Prices shuffled within each priority, over all its rows, in seven ranges."""
    o = st.table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rf.shuffled_values(o, F.col("o_totalprice"), F.col("o_orderkey"), ["o_orderpriority"], cells=7).withColumnRenamed("_moved", "moved")


@register("forest_permutation_importance")
def forest_permutation_importance(spark, folder):
    rows, names = _forest_rows(spark, folder)
    model = rf.fit_forest(rows, "count", names)
    return rounded(rf.permutation_importance(model, rows, "count", names, repeats=10))


@register("forest_benchmark_and_ablation")
def forest_benchmark_and_ablation(spark, folder):
    rows, names = _forest_rows(spark, folder)
    families = ft.feature_families(names, "directions")
    return rounded(rf.family_ablation(rows, "count", names, families))
