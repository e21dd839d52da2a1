"""Correlations, lag profiles, rank correlation and two-sample tests."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..operators import correlation as co, features as ft, nodes as nd, panel as pn
from . import standins as st
from .panels import features, features_sql
from .registry import ks_tails, normal_tail, q6, r6, register, rounded, t_tail
from .standins import with_

LAGS = list(range(-3, 8))
W = "OVER (PARTITION BY node ORDER BY date)"


def shift_sql(column: str, lag: int) -> str:
    return f"lag({column}, {lag}) {W}" if lag >= 0 else f"lead({column}, {-lag}) {W}"


def safe(r: str) -> str:
    return f"CASE WHEN NOT isnan({r}) THEN {r} END"


def ccf_sql(rel: str, lead: str, target: str, lags: list[int], min_rows: int, keys: str = "node") -> str:
    """CTE ``ccf`` (keys, lag, r, n)."""
    shifted = ", ".join(f"{shift_sql(lead, k)} AS s{i}" for i, k in enumerate(lags))
    rows = " UNION ALL ".join(
        f"SELECT {keys}, CAST({k} AS BIGINT) AS lag, corr(s{i}, {target}) AS r, count(s{i}) FILTER ({target} IS NOT NULL) AS n FROM shifted GROUP BY {keys}"
        for i, k in enumerate(lags))
    return f"shifted AS MATERIALIZED (SELECT *, {shifted} FROM {rel}), ccf AS (SELECT * REPLACE (CASE WHEN n > {min_rows} THEN r END AS r) FROM ({rows}))"


_PAIR_COLS = ("count", "directions", "temp", "precip", "sun", "wind", "snow_depth")


@register("corr_all_pairs", with_("node_panel", body=" UNION ALL ".join(
    f"SELECT node, '{a}' AS a, '{b}' AS b, {q6(f'corr({a}, {b})')} AS r, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM node_panel GROUP BY node"
    for a, b in combinations(_PAIR_COLS, 2))))
def corr_all_pairs(spark, folder):
    return rounded(co.pearson_pairs(st.node_panel(spark, folder), _PAIR_COLS))


_AGAINST = ("directions", "directions_lag2", "directions_roll7", "precip", "temp", "sun", "wind", "is_weekend_or_holiday", "weather_severity", "dow_mean_count")


@register("corr_features_with_count", with_("panel", body=features_sql("panel") + " " + " UNION ALL ".join(
    f"SELECT node, 'count' AS a, '{c}' AS b, {q6(f'corr(count, {c})')} AS r, count({c}) AS n FROM feat GROUP BY node" for c in _AGAINST)))
def corr_features_with_count(spark, folder):
    df, _ = features(spark, folder, by_node=False)
    return rounded(co.pearson_pairs(df, _AGAINST, against="count"))


@register("corr_stations", with_("node_weather", body=f"""SELECT a.node AS a, b.node AS b, {q6('corr(a.temp, b.temp)')} AS r, count(*) AS n
    FROM node_weather a JOIN node_weather b ON a.date = b.date AND a.node < b.node WHERE a.node IN ('1-URGENT', '2-HIGH', '5-LOW')
    AND b.node IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1, 2"""))
def corr_stations(spark, folder):
    names = ["1-URGENT", "2-HIGH", "5-LOW"]
    wide = pn.outer_align(st.node_weather(spark, folder), "node", "temp", names).transform(pn.with_node)
    return rounded(co.pearson_pairs(wide, names).drop("node"))


@register("corr_prefectures_daily", with_("survey", body=f"""WITH d AS (SELECT date, count(*) FILTER (prefecture = 'en') AS en, count(*) FILTER (prefecture = 'fr') AS fr,
    count(*) FILTER (prefecture = 'de') AS de FROM survey WHERE prefecture IN ('de', 'en', 'fr') GROUP BY 1)
    SELECT 'de' AS a, 'en' AS b, {q6('corr(de, en)')} AS r, count(*) AS n FROM d UNION ALL SELECT 'de', 'fr', {q6('corr(de, fr)')}, count(*) FROM d
    UNION ALL SELECT 'en', 'fr', {q6('corr(en, fr)')}, count(*) FROM d"""))
def corr_prefectures_daily(spark, folder):
    names = ("de", "en", "fr")
    s = st.survey(spark, folder)
    wide = pn.pivot_counts(s.where(F.col("prefecture").isin(*names)), "date", "prefecture", names)
    return rounded(co.pearson_pairs(wide.transform(pn.with_node), names).drop("node"))


@register("lag_profile_intent", with_("node_panel", body="WITH " + ccf_sql("node_panel", "directions", "count", list(range(8)), 0)
          + f" SELECT node, lag, {q6('r')} AS r, n FROM ccf"))
def lag_profile_intent(spark, folder):
    return rounded(co.lag_profile(st.node_panel(spark, folder), "count", "directions"))


@register("lag_two_by_weekend", with_("node_panel", body=f"""WITH d AS (SELECT node, count, CAST(isodow(date) >= 6 AS BIGINT) AS is_weekend,
    lag(directions, 2) {W} AS lag2 FROM node_panel) SELECT node, is_weekend, {q6('corr(count, lag2)')} AS r, count(lag2) AS n FROM d GROUP BY 1, 2"""))
def lag_two_by_weekend(spark, folder):
    from ..functions.calendar import is_weekend

    df = ft.add_lags(st.node_panel(spark, folder), "directions", 2).withColumn("is_weekend", is_weekend("date"))
    return rounded(co.lag_by_flag(df, "count", "directions_lag2", "is_weekend"))


_CROSS = """p AS (SELECT date, nullif(count(*) FILTER (prefecture = 'en'), 0) AS en_count, nullif(count(*) FILTER (prefecture = 'fr'), 0) AS fr_count FROM survey
    WHERE prefecture IN ('en', 'fr') GROUP BY 1), cross_panel AS MATERIALIZED (SELECT c.node, c.date, c.count, CAST(p.en_count AS DOUBLE) AS en_count, CAST(p.fr_count AS DOUBLE) AS fr_count
    FROM counts c JOIN p ON c.date = p.date WHERE en_count IS NOT NULL AND fr_count IS NOT NULL)"""


def cross_panel(spark, folder):
    pref = pn.daily_counts_matching(st.survey(spark, folder), "prefecture", {"en_count": "en", "fr_count": "fr"})
    return st.counts(spark, folder).join(pref, "date", "left").dropna()


@register("ccf_prefecture_to_count", with_("survey", "counts", body=f"WITH {_CROSS}, " + ccf_sql("cross_panel", "en_count", "count", LAGS, 10)
          + f" SELECT node, lag, {q6('r')} AS r, n FROM ccf"))
def ccf_prefecture_to_count(spark, folder):
    return rounded(co.cross_correlation(cross_panel(spark, folder), "en_count", "count"))


BEST = """best AS (SELECT node, arg_max({{lag: lag, r: r, n: n}}, {size} * 1e6 - lag / 1e6) AS b, max(r) FILTER (lag = 0) AS lag0_r FROM ccf WHERE r IS NOT NULL GROUP BY 1)"""


@register("ccf_best_lag_absolute", with_("survey", "counts", body=f"WITH {_CROSS}, " + ccf_sql("cross_panel", "en_count", "count", LAGS, 10) + ", "
          + BEST.format(size="abs(r)") + f" SELECT node, b.lag AS lag, {q6('b.r')} AS r, b.n AS n, {q6('lag0_r')} AS lag0_r FROM best"))
def ccf_best_lag_absolute(spark, folder):
    return rounded(co.best_lag(co.cross_correlation(cross_panel(spark, folder), "en_count", "count")))


@register("ccf_best_lag_signed", with_("survey", "counts", body=f"WITH {_CROSS}, " + ccf_sql("cross_panel", "fr_count", "en_count", LAGS, 10) + ", "
          + BEST.format(size="r") + f" SELECT node, b.lag AS lag, {q6('b.r')} AS r, b.n AS n, {q6('lag0_r')} AS lag0_r FROM best"))
def ccf_best_lag_signed(spark, folder):
    return rounded(co.best_lag(co.cross_correlation(cross_panel(spark, folder), "fr_count", "en_count"), by="signed"))


@register("ccf_every_node_best_lag", with_("node_counts", body="""WITH signal AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS volume
    FROM lineitem WHERE l_returnflag LIKE '%A%' GROUP BY 1), joined AS MATERIALIZED (SELECT c.*, volume FROM node_counts c JOIN signal USING (date)), """
          + ccf_sql("joined", "volume", "count", LAGS, 20) + ", " + BEST.format(size="abs(r)")
          + f" SELECT node, b.lag AS lag, {q6('b.r')} AS r, b.n AS n, {q6('lag0_r')} AS lag0_r FROM best"))
def ccf_every_node_best_lag(spark, folder):
    li = st.table(spark, folder, "lineitem").withColumn("date", F.col("l_shipdate").cast("date"))
    signal = pn.daily_counts_matching(li, "l_returnflag", {"volume": "A"})
    return rounded(nd.pipeline_lags(st.node_counts(spark, folder), signal, "volume"))


RANKED = """ranked AS (SELECT {keys} rank() OVER ({part} ORDER BY {a}) + (count(*) OVER (PARTITION BY {keys} {a}) - 1) / 2.0 AS ra,
    rank() OVER ({part} ORDER BY {b}) + (count(*) OVER (PARTITION BY {keys} {b}) - 1) / 2.0 AS rb FROM ({rel}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""


@register("spearman_panel", with_("node_panel", body="WITH " + RANKED.format(keys="node,", part="PARTITION BY node", a="count", b="directions", rel="SELECT * FROM node_panel")
          + f" SELECT node, {q6('corr(ra, rb)')} AS r, count(*) AS n FROM ranked GROUP BY 1"))
def spearman_panel(spark, folder):
    return rounded(co.spearman(st.node_panel(spark, folder), "count", "directions"))


@register("spearman_raw_rows", "WITH " + RANKED.format(keys="l_returnflag,", part="PARTITION BY l_returnflag", a="l_extendedprice", b="l_quantity", rel="SELECT * FROM lineitem")
          + f" SELECT l_returnflag, {q6('corr(ra, rb)')} AS r, count(*) AS n FROM ranked GROUP BY 1")
def spearman_raw_rows(spark, folder):
    li = st.table(spark, folder, "lineitem")
    return rounded(co.spearman(li, "l_extendedprice", "l_quantity", ["l_returnflag"], panel=False))


_PRICES = """v AS (SELECT o_orderpriority AS node, o_totalprice AS x, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b
    FROM orders GROUP BY 1, 2), c AS (SELECT node, sum(a) OVER w / sum(a) OVER (PARTITION BY node) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY node) AS fb,
    sum(a) OVER (PARTITION BY node) AS n_a, sum(b) OVER (PARTITION BY node) AS n_b FROM v WINDOW w AS (PARTITION BY node ORDER BY x))
    SELECT node, max(abs(fa - fb)) AS ks_statistic, CAST(max(n_a) AS BIGINT) AS n_a, CAST(max(n_b) AS BIGINT) AS n_b FROM c GROUP BY 1"""


@register("ks_two_sample_raw", f"SELECT node, {q6('ks_statistic')} AS ks_statistic, n_a, n_b FROM (WITH {_PRICES})")
def ks_two_sample_raw(spark, folder):
    return rounded(_order_prices(spark, folder))


def _order_prices(spark, folder):
    o = st.table(spark, folder, "orders")
    counted = o.groupBy(F.col("o_orderpriority").alias("node"), F.col("o_totalprice").alias("x")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("n_a"), F.count_if(F.col("o_orderstatus") == "O").alias("n_b"))
    return co.ks_two_sample(counted, "x", ["node"])


@register("chi_square_two_by_two", f"""WITH t AS (SELECT c_mktsegment AS segment, count(*) FILTER (c_acctbal > 5000 AND c_nationkey < 10) AS a, count(*) FILTER (c_acctbal <= 5000 AND c_nationkey < 10) AS b,
    count(*) FILTER (c_acctbal > 5000 AND c_nationkey >= 10) AS c, count(*) FILTER (c_acctbal <= 5000 AND c_nationkey >= 10) AS d FROM customer GROUP BY 1)
    SELECT segment, {q6('''(a + b + c + d) * pow(greatest(abs(a * d - b * c) - least(abs(a * d - b * c), (a + b + c + d) / 2.0), 0), 2)
    / nullif(CAST(a + b AS DOUBLE) * (c + d) * (a + c) * (b + d), 0)''')} AS chi2 FROM t""")
def chi_square_two_by_two(spark, folder):
    return rounded(_two_by_two(spark, folder))


def _two_by_two(spark, folder):
    rich, near = F.col("c_acctbal") > 5000, F.col("c_nationkey") < 10
    cells = [F.count_if(c) for c in (rich & near, ~rich & near, rich & ~near, ~rich & ~near)]
    c = st.table(spark, folder, "customer").groupBy(F.col("c_mktsegment").alias("segment"))
    return c.agg(co.chi_square_2x2(*cells).alias("chi2"))


@register("proxy_check", with_("survey", "node_counts", body=f"""WITH v AS (SELECT date, count(*) AS survey_count FROM survey GROUP BY 1)
    SELECT node, CASE WHEN count(*) >= 30 THEN {q6('corr(count, survey_count)')} END AS r, count(*) AS n FROM node_counts JOIN v USING (date) GROUP BY 1"""))
def proxy_check(spark, folder):
    volume = st.survey(spark, folder).groupBy("date").agg(F.count(F.lit(1)).alias("survey_count"))
    return rounded(nd.proxy_check(st.node_counts(spark, folder), volume, "survey_count"))


_CHI = """WITH t AS (SELECT c_mktsegment AS segment, count(*) FILTER (c_acctbal > 5000 AND c_nationkey < 10) AS a, count(*) FILTER (c_acctbal <= 5000 AND c_nationkey < 10) AS b,
    count(*) FILTER (c_acctbal > 5000 AND c_nationkey >= 10) AS c, count(*) FILTER (c_acctbal <= 5000 AND c_nationkey >= 10) AS d FROM customer GROUP BY 1)
    SELECT segment, (a + b + c + d) * pow(greatest(abs(a * d - b * c) - least(abs(a * d - b * c), (a + b + c + d) / 2.0), 0), 2) / nullif(CAST(a + b AS DOUBLE) * (c + d) * (a + c) * (b + d), 0) AS chi2 FROM t"""
_R_P = "CASE WHEN abs(r) >= 1 THEN 0 ELSE " + t_tail("(r * sqrt((n - 2) / (1 - r * r)))", "(n - 2)") + " END"


@register("p_values", with_("node_panel", recursive=True, body="WITH " + RANKED.format(keys="node,", part="PARTITION BY node", a="count", b="directions", rel="SELECT * FROM node_panel")
          + f""", rs AS (SELECT node, 'pearson' AS test, corr(count, directions) AS r, count(*) AS n FROM node_panel WHERE count IS NOT NULL AND directions IS NOT NULL GROUP BY 1
        UNION ALL SELECT node, 'spearman', corr(ra, rb), count(*) FROM ranked GROUP BY 1),
    {ks_tails("WITH " + _PRICES)}, chi AS ({_CHI})
    SELECT node, test, {q6(_R_P)} AS p FROM rs UNION ALL SELECT node, 'ks', {q6('ks_pvalue')} FROM ks_p UNION ALL SELECT segment, 'chi2', {q6(normal_tail('sqrt(chi2)'))} FROM chi"""))
def p_values(spark, folder):
    """Correlation, chi-square and Kolmogorov–Smirnov tails."""
    r = co.pearson_test(st.node_panel(spark, folder), "count", "directions").select("node", F.lit("pearson").alias("test"), "p")
    s = co.with_p(co.spearman(st.node_panel(spark, folder), "count", "directions")).select("node", F.lit("spearman").alias("test"), "p")
    k = co.with_ks_p(_order_prices(spark, folder)).select("node", F.lit("ks").alias("test"), F.col("ks_pvalue").alias("p"))
    c = co.with_chi_p(_two_by_two(spark, folder)).select(F.col("segment").alias("node"), F.lit("chi2").alias("test"), F.col("chi2_p").alias("p"))
    return rounded(r.unionByName(s).unionByName(k).unionByName(c))
