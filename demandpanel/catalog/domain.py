"""Lost visitors, rankings, crowding, comfort, complaints and the site network."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import economics as ec, nodes as nd, satisfaction as sa
from ..operators.classify import from_file
from ..plans import studies as pl
from ..session import shared_folder
from ..sources.sinks import metric_rows
from ..sources.tables import normalise_survey
from . import standins as st
from .aggregates import DI, WC
from .panels import GAP, features_sql
from .registry import q6, r6, register, rounded
from .standins import fitted, least_squares, with_
from .statistics import BEST, LAGS, RANKED, ccf_sql

LOSS = list(pl.LOSS_FEATURES)
LOSS_SQL = features_sql("node_panel") + ", " + GAP.format(rel="node_panel") + ", " + least_squares(
    "SELECT * FROM feat", "count", LOSS, ["node"]) + f""", lost AS (SELECT f.node, f.date, f.count, {fitted('fit', LOSS)} AS predicted,
    {fitted('fit', LOSS)} - f.count AS lost_population FROM feat f JOIN fit USING (node) JOIN (SELECT node AS gn, date AS gd, opportunity_gap FROM gap) g ON f.node = gn AND f.date = gd
    WHERE g.opportunity_gap = 1 AND """ + " AND ".join(f"{c} IS NOT NULL" for c in ["f.count", *[f"f.{c}" for c in LOSS]]) + ")"


@register("lost_visitors", with_("node_panel", recursive=True, body=LOSS_SQL + f"""
    SELECT node, date, {q6('count')} AS count, {q6('predicted', 5)} AS predicted, {q6('lost_population', 5)} AS lost_population FROM lost"""))
def lost_visitors(spark, folder):
    lost = pl.demand_loss(st.node_panel(spark, folder))
    return lost.select("node", "date", r6("count").alias("count"), r6("predicted", 5).alias("predicted"),
                       r6("lost_population", 5).alias("lost_population"))


@register("lost_visitors_totals", with_("node_panel", recursive=True, body=LOSS_SQL + f"""
    SELECT node, {q6('sum(lost_population)', 4)} AS total_lost, {q6('avg(lost_population)', 5)} AS mean_lost, count(*) AS gap_days FROM lost GROUP BY 1"""))
def lost_visitors_totals(spark, folder):
    t = ec.loss_totals(pl.demand_loss(st.node_panel(spark, folder)))
    return t.select("node", r6("total_lost", 4).alias("total_lost"), r6("mean_lost", 5).alias("mean_lost"), "gap_days")


@register("lost_visitors_by_month", with_("node_panel", recursive=True, body=LOSS_SQL + f"""
    SELECT node, CAST(month(date) AS BIGINT) AS month, {q6('sum(lost_population)', 4)} AS monthly_lost FROM lost GROUP BY 1, 2"""))
def lost_visitors_by_month(spark, folder):
    return rounded(ec.monthly_loss(pl.demand_loss(st.node_panel(spark, folder))), 4)


def _baseline_sql(weights=fixed.SEASON_WEIGHTS, ranks=fixed.RANK_BY_MONTH) -> str:
    rows = ", ".join(f"({m + 1}, {ranks[m]}, {fixed.GAP_K_BY_MONTH[m]}.0::DOUBLE, {weights[m]}::DOUBLE)" for m in range(12))
    return f"base AS (SELECT month::BIGINT AS month, rank::BIGINT AS rank, gap_k, weight, weight / sum(weight) OVER () AS share FROM (VALUES {rows}) AS t(month, rank, gap_k, weight))"


# Each node's total plays the lost visitors, in persons.
_TOTALS = "totals AS (SELECT node, sum(count) AS total_lost FROM node_counts GROUP BY 1)"


def _sim_sql(lost: str, floor_rank: int) -> str:
    return f"""s AS (SELECT node, month, rank, gap_k, {lost} AS monthly_lost FROM totals, base), sim AS (SELECT *,
    CASE WHEN gap_k > 0 AND monthly_lost > 0 THEN monthly_lost / 1000 / gap_k * 100 ELSE 0 END AS closure_pct,
    CAST(CASE WHEN gap_k > 0 AND monthly_lost > 0 THEN least(floor(monthly_lost / 1000 / gap_k * 12), 12) ELSE 0 END AS BIGINT) AS ranks_gained FROM s),
    done AS (SELECT *, greatest(rank - ranks_gained, {floor_rank}) AS hypo_rank FROM sim)"""


_SIM_OUT = f"SELECT node, month, rank, {q6('monthly_lost', 4)} AS monthly_lost, {q6('closure_pct')} AS closure_pct, ranks_gained, hypo_rank FROM done"


def _totals(spark, folder):
    return st.node_counts(spark, folder).groupBy("node").agg(F.sum("count").alias("total_lost"))


def _sim_out(sim):
    return rounded(sim.select("node", "month", "rank", r6("monthly_lost", 4).alias("monthly_lost"), r6("closure_pct").alias("closure_pct"),
                              "ranks_gained", "hypo_rank"))


@register("ranking_weighted", with_("node_counts", body=f"WITH {_baseline_sql()}, {_TOTALS}, {_sim_sql('total_lost * share', 1)} {_SIM_OUT}"))
def ranking_weighted(spark, folder):
    return _sim_out(ec.ranking_what_if(ec.ranking_baseline(spark), totals=_totals(spark, folder)))


@register("ranking_even_months", with_("node_counts", body=f"WITH {_baseline_sql()}, {_TOTALS}, {_sim_sql('total_lost * (1.0::DOUBLE / 12)', 1)} {_SIM_OUT}"))
def ranking_even_months(spark, folder):
    return _sim_out(ec.ranking_what_if(ec.ranking_baseline(spark), totals=_totals(spark, folder), even=True))


@register("ranking_chart_floor", with_("node_counts", body=f"WITH {_baseline_sql()}, {_TOTALS}, {_sim_sql('total_lost * share', 35)} {_SIM_OUT}"))
def ranking_chart_floor(spark, folder):
    return _sim_out(ec.ranking_what_if(ec.ranking_baseline(spark), totals=_totals(spark, folder), floor_rank=35))


@register("ranking_monthly_losses", with_("node_counts", body=f"""WITH {_baseline_sql()}, m AS (SELECT node, CAST(month(date) AS BIGINT) AS month, sum(count) AS lost FROM node_counts GROUP BY 1, 2), nodes AS (SELECT DISTINCT node FROM m), totals AS (SELECT nodes.node, b.month AS mm, coalesce(m.lost, 0) AS total_lost
    FROM nodes CROSS JOIN base b LEFT JOIN m ON m.node = nodes.node AND m.month = b.month),
    s AS (SELECT node, month, rank, gap_k, total_lost AS monthly_lost FROM totals JOIN base ON month = mm), {_sim_sql('0', 1).split('), sim AS', 1)[1].join(['sim AS', ''])} {_SIM_OUT}"""))
def ranking_monthly_losses(spark, folder):
    c = st.node_counts(spark, folder)
    monthly = c.groupBy("node", F.month("date").alias("month")).agg(F.sum("count").alias("monthly_lost"))
    return _sim_out(ec.ranking_what_if(ec.ranking_baseline(spark), monthly=monthly))


@register("ranking_flat_winter", with_("node_counts", body=f"""WITH {_baseline_sql(fixed.FLAT_WINTER_WEIGHTS, fixed.FLAT_WINTER_RANKS)}, {_TOTALS}, s AS (SELECT node, month, rank,
    round_even(total_lost * share, 0) AS monthly_lost FROM totals, base), g AS (SELECT *, CAST(least(floor(monthly_lost / 1000 * 12.0), 10) AS BIGINT) AS ranks_gained FROM s)
    SELECT node, month, rank, monthly_lost, ranks_gained, greatest(rank - ranks_gained, 1) AS hypo_rank FROM g"""))
def ranking_flat_winter(spark, folder):
    base = ec.ranking_baseline(spark, ranks=fixed.FLAT_WINTER_RANKS, weights=fixed.FLAT_WINTER_WEIGHTS)
    sim = ec.ranking_what_if(base, totals=_totals(spark, folder), cap=10, factor=12.0, whole_visitors=True)
    return rounded(sim.select("node", "month", "rank", "monthly_lost", "ranks_gained", "hypo_rank"))


@register("ranking_totals", with_("node_counts", body=f"""WITH {_baseline_sql()}, {_TOTALS}, {_sim_sql('total_lost * share', 1)}
    SELECT node, {q6('avg(rank) FILTER (month IN (12, 1, 2))')} AS mean_actual_rank, {q6('avg(hypo_rank) FILTER (month IN (12, 1, 2))')} AS mean_hypo_rank,
    max(ranks_gained) AS best_improvement, arg_max(month, ranks_gained * 100 - month) AS best_month,
    {q6('min(closure_pct) FILTER (gap_k > 0)')} AS min_closure_pct, {q6('max(closure_pct) FILTER (gap_k > 0)')} AS max_closure_pct FROM done GROUP BY 1"""))
def ranking_totals(spark, folder):
    return rounded(ec.ranking_totals(ec.ranking_what_if(ec.ranking_baseline(spark), totals=_totals(spark, folder))))


SAT_DAILY = """sat AS (SELECT date, avg(satisfaction) AS mean_satisfaction, count(satisfaction) AS n_responses, avg(nps_raw) AS mean_nps,
    avg(satisfaction_service) AS mean_service FROM survey GROUP BY 1)"""


@register("satisfaction_daily", with_("survey", body=f"""WITH {SAT_DAILY} SELECT date, {q6('mean_satisfaction')} AS mean_satisfaction, n_responses, {q6('mean_nps')} AS mean_nps,
    {q6('mean_service')} AS mean_service FROM sat"""))
def satisfaction_daily(spark, folder):
    return rounded(sa.daily_satisfaction(st.survey(spark, folder)))


@register("satisfaction_monthly", with_("survey", body=f"""WITH {SAT_DAILY} SELECT CAST(date_trunc('month', date) AS DATE) AS date, {q6('avg(mean_satisfaction)')} AS mean_satisfaction,
    CAST(sum(n_responses) AS BIGINT) AS n_responses, {q6('avg(mean_nps)')} AS mean_nps FROM sat GROUP BY 1"""))
def satisfaction_monthly(spark, folder):
    return rounded(sa.monthly_satisfaction(sa.daily_satisfaction(st.survey(spark, folder))))


_CROWD = f"""{SAT_DAILY}, exact AS (SELECT c.date, c.count * 7 AS count, mean_satisfaction, n_responses, mean_nps FROM counts c JOIN sat USING (date)),
    mc AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, avg(count * 7) AS count FROM counts GROUP BY 1),
    ms AS (SELECT CAST(date_trunc('month', date) AS DATE) AS date, avg(mean_satisfaction) AS mean_satisfaction, CAST(sum(n_responses) AS BIGINT) AS n_responses,
        avg(mean_nps) AS mean_nps FROM sat GROUP BY 1),
    crowd AS MATERIALIZED (SELECT *, 'day' AS grain FROM exact WHERE '{{grain}}' = 'day'
        UNION ALL SELECT mc.date, mc.count, mean_satisfaction, n_responses, mean_nps, 'month' FROM mc JOIN ms USING (date) WHERE '{{grain}}' = 'month')"""


def _crowd(spark, folder, grain="day"):
    c = st.counts(spark, folder).withColumn("count", F.col("count") * 7)
    return sa.crowding_join(c, sa.daily_satisfaction(st.survey(spark, folder)), grain)


_CROWD_OUT = f"SELECT date, {q6('count')} AS count, {q6('mean_satisfaction')} AS mean_satisfaction, n_responses, {q6('mean_nps')} AS mean_nps, grain FROM crowd"


@register("crowding_join_by_day", with_("survey", "counts", body=f"WITH {_CROWD.format(grain='day')} {_CROWD_OUT}"))
def crowding_join_by_day(spark, folder):
    return rounded(_crowd(spark, folder))


@register("crowding_join_by_month", with_("survey", "counts", body=f"WITH {_CROWD.format(grain='month')} {_CROWD_OUT}"))
def crowding_join_by_month(spark, folder):
    return rounded(_crowd(spark, folder, "month"))


@register("crowding_bins", with_("survey", "counts", body=f"""WITH {_CROWD.format(grain='day')}, b AS (SELECT *, CASE WHEN count <= 5000 THEN '<5K' WHEN count <= 8000 THEN '5-8K'
    WHEN count <= 12000 THEN '8-12K' WHEN count <= 15000 THEN '12-15K' WHEN count <= 20000 THEN '15-20K' WHEN count <= 50000 THEN '>20K' END AS visitor_bin FROM crowd WHERE count > 0)
    SELECT visitor_bin, {q6('avg(mean_satisfaction)')} AS mean_satisfaction, {q6('avg(mean_nps)')} AS mean_nps, count(*) AS n FROM b WHERE visitor_bin IS NOT NULL GROUP BY 1"""))
def crowding_bins(spark, folder):
    return rounded(sa.visitor_bins(_crowd(spark, folder)))


@register("crowding_correlation", with_("survey", "counts", body=f"""WITH {_CROWD.format(grain='day')}, pairs AS (SELECT 'satisfaction' AS measure, count AS x, mean_satisfaction AS y FROM crowd WHERE mean_satisfaction IS NOT NULL
    UNION ALL SELECT 'nps', count, coalesce(mean_nps, mean_satisfaction) FROM crowd WHERE mean_satisfaction IS NOT NULL), """
          + RANKED.format(keys="measure,", part="PARTITION BY measure", a="x", b="y", rel="SELECT * FROM pairs")
          + f" SELECT measure, CASE WHEN count(*) > 3 THEN {q6('corr(ra, rb)')} END AS r, count(*) AS n FROM ranked GROUP BY 1"))
def crowding_correlation(spark, folder):
    return rounded(sa.crowding_correlation(_crowd(spark, folder)))


_COMFORT = f"""comfort AS (SELECT node, date, {DI.format(t='temp', h='humidity')} AS discomfort_index, {WC.format(t='temp', w='wind')} AS wind_chill FROM weather)"""


@register("comfort_means", with_("weather", body=f"WITH {_COMFORT} SELECT node, {q6('avg(discomfort_index)')} AS di_mean, {q6('avg(wind_chill)')} AS wc_mean FROM comfort GROUP BY 1"))
def comfort_means(spark, folder):
    return rounded(pl.comfort_study(st.weather(spark, folder), st.survey(spark, folder))["means"])


@register("comfort_assumed_humidity", with_("weather", body=f"SELECT date, {q6(DI.format(t='temp', h='60'))} AS discomfort_index FROM weather"))
def comfort_assumed_humidity(spark, folder):
    return rounded(sa.add_comfort(st.weather(spark, folder).drop("humidity")).select("date", "discomfort_index"))


@register("comfort_correlations", with_("weather", "survey", body=f"""WITH {_COMFORT}, {SAT_DAILY}, j AS MATERIALIZED (SELECT * FROM comfort JOIN sat USING (date)),
    pairs AS (SELECT 'di_satisfaction' AS measure, discomfort_index AS x, mean_satisfaction AS y FROM j UNION ALL SELECT 'wc_satisfaction', wind_chill, mean_satisfaction FROM j
    UNION ALL SELECT 'di_nps', discomfort_index, mean_nps FROM j), """ + RANKED.format(keys="measure,", part="PARTITION BY measure", a="x", b="y", rel="SELECT * FROM pairs")
          + f" SELECT measure, CASE WHEN measure = 'di_satisfaction' OR count(*) > 10 THEN {q6('corr(ra, rb)')} END AS r, count(*) AS n FROM ranked GROUP BY 1"))
def comfort_correlations(spark, folder):
    return rounded(pl.comfort_study(st.weather(spark, folder), st.survey(spark, folder))["correlations"])


@register("comfort_peak_bin", with_("weather", "survey", body=f"""WITH {_COMFORT}, {SAT_DAILY}, j AS MATERIALIZED (SELECT * FROM comfort JOIN sat USING (date) WHERE mean_satisfaction IS NOT NULL),
    e AS (SELECT quantile_cont(discomfort_index, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM j), b AS (SELECT j.*, q, 1 + len(list_filter(q[2:5], lambda x: x < discomfort_index)) AS bin FROM j, e),
    g AS (SELECT bin, avg(mean_satisfaction) AS m, count(*) AS n, first(q) AS q FROM b GROUP BY 1)
    SELECT 'all' AS node, CAST(bin AS BIGINT) AS bin, {q6('m')} AS mean_score, n, {q6('q[bin]')} AS low, {q6('q[bin + 1]')} AS high, {q6('(q[bin] + q[bin + 1]) / 2')} AS mid
    FROM g ORDER BY m DESC, bin LIMIT 1"""))
def comfort_peak_bin(spark, folder):
    return rounded(pl.comfort_study(st.weather(spark, folder), st.survey(spark, folder))["peak"])


@register("comfort_panel", with_("hourly", body=f"""WITH d AS (SELECT station, CAST(timestamp AS DATE) AS date, avg(temp_c) AS t, avg(humidity_pct) AS h, avg(wind_speed_ms) AS w,
    max(snow_depth_cm) AS snow_depth_cm FROM hourly GROUP BY 1, 2) SELECT station, date, {q6('t')} AS temperature_c, {q6('snow_depth_cm')} AS snow_depth_cm,
    {q6(DI.format(t='coalesce(t, 20)', h='coalesce(h, 50)'))} AS discomfort_index, {q6(WC.format(t='coalesce(t, 20)', w='coalesce(w, 0)'))} AS wind_chill_c,
    CAST(month(date) AS BIGINT) AS month, CAST(isodow(date) - 1 AS BIGINT) AS day_of_week, CAST(isodow(date) >= 6 AS BIGINT) AS is_weekend, 'Winter' AS season FROM d"""))
def comfort_panel(spark, folder):
    h = st.hourly(spark, folder).drop("event_id").withColumnsRenamed(fixed.WEATHER_DASHBOARD_NAMES)
    out = pl.comfort_panel(h)
    return rounded(out.select("station", "date", "temperature_c", "snow_depth_cm", "discomfort_index", "wind_chill_c",
                              "month", "day_of_week", "is_weekend", "season"))


KEYWORDS = ("ering", "ment", "xqz")
_HIT = " OR ".join(f"contains(t, '{k}')" for k in KEYWORDS)
_TEXT = "coalesce(reason, '') || ' ' || coalesce(inconvenience, '') || ' ' || coalesce(freetext, '')"


@register("complaint_mining", with_("survey", body=f"""WITH x AS (SELECT prefecture, satisfaction, t, length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) AS len, {_HIT} AS hit
    FROM (SELECT *, {_TEXT} AS t FROM survey)), c AS (SELECT prefecture, count(*) FILTER (satisfaction IN (1, 2) AND len > 3) AS n_low, count(*) FILTER (satisfaction IN (1, 2) AND len > 3 AND hit) AS hits_low,
    count(*) FILTER (satisfaction IN (4, 5)) AS n_high, count(*) FILTER (satisfaction IN (4, 5) AND hit AND len >= 3) AS hits_high FROM x WHERE satisfaction IN (1, 2, 4, 5) GROUP BY 1),
    p AS (SELECT *, CASE WHEN n_low > 0 THEN hits_low * 100.0 / n_low ELSE 0 END AS pct_low, CASE WHEN n_high > 0 THEN hits_high * 100.0 / n_high ELSE 0.01 END AS pct_high,
        CAST(hits_low AS DOUBLE) AS a, CAST(n_low - hits_low AS DOUBLE) AS b, CAST(hits_high AS DOUBLE) AS cc, CAST(n_high - hits_high AS DOUBLE) AS d FROM c)
    SELECT prefecture, n_low, hits_low, n_high, hits_high, {q6('pct_low')} AS pct_low, {q6('pct_high')} AS pct_high, {q6('pct_low / greatest(pct_high, 0.1)')} AS ratio_vs_high,
    {q6('(a + b + cc + d) * pow(greatest(abs(a * d - b * cc) - least(abs(a * d - b * cc), (a + b + cc + d) / 2), 0), 2) / nullif((a + b) * (cc + d) * (a + cc) * (b + d), 0)')} AS chi2 FROM p"""))
def complaint_mining(spark, folder):
    return rounded(sa.complaint_mining(st.survey(spark, folder), KEYWORDS, keys=["prefecture"]))


@register("complaint_examples", with_("survey", body=f"""SELECT doc_id, satisfaction, CASE WHEN contains(t, 'ering') THEN 'ering' WHEN contains(t, 'ment') THEN 'ment' ELSE 'xqz' END AS keyword,
    substr(t, 1, 200) AS sample FROM (SELECT *, {_TEXT} AS t FROM survey) WHERE satisfaction IN (1, 2) AND length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) > 3 AND ({_HIT}) ORDER BY doc_id LIMIT 5"""))
def complaint_examples(spark, folder):
    return sa.complaint_examples(st.survey(spark, folder), "doc_id", KEYWORDS)


def _classify(text):
    """A stand-in classifier as a column; a model would be a ``pandas_udf`` here."""
    return (F.when(text.contains("ering"), "weather conditions").when(text.contains("ment"), "poor transportation")
            .when(text.contains("ung"), "language barrier").otherwise("pricing"))


@register("complaint_drivers", with_("survey", body=f"""WITH d AS (SELECT doc_id, concat_ws(' ', CASE WHEN regexp_matches(reason, '\\S') THEN reason END, CASE WHEN regexp_matches(inconvenience, '\\S') THEN inconvenience END) AS t
    FROM survey WHERE satisfaction <= 2), u AS (SELECT t FROM d WHERE length(t) > 3),
    l AS (SELECT CASE WHEN contains(t, 'ering') THEN 'weather conditions' WHEN contains(t, 'ment') THEN 'poor transportation' WHEN contains(t, 'ung') THEN 'language barrier' ELSE 'pricing' END AS label FROM u)
    SELECT v.label, count(l.label) AS n, {q6('count(l.label) * 100.0 / (SELECT count(*) FROM l)')} AS pct
    FROM (VALUES ('weather conditions'), ('poor transportation'), ('language barrier'), ('lack of information'), ('pricing')) AS v(label) LEFT JOIN l ON l.label = v.label GROUP BY 1"""))
def complaint_drivers(spark, folder):
    return rounded(sa.complaint_drivers(st.survey(spark, folder), _classify, "doc_id"))


_MODEL = {"labels": ["weather conditions", "poor transportation", "language barrier", "lack of information", "pricing"], "bias": [0, 1, 0, -1, 2],
          "weights": {"ering": [4, 0, 0, 1, 0], "ment": [0, 3, 1, 0, -1], "ung": [-1, 0, 5, 0, 0], "eaux": [0, 0, 0, 6, 0], "que": [1, 1, 0, 0, 1]}}


def _model_sql() -> str:
    """The label of the largest score, the first of equal ones."""
    scores = ", ".join(f"{_MODEL['bias'][i]}" + "".join(f" + CASE WHEN contains(t, '{p}') THEN {w[i]} ELSE 0 END" for p, w in _MODEL["weights"].items()) for i in range(5))
    names = ", ".join(f"'{x}'" for x in _MODEL["labels"])
    return f"[{names}][list_position([{scores}], list_max([{scores}]))]"


@register("complaint_drivers_model", with_("survey", body=f"""WITH d AS (SELECT doc_id, concat_ws(' ', CASE WHEN regexp_matches(reason, '\\S') THEN reason END, CASE WHEN regexp_matches(inconvenience, '\\S') THEN inconvenience END) AS t
    FROM survey WHERE satisfaction <= 2), l AS (SELECT {_model_sql()} AS label FROM d WHERE length(t) > 3)
    SELECT v.label, count(l.label) AS n, {q6('count(l.label) * 100.0 / (SELECT count(*) FROM l)')} AS pct
    FROM (SELECT unnest([{", ".join(f"'{x}'" for x in _MODEL['labels'])}]) AS label) v LEFT JOIN l ON l.label = v.label GROUP BY 1"""))
def complaint_drivers_model(spark, folder):
    """Shares by a linear model read from a file and opened once a task."""
    place = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/complaint_model"
    spark.createDataFrame([(json.dumps(_MODEL),)], "value string").coalesce(1).write.mode("overwrite").text(place)
    return rounded(sa.complaint_drivers(st.survey(spark, folder), from_file(spark, f"{place}/part-*"), "doc_id"))


@register("site_resilience", with_("survey", body=f"""WITH x AS (SELECT *, {_TEXT} AS t FROM survey WHERE contains(location, 'src1')),
    y AS (SELECT *, contains(t, 'ering') AS busy, contains(t, 'ment') AS quiet, satisfaction IN (4, 5) AS high, satisfaction IN (1, 2) AS low FROM x),
    s AS (SELECT count(*) AS n, count(*) FILTER (high) AS h, count(*) FILTER (low) AS l, count(*) FILTER (busy) AS b, count(*) FILTER (busy AND low) AS bl, count(*) FILTER (quiet AND low) AS ql FROM y),
    d AS (SELECT date, count(*) AS n, avg(satisfaction) AS m FROM y WHERE satisfaction IS NOT NULL GROUP BY 1 HAVING count(*) >= 1), """
          + RANKED.format(keys="k,", part="PARTITION BY k", a="n", b="m", rel="SELECT 1 AS k, n, m FROM d")
          + """, c AS (SELECT corr(ra, rb) AS r, count(*) AS n_days FROM ranked)
    SELECT 'src1' AS site, s.n AS n_responses, round_even(h * 100.0::DOUBLE / n, 1) AS sat_rate_pct, l AS n_low_sat, round_even(b * 100.0::DOUBLE / n, 1) AS congestion_pct,
    round_even(bl * 100.0::DOUBLE / nullif(l, 0), 1) AS congestion_low_sat_pct, ql AS undervibrancy_low_sat, n_days, CASE WHEN n_days >= 10 THEN round_even(r, 3) END AS spearman_r FROM s, c WHERE n >= 20"""))
def site_resilience(spark, folder):
    return sa.site_resilience(st.survey(spark, folder), "src1", min_per_day=1, congestion=("ering",), quiet=("ment",))


def network(spark, folder, *results):
    from ..operators.panel import daily_counts_matching

    li = st.table(spark, folder, "lineitem").withColumn("date", F.col("l_shipdate").cast("date"))
    signal = daily_counts_matching(li, "l_returnflag", {"volume": "A"})
    return pl.site_network(st.node_counts(spark, folder), st.node_weather(spark, folder), st.intent(spark, folder), "directions",
                           signal, "volume", ("1-URGENT", "2-HIGH", "3-MEDIUM"), results=results)


FIVE = ["directions", "temp", "precip", "wind", "snow"]
NODE_SQL = """nf AS MATERIALIZED (SELECT c.node, c.date, c.count, w.temp, w.precip, w.wind, i.directions, coalesce(w.snow_depth, 0.0) AS snow FROM node_counts c
    JOIN node_weather w ON c.node = w.node AND c.date = w.date JOIN intent i ON c.date = i.date), """ + least_squares("SELECT * FROM nf", "count", FIVE, ["node"]) + ", " \
    + least_squares("SELECT * FROM nf", "count", ["directions"], ["node"], "0") + f""", loss AS (SELECT node, sum(greatest({fitted('fit0', ['directions'])} - count, 0)) AS lost FROM nf JOIN fit0 USING (node) GROUP BY 1),
    models AS (SELECT fit.node, fit.n, fit.r2, 1 - (1 - fit.r2) * (fit.n - 1) / (fit.n - 6) AS adj_r2, fit.r2 - fit0.r2 AS weather_lift,
        fit.a[5][6] * sqrt(fit.var[5] / fit.var_y) AS snow_beta_std, fit.a[4][6] AS wind_coef, lost AS lost_visitors FROM fit JOIN fit0 USING (node) JOIN loss USING (node) WHERE fit.n >= 60)"""
_NODE_RELS = ("node_counts", "node_weather", "intent")


@register("node_models", with_(*_NODE_RELS, recursive=True, body=f"""WITH {NODE_SQL} SELECT node, n, {q6('r2')} AS r2, {q6('adj_r2')} AS adj_r2, {q6('weather_lift')} AS weather_lift,
    {q6('snow_beta_std')} AS snow_beta_std, {q6('wind_coef')} AS wind_coef, {q6('lost_visitors', 4)} AS lost_visitors, {q6('lost_visitors * 13811', 0)} AS lost_yen FROM models"""))
def node_models(spark, folder):
    m = network(spark, folder, "models")["models"]
    return m.select("node", "n", *[r6(c).alias(c) for c in ("r2", "adj_r2", "weather_lift", "snow_beta_std", "wind_coef")],
                    r6("lost_visitors", 4).alias("lost_visitors"), r6("lost_yen", 0).alias("lost_yen"))


@register("node_totals_and_snow_rank", with_(*_NODE_RELS, recursive=True, body=f"""WITH {NODE_SQL} SELECT {q6('sum(lost_visitors)', 4)} AS lost_visitors, {q6('sum(lost_visitors) * 13811', 0)} AS lost_yen,
    count(*) AS nodes, arg_max(node, abs(snow_beta_std)) AS most_sensitive, arg_min(node, abs(snow_beta_std)) AS most_resilient FROM models"""))
def node_totals_and_snow_rank(spark, folder):
    n = network(spark, folder, "totals", "snow")
    snow = n["snow"].select(F.struct("most_sensitive", "most_resilient").alias("s")).scalar()
    return n["totals"].withColumn("_s", snow).select(
        r6("lost_visitors", 4).alias("lost_visitors"), r6("lost_yen", 0).alias("lost_yen"), "nodes", "_s.most_sensitive", "_s.most_resilient")


_HEAT = {"snow_sensitivity_abs": "abs(snow_beta_std)", "wind_sensitivity_abs": "abs(wind_coef)", "weather_lift_r2": "weather_lift", "lost_visitors_k": "lost_visitors / 1000"}


@register("node_heat_table", with_(*_NODE_RELS, recursive=True, body=f"WITH {NODE_SQL} SELECT node, " + ", ".join(
    f"{q6(e, 5)} AS {c}, {q6(f'{e} / max({e}) OVER ()', 5)} AS {c}_norm" for c, e in _HEAT.items()) + " FROM models"))
def node_heat_table(spark, folder):
    return rounded(network(spark, folder, "heat")["heat"], 5)


_NUDGE_TERMS = ", ".join(f"{q6(f'(avg({c}) FILTER (hi) / avg({c}) FILTER (NOT hi) - 1) * 100')} AS {c}_delta_pct" for c in ("coast", "city", "mountain"))


@register("wind_nudge", with_("node_panel", body=f"""WITH d AS (SELECT a.date, a.count AS coast, a.wind, b.count AS city, c.count AS mountain FROM node_panel a JOIN node_panel b ON a.date = b.date
    JOIN node_panel c ON a.date = c.date WHERE a.node = '1-URGENT' AND b.node = '2-HIGH' AND c.node = '3-MEDIUM' AND a.wind IS NOT NULL), m AS (SELECT *, wind > 10 AS hi,
    wind > 10 AND coast < (SELECT median(coast) FROM d) AS sh FROM d)
    SELECT CAST(count(*) FILTER (hi) AS BIGINT) AS n_high, CAST(count(*) FILTER (NOT hi) AS BIGINT) AS n_normal, CAST(count(*) FILTER (sh) AS BIGINT) AS n_shield, {_NUDGE_TERMS},
    {q6('(avg(mountain) FILTER (sh) / avg(mountain) FILTER (NOT hi) - 1) * 100')} AS weather_shield_pct FROM m HAVING count(*) FILTER (hi) >= 10"""))
def wind_nudge(spark, folder):
    return rounded(nd.wind_nudge(st.node_panel(spark, folder), "1-URGENT", "2-HIGH", "3-MEDIUM"))


_VALID = """WITH full_rows AS MATERIALIZED (SELECT c.node, c.date, c.count, w.wind FROM node_counts c JOIN node_weather w ON c.node = w.node AND c.date = w.date JOIN intent i ON c.date = i.date
    WHERE w.temp IS NOT NULL AND w.precip IS NOT NULL AND w.wind IS NOT NULL AND i.directions IS NOT NULL),
    valid AS MATERIALIZED (SELECT * FROM full_rows WHERE node IN (SELECT node FROM full_rows GROUP BY 1 HAVING count(*) >= 60))"""


@register("network_nudge", with_(*_NODE_RELS, body=f"""{_VALID}, d AS (SELECT a.date, a.count AS coast, a.wind, b.count AS city, c.count AS mountain FROM valid a JOIN valid b ON a.date = b.date
    JOIN valid c ON a.date = c.date WHERE a.node = '1-URGENT' AND b.node = '2-HIGH' AND c.node = '3-MEDIUM'), m AS (SELECT *, wind > 10 AS hi, wind > 10 AND coast < (SELECT median(coast) FROM d) AS sh FROM d)
    SELECT CAST(count(*) FILTER (hi) AS BIGINT) AS n_high, CAST(count(*) FILTER (NOT hi) AS BIGINT) AS n_normal, CAST(count(*) FILTER (sh) AS BIGINT) AS n_shield, {_NUDGE_TERMS},
    CASE WHEN count(*) FILTER (sh) >= 8 THEN {q6('(avg(mountain) FILTER (sh) / avg(mountain) FILTER (NOT hi) - 1) * 100')} END AS weather_shield_pct FROM m
    HAVING count(*) FILTER (hi) >= 10 AND count(*) FILTER (NOT hi) >= 10"""))
def network_nudge(spark, folder):
    """The wind nudge of a network run: nodes with enough complete days only."""
    return rounded(network(spark, folder, "nudge")["nudge"])


@register("network_signal", with_(*_NODE_RELS, body=f"""{_VALID}, signal AS (SELECT CAST(l_shipdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS volume
    FROM lineitem WHERE l_returnflag LIKE '%A%' GROUP BY 1), joined AS MATERIALIZED (SELECT valid.*, volume FROM valid JOIN signal USING (date)), """
          + ccf_sql("joined", "volume", "count", LAGS, 20) + ", " + BEST.format(size="abs(r)")
          + f" SELECT node, b.lag AS lag, {q6('b.r')} AS r, b.n AS n, {q6('lag0_r')} AS lag0_r FROM best"))
def network_signal(spark, folder):
    """The outside signal's best lag at the nodes of a network run."""
    return rounded(network(spark, folder, "signal")["signal"])


@register("network_nudge_and_signal")
def network_nudge_and_signal(spark, folder):
    """The network run's own nudge and outside-signal results as metric rows."""
    n = network(spark, folder, "nudge", "signal")
    rows = metric_rows(rounded(n["nudge"]), "nudge").unionByName(metric_rows(rounded(n["signal"]), "signal", ["node"]))
    return rows


_DIV = """d AS (SELECT date, max(temp) - min(temp) AS max_diff, count(DISTINCT node) AS k FROM node_weather WHERE temp IS NOT NULL GROUP BY 1),
    e AS (SELECT * FROM d WHERE k = (SELECT count(DISTINCT node) FROM node_weather))"""


@register("station_divergence", with_("node_weather", body=f"WITH {_DIV} SELECT date, {q6('max_diff')} AS max_diff, max_diff > 15 AS is_shield_day FROM e"))
def station_divergence(spark, folder):
    w = st.node_weather(spark, folder).withColumnRenamed("node", "station")
    return rounded(nd.station_divergence(w, threshold=15))


@register("station_divergence_share", with_("node_weather", body=f"""WITH {_DIV} SELECT CAST(count(*) FILTER (max_diff > 15) AS BIGINT) AS shield_days, CAST(count(*) AS BIGINT) AS days,
    {q6('count(*) FILTER (max_diff > 15) * 100.0 / count(*)')} AS shield_pct FROM e"""))
def station_divergence_share(spark, folder):
    w = st.node_weather(spark, folder).withColumnRenamed("node", "station")
    return rounded(nd.divergence_share(nd.station_divergence(w, threshold=15)))


@register("survey_normalised", """SELECT doc_id, lang AS prefecture, CAST(n_chars % 11 AS DOUBLE) AS nps_score, round_even(least(greatest((n_chars % 11) / 2.0::DOUBLE, 1), 5), 1) AS satisfaction,
    CAST('2024-01-02 03:04:05' AS TIMESTAMP) AS date, concat_ws('。', CASE WHEN regexp_matches(text, '\\S') THEN text END, source) AS free_text FROM documents""")
def survey_normalised(spark, folder):
    d = st.table(spark, folder, "documents").select(
        "doc_id", F.col("lang").alias("都道府県"), (F.col("n_chars") % 11).cast("string").alias("NPS"),
        F.lit("2024/01/02 03:04:05").alias("回答日時"), F.col("text").alias("満足度の理由"), F.col("source").alias("不便さの内容"))
    out = normalise_survey(d)
    return out.select("doc_id", "prefecture", "nps_score", "satisfaction", "date", "free_text")


@register("survey_normalised_fallbacks", """SELECT doc_id, CASE n_chars % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE END AS satisfaction, text AS free_text FROM documents""")
def survey_normalised_fallbacks(spark, folder):
    """Labels before scores; without known text columns the longest texts are taken."""
    label = F.when(F.col("n_chars") % 3 == 0, "とても満足").when(F.col("n_chars") % 3 == 1, "不満").otherwise("選択肢なし")
    d = st.table(spark, folder, "documents").select(
        "doc_id", label.alias(fixed.SURVEY_SATISFACTION_HEADINGS[0]), (F.col("n_chars") % 11).cast("string").alias("NPS"), "text", "lang")
    return normalise_survey(d).select("doc_id", "satisfaction", "free_text")


@register("report_tables")
def report_tables(spark, folder):
    t = pl.report_tables(st.node_panel(spark, folder), ["directions", "temp", "precip", "wind"])
    beta = metric_rows(rounded(t["betas"]), "beta", ["node", "term"])
    coef = metric_rows(rounded(t["coefficients"].select("node", "term", "coef", "stars")), "coef", ["node", "term"])
    return beta.unionByName(coef).unionByName(t["metrics"])

