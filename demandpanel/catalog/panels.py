"""Panels: joins, windows, calendar, splits, gaps, upserts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.values import flag, percent_change, right_closed_bin, to_display_names
from ..operators import economics as ec, features as ft, nodes as nd, panel as pn
from . import standins as st
from .registry import q6, r6, register, rounded
from .standins import with_

DIRECTIONS = "directions"


def _python_holidays(first: int, last: int) -> str:
    """Japanese holidays by plain date arithmetic, as SQL values (independent of the Column rule)."""
    day = dt.date

    def nth_monday(y, m, n):
        d = day(y, m, 1)
        return d + dt.timedelta(days=(7 - d.weekday()) % 7 + 7 * (n - 1))

    named = set()
    for y in range(first, last + 1):
        eq = 0.242194 * (y - 1980) - (y - 1980) // 4
        named |= {day(y, 1, 1), day(y, 2, 11), day(y, 3, int(20.8431 + eq)), day(y, 4, 29), day(y, 5, 3), day(y, 5, 5),
                  day(y, 9, 15), day(y, 9, int(23.2488 + eq)), day(y, 11, 3), day(y, 11, 23), day(y, 12, 23)}
        named |= {day(y, 7, 20)} if y >= 1996 else set()
        named |= {day(y, 1, 15), day(y, 10, 10)} if y < 2000 else {nth_monday(y, 1, 2), nth_monday(y, 10, 2)}
    one = dt.timedelta(days=1)
    extra = {d + one for d in named if d.weekday() == 6 and d + one not in named}
    extra |= {d + one for d in named if d + 2 * one in named and d + one not in named and (d + one).weekday() != 6}
    return ", ".join(f"(DATE '{d}')" for d in sorted(named | extra))


HOLIDAYS = f"holidays AS (SELECT * FROM (VALUES {_python_holidays(1994, 2002)}) AS t(date))"
CALENDAR = f"""WITH {HOLIDAYS}, cal AS (SELECT p.*, CAST(isodow(p.date) - 1 AS BIGINT) AS dow,
    CAST(isodow(p.date) >= 6 AS BIGINT) AS is_weekend, CAST(h.date IS NOT NULL AS BIGINT) AS is_holiday,
    CAST(isodow(p.date) >= 6 OR h.date IS NOT NULL AS BIGINT) AS is_weekend_or_holiday,
    CAST(month(p.date) AS BIGINT) AS month FROM {{rel}} p LEFT JOIN holidays h ON p.date = h.date)"""
SEVERITY = """CAST(coalesce(CAST(precip > 0 AS INT), 0) + coalesce(CAST(precip > 10 AS INT), 0)
    + coalesce(CAST(wind > 8 AS INT), 0) AS BIGINT)"""
W = "(PARTITION BY node ORDER BY date)"
WN = "PARTITION BY node ORDER BY date"
FEATURES = [
    "directions", "directions_lag1", "directions_lag2", "directions_lag3", "directions_roll7",
    "precip", "temp", "sun", "wind", "precip_lag1", "is_weekend_or_holiday", "weather_severity",
    "dow_mean_count", "weekend_x_severity", "weekend_x_intent", "month",
]


def features_sql(rel: str) -> str:
    """CTE ``feat``: the panel with all model features."""
    lags = ", ".join(f"lag(directions, {k}) OVER {W} AS directions_lag{k}" for k in range(8))
    rolls = ", ".join(
        f"avg(directions) OVER ({WN} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS directions_roll{k}" for k in (3, 7, 14))
    return CALENDAR.format(rel=rel) + f""", sev AS (SELECT *, {SEVERITY} AS weather_severity FROM cal),
    feat AS (SELECT *, {lags}, {rolls}, lag(precip, 1) OVER {W} AS precip_lag1, lag(temp, 1) OVER {W} AS temp_lag1,
        is_weekend_or_holiday * weather_severity AS weekend_x_severity,
        is_weekend_or_holiday * coalesce(directions, 0.0) AS weekend_x_intent,
        avg(count) OVER (PARTITION BY node, dow) AS dow_mean_count FROM sev)"""


def features(spark, folder, by_node: bool = True):
    base = st.node_panel(spark, folder) if by_node else st.panel(spark, folder)
    return ft.build_features(base, DIRECTIONS)


_NUM = ("temp", "precip", "sun", "wind", "snow_depth", "humidity", "directions")


@register("panel_master", with_("panel", body=f"SELECT node, date, {q6('count')} AS count, "
          + ", ".join(f"{q6(c)} AS {c}" for c in _NUM) + " FROM panel"))
def panel_master(spark, folder):
    return rounded(st.panel(spark, folder).select("node", "date", "count", *_NUM))


@register("panel_by_node", with_("node_panel", body=f"SELECT node, date, {q6('count')} AS count, "
          + ", ".join(f"{q6(c)} AS {c}" for c in _NUM) + " FROM node_panel"))
def panel_by_node(spark, folder):
    return rounded(st.node_panel(spark, folder).select("node", "date", "count", *_NUM))


@register("panel_outliers", with_("node_counts", body=f"""SELECT node, date, {q6('count')} AS count,
    coalesce(count < q1 - 1.5 * (q3 - q1) OR count > q3 + 1.5 * (q3 - q1), false) AS is_outlier FROM (
    SELECT *, quantile_cont(count, 0.25) OVER (PARTITION BY node) AS q1, quantile_cont(count, 0.75) OVER (PARTITION BY node) AS q3
    FROM node_counts)"""))
def panel_outliers(spark, folder):
    return rounded(pn.flag_outliers(st.node_counts(spark, folder)))


@register("calendar_features", with_("counts", body=CALENDAR.format(rel="counts") + """
    SELECT node, date, dow, is_weekend, is_holiday, is_weekend_or_holiday, month,
    CASE WHEN month IN (12, 1, 2) THEN 'Winter' WHEN month < 6 THEN 'Spring' WHEN month < 9 THEN 'Summer' ELSE 'Autumn' END AS season,
    CAST(date_trunc('month', date) AS DATE) AS month_start FROM cal"""))
def calendar_features(spark, folder):
    df = cal.add_calendar(st.counts(spark, folder))
    return rounded(df.select(
        "node", "date", "dow", "is_weekend", "is_holiday", "is_weekend_or_holiday", "month",
        cal.season("month").alias("season"), cal.month_start("date").alias("month_start")))


@register("holiday_dimension_join", with_("counts", body="""WITH holidays AS (
    SELECT CAST(o_orderdate AS DATE) AS date FROM orders GROUP BY 1 HAVING count(*) >= 8)
    SELECT c.node, c.date, CAST(h.date IS NOT NULL AS BIGINT) AS is_holiday,
    CAST(isodow(c.date) >= 6 OR h.date IS NOT NULL AS BIGINT) AS is_weekend_or_holiday
    FROM counts c LEFT JOIN holidays h ON c.date = h.date"""))
def holiday_dimension_join(spark, folder):
    o = st.table(spark, folder, "orders")
    busy = o.groupBy(F.col("o_orderdate").cast("date").alias("date")).count().where("count >= 8")
    df = cal.add_calendar(st.counts(spark, folder), holidays=busy)
    return rounded(df.select("node", "date", "is_holiday", "is_weekend_or_holiday"))


_ROLLS = [f"directions_roll{k}" for k in (3, 7, 14)]
_LAGS = [f"directions_lag{k}" for k in range(8)] + ["precip_lag1", "temp_lag1"]
_OUT = [*_ROLLS, *_LAGS, "weather_severity", "weekend_x_severity", "weekend_x_intent", "dow_mean_count"]


@register("features_all", with_("node_panel", body=features_sql("node_panel") + " SELECT node, date, "
          + ", ".join(f"{q6(c)} AS {c}" if c not in ("weather_severity", "weekend_x_severity") else c for c in _OUT)
          + " FROM feat"))
def features_all(spark, folder):
    df, _ = features(spark, folder)
    return rounded(df.select("node", "date", *_OUT))


@register("feature_weekday_mean_train_only", with_("counts", body=f"""WITH pos AS (
    SELECT *, CAST(isodow(date) - 1 AS BIGINT) AS dow, row_number() OVER {W} AS p, count(*) OVER (PARTITION BY node) AS n FROM counts),
    means AS (SELECT node, dow, avg(count) AS m FROM pos WHERE p <= round_even(n * 0.8, 0) GROUP BY 1, 2)
    SELECT pos.node, date, {q6('m')} AS dow_mean_count FROM pos LEFT JOIN means USING (node, dow)"""))
def feature_weekday_mean_train_only(spark, folder):
    df = ft.mark_split(st.counts(spark, folder).withColumn("dow", cal.day_of_week("date")))
    out = ft.add_weekday_mean(df, fit_on=df.where("is_train"))
    return rounded(out.select("node", "date", "dow_mean_count"))


_SHIFTS = list(range(-3, 8))


@register("shifts_lead_lag", with_("node_counts", body="SELECT node, date, " + ", ".join(
    f"{q6(f'lag(count, {k}) OVER {W}' if k >= 0 else f'lead(count, {-k}) OVER {W}')} AS \"count_s{k}\"" for k in _SHIFTS) + " FROM node_counts"))
def shifts_lead_lag(spark, folder):
    df = ft.add_shifts(st.node_counts(spark, folder), "count", _SHIFTS)
    return rounded(df.select("node", "date", *[f"count_s{k}" for k in _SHIFTS]))


@register("first_differences", with_("node_panel", body=f"""SELECT node, date, {q6(f'count - lag(count, 1) OVER {W}')} AS count,
    {q6(f'directions - lag(directions, 1) OVER {W}')} AS directions, {q6(f'temp - lag(temp, 1) OVER {W}')} AS temp FROM node_panel"""))
def first_differences(spark, folder):
    df = st.node_panel(spark, folder).select("node", "date", "count", "directions", "temp")
    return rounded(ft.add_differences(df, ["count", "directions", "temp"]))


@register("forecast_baselines", with_("node_counts", body=f"""SELECT node, date, {q6(f'lag(count, 1) OVER {W}')} AS pred_naive_lag1,
    {q6(f'avg(count) OVER ({WN} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)')} AS pred_rolling_mean_7 FROM node_counts"""))
def forecast_baselines(spark, folder):
    df = ft.causal_mean(ft.naive_previous(st.node_counts(spark, folder)))
    return rounded(df.select("node", "date", "pred_naive_lag1", "pred_rolling_mean_7"))


@register("split_chronological", with_("node_counts", body=f"""WITH pos AS (
    SELECT node, date, row_number() OVER {W} AS p, count(*) OVER (PARTITION BY node) AS n FROM node_counts)
    SELECT node, date, p <= least(greatest(round_even(n * 0.8, 0), 1), n - 1) AS is_train,
    p <= floor(n * 0.8) AS is_train_truncated FROM pos"""))
def split_chronological(spark, folder):
    c = st.node_counts(spark, folder).select("node", "date")
    both = ft.mark_split(c).withColumn("_a", F.col("is_train")).drop("is_train")
    both = ft.mark_split(both, rounding="down").withColumnRenamed("is_train", "is_train_truncated")
    return both.select("node", "date", F.col("_a").alias("is_train"), "is_train_truncated")


@register("date_gaps", with_("node_counts", body="""WITH span AS (SELECT node, min(date) AS a, max(date) AS b FROM node_counts GROUP BY 1),
    days AS (SELECT node, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM span)
    SELECT d.node, d.date FROM days d ANTI JOIN node_counts c ON d.node = c.node AND d.date = c.date"""))
def date_gaps(spark, folder):
    return pn.date_gaps(st.node_counts(spark, folder)).select("node", "date")


@register("upsert_latest_wins", """WITH old AS (SELECT CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS price, 'old' AS batch
    FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
    new AS (SELECT CAST(o_orderdate AS DATE) AS day, arg_max(o_totalprice, o_orderkey) AS price, 'new' AS batch
    FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
    SELECT * FROM new UNION ALL SELECT * FROM old WHERE day NOT IN (SELECT day FROM new)""")
def upsert_latest_wins(spark, folder):
    o = st.table(spark, folder, "orders").withColumn("day", F.col("o_orderdate").cast("date"))
    odd = F.col("o_orderkey") % 2 == 1
    old = o.where(~odd).groupBy("day").agg(F.max("o_totalprice").alias("price")).withColumn("batch", F.lit("old"))
    new = o.where(odd).select("day", F.col("o_totalprice").alias("price"), F.lit("new").alias("batch"), "o_orderkey")
    return pn.upsert(old, new, ["day"], ["o_orderkey"])


@register("first_row_per_date", """SELECT CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS directions,
    min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1""")
def first_row_per_date(spark, folder):
    from ..sources.tables import first_intent

    o = st.table(spark, folder, "orders").select(
        F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("directions"), "o_orderkey")
    return first_intent(o, ["directions", "o_orderkey"], ["o_orderkey"])


@register("first_and_last_per_key", """SELECT o_custkey, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key,
    arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY 1""")
def first_and_last_per_key(spark, folder):
    o = st.table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    first = pn.first_per_key(o, ["o_custkey"], ["o_orderkey"]).select(
        "o_custkey", F.col("o_orderkey").alias("first_key"), F.col("o_totalprice").alias("first_price"))
    last = pn.last_per_key(o, ["o_custkey"], ["o_orderkey"]).select(
        "o_custkey", F.col("o_orderkey").alias("last_key"), F.col("o_totalprice").alias("last_price"))
    return first.join(last, "o_custkey")


@register("union_differing_columns", """SELECT c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment, 'customer' AS kind FROM customer
    UNION ALL SELECT s_name, s_acctbal, NULL, 'supplier' FROM supplier""")
def union_differing_columns(spark, folder):
    c = st.table(spark, folder, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.col("c_mktsegment").alias("segment"),
        F.lit("customer").alias("kind"))
    s = st.table(spark, folder, "supplier").select(
        F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("acctbal"), F.col("s_name").alias("name"))
    return pn.union_all([c, s])


@register("prefecture_daily_counts", with_("survey", body="""SELECT date, nullif(count(*) FILTER (prefecture LIKE '%fr%'), 0) AS fr_count,
    nullif(count(*) FILTER (prefecture LIKE '%de%'), 0) AS de_count FROM survey WHERE prefecture LIKE '%fr%' OR prefecture LIKE '%de%' GROUP BY 1"""))
def prefecture_daily_counts(spark, folder):
    return pn.daily_counts_matching(st.survey(spark, folder), "prefecture", {"fr_count": "fr", "de_count": "de"})


@register("align_three_nodes", with_("node_counts", body=f"""SELECT a.date, {q6('a.count')} AS n1, {q6('b.count')} AS n2, {q6('c.count')} AS n3
    FROM node_counts a JOIN node_counts b ON a.date = b.date JOIN node_counts c ON a.date = c.date
    WHERE a.node = '1-URGENT' AND b.node = '2-HIGH' AND c.node = '3-MEDIUM'"""))
def align_three_nodes(spark, folder):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
    wide = nd.align_nodes(st.node_counts(spark, folder), names)
    return rounded(wide.select("date", *[F.col(f"`{n}`").alias(f"n{i}") for i, n in enumerate(names, 1)]))


@register("align_stations_outer", with_("node_weather", body="SELECT date, " + ", ".join(
    f"{q6(f'''max(temp) FILTER (node = '{n}')''')} AS t{i}" for i, n in enumerate(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], 1))
    + " FROM node_weather GROUP BY date"))
def align_stations_outer(spark, folder):
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = pn.outer_align(st.node_weather(spark, folder), "node", "temp", names)
    return rounded(wide.select("date", *[F.col(f"`{n}`").alias(f"t{i}") for i, n in enumerate(names, 1)]))


@register("station_choice", with_("hourly", body="""SELECT 'given' AS wanted, station, CAST(count(*) AS BIGINT) AS rows FROM hourly WHERE station = 'purchase' GROUP BY 2
    UNION ALL SELECT 'fallback', station, count(*) FROM hourly WHERE station = (SELECT min(station) FROM hourly) GROUP BY 2"""))
def station_choice(spark, folder):
    h = st.hourly(spark, folder)
    def rows(wanted, name):
        return pn.one_station(h, name).groupBy("station").agg(F.count(F.lit(1)).alias("rows")).withColumn("wanted", F.lit(wanted))
    return rows("given", "purchase").unionByName(rows("fallback", "no such station"))


@register("proxy_when_camera_empty", with_("survey", "counts", body=f"""SELECT 'used' AS kind, date, {q6('count(*)')} AS count FROM survey
    WHERE regexp_matches(prefecture, 'fr|de') OR regexp_matches(location, 'src1$') GROUP BY 2
    UNION ALL SELECT 'unused', date, {q6('count')} FROM counts"""))
def proxy_when_camera_empty(spark, folder):
    camera = st.counts(spark, folder).select("date", "count")
    proxy = pn.proxy_counts(st.survey(spark, folder), ["prefecture", "location", "absent"], "fr|de|src1$").select(
        "date", F.col("count").cast("double").alias("count"))
    used = pn.choose_proxy(camera.where("count < 0"), proxy).withColumn("kind", F.lit("used"))
    unused = pn.choose_proxy(camera, proxy).withColumn("kind", F.lit("unused"))
    return rounded(used.unionByName(unused))


@register("row_filters", with_("node_panel", body=f"""SELECT node, date, {q6('count')} AS count, {q6('snow_depth')} AS snow_depth FROM node_panel
    WHERE count > 0 AND snow_depth IS NOT NULL AND temp IS NOT NULL AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'
    AND month(date) IN (12, 1, 2)"""))
def row_filters(spark, folder):
    p = pn.drop_zero_days(st.node_panel(spark, folder)).dropna(subset=["snow_depth", "temp"])
    first, last = F.lit("1996-01-01").cast("date"), F.lit("1999-12-31").cast("date")
    p = pn.in_months(pn.in_range(p, first, last), cal.WINTER)
    return rounded(p.select("node", "date", "count", "snow_depth"))


@register("months_semi_join", with_("node_counts", body=f"""WITH busy AS (SELECT CAST(date_trunc('month', date) AS DATE) AS m FROM node_counts GROUP BY 1 HAVING sum(count) > 45000)
    SELECT node, date, {q6('count')} AS count FROM node_counts WHERE CAST(date_trunc('month', date) AS DATE) IN (SELECT m FROM busy)"""))
def months_semi_join(spark, folder):
    c = st.node_counts(spark, folder).withColumn("m", cal.month_start("date"))
    busy = c.groupBy("m").agg(F.sum("count").alias("s")).where("s > 45000").select("m")
    return rounded(c.join(busy, "m", "left_semi").select("node", "date", "count"))


@register("opportunity_gap", with_("node_panel", body=f"""WITH med AS (SELECT node, median(directions) AS im, median(count) AS cm FROM node_panel GROUP BY 1)
    SELECT p.node, date, CAST(coalesce(directions > im, false) AS BIGINT) AS high_intent, CAST(coalesce(count < cm, false) AS BIGINT) AS low_count,
    CAST(coalesce(directions > im AND count < cm, false) AS BIGINT) AS opportunity_gap FROM node_panel p JOIN med USING (node)"""))
def opportunity_gap(spark, folder):
    df = ec.flag_gap_days(st.node_panel(spark, folder), DIRECTIONS)
    return rounded(df.select("node", "date", "high_intent", "low_count", "opportunity_gap"))


GAP = """med AS (SELECT node, median(directions) AS im, median(count) AS cm FROM {rel} GROUP BY 1),
    gap AS (SELECT p.*, CAST(coalesce(directions > im AND count < cm, false) AS BIGINT) AS opportunity_gap FROM {rel} p JOIN med USING (node))"""


@register("opportunity_gap_top_days", with_("node_panel", body=f"""WITH {GAP.format(rel='node_panel')}, ranked AS (
    SELECT node, date, directions, count, row_number() OVER (PARTITION BY node ORDER BY directions DESC, date) AS rank FROM gap WHERE opportunity_gap = 1)
    SELECT node, date, {q6('directions')} AS directions, {q6('count')} AS count, rank FROM ranked WHERE rank <= 10"""))
def opportunity_gap_top_days(spark, folder):
    df = ec.flag_gap_days(st.node_panel(spark, folder), DIRECTIONS)
    return rounded(ec.top_gap_days(df, DIRECTIONS).select("node", "date", "directions", "count", "rank"))


_COMPARED = ("precip", "temp", "wind")


@register("opportunity_gap_comparison", with_("node_panel", body=f"WITH {GAP.format(rel='node_panel')} " + " UNION ALL ".join(
    f"""SELECT node, '{c}' AS metric, {q6(f'avg({c}) FILTER (opportunity_gap = 1)')} AS gap_mean,
    {q6(f'avg({c}) FILTER (opportunity_gap = 0)')} AS other_mean,
    {q6(f'avg({c}) FILTER (opportunity_gap = 1) - avg({c}) FILTER (opportunity_gap = 0)')} AS difference FROM gap GROUP BY 1""" for c in _COMPARED)))
def opportunity_gap_comparison(spark, folder):
    df = ec.flag_gap_days(st.node_panel(spark, folder), DIRECTIONS)
    return rounded(ec.compare_gap_days(df, _COMPARED))


@register("opportunity_gap_distinct_flags", with_("node_panel", body=f"WITH {GAP.format(rel='node_panel')} SELECT DISTINCT date, opportunity_gap FROM gap"))
def opportunity_gap_distinct_flags(spark, folder):
    df = ec.flag_gap_days(st.node_panel(spark, folder), DIRECTIONS)
    return rounded(df.select("date", "opportunity_gap").distinct())


@register("visitor_bins", with_("counts", body="""SELECT CASE WHEN v > 0 AND v <= 5000 THEN '<5K' WHEN v > 5000 AND v <= 8000 THEN '5-8K'
    WHEN v > 8000 AND v <= 12000 THEN '8-12K' WHEN v > 12000 AND v <= 15000 THEN '12-15K' WHEN v > 15000 AND v <= 20000 THEN '15-20K'
    WHEN v > 20000 AND v <= 50000 THEN '>20K' END AS visitor_bin, CAST(count(*) AS BIGINT) AS days FROM (SELECT count * 7 AS v FROM counts) GROUP BY 1"""))
def visitor_bins(spark, folder):
    from ..functions import fixed

    c = st.counts(spark, folder).withColumn("v", F.col("count") * 7)
    return c.groupBy(right_closed_bin("v", fixed.VISITOR_EDGES, fixed.VISITOR_LABELS).alias("visitor_bin")).agg(
        F.count(F.lit(1)).alias("days"))


@register("percent_change_guarded", with_("node_panel", body=f"""SELECT node, date, {q6('(count / nullif(lag(count, 1) OVER (PARTITION BY node ORDER BY date), 0) - 1) * 100', 4)} AS pct,
    CAST(coalesce(snow_depth > 5, false) AS BIGINT) AS deep_snow FROM node_panel"""))
def percent_change_guarded(spark, folder):
    p = ft.add_shifts(st.node_panel(spark, folder), "count", [1])
    return p.select("node", "date", r6(percent_change("count", "count_s1"), 4).alias("pct"),
                    flag(F.col("snow_depth") > 5).cast("bigint").alias("deep_snow"))


@register("display_names", with_("hourly", body=f"""SELECT station AS "Station", {q6('avg(temp_c)')} AS "Temperature (C)" FROM hourly GROUP BY 1"""))
def display_names(spark, folder):
    h = st.hourly(spark, folder).groupBy("station").agg(r6(F.avg("temp_c")).alias("temp_c"))
    return to_display_names(h, {"station": "Station", "temp_c": "Temperature (C)", "absent": "Nothing"})
