"""Aggregates, pivots, histograms, top-k and scalar columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal, comfort as cf, survey as sv, text as tx, values as vl
from ..operators import economics as ec, nodes as nd, panel as pn, summaries as sm
from ..operators.ordered import quantiles
from ..sources.weather import panel_names
from . import standins as st
from .panels import features, features_sql
from .registry import q6, r6, register, rounded
from .standins import with_

_HOURLY_MEANS = {"temp": "temp_c", "sun": "sun_1h_h", "wind": "wind_speed_ms", "snow_depth": "snow_depth_cm", "humidity": "humidity_pct"}


@register("weather_daily_mean_depth", with_("hourly", body="SELECT station, CAST(timestamp AS DATE) AS date, "
          + f"{q6('coalesce(sum(precip_1h_mm), 0.0)')} AS precip, "
          + ", ".join(f"{q6(f'avg({old})')} AS {new}" for new, old in _HOURLY_MEANS.items()) + " FROM hourly GROUP BY 1, 2"))
def weather_daily_mean_depth(spark, folder):
    return rounded(pn.daily_weather(panel_names(st.hourly(spark, folder))))


DASHBOARD_DAILY = """SELECT station, CAST(timestamp AS DATE) AS date, coalesce(sum(precip_1h_mm), 0.0) AS precip_1h_mm,
    coalesce(sum(snowfall_1h_cm), 0.0) AS snowfall_1h_cm, max(snow_depth_cm) AS snow_depth_cm, avg(temp_c) AS temp_c,
    avg(sun_1h_h) AS sun_1h_h, avg(wind_speed_ms) AS wind_speed_ms, avg(humidity_pct) AS humidity_pct FROM hourly GROUP BY 1, 2"""
_DAILY_COLS = ("precip_1h_mm", "snowfall_1h_cm", "snow_depth_cm", "temp_c", "sun_1h_h", "wind_speed_ms", "humidity_pct")


def dashboard_daily(spark, folder):
    return pn.daily_weather_by_name(st.hourly(spark, folder).drop("event_id"), time="timestamp")


@register("weather_daily_by_name", with_("hourly", body=f"WITH d AS ({DASHBOARD_DAILY}) SELECT station, date, "
          + ", ".join(f"{q6(c)} AS {c}" for c in _DAILY_COLS) + " FROM d"))
def weather_daily_by_name(spark, folder):
    return rounded(dashboard_daily(spark, folder))


DI = "0.81 * {t} + 0.01 * {h} * (0.99 * {t} - 14.3) + 46.3"
WC = """CASE WHEN {t} <= 10 AND {w} * 3.6 > 4.8 THEN 13.12 + 0.6215 * {t} - 11.37 * pow(greatest({w} * 3.6, 0.1), 0.16)
    + 0.3965 * {t} * pow(greatest({w} * 3.6, 0.1), 0.16) ELSE {t} END"""


@register("comfort_indices", with_("panel", body=f"""SELECT node, date, {q6(DI.format(t='temp', h='humidity'))} AS di, {q6(WC.format(t='temp', w='wind'))} AS wc,
    CASE WHEN {DI.format(t='temp', h='humidity')} < 55 THEN 'Cold' WHEN {DI.format(t='temp', h='humidity')} < 70 THEN 'Comfortable'
    WHEN {DI.format(t='temp', h='humidity')} < 80 THEN 'Uncomfortable' WHEN temp IS NOT NULL THEN 'Dangerous' END AS comfort FROM panel"""))
def comfort_indices(spark, folder):
    p = st.panel(spark, folder)
    di = cf.discomfort_index("temp", "humidity")
    return p.select("node", "date", r6(di).alias("di"), r6(cf.wind_chill("temp", "wind")).alias("wc"), cf.comfort_label(di).alias("comfort"))


SCORE = """least(greatest(CASE WHEN least(greatest(temp, -10), 35) < 5 THEN (5 - least(greatest(temp, -10), 35)) / 15 ELSE 0 END * 0.4
    + CASE WHEN precip IS NOT NULL THEN least(greatest(precip / 50, 0), 1) END * 0.35 + CASE WHEN snow IS NOT NULL THEN least(greatest(snow / 50, 0), 1) END * 0.25, 0), 1)"""
_SEVERITY = f"""sev AS (SELECT station, date, CASE WHEN precip IS NULL OR snow IS NULL THEN NULL ELSE {SCORE} END AS severity_score
    FROM (SELECT station, date, temp_c AS temp, precip_1h_mm AS precip, snow_depth_cm AS snow FROM ({DASHBOARD_DAILY})))"""


def _severity(spark, folder):
    return dashboard_daily(spark, folder).withColumn(
        "severity_score", cf.severity_score("temp_c", "precip_1h_mm", "snow_depth_cm"))


@register("severity_scores", with_("hourly", body=f"""WITH {_SEVERITY} SELECT station, date, {q6('severity_score')} AS severity_score,
    CASE WHEN severity_score > -0.01 AND severity_score <= 0.2 THEN 'Good' WHEN severity_score <= 0.5 THEN 'Moderate'
    WHEN severity_score <= 1 THEN 'Severe' END AS day_type FROM sev"""))
def severity_scores(spark, folder):
    df = _severity(spark, folder)
    return df.select("station", "date", r6("severity_score").alias("severity_score"), cf.severity_class("severity_score").alias("day_type"))


_MONTHLY = f"""WITH {_SEVERITY}, monthly AS (SELECT station, CAST(month(date) AS BIGINT) AS month, avg(severity_score) AS mean_sev,
    CAST(count(*) FILTER (severity_score > 0.5) AS BIGINT) AS severe_days, count(severity_score) AS total FROM sev GROUP BY 1, 2)"""


@register("severity_by_month", with_("hourly", body=f"""{_MONTHLY} SELECT station, month, {q6('mean_sev')} AS mean_sev, severe_days, total,
    {q6('severe_days * 100.0 / nullif(total, 0)')} AS severe_pct FROM monthly"""))
def severity_by_month(spark, folder):
    return rounded(ec.monthly_severity(_severity(spark, folder)))


@register("severity_season_ratio", with_("node_weather", body=f"""WITH sev AS (SELECT node AS station, date, CASE WHEN precip IS NULL OR snow IS NULL THEN NULL ELSE {SCORE} END AS severity_score
    FROM (SELECT *, coalesce(snow_depth, 0.0) AS snow FROM node_weather)),
    monthly AS (SELECT station, month(date) AS month, avg(severity_score) AS mean_sev FROM sev GROUP BY 1, 2),
    r AS (SELECT station, avg(mean_sev) FILTER (month IN (12, 1, 2)) AS winter, avg(mean_sev) FILTER (month IN (6, 7, 8)) AS summer FROM monthly GROUP BY 1)
    SELECT station, {q6('winter')} AS winter, {q6('summer')} AS summer, {q6('CASE WHEN summer > 0.001 THEN winter / summer END')} AS ratio FROM r"""))
def severity_season_ratio(spark, folder):
    w = st.node_weather(spark, folder).withColumnRenamed("node", "station")
    w = w.withColumn("severity_score", cf.severity_score("temp", "precip", F.coalesce("snow_depth", F.lit(0.0))))
    return rounded(ec.season_ratio(ec.monthly_severity(w)))


@register("severity_value_counts", with_("node_panel", body=features_sql("node_panel")
          + " SELECT node, weather_severity, CAST(count(*) AS BIGINT) AS n FROM feat GROUP BY 1, 2"))
def severity_value_counts(spark, folder):
    df, _ = features(spark, folder)
    return rounded(sm.counts_by(df, ["node", "weather_severity"]))


@register("weekday_means", with_("panel", body=f"""SELECT node, CAST(isodow(date) - 1 AS BIGINT) AS dow, {q6('avg(count)')} AS count,
    {q6('avg(directions)')} AS directions FROM panel GROUP BY 1, 2"""))
def weekday_means(spark, folder):
    p = st.panel(spark, folder).withColumn("dow", cal.day_of_week("date"))
    return rounded(sm.group_means(p, ["node", "dow"], ["count", "directions"]))


@register("season_means_one_decimal", with_("node_weather", body="""SELECT node AS station,
    CASE WHEN month(date) IN (12, 1, 2) THEN 'Winter' WHEN month(date) < 6 THEN 'Spring' WHEN month(date) < 9 THEN 'Summer' ELSE 'Autumn' END AS season,
    round_even(avg(temp), 1) AS temp, round_even(avg(wind), 1) AS wind FROM node_weather GROUP BY 1, 2"""))
def season_means_one_decimal(spark, folder):
    w = st.node_weather(spark, folder).select(F.col("node").alias("station"), cal.season(F.month("date")).alias("season"), "temp", "wind")
    return sm.group_means(w, ["station", "season"], ["temp", "wind"], digits=1)


@register("month_station_means", with_("node_weather", body=f"""SELECT node AS station, CAST(month(date) AS BIGINT) AS month,
    {q6('avg(temp)')} AS temp FROM node_weather GROUP BY 1, 2"""))
def month_station_means(spark, folder):
    w = st.node_weather(spark, folder).select(F.col("node").alias("station"), F.month("date").alias("month"), "temp")
    return rounded(sm.group_means(w, ["station", "month"], ["temp"]))


@register("score_group_ranking", with_("survey", body=f"""SELECT location, {q6('avg(nps_raw)')} AS mean, CAST(count(nps_raw) AS BIGINT) AS n FROM survey
    GROUP BY 1 HAVING count(nps_raw) >= 5 ORDER BY avg(nps_raw) DESC, location LIMIT 15"""))
def score_group_ranking(spark, folder):
    return rounded(sm.top_groups(st.survey(spark, folder), "location", "nps_raw"))


@register("score_brackets", with_("survey", body="""SELECT CAST(round_even(nps_raw / 2, 0) AS BIGINT) AS bracket, CAST(count(*) AS BIGINT) AS n FROM survey GROUP BY 1"""))
def score_brackets(spark, folder):
    return sm.score_brackets(st.survey(spark, folder).withColumn("half", F.col("nps_raw") / 2), "half")


@register("score_from_recommendation", with_("survey", body="""SELECT doc_id, round_even(least(greatest(nps_raw / 2, 1), 5), 1) AS score FROM survey"""))
def score_from_recommendation(spark, folder):
    return st.survey(spark, folder).select("doc_id", sv.satisfaction_from_recommendation("nps_raw").alias("score"))


@register("score_coercion_ladder", with_("survey", body="""SELECT doc_id, satisfaction AS plain,
    CAST(regexp_extract(inconvenience, '(\\d+)', 1) AS DOUBLE) AS extracted, CAST(CASE WHEN satisfaction = 5 THEN 5 WHEN satisfaction = 2 THEN 2 END AS DOUBLE) AS labelled FROM survey"""))
def score_coercion_ladder(spark, folder):
    s = st.survey(spark, folder)
    word = F.when(F.col("satisfaction") == 5, "とても満足").when(F.col("satisfaction") == 2, "不満").otherwise("?")
    s = s.select("doc_id", F.col("satisfaction").cast("string").alias("t1"), F.col("inconvenience").alias("t2"), word.alias("t3"))
    for i, name in ((1, "plain"), (2, "extracted"), (3, "labelled")):
        s = sv.coerce_scores(s, f"t{i}", name)
    return s.select("doc_id", "plain", "extracted", "labelled")


@register("prefecture_labels", with_("survey", body="""SELECT doc_id, CASE WHEN prefecture LIKE '%fr%' THEN 'fr' WHEN prefecture LIKE '%de%' THEN 'de' END AS label
    FROM survey WHERE prefecture LIKE '%fr%' OR prefecture LIKE '%de%'"""))
def prefecture_labels(spark, folder):
    s = st.survey(spark, folder).withColumn("label", sv.prefecture_label("prefecture", ("fr", "de")))
    return s.where("label is not null").select("doc_id", "label")


_PREFS = ["de", "en", "es", "fr"]


@register("pivot_month_prefecture", with_("survey", body="SELECT strftime(date, '%Y-%m') AS ym, " + ", ".join(
    f"CAST(count(*) FILTER (prefecture = '{p}') AS BIGINT) AS {p}" for p in _PREFS) + " FROM survey GROUP BY 1"))
def pivot_month_prefecture(spark, folder):
    s = st.survey(spark, folder)
    return pn.pivot_counts(s, F.date_format("date", "yyyy-MM").alias("ym"), "prefecture", _PREFS)


@register("pivot_date_prefecture", with_("survey", body="SELECT date, " + ", ".join(
    f"CAST(count(*) FILTER (prefecture = '{p}') AS BIGINT) AS {p}" for p in _PREFS) + " FROM survey GROUP BY 1"))
def pivot_date_prefecture(spark, folder):
    return pn.pivot_counts(st.survey(spark, folder), "date", "prefecture", _PREFS)


@register("rain_distribution", with_("hourly", body=f"""WITH wet AS (SELECT station, precip_1h_mm AS x FROM hourly WHERE precip_1h_mm > 0),
    q AS (SELECT station AS s, count(*) AS n, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3 FROM wet GROUP BY 1)
    SELECT station, n, {q6('q1')} AS q1, {q6('median')} AS median, {q6('q3')} AS q3, {q6('min(x) FILTER (inside)')} AS low_whisker, {q6('max(x) FILTER (inside)')} AS high_whisker,
    CAST(count(*) FILTER (NOT inside) AS BIGINT) AS outliers FROM (SELECT *, x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM wet JOIN q ON station = s) GROUP BY ALL"""))
def rain_distribution(spark, folder):
    """Box numbers of every station's positive hourly rain."""
    wet = pn.drop_zero_days(st.hourly(spark, folder), "precip_1h_mm")
    return rounded(sm.box_numbers(wet, "precip_1h_mm", ["station"]))


@register("box_numbers_raw", f"""WITH q AS (SELECT l_returnflag AS flag, count(*) AS n, quantile_cont(l_extendedprice, 0.25) AS q1,
    quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
    SELECT flag, q.n, {q6('q1', 4)} AS q1, {q6('median', 4)} AS median, {q6('q3', 4)} AS q3,
    min(l_extendedprice) FILTER (inside) AS low_whisker, max(l_extendedprice) FILTER (inside) AS high_whisker,
    CAST(count(*) FILTER (NOT inside) AS BIGINT) AS outliers FROM (SELECT *, l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
    FROM lineitem JOIN q ON l_returnflag = flag) q GROUP BY ALL""")
def box_numbers_raw(spark, folder):
    li = st.table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    out = sm.box_numbers(li, "l_extendedprice", ["flag"])
    return out.withColumns({c: r6(c, 4) for c in ("q1", "median", "q3")})


@register("box_numbers_by_weekday", with_("counts", body=f"""WITH d AS (SELECT CAST(isodow(date) - 1 AS BIGINT) AS dow, count FROM counts),
    q AS (SELECT dow, count(*) AS n, quantile_cont(count, 0.25) AS q1, quantile_cont(count, 0.5) AS median, quantile_cont(count, 0.75) AS q3 FROM d GROUP BY 1)
    SELECT dow, n, {q6('q1')} AS q1, {q6('median')} AS median, {q6('q3')} AS q3, {q6('min(count) FILTER (inside)')} AS low_whisker,
    {q6('max(count) FILTER (inside)')} AS high_whisker, CAST(count(*) FILTER (NOT inside) AS BIGINT) AS outliers
    FROM (SELECT d.count, q.*, d.count BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM d JOIN q USING (dow)) GROUP BY ALL"""))
def box_numbers_by_weekday(spark, folder):
    c = st.counts(spark, folder).withColumn("dow", cal.day_of_week("date"))
    return rounded(sm.box_numbers(c, "count", ["dow"]))


@register("quantiles_raw_column", f"""SELECT o_orderstatus AS status, count(*) AS n, {q6('quantile_cont(o_totalprice, 0.1)', 4)} AS p10,
    {q6('median(o_totalprice)', 4)} AS p50, {q6('quantile_cont(o_totalprice, 0.99)', 4)} AS p99 FROM orders GROUP BY 1""")
def quantiles_raw_column(spark, folder):
    o = st.table(spark, folder, "orders").select(F.col("o_orderstatus").alias("status"), "o_totalprice")
    return rounded(quantiles(o, "o_totalprice", {"p10": 0.1, "p50": 0.5, "p99": 0.99}, ["status"]), 4)


@register("histogram_equal_width", f"""WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, (max(o_totalprice) - min(o_totalprice)) / 40 AS w FROM orders)
    SELECT o_orderstatus, bin, CAST(count(*) AS BIGINT) AS n, {q6('min(lo + (bin - 1) * w)')} AS "left"
    FROM (SELECT o_orderstatus, lo, w, CAST(least(floor((o_totalprice - lo) / w), 39) AS BIGINT) + 1 AS bin FROM orders CROSS JOIN s) GROUP BY 1, 2""")
def histogram_equal_width(spark, folder):
    return rounded(sm.histogram(st.table(spark, folder, "orders"), "o_totalprice", 40, label="o_orderstatus"))


@register("histogram_per_station", with_("hourly", body=f"""WITH s AS (SELECT station, min(temp_c) AS lo, (max(temp_c) - min(temp_c)) / 20 AS w FROM hourly GROUP BY 1)
    SELECT station, bin, CAST(count(*) AS BIGINT) AS n, {q6('min(lo + (bin - 1) * w)')} AS "left"
    FROM (SELECT station, lo, w, CAST(least(floor((temp_c - lo) / w), 19) AS BIGINT) + 1 AS bin FROM hourly JOIN s USING (station)) GROUP BY 1, 2"""))
def histogram_per_station(spark, folder):
    return rounded(sm.histogram(st.hourly(spark, folder), "temp_c", 20, keys=["station"]))


@register("label_shares", with_("hourly", body=f"""SELECT station, CAST(count(*) AS BIGINT) AS n, {q6('count(*) / sum(count(*)) OVER ()')} AS share FROM hourly GROUP BY 1"""))
def label_shares(spark, folder):
    return rounded(sm.shares(st.hourly(spark, folder), "station"))


@register("distinct_and_range", with_("hourly", "survey", body="""SELECT 'weather' AS source, CAST(count(*) AS BIGINT) AS rows, count(DISTINCT station) AS groups,
    CAST(min(timestamp) AS DATE) AS first, CAST(max(timestamp) AS DATE) AS last FROM hourly
    UNION ALL SELECT 'survey', count(*), count(DISTINCT prefecture), min(date), max(date) FROM survey"""))
def distinct_and_range(spark, folder):
    def one(name, df, group, date):
        return df.withColumn("_d", F.col(date).cast("date")).groupBy(F.lit(name).alias("source")).agg(
            F.count(F.lit(1)).alias("rows"), F.count_distinct(group).alias("groups"), F.min("_d").alias("first"), F.max("_d").alias("last"))
    return one("weather", st.hourly(spark, folder), "station", "timestamp").unionByName(
        one("survey", st.survey(spark, folder), "prefecture", "date"))


@register("rows_and_date_range", with_("node_counts", body="SELECT node, min(date) AS first, max(date) AS last, CAST(count(*) AS BIGINT) AS rows FROM node_counts GROUP BY 1"))
def rows_and_date_range(spark, folder):
    return pn.range_and_rows(st.node_counts(spark, folder), keys=["node"])


@register("spending_loss", f"""WITH s AS (SELECT CASE n_chars % 3 WHEN 0 THEN 500.0 WHEN 1 THEN 7500.0 END AS spending_midpoint FROM documents)
    SELECT {q6('avg(spending_midpoint)')} AS mean_spend, {q6('abs(-85522.0) * avg(spending_midpoint)', 2)} AS loss_yen FROM s""")
def spending_loss(spark, folder):
    band = F.when(F.col("n_chars") % 3 == 0, "1,000円未満").when(F.col("n_chars") % 3 == 1, "5,000円以上 10,000円未満").otherwise("other")
    s = st.table(spark, folder, "documents").select(sv.spending_midpoint(band).alias("spending_midpoint"))
    out = ec.mean_spend_loss(s, -85522.0)
    return out.select(r6("mean_spend").alias("mean_spend"), r6("loss_yen", 2).alias("loss_yen"))


@register("unit_conversions", with_("node_counts", body=f"""SELECT node, {q6('sum(count) * 13811 / 1e9')} AS yen_billions, {q6('sum(count) * 13811 / 164.7 / 1e6')} AS usd_millions,
    {q6('sum(count) / 1000')} AS visitors_k, {q6('sum(count) / greatest(count(*), 1)')} AS per_day FROM node_counts GROUP BY 1"""))
def unit_conversions(spark, folder):
    c = st.node_counts(spark, folder).groupBy("node").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("days"))
    yen = F.col("total") * 13811
    return rounded(c.select(
        "node", vl.yen_to_billions(yen).alias("yen_billions"), vl.yen_to_million_dollars(yen, 164.7).alias("usd_millions"),
        vl.thousands("total").alias("visitors_k"), vl.mean_per_day("total", "days").alias("per_day")))


@register("relative_density", with_("survey", body=f"""WITH d AS (SELECT location AS site, date, count(*) AS n FROM survey GROUP BY 1, 2)
    SELECT site, date, CAST(n AS BIGINT) AS n, {q6('n * 100.0 / max(n) OVER (PARTITION BY site)')} AS rel_density FROM d"""))
def relative_density(spark, folder):
    from ..operators.satisfaction import relative_density as density

    d = st.survey(spark, folder).groupBy(F.col("location").alias("site"), "date").agg(F.count(F.lit(1)).alias("n"))
    return rounded(density(d))


@register("bubble_radius", with_("node_counts", body=f"""WITH t AS (SELECT node, sum(count) AS lost_visitors FROM node_counts GROUP BY 1)
    SELECT node, {q6('0.03 + 0.08 * sqrt(lost_visitors / max(lost_visitors) OVER ())')} AS radius FROM t"""))
def bubble_radius(spark, folder):
    t = st.node_counts(spark, folder).groupBy("node").agg(F.sum("count").alias("lost_visitors"))
    return rounded(nd.bubble_radius(t).select("node", "radius"))


@register("scenario_losses", f"""SELECT c_custkey, CAST((c_custkey % 90 + 10) * (c_nationkey * 100 + 500) AS BIGINT) AS total_lost,
    {q6('(c_custkey % 90 + 10) * (c_nationkey * 100 + 500) * 13811.0')} AS total_yen FROM customer""")
def scenario_losses(spark, folder):
    c = st.table(spark, folder, "customer").select(
        "c_custkey", (F.col("c_custkey") % 90 + 10).alias("gap_days"),
        (F.col("c_nationkey").cast("bigint") * 100 + 500).alias("visitors"), F.lit(13811.0).alias("spend"))
    return rounded(ec.scenario_losses(c).select("c_custkey", "total_lost", "total_yen"))


@register("nps_digits_and_buckets", """SELECT event_id, CAST(nullif(regexp_extract(props, '(\\d+)', 1), '') AS DOUBLE) AS digits FROM events""")
def nps_digits_and_buckets(spark, folder):
    return st.table(spark, folder, "events").select("event_id", sv.digits("props").alias("digits"))


@register("seeded_sample", "SELECT doc_id, n_chars FROM documents ORDER BY md5(doc_id || ':42'), doc_id LIMIT 10")
def seeded_sample(spark, folder):
    return sm.seeded_sample(st.table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id", 10)


@register("first_samples_cut", """SELECT doc_id, substr(text, 1, 120) AS text FROM documents ORDER BY doc_id LIMIT 5""")
def first_samples_cut(spark, folder):
    return sm.first_samples(st.table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", 5, 120)


@register("longest_text_profile", f"""SELECT 'text' AS "column", {q6('avg(length(text))')} AS mean_length FROM documents
    UNION ALL SELECT 'lang', {q6('avg(length(lang))')} FROM documents UNION ALL SELECT 'source', {q6('avg(length(source))')} FROM documents""")
def longest_text_profile(spark, folder):
    return rounded(sm.text_column_profile(st.table(spark, folder, "documents")).select("column", "mean_length"))


@register("grouping_column_candidates", """SELECT 'o_orderstatus' AS "column", CAST(count(*) FILTER (n >= 5) AS BIGINT) AS groups FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)
    UNION ALL SELECT 'o_custkey', count(*) FILTER (n >= 5) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)""")
def grouping_column_candidates(spark, folder):
    return sm.group_sizes(st.table(spark, folder, "orders"), ["o_orderstatus", "o_custkey"]).select("column", "groups")


@register("combined_free_text", with_("survey", body="""SELECT doc_id, nullif(concat_ws('。', CASE WHEN regexp_matches(reason, '\\S') THEN reason END,
    CASE WHEN regexp_matches(inconvenience, '\\S') THEN inconvenience END), '') AS joined,
    CAST(length(coalesce(reason, '') || ' ' || coalesce(inconvenience, '') || ' ' || coalesce(freetext, '')) AS BIGINT) AS chars FROM survey"""))
def combined_free_text(spark, folder):
    s = st.survey(spark, folder)
    return s.select("doc_id", tx.join_non_empty(["reason", "inconvenience", "freetext"]).alias("joined"),
                    F.length(tx.join_with_spaces("reason", "inconvenience", "freetext")).cast("bigint").alias("chars"))


@register("window_normalised_by_max", with_("node_panel", body=f"""WITH t AS (SELECT node, avg(temp) AS temp, avg(wind) AS wind, 0.0 * avg(sun) AS zero FROM node_panel GROUP BY 1)
    SELECT node, {q6('temp / max(temp) OVER ()')} AS temp_norm, {q6('wind / max(wind) OVER ()')} AS wind_norm, {q6('zero')} AS zero_norm FROM t"""))
def window_normalised_by_max(spark, folder):
    t = st.node_panel(spark, folder).groupBy("node").agg(
        F.avg("temp").alias("temp"), F.avg("wind").alias("wind"), (F.avg("sun") * 0.0).alias("zero"))
    return rounded(nd.normalise_by_max(t, ["temp", "wind", "zero"]).select("node", "temp_norm", "wind_norm", "zero_norm"))

