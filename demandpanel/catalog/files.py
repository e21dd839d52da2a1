"""Sources, sinks and streams, run on files that Spark derives from the given tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import fixed
from ..session import shared_folder
from ..sources import camera, files as fl, sinks, tables, weather as wx
from ..streaming import feeds
from . import standins as st
from .audits import findings, findings_sql
from .registry import q6, register, rounded
from .standins import with_


def _place(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}"


def _fresh(spark, name: str) -> str:
    """A place no earlier run of this session used (a stream must not resume)."""
    import uuid

    return f"{_place(spark, name)}/{uuid.uuid4().hex}"


@F.pandas_udf(T.StringType())
def _cp932(values: pd.Series) -> pd.Series:
    """Text as the single-byte reading of its cp932 bytes, for a writer that knows only Latin-1."""
    return values.map(lambda s: None if s is None else s.encode("cp932").decode("latin-1"))


def _write(df: DataFrame, path: str, *by: str, mode: str = "overwrite") -> str:
    writer = df.write.mode(mode).option("header", True).option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (writer.partitionBy(*by) if by else writer).csv(path)
    return path


def _camera_files(spark, folder, name: str) -> str:
    """Five-minute counts in three header layouts; the third lacks the count and must be ignored."""
    e = st.table(spark, folder, "events").withColumn("slot", F.window("ts", "5 minutes"))
    five = e.groupBy(F.col("event_type").alias("node"), "slot").agg(F.count(F.lit(1)).alias("n")).select(
        "node", F.col("slot.start").cast("date").cast("string").alias("day"), F.col("slot.start").cast("string").alias("aggregate from"),
        F.col("slot.end").cast("string").alias("aggregate to"), F.col("n").alias("total count"))
    # One file per site and day: hot sites are split over days before writing.
    five = five.repartition("node", "day")
    root = _place(spark, name)
    odd = F.dayofmonth(F.col("day").cast("date")) % 2 == 1
    _write(five.where(odd), f"{root}/a", "node", "day")
    _write(five.where(~odd).select("node", "day", "total count", F.lit("x").alias("camera"), "aggregate to", "aggregate from"), f"{root}/b", "node", "day")
    _write(five.select("node", "day", "aggregate from"), f"{root}/c", "node", "day")
    return root


_DAY = r"day=([^/]+)/"


@register("source_camera_daily", f"SELECT CAST(ts AS DATE) AS date, {q6('count(*)')} AS count FROM events GROUP BY event_type, 1")
def source_camera_daily(spark, folder):
    return rounded(camera.camera_daily(spark, _camera_files(spark, folder, "camera_daily"), stem=_DAY))


@register("source_camera_by_node", f"SELECT event_type AS node, CAST(ts AS DATE) AS date, {q6('count(*)')} AS count FROM events GROUP BY 1, 2")
def source_camera_by_node(spark, folder):
    return rounded(camera.camera_daily_kept(spark, _camera_files(spark, folder, "camera_nodes"), stem=_DAY, node=r"node=([^/]+)/"))


@register("source_camera_preview", """WITH slots AS (SELECT DISTINCT event_type, CAST(ts AS DATE) AS day, time_bucket(INTERVAL 5 MINUTE, ts) AS slot FROM events),
    f AS (SELECT CASE WHEN day(day) % 2 = 1 THEN 'a' ELSE 'b' END AS layout, event_type, day, count(*) AS n FROM slots GROUP BY 1, 2, 3
        UNION ALL SELECT 'c', event_type, day, count(*) FROM slots GROUP BY 1, 2, 3)
    SELECT layout, CAST(sum(n) AS BIGINT) AS rows FROM (SELECT * FROM f ORDER BY layout, event_type, day LIMIT 50) GROUP BY 1""")
def source_camera_preview(spark, folder):
    """The first fifty files over all layouts, in the order of their paths."""
    preview = camera.camera_preview(spark, _camera_files(spark, folder, "camera_preview"))
    return preview.groupBy(F.regexp_extract(fl.ROW_FILE, "/([abc])/node=", 1).alias("layout")).agg(F.count(F.lit(1)).alias("rows"))


def _weather_files(spark, folder, name: str) -> str:
    h = st.hourly(spark, folder).drop("event_id")
    ready = h.withColumns({
        "timestamp": F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), "weather_type": F.lit("晴"),
        "temp_c": F.when(F.col("sun_1h_h") == 0.5, F.lit("×")).otherwise(F.col("temp_c").cast("string")),
        "file": F.concat(F.lit("jma_"), "station", F.lit("_hourly_8")),
    }).select("file", *fixed.HOURLY_COLUMNS)
    root = _place(spark, name)
    click = F.col("file") == "jma_click_hourly_8"
    _write(ready.where(~click), f"{root}/a", "file")
    _write(ready.where(click).select("file", "humidity_pct", "timestamp", "temp_c", "precip_1h_mm", "wind_speed_ms", "snow_depth_cm"), f"{root}/b", "file")
    return root


_FILE = r"file=([^/]+)/"
_PARSED = "parsed AS (SELECT * EXCLUDE (temp_c, timestamp), date_trunc('second', timestamp) AS timestamp, CASE WHEN sun_1h_h <> 0.5 THEN temp_c END AS temp_c FROM hourly)"


@register("source_weather_by_node", with_("hourly", body=f"""WITH {_PARSED} SELECT station, CAST(timestamp AS DATE) AS date, {q6('avg(temp_c)')} AS temp, {q6('coalesce(sum(precip_1h_mm), 0.0)')} AS precip,
    {q6('avg(wind_speed_ms)')} AS wind, {q6('avg(snow_depth_cm)')} AS snow_depth FROM parsed GROUP BY 1, 2"""))
def source_weather_by_node(spark, folder):
    return rounded(wx.node_weather_daily(spark, _weather_files(spark, folder, "weather_nodes"), stem=_FILE))


@register("source_weather_daily", with_("hourly", body=f"""WITH {_PARSED} SELECT CAST(timestamp AS DATE) AS date, {q6('avg(temp_c)')} AS temp, {q6('coalesce(sum(precip_1h_mm), 0.0)')} AS precip,
    {q6('avg(wind_speed_ms)')} AS wind, {q6('avg(humidity_pct)')} AS humidity, {q6("avg(CASE WHEN station <> 'click' THEN sun_1h_h END)")} AS sun FROM parsed GROUP BY 1"""))
def source_weather_daily(spark, folder):
    root = _weather_files(spark, folder, "weather_daily")
    daily = wx.weather_daily(spark, f"{root}/no such folder", root, stem=_FILE)
    return rounded(daily.select("date", "temp", "precip", "wind", "humidity", "sun"))


@register("source_weather_stations", with_("hourly", body=f"WITH {_PARSED} SELECT station, CAST(count(*) AS BIGINT) AS rows, count(temp_c) AS temps, min(timestamp) AS first FROM parsed GROUP BY 1"))
def source_weather_stations(spark, folder):
    rows = wx.station_weather(spark, _weather_files(spark, folder, "weather_stations"), "*.csv", stem=_FILE)
    return rows.groupBy("station").agg(F.count(F.lit(1)).alias("rows"), F.count("temperature_c").alias("temps"), F.min("datetime").alias("first"))


@register("source_intent", with_("intent", body="SELECT date, directions FROM intent"))
def source_intent(spark, folder):
    """Every day also sits in the next year's file with a wrong value; the first file wins."""
    i = st.intent(spark, folder).withColumn("year", F.year("date"))
    later = i.withColumns({"year": F.col("year") + 1, "directions": F.lit(-1.0)})
    root = _place(spark, "intent")
    _write(i.unionByName(later).withColumn("file", F.lit("total_daily_metrics.csv")).select("year", "file", "date", "directions"), root, "year", "file")
    daily, route = tables.intent_daily(spark, root)
    return daily.select("date", F.col(route).alias("directions"))


def _survey_files(spark, folder, name: str) -> str:
    """Merged survey in two layouts; the second lacks the service score and the remarks."""
    s = st.survey(spark, folder)
    wide = s.select(
        F.col("prefecture").alias("対象県"), F.date_format("date", "yyyy/M/d").alias("アンケート回答日"),
        F.col("satisfaction").cast("string").alias(fixed.TRIP_SATISFACTION), F.col("satisfaction_service").cast("string").alias(fixed.SERVICE_SATISFACTION),
        F.concat(F.col("nps_raw").cast("int").cast("string"), F.lit("点")).alias(fixed.RECOMMENDATION), F.col("location").alias(fixed.ANSWER_PLACE),
        F.col("reason").alias(fixed.SURVEY_TEXT_HEADINGS[0]), F.col("doc_id").cast("string").alias(fixed.SURVEY_TEXT_HEADINGS[1]), F.lit("なし").alias(fixed.SURVEY_TEXT_HEADINGS[2]),
    )
    root, first = _place(spark, name), F.col("対象県") == "en"
    _write(wide.where(first), f"{root}/merged_survey_1.csv")
    _write(wide.where(~first).drop(fixed.SERVICE_SATISFACTION, fixed.SURVEY_TEXT_HEADINGS[2]), f"{root}/merged_survey_2.csv")
    return root


@register("source_survey_prefectures", with_("survey", body="SELECT prefecture, date, CAST(count(*) AS BIGINT) AS n FROM survey GROUP BY 1, 2"))
def source_survey_prefectures(spark, folder):
    rows = tables.survey_prefectures(spark, _survey_files(spark, folder, "survey_prefectures"))
    return rows.groupBy("prefecture", "date").agg(F.count(F.lit(1)).alias("n"))


@register("source_survey_satisfaction", with_("survey", body="""SELECT prefecture, date, satisfaction, CASE WHEN prefecture = 'en' THEN satisfaction_service END AS satisfaction_service, nps_raw, location,
    CAST(doc_id AS VARCHAR) AS doc, CASE WHEN prefecture = 'en' THEN 'なし' ELSE '' END AS remark FROM survey"""))
def source_survey_satisfaction(spark, folder):
    rows = tables.survey_satisfaction(spark, _survey_files(spark, folder, "survey_satisfaction"))
    _, doc, remark = fixed.SURVEY_TEXT_HEADINGS
    return rows.select("prefecture", "date", "satisfaction", "satisfaction_service", "nps_raw", "location",
                       F.col(doc).alias("doc"), F.col(remark).alias("remark"))


@register("source_survey_text", with_("survey", body="""SELECT prefecture, satisfaction, CAST(doc_id AS VARCHAR) AS inconvenience, CAST(length(reason) AS BIGINT) AS chars, md5(reason) AS digest FROM survey"""))
def source_survey_text(spark, folder):
    rows = tables.survey_text(spark, _survey_files(spark, folder, "survey_text"))
    return rows.select("prefecture", "satisfaction", "inconvenience", F.length("reason").cast("bigint").alias("chars"), F.md5("reason").alias("digest"))


@register("source_raw_survey", """SELECT CAST(doc_id AS VARCHAR) AS id, CASE n_chars % 3 WHEN 0 THEN 500.0::DOUBLE WHEN 1 THEN 7500.0::DOUBLE END AS spending_midpoint,
    CASE WHEN doc_id % 5 <> 0 THEN DATE '1995-01-01' + CAST(doc_id % 120 AS INTEGER) END AS date FROM documents""")
def source_raw_survey(spark, folder):
    band = F.when(F.col("n_chars") % 3 == 0, "1,000円未満").when(F.col("n_chars") % 3 == 1, "5,000円以上 10,000円未満").otherwise("other")
    when = F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), (F.col("doc_id") % 120).cast("int")), "yyyy-MM-dd 10:20:30")
    d = st.table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("id"), band.alias("県内消費額"), F.when(F.col("doc_id") % 5 != 0, when).otherwise("いつか").alias("回答日時"))
    return tables.raw_survey(spark, _write(d, _place(spark, "raw_survey"))).select("id", "spending_midpoint", "date")


def _encoded_files(spark, folder, name: str) -> str:
    d = st.table(spark, folder, "customer").select("c_name", F.lit("福井県").alias("県"))
    root = _place(spark, name)
    _write(d, f"{root}/plain")
    legacy = d.select("c_name", _cp932("県").alias("県".encode("cp932").decode("latin-1")))
    legacy.write.mode("overwrite").option("header", True).option("encoding", "ISO-8859-1").csv(f"{root}/legacy")
    return root


@register("source_encodings", "SELECT 'plain' AS kind, 'utf-8' AS encoding UNION ALL SELECT 'legacy', 'cp932'")
def source_encodings(spark, folder):
    found = fl.detect_encodings(spark, _encoded_files(spark, folder, "encodings"))
    return found.select(F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1).alias("kind"), "encoding").distinct()


@register("source_encoded_read", "SELECT c_name, '福井県' AS pref, 2 * count(*) AS n FROM customer GROUP BY 1, 2")
def source_encoded_read(spark, folder):
    root = _encoded_files(spark, folder, "encoded_read")
    both = fl.read_by_header(spark, f"{root}/plain").unionByName(fl.read_by_header(spark, f"{root}/legacy", encoding="cp932"))
    return both.groupBy("c_name", F.col("県").alias("pref")).agg(F.count(F.lit(1)).alias("n"))


@register("source_rows_per_file", "SELECT 'narrow' AS kind, CAST(count(*) AS BIGINT) AS rows, CAST(2 AS BIGINT) AS columns FROM supplier UNION ALL SELECT 'wide', count(*), 6 FROM orders")
def source_rows_per_file(spark, folder):
    root = _place(spark, "rows_per_file")
    _write(st.table(spark, folder, "supplier").select("s_suppkey", "s_name"), f"{root}/narrow")
    _write(st.table(spark, folder, "orders"), f"{root}/wide")
    per = fl.rows_per_file(spark, root).withColumn("kind", F.regexp_extract("file", r"/([^/]+)/[^/]+$", 1))
    return per.groupBy("kind").agg(F.sum("rows").alias("rows"), F.max("columns").cast("bigint").alias("columns"))


@register("source_file_choice", "SELECT 'wide' AS kind, CAST(count(*) AS BIGINT) AS rows FROM orders")
def source_file_choice(spark, folder):
    """No ``all.csv`` here, so the longest file with more than five columns is taken."""
    root = _place(spark, "file_choice")
    _write(st.table(spark, folder, "lineitem").select("l_orderkey", "l_partkey"), f"{root}/narrow")
    orders = st.table(spark, folder, "orders")
    _write(orders, f"{root}/wide")
    best = tables.choose_survey_file(spark, root)
    rows = fl.read_by_header(spark, best.rsplit("/", 1)[0])
    kind = F.regexp_extract(F.col(fl.ROW_FILE), r"/([^/]+)/[^/]+$", 1)
    return rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("rows"))


def _raw_export_files(spark, folder, name: str) -> str:
    """Raw exports in the legacy encoding: preamble, three header lines, repeated labels."""
    h = st.hourly(spark, folder)
    labels = ["年月日時", "気温(℃)", "気温(℃)", "降水量(mm)", "降水量(mm)", "降雪(cm)", "積雪(cm)", "日照時間(時間)", "風速(m/s)", "風速(m/s)", "風速(m/s)", "天気", "相対湿度(％)"]
    extra = ["", "", "", "", "", "", "", "", "", "", "風向", "", ""]
    quality = ["", "", "品質情報", "", "品質情報", "", "", "", "", "品質情報", "", "", ""]
    head = [(-5, "ダウンロードした時刻：2026/02/20"), (-3, ",".join(labels)), (-2, ",".join(extra)), (-1, ",".join(quality))]
    top = F.array(*[F.struct(F.lit(n).cast("bigint").alias("ord"), F.lit(t).alias("line")) for n, t in head])
    lines = h.select("station").distinct().select(F.explode(top).alias("_l"), "station").select("_l.*", "station")
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))
    data = h.select(F.col("event_id").alias("ord"), F.concat_ws(
        ",", F.date_format("timestamp", "yyyy/M/d H:mm:ss"), text("temp_c"), F.lit("8"), text("precip_1h_mm"), F.lit("8"), text("snowfall_1h_cm"),
        text("snow_depth_cm"), text("sun_1h_h"), text("wind_speed_ms"), F.lit("8"), F.lit("北"), F.lit("晴"), text("humidity_pct")).alias("line"), "station")
    root = _place(spark, name)
    # A raw export is one file per station by its nature.
    one_file = data.unionByName(lines).repartition("station").sortWithinPartitions("station", "ord")
    (one_file.select("station", _cp932("line").alias("line")).write.mode("overwrite").partitionBy("station").option("encoding", "ISO-8859-1")
     .option("sep", "\u0001").option("quote", "\u0000").option("escapeQuotes", False).csv(root))
    return root


@register("source_raw_exports", with_("hourly", body="SELECT date_trunc('second', timestamp) AS timestamp, temp_c, precip_1h_mm, snowfall_1h_cm, snow_depth_cm, sun_1h_h, wind_speed_ms, '晴' AS weather_type, humidity_pct FROM hourly"))
def source_raw_exports(spark, folder):
    return wx.raw_exports(spark, _raw_export_files(spark, folder, "raw_exports")).drop("source_file")


@register("source_scraped_rows", with_("hourly", body="""SELECT CAST(CAST(timestamp AS DATE) AS TIMESTAMP) + INTERVAL 1 HOUR * (event_id % 24 + 1) AS timestamp, CAST(event_id % 50 AS VARCHAR) AS temp_c,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE '1.5' END AS precip_1h_mm, '' AS humidity_pct, CAST(count(*) AS BIGINT) AS n FROM hourly WHERE event_id % 7 <> 0 GROUP BY 1, 2, 3, 4"""))
def source_scraped_rows(spark, folder):
    e = F.col("event_id")
    page = st.hourly(spark, folder).select(
        F.col("timestamp").cast("date").alias("date"), F.when(e % 7 == 0, F.lit("平均")).otherwise((e % 24 + 1).cast("string")).alias("時"),
        F.concat((e % 50).cast("string"), F.lit(" )]")).alias("気温(℃)"), F.when(e % 3 == 0, "--").otherwise("1.5)").alias("降水量(mm)"))
    rows = wx.scraped_rows(page)
    return rows.groupBy("timestamp", "temp_c", "precip_1h_mm", "humidity_pct").agg(F.count(F.lit(1)).alias("n"))


_SINK_COLS = [c for c in fixed.HOURLY_COLUMNS if c not in ("timestamp", "weather_type")]


@register("sink_hourly", with_("hourly", body="SELECT station, timestamp, " + ", ".join(_SINK_COLS) + " FROM hourly"))
def sink_hourly(spark, folder):
    """Written once, left alone by the second run that must not overwrite, then read back."""
    h, path = st.hourly(spark, folder), _place(spark, "sink_hourly")
    sinks.write_hourly(h, path, fmt="parquet")
    sinks.write_hourly(h.limit(0), path, overwrite=False, fmt="parquet")
    return spark.read.parquet(path).select("station", "timestamp", *_SINK_COLS)


@register("sink_hourly_upsert", with_("hourly", body="""WITH a AS (SELECT date_trunc('second', timestamp) AS t, temp_c, precip_1h_mm FROM hourly),
    n AS (SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS timestamp, max(temp_c) AS temp_c, min(precip_1h_mm) AS precip_1h_mm, bool_or(day(t) % 2 = 0) AS newer FROM a GROUP BY 1)
    SELECT timestamp, round(CASE WHEN newer THEN temp_c + 100 ELSE temp_c END, 6) AS temp_c, CASE WHEN NOT newer THEN round(precip_1h_mm, 6) END AS precip_1h_mm FROM n"""))
def sink_hourly_upsert(spark, folder):
    """A first load of all hours, then new rows for every other day that also lack a column; read back from CSV."""
    h = st.hourly(spark, folder).groupBy(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp")).agg(
        F.max("temp_c").alias("temp_c"), F.min("precip_1h_mm").alias("precip_1h_mm"))
    path = _fresh(spark, "sink_hourly_upsert")
    sinks.upsert_hourly(h, path)
    even = F.dayofmonth(F.col("timestamp").cast("timestamp_ntz")) % 2 == 0
    later = h.where(even).select("timestamp", (F.col("temp_c") + 100).alias("temp_c"), F.lit("b").alias("source_file"))
    stale = later.withColumns({"temp_c": F.lit(-1.0), "source_file": F.lit("a")})
    sinks.upsert_hourly(later.unionByName(stale), path)
    back = sinks.hourly_table(spark, path)
    return back.select("timestamp", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in ("temp_c", "precip_1h_mm")])


@register("sink_monthly", "SELECT strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month, CAST(count(*) AS BIGINT) AS rows FROM orders GROUP BY 1, 2")
def sink_monthly(spark, folder):
    o = st.table(spark, folder, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.col("o_totalprice").alias("temp_c"))
    path = sinks.write_monthly(o.repartition(F.substring("timestamp", 1, 7)), _place(spark, "sink_monthly"), overwrite=True)
    back = spark.read.option("header", True).option("basePath", path).schema(
        ", ".join(f"{c} string" for c in fixed.HOURLY_COLUMNS) + ", year string, month string").csv(path)
    return back.groupBy("year", "month").agg(F.count(F.lit(1)).alias("rows"))


@register("sink_report", findings_sql("SELECT * FROM found"))
def sink_report(spark, folder):
    """The audit's report, every line read back."""
    path = sinks.write_report(findings(spark, folder), _place(spark, "sink_report"))
    return spark.read.schema("source string, severity string, message string").json(path)


@register("sink_metrics", with_("node_counts", body="SELECT 'nodes' AS section, node || '.days=' || count(*) AS line FROM node_counts GROUP BY node"))
def sink_metrics(spark, folder):
    days = st.node_counts(spark, folder).groupBy("node").agg(F.count(F.lit(1)).alias("days"))
    path = sinks.write_metrics(sinks.metric_rows(days, "nodes", ["node"]), _place(spark, "sink_metrics"))
    return spark.read.schema("value string, section string").text(path).select("section", F.col("value").alias("line"))


@register("stream_daily_counts", """WITH m AS (SELECT max(ts) - INTERVAL 2 DAY AS w FROM events) SELECT event_type AS node, CAST(ts AS DATE) AS date, CAST(count(*) AS BIGINT) AS count FROM events, m
    GROUP BY 1, 2, w HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= w""")
def stream_daily_counts(spark, folder):
    """Closed days only: the newest ones stay open behind the watermark."""
    schema = st.table(spark, folder, "events").schema
    feed = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder).select(
        F.col("event_type").alias("node"), F.col("ts").cast("timestamp").alias("ts"), F.lit(1).cast("bigint").alias("count"))
    place = _fresh(spark, "stream_daily_counts")
    feeds.start_daily_counts(feed, f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.schema("node string, date date, count bigint").parquet(f"{place}/out")


@register("stream_upsert", "SELECT CAST(o_orderdate AS DATE) AS day, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1")
def stream_upsert(spark, folder):
    schema = st.table(spark, folder, "orders").schema
    feed = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(folder).select(
        F.col("o_orderdate").cast("date").alias("day"), "o_orderkey", F.col("o_totalprice").alias("price"))
    place = _fresh(spark, "stream_upsert")
    feeds.start_upsert(feed, f"{place}/out", f"{place}/state", ["day"], ["o_orderkey"]).awaitTermination()
    feeds.compact(spark, f"{place}/out", ["day"])
    return feeds.current_rows(spark, f"{place}/out", ["day"])

