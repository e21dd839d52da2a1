from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandpanel.functions import fixed
from demandpanel.sources import camera, files as fl, sinks, tables, weather as wx


def put(path, text, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(encoding))


@pytest.fixture
def cameras(tmp_path):
    root = tmp_path / "cams"
    put(root / "gate/Person/2024/2024-01-01.csv", "aggregate from,aggregate to,total count\n0:00,0:05,3\n0:05,0:10,4\n")
    put(root / "gate/Person/2024/2024-01-02.csv", "total count,aggregate from,aggregate to,extra\n5,0:00,0:05,x\n")
    put(root / "gate/Person/2024/2024-01-03.csv", "aggregate from,aggregate to,total count\n0:00,0:05,0\n")
    put(root / "gate/Person/2024/2024-01-04.csv", "aggregate from,something\n0:00,9\n")
    put(root / "gate/Person/b/2024-01-01.csv", "aggregate from,aggregate to,total count\n0:00,0:05,10\n")
    put(root / "gate/Person/b/not a date.csv", "aggregate from,total count\n0:00,7\n")
    return str(root)


def test_camera_layouts(spark, cameras, rows):
    got = rows(camera.camera_file_counts(spark, cameras).select("day", "count"), "day", "count")
    assert got == [("2024-01-01", 7.0), ("2024-01-01", 10.0), ("2024-01-02", 5.0), ("2024-01-03", 0.0), ("not a date", 7.0)]
    kept = rows(camera.camera_daily_kept(spark, cameras, node=r"/([^/]+)/Person/").select("node", "date", "count"), "date")
    assert kept == [("gate", dt.date(2024, 1, 1), 17.0), ("gate", dt.date(2024, 1, 2), 5.0), ("gate", dt.date(2024, 1, 3), 0.0)]
    strict = camera.camera_daily(spark, cameras.replace("cams", "cams/gate/Person/2024"))
    assert rows(strict, "date") == [(dt.date(2024, 1, 1), 7.0), (dt.date(2024, 1, 2), 5.0)]


def test_absent_camera_folder_is_empty(spark, tmp_path):
    assert camera.camera_daily(spark, str(tmp_path / "nothing")).count() == 0


HEAD = ",".join(fixed.HOURLY_COLUMNS)


def test_hourly_weather(spark, tmp_path, rows):
    put(tmp_path / "jma_north_hourly_8.csv", f"{HEAD}\n2024-01-01 01:00:00,5,1,1.5,,0,3,晴,60\n2024-01-01 02:00:00,7,1,x,0.5,0,5,晴,\nbad,1,1,1,1,1,1,晴,1\n")
    put(tmp_path / "jma_south_hourly_8.csv", "timestamp,temp_c,precip_1h_mm\n2024-01-01 01:00,9,2\n")
    out = {r.station: r for r in wx.node_weather_daily(spark, str(tmp_path)).collect()}
    assert out["north"].temp == 1.5 and out["north"].precip == 0.5 and out["north"].wind == 4.0 and out["north"].snow_depth == 6.0
    assert out["south"].temp == 9.0 and out["south"].wind is None
    one = wx.weather_daily(spark, str(tmp_path / "absent.csv"), str(tmp_path / "jma_north_hourly_8.csv")).first()
    assert one.precip == 0.5 and one.humidity == 60.0
    with pytest.raises(FileNotFoundError):
        wx.weather_daily(spark, str(tmp_path / "absent.csv"))
    assert wx.node_weather_daily(spark, str(tmp_path / "none")).columns == ["station", "date", "temp", "precip", "wind", "snow_depth"]


RAW = """ダウンロードした時刻：2026/02/20 10:00:00

,三国,三国,三国,三国,三国,三国,三国,三国,三国,三国,三国,三国,三国
年月日時,積雪(cm),積雪(cm),降雪(cm),気温(℃),降水量(mm),日照時間(時間),風速(m/s),風速(m/s),風速(m/s),天気,相対湿度(％),気温(℃),天気
,,,,,,,,風向,,,,,
,,品質情報,,,,,,,品質情報,,,品質情報,品質情報
2024/1/1 1:00:00,3,8,0,1.5,0.0,0.1,4.2,北,8,晴,70,8,8
2024/1/1 24:00:00,x,8,0,-0.5,,0.2,3.1,南,8,,71,8,8
2024/1/2 2:00:00,x,8,0,-0.5,,0.2,3.1,南,8,,71,8,8
"""


def test_raw_export_in_legacy_encoding(spark, tmp_path, rows):
    put(tmp_path / "raw1.csv", RAW.replace("\n", "\r\n"), "cp932")
    out = wx.raw_exports(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert [r.timestamp for r in out] == [dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 1, 2, 2)]
    a, b = out
    assert (a.snow_depth_cm, a.temp_c, a.wind_speed_ms, a.weather_type, a.humidity_pct, a.source_file) == (3.0, 1.5, 4.2, "晴", 70.0, "raw1.csv")
    assert b.snow_depth_cm is None and b.precip_1h_mm is None and b.weather_type is None and b.temp_c == -0.5


def test_scraped_rows(spark, rows):
    page = spark.createDataFrame(
        [(dt.date(2024, 1, 31), "1", "5.2 )", "--", "南"), (dt.date(2024, 1, 31), "24", "4.0]", "×", "北"), (dt.date(2024, 1, 31), "合計", "1", "1", "")],
        "date date, `時` string, `気温(℃)` string, `降水量(mm)` string, `風向` string")
    out = wx.scraped_rows(page).orderBy("timestamp").collect()
    assert [r.timestamp for r in out] == [dt.datetime(2024, 1, 31, 1), dt.datetime(2024, 2, 1)]
    assert [r.temp_c for r in out] == ["5.2", "4.0"] and [r.precip_1h_mm for r in out] == ["", ""]
    assert tuple(wx.scraped_rows(page).columns) == fixed.HOURLY_COLUMNS


def test_intent_first_year_wins(spark, tmp_path, rows):
    put(tmp_path / "2024/total_daily_metrics.csv", "date,ルート検索,directions\n2024-12-31,1,10\n2024-12-31,1,99\n2024-12-30,1,8\n")
    put(tmp_path / "2025/total_daily_metrics.csv", "date,directions\n2024-12-31,77\n2025-01-01,5\n")
    df, route = tables.intent_daily(spark, str(tmp_path))
    assert route == "directions"
    assert rows(df.select("date", route), "date") == [(dt.date(2024, 12, 30), 8.0), (dt.date(2024, 12, 31), 10.0), (dt.date(2025, 1, 1), 5.0)]
    with pytest.raises(FileNotFoundError):
        tables.intent_daily(spark, str(tmp_path / "none"))


def test_intent_without_known_column(spark, tmp_path):
    put(tmp_path / "2024/total_daily_metrics.csv", "day,clicks\n2024-12-31,1\n")
    with pytest.raises(ValueError):
        tables.intent_daily(spark, str(tmp_path))


SURVEY = '''対象県,アンケート回答日,満足度（旅行全体）,満足度（商品・サービス）,おすすめ度,満足度理由,不便に感じたこと・困ったこと,自由意見,回答場所
福井県,2024/5/1,5,4,9点,"良い
二行目, と ""引用""",なし,,永平寺
石川県,いつか,4,4,8,a,b,c,d
'''


def test_survey_layouts(spark, tmp_path):
    put(tmp_path / "merged_survey_1.csv", SURVEY)
    put(tmp_path / "merged_survey_2.csv", "対象県,アンケート回答日,満足度（旅行全体）\n富山県,2024-05-02,x\n")
    root = str(tmp_path)
    sat = {r.prefecture: r for r in tables.survey_satisfaction(spark, root).collect()}
    assert set(sat) == {"福井県", "富山県"}
    a = sat["福井県"]
    assert (a.satisfaction, a.satisfaction_service, a.nps_raw, a.location) == (5.0, 4.0, 9.0, "永平寺")
    assert a["満足度理由"] == '良い\n二行目, と "引用"' and a["自由意見"] == ""
    assert sat["富山県"].satisfaction is None and sat["富山県"].nps_raw is None and sat["富山県"].location == ""
    text = {r.prefecture: r for r in tables.survey_text(spark, root).collect()}
    assert text["福井県"].inconvenience == "なし" and text["富山県"].reason == ""
    assert tables.survey_prefectures(spark, root).count() == 2
    assert tables.survey_text(spark, str(tmp_path / "none")).count() == 0


def test_survey_file_choice(spark, tmp_path):
    wide = "a,b,c,d,e,f\n"
    put(tmp_path / "all.csv", wide + "1,2,3,4,5,6\n" * 5)
    put(tmp_path / "x/big.csv", wide + "1,2,3,4,5,6\n" * 9)
    put(tmp_path / "narrow.csv", "a,b\n" + "1,2\n" * 50)
    assert tables.choose_survey_file(spark, str(tmp_path)).endswith("/x/big.csv")
    put(tmp_path / "all.csv", wide + "1,2,3,4,5,6\n" * 11)
    assert tables.choose_survey_file(spark, str(tmp_path)).endswith("/all.csv")


def test_encodings(spark, tmp_path):
    put(tmp_path / "a.csv", "県,n\n福井,1\n")
    put(tmp_path / "b.csv", "県,n\n福井,2\n", "utf-8-sig")
    put(tmp_path / "c.csv", "県,表示能力\n福井ソ,3\n", "cp932")
    got = {r.file.rsplit("/", 1)[1]: r.encoding for r in fl.detect_encodings(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": "utf-8", "b.csv": "utf-8", "c.csv": "cp932"}
    c = fl.read_by_header(spark, str(tmp_path / "c.csv"), encoding="cp932")
    assert c.columns[:2] == ["県", "表示能力"] and c.first()["県"] == "福井ソ"
    b = fl.read_by_header(spark, str(tmp_path / "b.csv"))
    assert b.columns[0] == "県"


def test_normalised_survey(spark):
    df = spark.createDataFrame([("8", "2024/1/2 3:04:05", "良い", " "), ("x", "bad", None, None)], "NPS string, `回答日時` string, `満足度の理由` string, `推奨項目` string")
    out = tables.normalise_survey(df).collect()
    assert (out[0].satisfaction, out[0].date, out[0].free_text) == (4.0, dt.datetime(2024, 1, 2, 3, 4, 5), "良い")
    assert (out[1].satisfaction, out[1].date, out[1].free_text) == (None, None, None)


def test_sinks(spark, tmp_path, rows):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 1), 1.5)], "timestamp timestamp_ntz, temp_c double")
    path = sinks.write_hourly(df, str(tmp_path / "h"))
    sinks.write_hourly(df.limit(0), path, overwrite=False)
    assert spark.read.option("header", True).csv(path).count() == 1
    month = sinks.write_monthly(df.withColumn("timestamp", F.col("timestamp").cast("string")), str(tmp_path / "m"))
    back = spark.read.option("header", True).csv(month + "/year=2024/month=01")
    assert tuple(back.columns) == fixed.HOURLY_COLUMNS and back.count() == 1
    m = sinks.metric_rows(spark.createDataFrame([("a", 0.5, None)], "node string, r2 double, p double"), "ols", ["node"])
    assert rows(m, "key") == [("ols", "a.p", None), ("ols", "a.r2", "0.5")]
    sinks.write_metrics(m, str(tmp_path / "k"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "k/section=ols")).collect()) == ["a.p=", "a.r2=0.5"]


def test_records_with_line_breaks_and_quoted_headers_count_once(spark, tmp_path):
    from demandpanel.sources import files as fl, tables
    for name in ("long", "short"):
        (tmp_path / name).mkdir()
    (tmp_path / "long" / "a.csv").write_text("a,b,c,d,e,f\n" + "".join(f"{i},x,x,x,x,x\n" for i in range(50)))
    (tmp_path / "short" / "b.csv").write_text('a,"b,\'2\'",c,d,e,f\n' + "".join(f'{i},"one\ntwo\nthree\nfour",x,x,x,x\n' for i in range(20)))
    got = {r["file"].rsplit("/", 1)[1]: (r["rows"], r["columns"]) for r in fl.rows_per_file(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": (50, 6), "b.csv": (20, 6)}
    assert tables.choose_survey_file(spark, str(tmp_path)).endswith("/long/a.csv")
    assert fl.header_names('﻿"x, y",z ,"w"') == ["x, y", "z", "w"]
