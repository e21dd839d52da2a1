"""Records of CSV files against the standard library's reader."""

from __future__ import annotations

import csv
import random

import pytest
from pyspark.sql import functions as F

from demandpanel.functions import fixed
from demandpanel.sources import camera, files as fl, records as rc, weather as wx


def plain(path, encoding="utf-8"):
    with open(path, encoding=encoding, newline="") as f:
        return [row for row in csv.reader(f) if row and any(c.strip() for c in row)]


def got(spark, path, **options):
    rows = rc.records(spark, str(path), **options).select(rc.NUMBER, rc.cells(rc.RECORD, "").alias("c")).orderBy(rc.NUMBER).collect()
    assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
    return [r["c"] for r in rows]


def field(rng):
    return rng.choice(["", "x", "1.5", "two words", "a,b", 'say ""so""'.replace('""', '"'), "line\nbreak", "\n", "many\n\nlines,\n\"quoted\"\n", "tail ", " 福井"])


@pytest.fixture
def small_blocks(spark):
    """Files are read in pieces of a few kilobytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_one_large_file_with_quoted_line_breaks_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    rng = random.Random(1)
    path = tmp_path / "large.csv"
    with open(path, "w", encoding="utf-8", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([[f"id{i}", *(field(rng) for _ in range(4))] for i in range(3000)])
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 10
    assert got(spark, path) == plain(path)


def test_a_field_longer_than_blocks(spark, tmp_path, small_blocks):
    path = tmp_path / "long.csv"
    path.write_text('a,b\n1,"' + "x,\ny\n" * 5000 + '"\n\n2,z\n3,"end\n"\n')
    assert got(spark, path) == plain(path)


def test_line_ends_blank_lines_and_encodings(spark, tmp_path):
    text = 'a,b\r\n1,"x"\r\n\r\n2,"y ""z"""\r\n   \r\n3,\r\n'
    (tmp_path / "w.csv").write_bytes(text.encode())
    assert got(spark, tmp_path / "w.csv") == [["a", "b"], ["1", "x"], ["2", 'y "z"'], ["3", ""]]
    (tmp_path / "j.csv").write_bytes("県,表示能力\n福井ソ,\"十,表\"\n".encode("cp932"))
    assert got(spark, tmp_path / "j.csv", encoding="cp932") == [["県", "表示能力"], ["福井ソ", "十,表"]]
    (tmp_path / "bad.csv").write_bytes(b"a,b\n\xff\xfe,2\n")
    assert got(spark, tmp_path / "bad.csv")[1][1] == "2"


def test_unbalanced_quotes_stop_the_read_or_leave_the_file_out(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a\n1\n")
    (tmp_path / "open.csv").write_text('a\n"1\n2\n')
    with pytest.raises(ValueError, match="open.csv"):
        rc.records(spark, str(tmp_path))
    assert rc.records(spark, str(tmp_path), skip_unreadable=True).count() == 2


def test_layouts_by_name_by_position_and_repeated_names(spark, tmp_path):
    (tmp_path / "1.csv").write_text("x,y,y\n1,2,3\n4\n")
    (tmp_path / "2.csv").write_text('﻿y,"z,w"\n5,""\n,6\n')
    (tmp_path / "3.csv").write_text("only\n7\n")
    out = fl.read_by_header(spark, str(tmp_path), leading=("first", "second"))
    rows = sorted((tuple(r[c] for c in ("x", "y", "y.1", "z,w", "only", "first", "second")) for r in out.collect()), key=str)
    assert rows == sorted([("1", "2", "3", None, None, "1", "2"), ("4", None, None, None, None, "4", None), (None, "5", None, "", None, "5", ""),
                           (None, None, None, "6", None, None, "6"), (None, None, None, None, "7", "7", None)], key=str)
    assert fl.read_by_header(spark, str(tmp_path), required=("y", "x")).count() == 2
    assert fl.read_by_header(spark, str(tmp_path), required=("absent",)) is None


def test_ten_thousand_tiny_files(spark, tmp_path):
    """No list of paths is made; two layouts are all the driver sees of the files."""
    for i in range(10_000):
        folder = tmp_path / f"site{i % 10}/Person"
        folder.mkdir(parents=True, exist_ok=True)
        day = f"{2000 + i // 3650}-{i // 310 % 12 + 1:02d}-{i // 10 % 28 + 1:02d}-{i}"
        (folder / f"{day}.csv").write_text("aggregate from,total count\n0:00,1\n0:05,2\n" if i % 3 else "total count,aggregate from\n4,0:00\n")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        counts = camera.camera_file_counts(spark, str(tmp_path))
        assert counts.groupBy("count").agg(F.count(F.lit(1)).alias("n")).orderBy("count").collect() == [(3.0, 6666), (4.0, 3334)]
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_raw_export_of_sixty_columns_over_many_blocks(spark, tmp_path, small_blocks):
    wide = ["年月日時"] + ["風速(m/s)"] * 40 + ["気温(℃)", "降水量(mm)", "降雪(cm)", "積雪(cm)", "日照時間(時間)", "天気", "相対湿度(％)"] + ["気温(℃)"] * 12
    extra = [""] + ["風向"] * 39 + [""] + [""] * 19
    quality = [""] + [""] * 40 + [""] * 7 + ["品質情報"] * 12
    days = [f"2024/1/{1 + i // 24} {i % 24}:00:00" for i in range(600)]
    body = [[d, *["北"] * 39, str(i), str(i / 2), "1", "2", "3", "0.5", "晴", "70", *["8"] * 12] for i, d in enumerate(days)]
    text = "\r\n".join(",".join(r) for r in [["ダウンロードした時刻：x"], wide, extra, quality, *body]) + "\r\n"
    (tmp_path / "wide.csv").write_bytes(text.encode("cp932"))
    out = wx.raw_exports(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert len(out) == 600 and [r.wind_speed_ms for r in out] == [float(i) for i in range(600)] and [r.temp_c for r in out] == [i / 2 for i in range(600)]
    assert {(r.weather_type, r.humidity_pct, r.source_file) for r in out} == {("晴", 70.0, "wide.csv")} and tuple(wx.raw_exports(spark, str(tmp_path)).columns[:9]) == fixed.HOURLY_COLUMNS


def test_preview_takes_the_first_files_of_all_layouts(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"{i:03d}.csv").write_text("aggregate from,total count\n0:00,1\n" if i % 2 else "total count,camera\n1,x\n")
    rows = camera.camera_preview(spark, str(tmp_path))
    assert rows.count() == 50 and rows.agg(F.max(fl.ROW_FILE)).first()[0].endswith("049.csv") and {"camera", "aggregate from"} <= set(rows.columns)
