from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from demandpanel.functions import calendar as cal, comfort as cf, survey as sv, tails, text as tx, values as vl
from demandpanel.sources.files import station_name


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize("t,h,expected", [(25, 60, 72.82), (30, 80, 82.92), (35, 90, 92.965), (0, 50, 39.15), (10, 70, 51.32)])
def test_discomfort_index_goldens(spark, t, h, expected):
    row = spark.createDataFrame([(float(t), float(h))], "t double, h double")
    got = row.select(cf.discomfort_index("t", "h")).first()[0]
    assert got == pytest.approx(expected, abs=0.01)
    assert got == pytest.approx(0.81 * t + 0.01 * h * (0.99 * t - 14.3) + 46.3, abs=1e-10)


def test_discomfort_index_coefficients(spark):
    row = spark.createDataFrame([(20.0, 70.0)], "t double, h double")
    got = row.select(cf.discomfort_index("t", "h", {"1": 45.0, "t": .8, "h": -.3, "th": .02})).first()[0]
    assert got == pytest.approx(.8 * 20 + .02 * 70 * (20 - 15) + 45)


def test_wind_chill(spark):
    df = spark.createDataFrame([(-5.0, 5.0), (15.0, 9.0), (-5.0, 1.0), (0.0, 3.0), (0.0, 6.0), (0.0, 10.0), (5.0, None)], "t double, w double")
    got = [r[0] for r in df.select(cf.wind_chill("t", "w")).collect()]
    p = 18.0 ** 0.16
    assert got[0] == pytest.approx(13.12 + 0.6215 * -5 - 11.37 * p + 0.3965 * -5 * p)
    assert got[1] == 15.0 and got[2] == -5.0 and got[6] == 5.0
    assert got[3] > got[4] > got[5]


def test_severity_level_and_nulls(spark):
    df = spark.createDataFrame([(0.0, 2.0), (15.0, 12.0), (None, 9.0), (None, None), (3.0, None)], "p double, w double")
    assert [r[0] for r in df.select(cf.severity_level("p", "w")).collect()] == [0, 3, 1, 0, 1]


def test_severity_score_missing_values(spark):
    df = spark.createDataFrame([(None, 50.0, 0.0), (-20.0, 0.0, 100.0), (10.0, None, 0.0)], "t double, p double, s double")
    got = [r[0] for r in df.select(cf.severity_score("t", "p", "s")).collect()]
    assert got[0] == pytest.approx(0.35) and got[1] == pytest.approx(0.4 * 1.0 + 0.25) and got[2] is None


def test_visitor_bin_edges(spark):
    df = spark.createDataFrame([(0.0,), (5000.0,), (5001.0,), (50000.0,), (50001.0,)], "x double")
    from demandpanel.functions import fixed
    got = [r[0] for r in df.select(vl.right_closed_bin("x", fixed.VISITOR_EDGES, fixed.VISITOR_LABELS)).collect()]
    assert got == [None, "<5K", "5-8K", ">20K", None]


def test_number_and_time_coercion(spark):
    df = spark.createDataFrame([("1.5",), (" 2 ",), ("1e3",), ("nan",), ("1.0d",), ("×",), (None,)], "x string")
    assert [r[0] for r in df.select(vl.number("x")).collect()] == [1.5, 2.0, 1000.0, None, None, None, None]
    df = spark.createDataFrame([("2024/1/5 9:00",), ("2024-01-05",), ("いつか",), ("2024-13-01",)], "x string")
    got = [r[0] for r in df.select(vl.timestamp("x")).collect()]
    assert got == [dt.datetime(2024, 1, 5, 9), dt.datetime(2024, 1, 5), None, None]


def test_missing_rules(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),)], "x double")
    assert [r[0] for r in df.select(vl.missing("x")).collect()][:2] == [None, 1.0]
    assert [r[0] for r in df.select(vl.finite("x")).collect()] == [None, 1.0, None]
    empty = spark.createDataFrame([(None,)], "x double")
    assert empty.agg(vl.sum_or_zero("x")).first()[0] == 0.0
    assert empty.select(vl.flag(F.col("x") > 1), vl.known(F.col("x") > 1), vl.ratio(F.lit(1.0), F.lit(0.0))).first() == (0, False, None)


@pytest.mark.parametrize("stem,expected", [
    ("jma_fukuicity_hourly_8", "fukuicity"), ("jma_katsuyama_hourly_8", "katsuyama"), ("jma_north_coast_daily", "north_coast"),
    ("JMA_Mihama_3", "mihama"), ("jma_hourly_8", "hourly_8"), ("plain", "plain")])
def test_station_names(spark, stem, expected):
    assert one(spark, stem, station_name(F.col("x"))) == expected


def test_holidays_of_a_year(spark):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-12-31')) d").where(cal.is_japanese_holiday("d"))
    got = [r[0].strftime("%m-%d") for r in days.orderBy("d").collect()]
    assert got == ["01-01", "01-08", "02-11", "02-12", "02-23", "03-20", "04-29", "05-03", "05-04", "05-05", "05-06", "07-15",
                   "08-11", "08-12", "09-16", "09-22", "09-23", "10-14", "11-03", "11-04", "11-23"]


def test_bridge_days_of_2019(spark):
    days = spark.sql("select explode(sequence(date'2019-04-28', date'2019-05-07')) d").where(cal.is_japanese_holiday("d"))
    assert [r[0].day for r in days.orderBy("d").collect()] == [29, 30, 1, 2, 3, 4, 5, 6]


def test_weekday_numbers(spark):
    df = spark.createDataFrame([(dt.date(2024, 6, 3),), (dt.date(2024, 6, 9),)], "d date")
    assert [tuple(r) for r in df.select(cal.day_of_week("d"), cal.is_weekend("d")).collect()] == [(0, 0), (6, 1)]


@pytest.mark.parametrize("text,expected", [
    ("mail a.b@example.com now", "mail [REDACTED_EMAIL] now"), ("call 090-1234-5678.", "call [REDACTED_PHONE]."),
    ("03(1234)5678 or 090 1234 5678", "[REDACTED_PHONE] or [REDACTED_PHONE]"), ("  ", "  "), (None, None), ("no data", "no data")])
def test_redaction(spark, text, expected):
    assert one(spark, text, tx.redact("x")) == expected
    again = spark.createDataFrame([(text,)], "x string").select(tx.redact("x").alias("x")).select(tx.redact("x")).first()[0]
    assert again == expected


def test_tokens_japanese_first_then_latin(spark):
    got = one(spark, "Great view! 東尋坊の景色が最高 The crab カニ a", tx.tokens("x"))
    assert got == ["東尋坊の景色が最高", "カニ", "great", "view", "the", "crab"]
    assert one(spark, "the the crab", tx.drop_stop_words(tx.tokens("x"))) == ["crab"]
    assert one(spark, None, tx.tokens("x")) == [] and one(spark, " ", tx.tokens("x")) == []


def test_vector_terms_split_inside_kana_runs(spark):
    assert one(spark, "カニ・エビ good", tx.vector_terms(tx.tokens("x"))) == ["カニ", "エビ", "good"]


def test_term_counts_and_ngrams(spark):
    assert one(spark, "bbb aaa bbb", tx.term_counts(tx.tokens("x"))) == [("aaa", 1), ("bbb", 2)]
    assert one(spark, "", tx.term_counts(tx.tokens("x"))) == []
    assert one(spark, "aaa bbb ccc", tx.ngrams(tx.tokens("x"), 2)) == ["aaa bbb", "bbb ccc"]
    assert one(spark, "aaa bbb", tx.ngrams(tx.tokens("x"), 3)) == []


def test_sentiment_labels(spark):
    s = one(spark, "Excellent and beautiful", tx.sentiment("x"))
    assert (s.polarity, s.label, s.positive_terms) == (0.6, "Positive", ["excellent", "beautiful"])
    s = one(spark, "terrible 不満", tx.sentiment("x"))
    assert (s.label, s.negative_terms) == ("Negative", ["不満", "terrible"]) and s.polarity == -0.8
    assert one(spark, None, tx.sentiment("x")).label == "Neutral"
    # Whole tokens only: the lexicon word inside a longer run does not count.
    assert one(spark, "景色が最高でした", tx.sentiment("x")).polarity == 0.0


def test_keywords_are_literals(spark):
    assert one(spark, "a.c", tx.contains_any("x", ["a.c"])) is True
    assert one(spark, "abc", tx.contains_any("x", ["a.c"])) is False
    assert one(spark, None, tx.contains_any("x", ["a"])) is False
    assert one(spark, "人通りも活気もない", tx.first_keyword("x", ["活気", "人通り"])) == "活気"


def test_text_joins(spark):
    df = spark.createDataFrame([("a", None, " "), (None, None, "")], "a string, b string, c string")
    assert [r[0] for r in df.select(tx.join_with_spaces("a", "b", "c")).collect()] == ["a   ", "  "]
    assert [r[0] for r in df.select(tx.join_non_empty(["a", "b", "c"])).collect()] == ["a", None]


def test_survey_scores(spark):
    assert one(spark, "8点", sv.digits("x")) == 8.0 and one(spark, "なし", sv.digits("x")) is None
    assert one(spark, "5,000円以上 10,000円未満", sv.spending_midpoint("x")) == 7500.0
    assert one(spark, "?", sv.spending_midpoint("x")) is None
    assert one(spark, "満足", sv.satisfaction_score("x")) == 4.0
    assert one(spark, "福井県", sv.prefecture_label("x")) == "福井" and one(spark, "東京", sv.prefecture_label("x")) is None
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 5, 9, 10)], "n double")
    assert [r[0] for r in df.select(sv.satisfaction_from_recommendation("n")).collect()] == [1.0, 1.0, 2.5, 4.5, 5.0]


@pytest.mark.parametrize("values,expected", [
    (["4", "5", "x"], [4.0, 5.0, None]), (["score 4", "score 5", "x"], [4.0, 5.0, None]), (["やや不満", "大変満足", "x"], [2.0, 5.0, None])])
def test_score_ladder(spark, values, expected):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    assert [r.score for r in sv.coerce_scores(df, "s").orderBy("i").collect()] == expected


def _tail(spark, fn, *values):
    frame = spark.createDataFrame([tuple(None if v is None else float(v) for v in values)], ", ".join(f"c{i} double" for i in range(len(values))))
    return frame.select(fn(*[F.col(c) for c in frame.columns])).first()[0]


def test_tail_probabilities_against_tables(spark):
    for t, dof, p in ((2.228139, 10, 0.05), (2.000298, 60, 0.05), (0.0, 5, 1.0), (1.0, 1, 0.5), (-31.820516, 1, 0.02), (1.959988, 100_000, 0.05), (2.575834, 10 ** 9, 0.0099999)):
        assert _tail(spark, tails.t_p, t, dof) == pytest.approx(p, rel=2e-5)
    assert _tail(spark, tails.t_p, 40, 30) == pytest.approx(1.1e-27, rel=0.2) and _tail(spark, tails.t_p, float("inf"), 3) == 0.0
    assert _tail(spark, tails.t_p, 1, 0) is None and _tail(spark, tails.t_p, None, 3) is None and _tail(spark, tails.t_p, float("nan"), 3) is None
    for z in (0.0, 0.3, 1.0, 1.959964, 5.0, 12.0):
        assert _tail(spark, tails.normal_p, z) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-10)
        assert _tail(spark, tails.normal_cdf, -z) == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, rel=1e-10)
    assert _tail(spark, tails.chi2_p, 3.841459) == pytest.approx(0.05, abs=1e-7) and _tail(spark, tails.chi2_p, 0) == 1.0
    # Limiting distribution: K(1.358) = 0.95, K(1.628) = 0.99.
    assert _tail(spark, tails.ks_limit, 1.3581 / math.sqrt(50), 100, 100) == pytest.approx(0.05, abs=1e-3)
    assert _tail(spark, tails.ks_limit, 1.6276 / math.sqrt(50), 100, 100) == pytest.approx(0.01, abs=1e-3)
    assert _tail(spark, tails.ks_limit, 0.0, 10, 10) == 1.0
    # Published critical values with a constant: −3.43 (1 %), −2.86 (5 %), −2.57 (10 %).
    for stat, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert _tail(spark, tails.unit_root_p, stat) == pytest.approx(p, abs=2e-3)


def _paths(m, n, most):
    """Share of the orders of two samples whose largest |i n - j m| is at least ``most``, path by path."""
    row = [[0] * (n + 1) for _ in range(m + 1)]
    row[0][0] = 1
    for i in range(m + 1):
        for j in range(n + 1):
            if i or j:
                row[i][j] = 0 if abs(i * n - j * m) >= most else (row[i - 1][j] if i else 0) + (row[i][j - 1] if j else 0)
    return 1 - row[m][n] / math.comb(m + n, m) if most > 0 else 1.0


def test_two_sample_tail_is_exact(spark):
    rng = random.Random(2)
    cases = [(1, 1, 1), (5, 5, 20), (7, 4, 14), (100, 100, 1900), (100, 99, 1300), (60, 100, 0)]
    cases += [(m, n, rng.randint(1, m * n)) for m, n in ((3, 8), (20, 31), (50, 50), (100, 37))]
    for m, n, most in cases:
        assert _tail(spark, tails.ks_p, most / (m * n), m, n) == pytest.approx(_paths(m, n, most), abs=1e-12)
    # Tied values take the same form: the distance is what counts. Large samples follow the limit closely.
    assert _tail(spark, tails.ks_p, 0.03, 9000, 9500) == pytest.approx(_tail(spark, tails.ks_limit, 0.03, 9000, 9500), rel=0.05)
    assert _tail(spark, tails.ks_p, 0.9, 9000, 9500) == 0.0 and _tail(spark, tails.ks_p, 0.1, 0, 5) is None


def test_labels(spark):
    df = spark.createDataFrame([(0.0005,), (0.005,), (0.03,), (0.5,)], "p double")
    assert [r[0] for r in df.select(vl.significance_stars("p")).collect()] == ["***", "**", "*", ""]
    df = spark.createDataFrame([(0.4,), (0.2,), (0.05,), (0.0,)], "f double")
    assert [r[0].split()[0] for r in df.select(vl.effect_size_label("f")).collect()] == ["large", "medium", "small", "negligible"]
    names = {"temp_c": "Temperature"}
    df = spark.createDataFrame([(1.0,)], "temp_c double")
    assert vl.to_internal_names(vl.to_display_names(df, names), names).columns == ["temp_c"]
    assert vl.first_containing(df, "temp") == "temp_c" and vl.first_present(df, ["a", "temp_c"]) == "temp_c"
