"""Search intent and survey tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed
from ..functions.survey import digits, satisfaction_from_recommendation, spending_midpoint
from ..functions.text import join_non_empty
from ..functions.values import day, first_containing, first_present, lookup, number, timestamp
from ..operators.summaries import longest_text_column
from .files import ROW_FILE, ROW_ID, _existing, read_by_header, rows_per_file

INTENT_CANDIDATES = ("directions", "ルート検索", "route_searches")


def intent_daily(spark: SparkSession, root: str) -> tuple[DataFrame, str]:
    """Intent of all year folders, first row per date in path and row order, and its column."""
    rows = read_by_header(spark, f"{root}/*/*total_daily_metrics.csv")
    if rows is None:
        raise FileNotFoundError(f"no intent files under {root}")
    route = first_present(rows, INTENT_CANDIDATES)
    if route is None:
        raise ValueError("no route search column in the intent files")
    date = "date" if "date" in rows.columns else rows.columns[0]
    values = [c for c in rows.columns if c not in (date, ROW_FILE, ROW_ID)]
    parsed = rows.select(day(date).alias("date"), *[number(f"`{c}`").alias(c) for c in values], ROW_FILE, ROW_ID)
    return first_intent(parsed, values, [ROW_FILE, ROW_ID]), route


def first_intent(df: DataFrame, values: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per date, by ``min_by`` so partial aggregation shrinks the shuffle."""
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in values]), F.struct(*order))
    return df.where("date is not null").groupBy("date").agg(first.alias("_r")).select("date", "_r.*")


#: Names for the first two fields of a survey file: its prefecture and its day, whatever the header says.
FIRST, SECOND = "_first", "_second"


def _survey(spark: SparkSession, path, pattern: str) -> DataFrame | None:
    return read_by_header(spark, path, pattern, leading=(FIRST, SECOND))


def _by_position(df: DataFrame) -> tuple[str, str]:
    """The first two fields by position, of each file where they are known apart."""
    return (FIRST, SECOND) if FIRST in df.columns else (f"`{df.columns[0]}`", f"`{df.columns[1]}`")


def survey_prefectures(spark: SparkSession, path, pattern: str = "*.csv") -> DataFrame:
    """(prefecture, date) from the first two columns; rows without a date dropped."""
    rows = _survey(spark, path, pattern)
    if rows is None:
        return spark.createDataFrame([], "prefecture string, date date")
    pref, date = _by_position(rows)
    return rows.select(F.col(pref).alias("prefecture"), day(date).alias("date")).where("date is not null")


def satisfaction_columns(rows: DataFrame) -> DataFrame:
    """Scores, place and texts of a merged survey; absent columns are filled."""
    pref, date = _by_position(rows)
    have = set(rows.columns)

    def score(heading):
        return number(f"`{heading}`") if heading in have else F.lit(None).cast("double")

    def words(heading):
        return F.coalesce(F.col(f"`{heading}`"), F.lit("")) if heading in have else F.lit("")

    return rows.select(
        F.col(pref).alias("prefecture"), day(date).alias("date"),
        score(fixed.TRIP_SATISFACTION).alias("satisfaction"),
        score(fixed.SERVICE_SATISFACTION).alias("satisfaction_service"),
        (digits(f"`{fixed.RECOMMENDATION}`") if fixed.RECOMMENDATION in have else F.lit(None).cast("double")).alias("nps_raw"),
        words(fixed.ANSWER_PLACE).alias("location"),
        *[words(h).alias(h) for h in fixed.SURVEY_TEXT_HEADINGS],
    ).where("date is not null")


def survey_satisfaction(spark: SparkSession, path, pattern: str = "*.csv") -> DataFrame:
    rows = _survey(spark, path, pattern)
    if rows is None:
        return spark.createDataFrame(
            [], "prefecture string, date date, satisfaction double, satisfaction_service double, nps_raw double")
    return satisfaction_columns(rows)


def text_columns(rows: DataFrame) -> DataFrame:
    """Satisfaction and the three free texts, columns found by part of their name."""
    pref, date = _by_position(rows)
    score = first_containing(rows, fixed.TRIP_SATISFACTION)
    texts = {
        "reason": first_containing(rows, "満足度理由", excluding="サービス"),
        "inconvenience": first_containing(rows, "不便"),
        "freetext": first_containing(rows, "自由意見"),
    }
    return rows.select(
        F.col(pref).alias("prefecture"), timestamp(date).alias("date"),
        (number(f"`{score}`") if score else F.lit(None).cast("double")).alias("satisfaction"),
        *[(F.coalesce(F.col(f"`{c}`"), F.lit("")) if c else F.lit("")).alias(n) for n, c in texts.items()],
    ).where("date is not null")


def survey_text(spark: SparkSession, path, pattern: str = "*.csv") -> DataFrame:
    rows = _survey(spark, path, pattern)
    if rows is None:
        return spark.createDataFrame(
            [], "prefecture string, date timestamp_ntz, satisfaction double, reason string, inconvenience string, freetext string")
    return text_columns(rows)


def with_spending(rows: DataFrame, band: str = "県内消費額", time: str = "回答日時") -> DataFrame:
    """Spending midpoint and date of a raw survey."""
    out = rows
    if band in rows.columns:
        out = out.withColumn("spending_midpoint", spending_midpoint(band))
    return out.withColumn("date", day(time) if time in rows.columns else F.lit(None).cast("date"))


def raw_survey(spark: SparkSession, path: str) -> DataFrame | None:
    """The raw survey with spending midpoint and date; None if the file is absent."""
    if not _existing(spark, path):
        return None
    rows = _survey(spark, path, "*.csv")
    return None if rows is None else with_spending(rows.drop(ROW_FILE, ROW_ID, FIRST, SECOND))


def choose_survey_file(spark: SparkSession, folder: str, preferred: str = "all.csv",
                       min_rows: int = 10, min_columns: int = 5) -> str | None:
    """``preferred`` if it has more than ``min_rows`` rows, else the longest wide CSV.

    The rule is the data's own: a main file that holds almost nothing is a stub. Records
    of all files are counted in one job; one row comes back.
    """
    if not _existing(spark, folder):
        return None
    files = rows_per_file(spark, folder)
    liked = F.col("file").endswith("/" + preferred) & (F.col("rows") > min_rows)
    usable = files.where(liked | (F.col("columns") > min_columns))
    best = usable.orderBy(liked.desc(), F.col("rows").desc(), "file").first()
    return None if best is None else best["file"]


def normalise_survey(rows: DataFrame) -> DataFrame:
    """Survey under its English names with satisfaction, date and one combined free text.

    Satisfaction comes from a label column, else from the recommendation score, else NULL.
    Without known text columns the column with the longest texts is taken.
    """
    heading = first_present(rows, fixed.SURVEY_SATISFACTION_HEADINGS)
    out = rows.withColumnsRenamed({k: v for k, v in fixed.SURVEY_NAMES.items() if k in rows.columns})
    if "nps_score" in out.columns:
        out = out.withColumn("nps_score", number("nps_score"))
    if heading is not None:
        score = lookup(F.col(f"`{heading}`"), fixed.SATISFACTION_SCORES, "double")
    elif "nps_score" in out.columns:
        score = satisfaction_from_recommendation("nps_score")
    else:
        score = F.lit(None).cast("double")
    out = out.withColumn("satisfaction", score)
    if "date" in out.columns:
        out = out.withColumn("date", timestamp("date"))
    parts = [c for c in fixed.SURVEY_TEXT_COLUMNS if c in out.columns]
    if parts:
        return out.withColumn("free_text", join_non_empty(parts))
    fallback = longest_text_column(out)
    return out.withColumn("free_text", F.col(fallback) if fallback else F.lit(None).cast("string"))
