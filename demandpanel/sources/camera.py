"""Camera counts: one CSV per site and day, the date is in the path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.values import number
from .files import ROW_FILE, STEM, _existing, first_files, read_by_header

REQUIRED = ("aggregate from", "total count")
FILE_SCHEMA = "day string, count double, file string"


def camera_file_counts(spark: SparkSession, path, stem: str = STEM) -> DataFrame:
    """(day, count, file): total per file; files without the needed columns, and unreadable ones, are left out.

    ``stem`` is the pattern whose first group is the day, by default the file's stem.
    """
    rows = read_by_header(spark, path, required=REQUIRED, skip_unreadable=True)
    if rows is None:
        return spark.createDataFrame([], FILE_SCHEMA)
    return rows.groupBy(F.col(ROW_FILE).alias("file")).agg(
        F.coalesce(F.sum(number("total count")), F.lit(0.0)).alias("count"),
    ).select(F.regexp_extract("file", stem, 1).alias("day"), "count", "file")


def camera_daily(spark: SparkSession, path, stem: str = STEM) -> DataFrame:
    """(date, count): outage days of count 0 removed, several files of a day stay several rows."""
    counts = camera_file_counts(spark, path, stem)
    return counts.select(F.to_date("day").alias("date"), "count").where(F.col("count") > 0)


def camera_daily_kept(spark: SparkSession, path, stem: str = STEM, node: str | None = None) -> DataFrame:
    """(node, date, count): zero days kept, one row per day, unreadable dates dropped.

    ``node`` is a pattern on the path whose first group names the site.
    """
    counts = camera_file_counts(spark, path, stem)
    # A function of the file even for a single site, so that it is not folded out of joins.
    site = F.regexp_extract("file", node, 1) if node else F.concat(F.lit("all"), F.substring("file", 1, 0))
    return (
        counts.select(site.alias("node"), F.col("day").try_cast("date").alias("date"), "count")
        .where("date is not null").groupBy("node", "date").agg(F.sum("count").alias("count"))
    )


def camera_preview(spark: SparkSession, path, n: int = 50) -> DataFrame | None:
    """The first ``n`` files of a folder, in the order of their paths, as they are (a preview, so the cut is the feature)."""
    if not _existing(spark, path):
        return None
    paths = first_files(spark, path, n)
    return read_by_header(spark, paths) if paths else None
