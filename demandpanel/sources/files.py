"""CSV files whose headers differ, file names as data, encodings.

Spark gives every file of one read the header of the first. Here records are cut by
``records`` and each file's fields are taken by the positions of its own header.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .records import FILE as ROW_FILE, NUMBER as ROW_ID, by_header, file_path, headers, records

STEM = r"([^/]+)\.csv$"


def _existing(spark: SparkSession, path: str | Sequence[str]) -> bool:
    """Whether a path or glob names any file (asked of the file system, no job)."""
    paths = [path] if isinstance(path, str) else list(path)
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        hadoop = jvm.org.apache.hadoop.fs.Path(p)
        found = hadoop.getFileSystem(conf).globStatus(hadoop)
        if found is not None and len(found) > 0:
            return True
    return False


def header_names(header: str) -> list[str]:
    """Names of a header line; separators inside quotes belong to the name."""
    return [c.strip() for c in next(csv.reader([(header or "").lstrip("\ufeff")]), [""])]


def read_by_header(spark: SparkSession, path, pattern: str = "*.csv", required: Sequence[str] = (), encoding: str = "UTF-8",
                   skip_unreadable: bool = False, leading: Sequence[str] = ()) -> DataFrame | None:
    """All files as one frame of text columns, with the file and the record's number in it.

    Files lacking a required column are left out; None if none remain. ``leading`` names
    additional columns for the first fields of every file, taken by position.
    """
    if not _existing(spark, path):
        return None
    return by_header(records(spark, path, pattern, encoding, skip_unreadable), required, leading)


def first_files(spark: SparkSession, path, n: int, pattern: str = "*.csv") -> list[str]:
    """The first ``n`` files in the order of their paths; only paths are read, ``n`` of them come back."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return [r["path"] for r in found.select("path").orderBy("path").limit(n).collect()]


def file_name(c: Column | str = ROW_FILE) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(c, r"([^/]+)$", 1)


def station_name(stem: Column) -> Column:
    """Station of a weather file: parts before hourly/daily/monthly or a number."""
    name = F.regexp_replace(F.lower(stem), "^jma_", "")
    parts = F.split(name, "_")
    stop = F.array_position(F.transform(parts, lambda p: p.rlike(r"^(hourly|daily|monthly|\d+)$")), True)
    return (
        F.when(stop == 0, name)
        .when(stop == 1, name)
        .otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int")), "_"))
    )


def detect_encodings(spark: SparkSession, path, pattern: str = "*.csv") -> DataFrame:
    """(file, encoding): utf-8 or cp932 (which covers shift_jis).

    The text source does not decode, so each line is checked as it is: the whole file is
    judged and large files stay split over tasks. A byte order mark needs no encoding of its
    own, the readers drop it.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    return lines.groupBy(file_path().alias("file")).agg(
        F.when(F.bool_and(F.is_valid_utf8("value")), "utf-8").otherwise("cp932").alias("encoding"))


def rows_per_file(spark: SparkSession, path, pattern: str = "*.csv") -> DataFrame:
    """(file, rows, columns) of every CSV: records after the header, however many lines they take,
    and the fields of the header."""
    rows = records(spark, path, pattern, skip_unreadable=True)
    counted = rows.groupBy(ROW_FILE).agg((F.max(ROW_ID) - 1).alias("rows"))
    return counted.join(headers(rows), ROW_FILE).select(F.col(ROW_FILE).alias("file"), "rows", F.size("names").alias("columns"))
