"""Weather files: hourly tables, raw exports, scraped rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed
from ..functions.values import number, timestamp
from ..operators.panel import daily_weather
from .files import ROW_FILE, ROW_ID, STEM, _existing, file_name, read_by_header, station_name
from .records import RECORD, cells, records


def panel_names(df: DataFrame) -> DataFrame:
    """Add panel columns from the hourly names unless they exist already."""
    new = {new: number(old) for old, new in fixed.WEATHER_PANEL_NAMES.items()
           if old in df.columns and new not in df.columns}
    return df.withColumns(new)


def hourly_weather(spark: SparkSession, path, pattern: str = "*.csv", stem: str = STEM) -> DataFrame | None:
    """Hourly rows of all stations: station from the path, numbers and times parsed.

    ``stem`` is the pattern whose first group is the name holding the station.
    """
    rows = read_by_header(spark, path, pattern)
    if rows is None:
        return None
    name = station_name(F.regexp_extract(ROW_FILE, stem, 1))
    time = "timestamp" if "timestamp" in rows.columns else rows.columns[0]
    parsed = rows.withColumn("station", name).withColumn("timestamp", timestamp(f"`{time}`"))
    numbers = {c: number(c) for c in fixed.HOURLY_NUMBERS if c in parsed.columns}
    return parsed.withColumns(numbers).where("timestamp is not null").drop(ROW_FILE, ROW_ID)


def station_weather(spark: SparkSession, path, pattern: str = "jma_*.csv", stem: str = STEM) -> DataFrame | None:
    """The multi-station table under its dashboard names."""
    rows = hourly_weather(spark, path, pattern, stem)
    return None if rows is None else rows.withColumnsRenamed(fixed.WEATHER_DASHBOARD_NAMES)


def weather_daily(spark: SparkSession, primary: str, legacy: str | None = None, stem: str = STEM) -> DataFrame:
    """Daily weather of the primary file, else of the legacy file, else an error."""
    path = next((p for p in (primary, legacy) if p and _existing(spark, p)), None)
    if path is None:
        raise FileNotFoundError(f"no weather file at {primary}" + (f" or {legacy}" if legacy else ""))
    return daily_weather(panel_names(hourly_weather(spark, path, stem=stem)), keys=())


def node_weather_daily(spark: SparkSession, path, pattern: str = "*.csv", stem: str = STEM) -> DataFrame:
    """Daily temp, precip, wind and snow depth per station; no file gives an empty frame."""
    rows = hourly_weather(spark, path, pattern, stem)
    if rows is None:
        return spark.createDataFrame(
            [], "station string, date date, temp double, precip double, wind double, snow_depth double")
    named = panel_names(rows)
    absent = {c: F.lit(None).cast("double") for c in ("temp", "precip", "wind", "snow_depth") if c not in named.columns}
    daily = daily_weather(named.withColumns(absent), means=("temp", "wind", "snow_depth"))
    return daily.select("station", "date", "temp", "precip", "wind", "snow_depth")


def raw_exports(spark: SparkSession, path, encoding: str = "cp932") -> DataFrame:
    """Raw station exports to hourly rows, all files of a folder at once.

    Each file has its own preamble, repeated labels and width. Its header is its first
    record that begins with the time's label; that one and the two after it, found by
    their numbers, become one row of field positions that data records join by file.
    Value columns are the ones whose quality cell is empty; of the wind columns the
    one not marked as direction. Blank lines don't count as records.
    """
    rows = records(spark, path, "*.csv", encoding).select(ROW_FILE, ROW_ID, cells(RECORD, "").alias("_c"))
    heads = rows.filter(F.get("_c", F.lit(0)) == fixed.RAW_EXPORT_TIME).groupBy(ROW_FILE).agg(F.min(ROW_ID).alias("_head"))
    top = rows.join(heads, ROW_FILE).withColumn("_n", F.col(ROW_ID) - F.col("_head"))

    def line(n: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("_n") == n, F.col("_c"))), F.array().cast("array<string>"))

    parts = top.filter(F.col("_n").between(0, 2)).groupBy(ROW_FILE, "_head").agg(
        line(0).alias("_labels"), line(1).alias("_extra"), line(2).alias("_quality"))
    index = F.sequence(F.lit(0), F.size("_labels") - 1)

    def matching(label: str) -> Column:
        return F.filter(index, lambda i: (F.get("_labels", i) == label) & (F.get("_quality", i) == ""))

    wind = matching(fixed.RAW_EXPORT_WIND)
    speed = F.filter(wind, lambda i: F.coalesce(F.get("_extra", i), F.lit("")) != fixed.RAW_EXPORT_WIND_DIRECTION)
    where = {name: F.get(matching(label), F.lit(0)) for label, name in fixed.RAW_EXPORT_LABELS.items()}
    where["wind_speed_ms"] = F.coalesce(F.get(speed, F.lit(0)), F.get(wind, F.lit(0)))
    positions = parts.select(
        ROW_FILE, "_head", (F.array_position("_labels", fixed.RAW_EXPORT_TIME) - 1).cast("int").alias("_time"),
        *[p.alias(f"_p_{name}") for name, p in where.items()],
    )
    data = rows.join(positions, ROW_FILE).where(F.col(ROW_ID) >= F.col("_head") + 3)

    def cell(name: str) -> Column:
        return F.get("_c", F.col(f"_p_{name}"))

    return data.select(
        timestamp(F.get("_c", F.col("_time"))).alias("timestamp"),
        *[(F.nullif(F.trim(cell(c)), F.lit("")) if c == "weather_type" else number(cell(c))).alias(c)
          for c in fixed.HOURLY_COLUMNS if c != "timestamp"],
        file_name(ROW_FILE).alias("source_file"),
    ).where("timestamp is not null")


def clean_cell(c: Column | str) -> Column:
    """Scraped cell without quality flags; markers of absence become the empty text."""
    text = F.trim(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")))
    return F.when(text.isin(*fixed.MISSING_CELLS), "").otherwise(F.trim(F.regexp_replace(text, r"[)\]]+$", "")))


def find_column(columns: Sequence[str], *keywords: str) -> str | None:
    return next((c for c in columns if all(k in c for k in keywords)), None)


# Scraped table heading keyword -> hourly name (fixed values).
SCRAPED_HEADINGS = {
    "降水量": "precip_1h_mm", "気温": "temp_c", "湿度": "humidity_pct", "風速": "wind_speed_ms",
    "日照": "sun_1h_h", "降雪": "snowfall_1h_cm", "積雪": "snow_depth_cm", "天気": "weather_type",
}


def scraped_rows(df: DataFrame, date: str = "date", headings: Mapping[str, str] = SCRAPED_HEADINGS) -> DataFrame:
    """Hourly rows of scraped tables already in a frame with their date.

    Rows whose hour is not a number are dropped; hour 24 is midnight of the next day.
    """
    hour = clean_cell(find_column(df.columns, "時"))
    found = {name: find_column(df.columns, key) for key, name in headings.items()}
    rows = df.withColumn("_hour", hour).where(F.col("_hour").rlike(r"^\d+$"))
    start = F.col(date).cast("timestamp_ntz")
    out = rows.select(
        (start + F.make_dt_interval(hours=F.col("_hour").cast("int"))).alias("timestamp"),
        *[clean_cell(c).alias(name) for name, c in found.items() if c is not None],
    )
    return canonical_columns(out)


def canonical_columns(df: DataFrame, columns: Sequence[str] = fixed.HOURLY_COLUMNS) -> DataFrame:
    """The hourly columns in their order, absent ones as empty text."""
    return df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns])
