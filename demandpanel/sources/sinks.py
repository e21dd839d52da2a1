"""Sinks. A path being read is never overwritten; repeated runs may skip existing output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed
from . import versions


def write_hourly(df: DataFrame, path: str, columns: Sequence[str] = fixed.HOURLY_COLUMNS,
                 overwrite: bool = True, fmt: str = "csv") -> str:
    """The merged hourly table at a new path, columns in canonical order.

    ``overwrite=False`` leaves existing output alone.
    """
    keep = [c for c in ("station", *columns) if c in df.columns]
    mode = "overwrite" if overwrite else "ignore"
    df.select(*keep).write.mode(mode).option("header", True).format(fmt).save(path)
    return path


def hourly_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version of a merged hourly table as text columns in canonical order; None before the first."""
    number = versions.latest(spark, path)
    if number is None:
        return None
    return spark.read.option("header", True).schema(", ".join(f"{c} string" for c in fixed.HOURLY_COLUMNS)).csv(f"{path}/version={number}")


def upsert_hourly(new: DataFrame, path: str, source: str = "source_file", columns: Sequence[str] = fixed.HOURLY_COLUMNS) -> int:
    """Merges new hourly rows into the table at ``path``, new rows winning, and returns the version's number.

    Of new rows of one time the one of the last source counts; rows without a time go.
    The version is CSV, one row a time in order of time, all canonical columns, absent ones empty.
    """
    spark = new.sparkSession
    kept = new.where(F.col("timestamp").isNotNull())
    order = [F.col(source).cast("string")] if source in new.columns else [F.lit("")]
    ready = kept.select(*[F.col(c).cast("string").alias(c) if c in new.columns else F.lit(None).cast("string").alias(c) for c in columns], *[o.alias("_source") for o in order])
    fresh = ready.withColumn("_new", F.lit(True))
    before = hourly_table(spark, path)
    if before is not None:
        fresh = fresh.unionByName(before.withColumns({"_source": F.lit(""), "_new": F.lit(False)}))
    values = [c for c in columns if c != "timestamp"]
    last = F.max_by(F.struct(*values), F.struct("_new", "_source", F.struct(*values)))
    merged = fresh.groupBy("timestamp").agg(last.alias("_r")).select("timestamp", "_r.*").select(*columns)
    number = (versions.latest(spark, path) or 0) + 1
    merged.orderBy("timestamp").write.mode("overwrite").option("header", True).csv(f"{path}/version={number}")
    versions.publish(spark, path, number)
    if number > 2:
        versions.remove(spark, f"{path}/version={number - 2}")
    return number


def write_monthly(df: DataFrame, path: str, overwrite: bool = False) -> str:
    """One folder per year and month, canonical columns, absent columns filled."""
    ready = df.select(*[
        F.col(c).cast("string").alias(c) if c in df.columns else F.lit("").alias(c) for c in fixed.HOURLY_COLUMNS
    ]).withColumns({"year": F.substring("timestamp", 1, 4), "month": F.substring("timestamp", 6, 2)})
    mode = "overwrite" if overwrite else "ignore"
    ready.write.mode(mode).partitionBy("year", "month").option("header", True).csv(path)
    return path


def write_report(findings: DataFrame, path: str) -> str:
    """Audit findings as JSON lines."""
    findings.write.mode("overwrite").json(path)
    return path


def metric_rows(df: DataFrame, section: str, keys: Sequence[str] = ()) -> DataFrame:
    """A result frame as (section, key, value) rows; key columns prefix the metric's name."""
    metrics = [c for c in df.columns if c not in keys]
    prefix = F.concat_ws(".", *[F.col(k).cast("string") for k in keys]) if keys else None

    def name(c):
        return F.concat_ws(".", prefix, F.lit(c)) if prefix is not None else F.lit(c)

    pairs = F.array(*[F.struct(name(c).alias("key"), F.col(c).cast("string").alias("value")) for c in metrics])
    return df.select(F.lit(section).alias("section"), F.explode(pairs).alias("_p")).select("section", "_p.*")


def write_metrics(rows: DataFrame, path: str) -> str:
    """``key=value`` lines, one folder per section."""
    rows.select("section", F.concat_ws("=", "key", F.coalesce("value", F.lit("")))).write.mode("overwrite") \
        .partitionBy("section").text(path)
    return path
