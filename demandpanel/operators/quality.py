"""Audits: schema, column profile, date gaps, drift, domain checks and their roll-up."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.values import number
from ..session import staged
from .correlation import ks_two_sample, with_ks_p
from .ordered import interpolated, ranged, running_totals, value_counts
from .panel import date_gaps

PROFILE = ("mean", "std", "min", "max", "q25", "q75")


def schema_difference(df: DataFrame, expected: Sequence[str]) -> tuple[list[str], list[str]]:
    """(missing, extra) column names, sorted; reads the schema only."""
    actual = set(df.columns)
    return sorted(set(expected) - actual), sorted(actual - set(expected))


def schema_report(df: DataFrame, source: str, expected: Sequence[str]) -> DataFrame:
    """The schema difference as a frame (source, kind, column)."""
    missing, extra = schema_difference(df, expected)
    rows = [(source, "missing", c) for c in missing] + [(source, "extra", c) for c in extra]
    return df.sparkSession.createDataFrame(rows, "source string, kind string, column string")


def melt(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, column, value): several columns as one long column of numbers."""
    kinds = dict(df.dtypes)
    def as_number(c):
        return number(c) if kinds[c] == "string" else F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    pairs = [F.struct(F.lit(c).alias("column"), as_number(c).alias("value")) for c in columns]
    return df.select(*keys, F.explode(F.array(*pairs)).alias("_p")).select(*keys, "_p.column", "_p.value")


def profile_columns(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), z_limit: float = 3.5) -> DataFrame:
    """Per column: rows, missing, share, moments, quartiles and two outlier counts.

    Moments come from one scan with partial aggregation; quartiles and outliers from the
    distinct values with their counts, which few staged groups join by a broadcast. All-missing
    columns report NULLs.
    """
    groups = [*keys, "column"]
    long = melt(df, columns, keys)
    present = ranged(value_counts(long, "value", groups), "value", groups)
    ranked = running_totals(present, "value", ["n"], groups)
    x, n = F.col("value"), F.col("n")
    basic = long.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(x.isNull()).alias("n_missing"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
    )
    quartiles = ranked.groupBy(*groups).agg(
        interpolated("value", 0.25).alias("q25"), interpolated("value", 0.75).alias("q75"))
    stats = staged(basic.join(quartiles, groups, "left"))
    iqr = F.col("q75") - F.col("q25")
    beyond = (x < F.col("q25") - 1.5 * iqr) | (x > F.col("q75") + 1.5 * iqr)
    far = (F.col("std") > 0) & (F.abs(x - F.col("mean")) > z_limit * F.col("std"))
    outliers = present.join(stats.select(*groups, "mean", "std", "q25", "q75"), groups).groupBy(*groups).agg(
        F.coalesce(F.sum(F.when(beyond, n)), F.lit(0)).alias("n_outliers_iqr"),
        F.coalesce(F.sum(F.when(far, n)), F.lit(0)).alias("n_outliers_zscore"),
    )
    return stats.join(outliers, groups, "left").select(
        *groups, "n_total", "n_missing",
        F.bround(F.col("n_missing") / F.greatest("n_total", F.lit(1)) * 100, 2).alias("pct_missing"),
        *PROFILE,
        F.coalesce("n_outliers_iqr", F.lit(0)).alias("n_outliers_iqr"),
        F.coalesce("n_outliers_zscore", F.lit(0)).alias("n_outliers_zscore"),
    )


def drift(df: DataFrame, date: str, columns: Sequence[str], keys: Sequence[str] = (), window_months: int = 3,
          min_rows: int = 30, min_block: int = 10) -> DataFrame:
    """Kolmogorov–Smirnov distance between neighbouring blocks of observed months.

    Rows shrink to (column, month, value, n) first, staged: raw rows are read once. Observed
    months, not calendar months, are numbered in order and cut into blocks; each block counts
    once as the later and once as the earlier side of a pair, so there is no self-join. Months
    and moments are staged too, so that few of them are broadcast and no values move for them.
    """
    groups = [*keys, "column"]
    month = F.trunc(F.col(date).cast("date"), "MM")
    counted = staged(
        melt(df.withColumn("_month", month).where("_month is not null"), columns, [*keys, "_month"])
        .where("value is not null").groupBy(*groups, "_month", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    months = counted.groupBy(*groups, "_month").agg(F.sum("n").alias("_rows"))
    order, whole = Window.partitionBy(*groups).orderBy("_month"), Window.partitionBy(*groups)
    numbered = staged(months.select(
        *groups, "_month",
        F.floor((F.row_number().over(order) - 1) / window_months).alias("block"),
        F.sum("_rows").over(whole).alias("_all"),
    ).where(F.col("_all") >= min_rows).drop("_all"))
    rows = counted.join(numbered, [*groups, "_month"])
    both = rows.select(*groups, "_month", "value", "n", F.explode(F.array(
        F.struct(F.col("block").alias("pair"), F.lit(True).alias("is_a")),
        F.struct((F.col("block") - 1).alias("pair"), F.lit(False).alias("is_a")),
    )).alias("_s")).select(*groups, "_month", "value", "n", "_s.*")
    pair = [*groups, "pair"]
    n, x, a = F.col("n"), F.col("value"), F.col("is_a")
    sides = both.groupBy(*pair, "value").agg(
        F.coalesce(F.sum(F.when(a, n)), F.lit(0)).alias("n_a"), F.coalesce(F.sum(F.when(~a, n)), F.lit(0)).alias("n_b"),
    )
    ks = ks_two_sample(sides, "value", pair).where((F.col("n_a") >= min_block) & (F.col("n_b") >= min_block))

    def side(flag: Column, tag: str):
        weight = F.when(flag, n)
        mean = F.sum(x * weight) / F.sum(weight)
        return [
            F.date_format(F.min(F.when(flag, F.col("_month"))), "yyyy-MM").alias(f"first_{tag}"),
            F.date_format(F.max(F.when(flag, F.col("_month"))), "yyyy-MM").alias(f"last_{tag}"),
            mean.alias(f"mean_{tag}"),
        ]

    moments = staged(both.groupBy(*pair).agg(*side(a, "a"), *side(~a, "b")))
    spread = sides.join(moments.select(*pair, "mean_a", "mean_b"), pair).groupBy(*pair).agg(*[
        F.sqrt(F.sum(F.col(f"n_{t}") * F.pow(x - F.col(f"mean_{t}"), F.lit(2))) / F.nullif(F.sum(f"n_{t}"), F.lit(0)))
        .alias(f"std_{t}") for t in ("a", "b")
    ])
    return (
        ks.join(moments, pair).join(spread, pair)
        .select(
            *pair,
            F.concat("first_a", F.lit("–"), "last_a").alias("period_a"),
            F.concat("first_b", F.lit("–"), "last_b").alias("period_b"),
            "n_a", "n_b", "mean_a", "mean_b", "std_a", "std_b",
            "ks_statistic",
        )
    )


def drift_report(df: DataFrame, date: str, columns: Sequence[str], keys: Sequence[str] = (), **options) -> DataFrame:
    """Drift with its p-value and the flag p < 0.05."""
    return with_ks_p(drift(df, date, columns, keys, **options)).withColumn(
        "drift_detected", F.col("ks_pvalue") < 0.05)


def domain_violations(df: DataFrame, rules: dict[str, tuple[str, Column]], keys: Sequence[str] = ()) -> DataFrame:
    """Rows that break each rule, all rules in one aggregate.

    ``rules`` maps a name to (severity, violating condition).
    """
    aggs = [F.count_if(F.coalesce(c, F.lit(False))).alias(f"_r{i}") for i, (_, c) in enumerate(rules.values())]
    parts = ", ".join(f"'{name}', '{kind}', _r{i}" for i, (name, (kind, _)) in enumerate(rules.items()))
    return df.groupBy(*keys).agg(*aggs).select(
        *keys, F.expr(f"stack({len(rules)}, {parts}) as (rule, severity, violations)"))


def weather_rules(columns: Sequence[str]) -> dict[str, tuple[str, Column]]:
    rules = {
        "temp_too_low": ("warning", "temp_c", lambda c: c < -40),
        "temp_too_high": ("warning", "temp_c", lambda c: c > 50),
        "negative_precipitation": ("error", "precip_1h_mm", lambda c: c < 0),
        "extreme_wind": ("warning", "wind_speed_ms", lambda c: c > 60),
    }
    return {k: (kind, test(F.col(c))) for k, (kind, c, test) in rules.items() if c in columns}


def _lines(spark: SparkSession, source: str, rows: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(source, k, v) for k, v in rows], "source string, severity string, message string")


def _violation_lines(violations: DataFrame, source: str) -> DataFrame:
    return violations.where("violations > 0").select(
        F.lit(source).alias("source"), "severity",
        F.format_string("%s: %d rows", F.col("rule"), F.col("violations")).alias("message"))


def _gap_line(df: DataFrame, date: str, source: str) -> DataFrame:
    gaps = date_gaps(df, date, keys=()).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    return gaps.select(F.lit(source).alias("source"), F.lit("warning").alias("severity"),
                       F.format_string("%d date gaps", F.col("n")).alias("message"))


def _drift_lines(report: DataFrame, source: str) -> DataFrame:
    return report.where("drift_detected").select(
        F.lit(source).alias("source"), F.lit("drift").alias("severity"),
        F.concat_ws(" ", "column", "period_a", "period_b").alias("message"))


def _rows_line(df: DataFrame, source: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(source).alias("source"), F.lit("rows").alias("severity"), F.col("n").cast("string").alias("message"))


def _profile_lines(df: DataFrame, columns: Sequence[str], source: str) -> DataFrame:
    """Rows and missing values of each column, all in one aggregate."""
    aggs = [F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_m{i}") for i, c in enumerate(columns)]]
    lines = F.array(*[F.format_string("%s: %d rows, %d missing", F.lit(c), F.col("_n"), F.col(f"_m{i}")) for i, c in enumerate(columns)])
    return df.agg(*aggs).select(F.lit(source).alias("source"), F.lit("profile").alias("severity"), F.explode(lines).alias("message"))


def guarded(spark: SparkSession, sources: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """Findings of all sources, each audited in a plan of its own.

    A source that can't be read or audited becomes one error line that names the kind of
    failure; the others are audited all the same. Findings are few, so each source's are
    written and read again, which is what makes a failure its own.
    """
    parts = []
    for source, build in sources.items():
        try:
            parts.append(staged(build()))
        except Exception as failure:  # whatever a source does is a finding about it
            parts.append(_lines(spark, source, [("error", f"could not be audited: {type(failure).__name__}")]))
    return _union(parts)


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def audit_camera(daily: DataFrame, source: str, missing: Sequence[str] = ()) -> DataFrame:
    """Findings of a camera feed reduced to (date, count)."""
    spark = daily.sparkSession
    parts = [
        _rows_line(daily, source), _gap_line(daily, "date", source),
        _lines(spark, source, [("error", f"missing column {c}") for c in missing]),
        _violation_lines(domain_violations(daily, {"zero_count_days": ("warning", F.col("count") == 0)}), source),
        _profile_lines(daily, ["count"], source), _drift_lines(drift_report(daily, "date", ["count"]), source),
    ]
    return _union(parts)


def audit_weather(hourly: DataFrame, source: str, expected: Sequence[str], time: str = "timestamp") -> DataFrame:
    """Findings of an hourly weather table; negative rain is an error."""
    missing, _ = schema_difference(hourly, expected)
    drifting = [c for c in ("temp_c", "precip_1h_mm", "wind_speed_ms") if c in hourly.columns]
    rules = weather_rules(hourly.columns)
    parts = [
        _rows_line(hourly, source), _gap_line(hourly, time, source),
        _lines(hourly.sparkSession, source, [("warning", f"missing column {c}") for c in missing]),
    ]
    if rules:
        parts.append(_violation_lines(domain_violations(hourly, rules), source))
    if drifting:
        parts += [_profile_lines(hourly, drifting, source), _drift_lines(drift_report(hourly, time, drifting), source)]
    return _union(parts)


def audit_survey(survey: DataFrame, source: str, expected_parts: Sequence[str], score: str = "satisfaction",
                 place: str = "prefecture") -> DataFrame:
    """Findings of a survey table; expected headings match by part of their name, missing places are counted."""
    absent = [p for p in expected_parts if not any(p in c for c in survey.columns)]
    parts = [_rows_line(survey, source),
             _lines(survey.sparkSession, source, [("warning", f"no column containing {p}") for p in absent])]
    shown = [c for c in (place, score) if c in survey.columns]
    if shown:
        parts.append(_profile_lines(survey, shown, source))
    if score in survey.columns:
        value = F.col(score).cast("double")
        parts.append(_violation_lines(domain_violations(
            survey, {"score_outside_1_to_5": ("warning", (value < 1) | (value > 5))}), source))
    return _union(parts)


def audit_rollup(findings: DataFrame) -> DataFrame:
    """One row over all sources: rows, warnings, errors, drift events and the verdict."""
    def count(kind):
        return F.count_if(F.col("severity") == kind)
    return findings.agg(
        F.count_distinct("source").alias("sources"),
        F.sum(F.when(F.col("severity") == "rows", F.col("message").cast("bigint"))).alias("total_rows"),
        count("warning").alias("warnings"), count("error").alias("errors"), count("drift").alias("drift_events"),
        (count("error") == 0).alias("passed"),
    )


def source_status(sources: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Rows and distinct groups found per source; a source without rows is unavailable."""
    parts = []
    for name, (df, group) in sources.items():
        distinct = F.count_distinct(group) if group else F.lit(0).cast("bigint")
        parts.append(df.agg(F.count(F.lit(1)).alias("rows"), distinct.alias("groups")).select(
            F.lit(name).alias("source"), "rows", "groups", (F.col("rows") > 0).alias("available")))
    return _union(parts)
