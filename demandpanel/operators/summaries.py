"""Summaries behind charts and tables: counts, shares, histograms, box numbers, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import staged
from .ordered import interpolated, ranged, running_totals, value_counts


def group_means(df: DataFrame, keys: Sequence[str], columns: Sequence[str], digits: int | None = None) -> DataFrame:
    """Mean of several columns per group, optionally rounded half to even."""
    def mean(c):
        return F.avg(c) if digits is None else F.bround(F.avg(c), digits)
    return df.groupBy(*keys).agg(*[mean(c).alias(c) for c in columns])


def counts_by(df: DataFrame, keys: Sequence[str | Column], n: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))


def shares(df: DataFrame, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count and share of each label."""
    counted = counts_by(df.where(F.col(label).isNotNull()), [*keys, label])
    total = F.sum("n").over(Window.partitionBy(*(keys or [F.lit(1)])))  # over labels, not rows
    return counted.withColumn("share", F.col("n") / total)


def top_groups(df: DataFrame, group: str, score: str, min_rows: int = 5, top: int = 15) -> DataFrame:
    """Groups with enough scores, best mean first."""
    return (
        df.where(F.col(score).isNotNull() & F.col(group).isNotNull()).groupBy(group)
        .agg(F.avg(score).alias("mean"), F.count(score).alias("n"))
        .where(F.col("n") >= min_rows).orderBy(F.col("mean").desc(), group).limit(top)
    )


def score_brackets(df: DataFrame, score: str) -> DataFrame:
    """Rows per rounded score (half to even)."""
    return counts_by(df.where(F.col(score).isNotNull()), [F.bround(score, 0).cast("bigint").alias("bracket")])


def histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str] = (), label: str | None = None) -> DataFrame:
    """Equal-width bins from minimum to maximum; the maximum belongs to the last bin.

    The ranges are staged, so the planner knows their size: those of few keys are broadcast and
    no raw row moves; only so many keys that none holds a large share are joined by a shuffle.
    """
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull())
    groups = [*keys, *([label] if label else [])]
    if keys:
        span = staged(rows.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi")))
        rows = rows.join(span, list(keys))
    else:
        span = rows.select(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
        rows = rows.withColumn("_s", span).withColumns({"_lo": F.col("_s.lo"), "_hi": F.col("_s.hi")})
    width = (F.col("_hi") - F.col("_lo")) / bins
    step = F.floor((x - F.col("_lo")) / F.nullif(width, F.lit(0.0)))
    binned = rows.withColumn("bin", F.least(F.coalesce(step, F.lit(0)), F.lit(bins - 1)).cast("bigint") + 1)
    return binned.groupBy(*groups, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("_lo") + (F.col("bin") - 1) * width).alias("left"),
    )


def box_numbers(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at 1.5·IQR and outlier count of a raw column, exact at any size.

    Works on distinct values with their counts, so the second pass reads the reduced table; the
    staged quartiles of few keys are broadcast, and the values stay where they are.
    """
    cells = ranged(value_counts(df, value, keys), value, keys)
    quartiles = staged(running_totals(cells, value, ["n"], keys).groupBy(*keys).agg(
        *[interpolated(value, p).alias(c) for c, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))]))
    iqr = F.col("q3") - F.col("q1")
    x = F.col(value)
    inside = x.between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    return cells.select(*keys, value, "n").join(quartiles, list(keys)).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("q1").alias("q1"), F.min("median").alias("median"), F.min("q3").alias("q3"),
        F.min(F.when(inside, x)).alias("low_whisker"), F.max(F.when(inside, x)).alias("high_whisker"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("outliers"),
    )


def text_column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean length and distinct ratio of every text column in one aggregate."""
    columns = list(columns or [c for c, t in df.dtypes if t == "string"])
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.avg(F.length(c)).alias(f"_l{i}"),
                 (F.approx_count_distinct(c) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias(f"_r{i}")]
    parts = ", ".join(f"'{c}', _l{i}, _r{i}" for i, c in enumerate(columns))
    return df.agg(*aggs).select(F.expr(f"stack({len(columns)}, {parts}) as (column, mean_length, unique_ratio)"))


def longest_text_column(df: DataFrame, min_length: float = 15, min_ratio: float = 0.05) -> str | None:
    """Name of the text column with the longest mean text (one row is read)."""
    profile = text_column_profile(df).where((F.col("mean_length") > min_length) & (F.col("unique_ratio") > min_ratio))
    best = profile.orderBy(F.col("mean_length").desc(), "column").first()
    return None if best is None else best["column"]


def group_sizes(df: DataFrame, columns: Sequence[str], min_rows: int = 5) -> DataFrame:
    """For each candidate column the number of groups with enough rows, in one job."""
    parts = ", ".join(f"{i}, '{c}', cast(`{c}` as string)" for i, c in enumerate(columns))
    long = df.select(F.expr(f"stack({len(columns)}, {parts}) as (position, column, value)"))
    return (
        long.where("value is not null").groupBy("position", "column", "value").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("position", "column").agg(F.count_if(F.col("n") >= min_rows).alias("groups"))
    )


def grouping_column(df: DataFrame, candidates: Sequence[str], min_rows: int = 5, min_groups: int = 2) -> str | None:
    """First candidate with enough groups of enough rows."""
    present = [c for c in candidates if c in df.columns]
    if not present:
        return None
    row = group_sizes(df, present, min_rows).where(F.col("groups") >= min_groups).orderBy("position").first()
    return None if row is None else row["column"]


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable random sample: the ``n`` smallest digests of the key with the seed."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), key).limit(n)


def first_samples(df: DataFrame, key: str, text: str, n: int, chars: int) -> DataFrame:
    """The first ``n`` rows in key order, their text cut to ``chars``."""
    return df.orderBy(key).limit(n).withColumn(text, F.substring(text, 1, chars))

