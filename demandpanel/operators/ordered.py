"""Exact order statistics of raw columns without gathering a group in one task.

``percentile`` keeps every distinct value of a group in one hash map. That is right for a
daily panel, wrong for a raw column of billions of prices. Here the distinct values are
counted first (map-side combine absorbs hot values), sorted into ranges, summed inside each
range and shifted by the totals of the ranges below. The ranges come from Spark's range
partitioning, whose sampled bounds split any distribution evenly: clustered times, long tails,
a single key. The ranged values are staged with their range, so all branches of a plan agree
on it even if a lost executor makes one run again, and the raw rows are read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..session import staged


def ranged(counted: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """``counted`` and ``_cell``, the number of the row's range in (keys, value) order; staged.

    ``counted`` holds each (keys, value) once, so a hot value is one row and never fills a range.
    A key spans one range or several neighbouring ones.
    """
    return staged(counted.repartitionByRange(*keys, value).withColumn("_cell", F.spark_partition_id()))


def running_totals(cells: DataFrame, value: str, measures: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Running totals ``cum_<m>`` and ``total_<m>`` in value order, per key, of a ranged frame."""
    in_cell = Window.partitionBy(*keys, "_cell").orderBy(value)
    running = cells.withColumns({f"_run_{m}": F.sum(m).over(in_cell) for m in measures})
    per_cell = cells.groupBy(*keys, "_cell").agg(*[F.sum(m).alias(f"_sum_{m}") for m in measures])
    below = Window.partitionBy(*keys).orderBy("_cell")
    everything = Window.partitionBy(*keys)
    offsets = per_cell.select(
        *keys,
        "_cell",
        *[(F.sum(f"_sum_{m}").over(below) - F.col(f"_sum_{m}")).alias(f"_off_{m}") for m in measures],
        *[F.sum(f"_sum_{m}").over(everything).alias(f"total_{m}") for m in measures],
    )
    return running.join(offsets, [*keys, "_cell"]).select(
        *[c for c in cells.columns if c != "_cell"],
        *[(F.col(f"_off_{m}") + F.col(f"_run_{m}")).alias(f"cum_{m}") for m in measures],
        *[f"total_{m}" for m in measures],
    )


def cumulative(counted: DataFrame, value: str, measures: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Running totals ``cum_<m>`` and ``total_<m>`` in value order, per key.

    ``counted`` holds each (keys, value) once.
    """
    return running_totals(ranged(counted, value, keys), value, measures, keys)


def value_counts(df: DataFrame, value: str, keys: Sequence[str], n: str = "n",
                 weight: str | None = None) -> DataFrame:
    """Each (keys, value) once with its rows, or with the sum of ``weight``; NaN is missing.

    Rows without a key are left out here, before the first shuffle: every later join would drop
    them anyway, and only equal filters let the branches share one scan and one exchange.
    """
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    for c in (*keys, value):
        df = df.where(F.col(c).isNotNull())
        if df.schema[c].dataType in (FloatType(), DoubleType()):
            df = df.where(~F.isnan(c))
    return df.groupBy(*keys, value).agg(rows.alias(n))


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    keys: Sequence[str],
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key."""
    ranked = cumulative(value_counts(df, value, keys), value, ["n"], keys)
    return ranked.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[interpolated(value, p).alias(name) for name, p in probabilities.items()],
    )


def interpolated(value: str, p: float) -> Column:
    """Aggregate over a ranked frame that interpolates the quantile ``p``."""
    position = (F.col("total_n") - 1) * F.lit(p)
    first = F.col("cum_n") - F.col("n")

    def at(index: Column) -> Column:
        return F.max(F.when((first <= index) & (index < F.col("cum_n")), F.col(value)))

    low, high = at(F.floor(position)), at(F.ceil(position))
    return low + (high - low) * F.max(position - F.floor(position))


def average_ranks(df: DataFrame, value: str, keys: Sequence[str], out: str,
                  weight: str | None = None) -> DataFrame:
    """(keys, value, rank): the mean rank of each distinct value; ties share it."""
    ranked = cumulative(value_counts(df, value, keys, "n", weight), value, ["n"], keys)
    return ranked.select(
        *keys, value, (F.col("cum_n") - (F.col("n") - 1) / 2).alias(out),
    )


def panel_quantile(value: Column | str, p: float) -> Column:
    """Exact quantile of an already reduced panel (at most one row per day and node)."""
    return F.percentile(value, F.lit(p))
