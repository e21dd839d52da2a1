"""The daily panel: aggregation to days, joins, outliers, upserts, gaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.values import any_of, col, known, numeric_columns, sum_or_zero
from .ordered import panel_quantile

NODE = "all"


def with_node(df: DataFrame, name: str = NODE, of: str = "date") -> DataFrame:
    """Give a single-site frame the ``node`` key every operator expects.

    The key is written as a function of column ``of``: a plain literal would be folded out of
    later join conditions and turn joins on ``node`` into cross products.
    """
    if "node" in df.columns:
        return df
    nothing = F.coalesce(F.substring(F.col(of).cast("string"), 1, 0), F.lit(""))
    return df.select(F.concat(F.lit(name), nothing).alias("node"), *df.columns)


def daily_weather(
    hourly: DataFrame,
    keys: Sequence[str] = ("station",),
    time: str = "timestamp",
    sums: Sequence[str] = ("precip",),
    maxima: Sequence[str] = (),
    means: Sequence[str] = ("temp", "sun", "wind", "snow_depth", "humidity"),
) -> DataFrame:
    """Hours to days. Absent columns are skipped; ``snow_depth`` may be a mean or a maximum."""
    have = set(hourly.columns)
    aggs = [sum_or_zero(c).alias(c) for c in sums if c in have]
    aggs += [F.max(c).alias(c) for c in maxima if c in have]
    aggs += [F.avg(c).alias(c) for c in means if c in have]
    return hourly.groupBy(*keys, F.col(time).cast("date").alias("date")).agg(*aggs)


def daily_weather_by_name(
    hourly: DataFrame, keys: Sequence[str] = ("station",), time: str = "datetime",
) -> DataFrame:
    """Hours to days, the aggregate chosen by the column's name.

    precip / rain / snowfall are summed, snow_depth takes the maximum, the rest the mean.
    """
    sums, maxima, means = [], [], []
    for name in numeric_columns(hourly, exclude=keys):
        low = name.lower()
        if any(k in low for k in ("precip", "rain", "snowfall")):
            sums.append(name)
        elif "snow_depth" in low:
            maxima.append(name)
        else:
            means.append(name)
    return daily_weather(hourly, keys, time, sums, maxima, means)


def master_panel(
    counts: DataFrame,
    weather: DataFrame,
    intent: DataFrame,
    weather_keys: Sequence[str] = ("node", "date"),
    intent_keys: Sequence[str] = ("date",),
) -> DataFrame:
    """Counts ⟕ weather ⟕ intent, rows without a count dropped.

    All sides are daily aggregates; the planner picks broadcast or shuffle by size.
    """
    return (
        counts.join(weather, list(weather_keys), "left")
        .join(intent, list(intent_keys), "left")
        .where(F.col("count").isNotNull())
    )


def flag_outliers(
    panel: DataFrame, value: str = "count", keys: Sequence[str] = ("node",), out: str = "is_outlier",
) -> DataFrame:
    """Boolean flag outside the 1.5·IQR fences of the node."""
    group = Window.partitionBy(*keys)
    q1, q3 = panel_quantile(value, 0.25).over(group), panel_quantile(value, 0.75).over(group)
    x = F.col(value)
    return (
        panel.withColumns({"_q1": q1, "_q3": q3})
        .withColumn("_iqr", F.col("_q3") - F.col("_q1"))
        .withColumn(out, known(
            (x < F.col("_q1") - 1.5 * F.col("_iqr")) | (x > F.col("_q3") + 1.5 * F.col("_iqr"))
        ))
        .drop("_q1", "_q3", "_iqr")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key, by ``min_by``: partial aggregation, so a hot key costs nothing extra."""
    values = [c for c in df.columns if c not in keys]
    earliest = F.min_by(F.struct(*values), F.struct(*order))
    return df.groupBy(*keys).agg(earliest.alias("_row")).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    )


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, by ``max_by`` so that partial aggregation shrinks the shuffle."""
    values = [c for c in df.columns if c not in keys]
    latest = F.max_by(F.struct(*values), F.struct(*order))
    return df.groupBy(*keys).agg(latest.alias("_row")).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    )


def upsert(
    old: DataFrame, new: DataFrame, keys: Sequence[str], batch_order: Sequence[str],
) -> DataFrame:
    """New rows win over old ones; inside the batch the last row in ``batch_order`` wins."""
    batch = last_per_key(new, keys, batch_order)
    kept = old.join(batch.select(*keys), list(keys), "left_anti")
    columns = [c for c in old.columns if c in new.columns]
    return kept.select(*columns).unionByName(batch.select(*columns))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of frames whose columns differ; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def date_gaps(df: DataFrame, date: str = "date", keys: Sequence[str] = ("node",)) -> DataFrame:
    """Missing days between the first and last day of each key."""
    days = df.where(F.col(date).isNotNull()).select(*keys, F.col(date).cast("date").alias("date")).distinct()
    span = days.groupBy(*keys).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    calendar = span.select(*keys, F.explode(F.sequence("_a", "_b")).alias("date"))
    return calendar.join(days, [*keys, "date"], "left_anti")


def daily_counts_matching(
    df: DataFrame, column: str, keywords: Mapping[str, str], date: str = "date",
) -> DataFrame:
    """Rows per day whose text contains each keyword, all keywords in one scan.

    A count is NULL, not 0, on days without a match, as if joined from its own table.
    """
    hits = {out: F.count_if(known(F.col(column).contains(k))) for out, k in keywords.items()}
    return (
        df.where(any_of([known(F.col(column).contains(k)) for k in keywords.values()]))
        .groupBy(date)
        .agg(*[F.nullif(h, F.lit(0)).alias(out) for out, h in hits.items()])
    )


def range_and_rows(df: DataFrame, date: str = "date", keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.min(date).alias("first"), F.max(date).alias("last"), F.count(F.lit(1)).alias("rows"),
    )


def drop_zero_days(df: DataFrame, value: str = "count") -> DataFrame:
    return df.where(F.col(value) > 0)


def in_range(df: DataFrame, start, end, date: str = "date") -> DataFrame:
    """Closed date range; pushed into the Parquet scan."""
    return df.where(F.col(date).between(start, end))


def in_months(df: DataFrame, months: Sequence[int], date: str = "date") -> DataFrame:
    return df.where(F.month(F.col(date)).isin(*months))


def one_station(df: DataFrame, station: str, column: str = "station") -> DataFrame:
    """Rows of a station, or of the first station by name if it has none.

    One aggregate decides, as a scalar subquery.
    """
    chosen = df.select(F.coalesce(
        F.max(F.when(F.col(column) == station, F.col(column))), F.min(column),
    )).scalar()
    return df.where(F.col(column) == chosen)


def choose_proxy(primary: DataFrame, proxy: DataFrame) -> DataFrame:
    """``proxy`` only if ``primary`` has no row; the choice is part of the plan."""
    n = primary.limit(1).select(F.count(F.lit(1))).scalar()
    return primary.unionByName(proxy.select(*primary.columns).where(n == 0))


def proxy_counts(survey: DataFrame, columns: Sequence[str], pattern: str, date: str = "date") -> DataFrame:
    """Survey answers mentioning a place, per day, as a stand-in for visitor counts."""
    from ..functions.text import matches_any_column

    present = [c for c in columns if c in survey.columns]
    return (
        survey.where(F.col(date).isNotNull() & matches_any_column(present, pattern))
        .groupBy(date).agg(F.count(F.lit(1)).alias("count"))
    )


def outer_align(df: DataFrame, key: str, value: str, values: Sequence[str], date: str = "date") -> DataFrame:
    """One column per station over the union of dates (explicit list, so no extra job)."""
    return df.groupBy(date).pivot(key, list(values)).agg(F.first(value))


def pivot_counts(df: DataFrame, row: Column | str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts as a row × column table, empty cells 0."""
    return df.groupBy(col(row)).pivot(column, list(values)).count().na.fill(0, list(values))
