"""Windows and model features of the daily panel.

Every window is partitioned by node and runs on rows already reduced to days. Lags count
kept rows, not calendar days, so they step over removed outage days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.calendar import add_calendar
from ..functions.comfort import severity_level


def _by_day(keys: Sequence[str], date: str = "date"):
    return Window.partitionBy(*keys).orderBy(date)


def add_severity(df: DataFrame, **thresholds: float) -> DataFrame:
    return df.withColumn("weather_severity", severity_level("precip", "wind", **thresholds))


def add_rolling(
    df: DataFrame, column: str, windows: Sequence[int] = (3, 7, 14), keys: Sequence[str] = ("node",),
) -> DataFrame:
    """Mean over the last w rows, current row included, missing values skipped."""
    w = _by_day(keys)
    return df.withColumns({
        f"{column}_roll{n}": F.avg(column).over(w.rowsBetween(-(n - 1), 0)) for n in windows
    })


def add_lags(
    df: DataFrame, column: str, max_lag: int = 7, also: Sequence[str] = ("precip", "temp"),
    keys: Sequence[str] = ("node",),
) -> DataFrame:
    w = _by_day(keys)
    new = {f"{column}_lag{k}": F.lag(column, k).over(w) for k in range(max_lag + 1)}
    new |= {f"{c}_lag1": F.lag(c, 1).over(w) for c in also if c in df.columns}
    return df.withColumns(new)


def add_shifts(
    df: DataFrame, column: str, lags: Sequence[int], keys: Sequence[str] = ("node",),
) -> DataFrame:
    """Columns ``<column>_s<k>``; a negative lag leads."""
    w = _by_day(keys)
    return df.withColumns({
        f"{column}_s{k}": (F.lag(column, k) if k >= 0 else F.lead(column, -k)).over(w) for k in lags
    })


def add_differences(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("node",)) -> DataFrame:
    """Each column minus its previous row, in place."""
    w = _by_day(keys)
    return df.withColumns({c: F.col(c) - F.lag(c, 1).over(w) for c in columns})


def add_interactions(df: DataFrame, intent: str) -> DataFrame:
    return df.withColumns({
        "weekend_x_severity": F.col("is_weekend_or_holiday") * F.col("weather_severity"),
        "weekend_x_intent": F.col("is_weekend_or_holiday") * F.coalesce(F.col(intent), F.lit(0.0)),
    })


def add_weekday_mean(
    df: DataFrame, value: str = "count", keys: Sequence[str] = ("node",), fit_on: DataFrame | None = None,
) -> DataFrame:
    """Mean count of the weekday, joined back to its rows.

    By default over all rows, later test rows included; pass ``fit_on`` to learn the means
    from training rows only.
    """
    if fit_on is None:
        return df.withColumn("dow_mean_count", F.avg(value).over(Window.partitionBy(*keys, "dow")))
    means = fit_on.groupBy(*keys, "dow").agg(F.avg(value).alias("dow_mean_count"))
    return df.join(means, [*keys, "dow"], "left")


def causal_mean(df: DataFrame, value: str = "count", rows: int = 7, keys: Sequence[str] = ("node",),
                out: str = "pred_rolling_mean_7") -> DataFrame:
    """Mean of up to ``rows`` earlier rows; NULL on the first."""
    return df.withColumn(out, F.avg(value).over(_by_day(keys).rowsBetween(-rows, -1)))


def naive_previous(df: DataFrame, value: str = "count", keys: Sequence[str] = ("node",),
                   out: str = "pred_naive_lag1") -> DataFrame:
    return df.withColumn(out, F.lag(value, 1).over(_by_day(keys)).cast("double"))


def model_columns(intent: str, available: Sequence[str]) -> list[str]:
    """The model feature names that are present."""
    return [n for n in (pattern.format(intent) for pattern in fixed.MODEL_FEATURES) if n in available]


def build_features(
    panel: DataFrame, intent: str, *, keys: Sequence[str] = ("node",),
    holidays: DataFrame | None = None, thresholds: dict[str, float] | None = None,
    fit_on: DataFrame | None = None,
) -> tuple[DataFrame, list[str]]:
    """The whole feature step: the panel with features, and the model feature names."""
    df = add_calendar(panel, holidays=holidays)
    df = add_severity(df, **(thresholds or {}))
    df = add_rolling(df, intent, keys=keys)
    df = add_lags(df, intent, keys=keys)
    df = add_interactions(df, intent)
    df = add_weekday_mean(df, keys=keys, fit_on=fit_on)
    return df, model_columns(intent, df.columns)


def feature_families(columns: Sequence[str], intent: str) -> dict[str, list[str]]:
    """Feature names by family: weather, intent, calendar."""
    def is_intent(c: str) -> bool:
        return c == intent or c.startswith(f"{intent}_") or c == "weekend_x_intent"

    return {
        "weather": [c for c in columns if c in fixed.WEATHER_FEATURES],
        "intent": [c for c in columns if is_intent(c)],
        "calendar": [c for c in columns if c in fixed.CALENDAR_FEATURES],
    }


def without_family(columns: Sequence[str], family: str, families: dict[str, list[str]]) -> list[str]:
    gone = set(families.get(family, ()))
    return [c for c in columns if c not in gone]


def positions(df: DataFrame, keys: Sequence[str] = ("node",)) -> DataFrame:
    """Chronological position ``_pos`` (from 1) and group size ``_n``."""
    return df.withColumns({
        "_pos": F.row_number().over(_by_day(keys)),
        "_n": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
    })


def mark_split(
    df: DataFrame, train_pct: float = 0.8, keys: Sequence[str] = ("node",), rounding: str = "nearest",
) -> DataFrame:
    """Boolean ``is_train``: the first part of each node's rows in date order.

    ``nearest`` rounds half to even and keeps one row on each side; ``down`` truncates.
    """
    df = positions(df, keys)
    raw = F.col("_n") * F.lit(float(train_pct))
    if rounding == "nearest":
        size = F.least(F.greatest(F.bround(raw, 0), F.lit(1.0)), F.col("_n") - 1)
    else:
        size = F.floor(raw)
    return df.withColumn("is_train", F.col("_pos") <= size).drop("_pos", "_n")
