"""Missing values, coercion and small scalar helpers.

Contract kept by every operator: a missing value is NULL, never NaN.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing(c: Column | str) -> Column:
    """NaN becomes NULL."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def finite(c: Column | str) -> Column:
    """NaN and the infinities become NULL."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def number(c: Column | str) -> Column:
    """Text to DOUBLE; anything that is not a plain number becomes NULL."""
    c = col(c).cast("string")
    return F.when(c.rlike(NUMBER_PATTERN), F.trim(c).try_cast("double"))


def timestamp(c: Column | str) -> Column:
    """Text to TIMESTAMP_NTZ; bad text becomes NULL. ``/`` and ``-`` both separate dates."""
    c = F.trim(F.regexp_replace(col(c).cast("string"), "/", "-"))
    return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), c.try_cast("timestamp_ntz"))


def day(c: Column | str) -> Column:
    """Text or timestamp to DATE, bad text to NULL."""
    return timestamp(c).cast("date")


def sum_or_zero(c: Column | str) -> Column:
    """Sum in which an all-missing group is 0, not NULL."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def flag(condition: Column) -> Column:
    """Condition as 0/1 where an unknown comparison counts as 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def known(condition: Column) -> Column:
    """Condition as BOOLEAN where unknown counts as false."""
    return F.coalesce(condition, F.lit(False))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL when b is 0."""
    return col(a) / F.nullif(col(b), F.lit(0).cast("double"))


def percent_change(a: Column | str, b: Column | str) -> Column:
    """(a / b - 1) * 100, NULL when b is 0."""
    return (ratio(a, b) - 1) * 100


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def lookup(c: Column | str, table: Mapping, kind: str) -> Column:
    """Map a code column through a small fixed table; unknown codes become NULL."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.create_map(*entries)[col(c)].cast(kind)


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First of ``candidates`` that is a column of ``df`` (schema only, no job)."""
    return next((c for c in candidates if c in df.columns), None)


def first_containing(df: DataFrame, text: str, excluding: str | None = None) -> str | None:
    """First column whose name contains ``text`` and lacks ``excluding``."""
    for name in df.columns:
        if text in name and (excluding is None or excluding not in name):
            return name
    return None


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    skip = set(exclude)
    return [c for c, t in df.dtypes if c not in skip and (t in kinds or t.startswith("decimal"))]


def to_display_names(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename known columns to their display names."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def to_internal_names(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """The inverse of :func:`to_display_names`."""
    return to_display_names(df, {v: k for k, v in names.items()})


def clipped(c: Column | str, low: float, high: float) -> Column:
    """Clip to [low, high]; NULL stays NULL (``greatest`` alone would drop it)."""
    c = col(c)
    return F.when(c < low, F.lit(float(low))).when(c > high, F.lit(float(high))).otherwise(c)


def right_closed_bin(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the (left, right] bin holding ``c``; outside all bins NULL."""
    c = col(c)
    out = None
    for left, right, label in zip(edges[:-1], edges[1:], labels, strict=True):
        inside = (c > left) & (c <= right)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def significance_stars(p: Column | str) -> Column:
    p = col(p)
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def effect_size_label(f2: Column | str) -> Column:
    f2 = col(f2)
    return (
        F.when(f2 >= 0.35, "large (≥0.35)")
        .when(f2 >= 0.15, "medium (≥0.15)")
        .when(f2 >= 0.02, "small (≥0.02)")
        .otherwise("negligible (<0.02)")
    )


def yen_to_billions(yen: Column | str) -> Column:
    return col(yen) / 1e9


def yen_to_million_dollars(yen: Column | str, rate: float) -> Column:
    return col(yen) / F.lit(float(rate)) / 1e6


def thousands(visitors: Column | str) -> Column:
    return col(visitors) / 1000.0


def mean_per_day(total: Column | str, days: Column | str) -> Column:
    return col(total) / F.greatest(col(days), F.lit(1))
