"""Survey answers to numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import fixed
from .values import clipped, col, lookup, number


def digits(c: Column | str) -> Column:
    """First run of digits in a text as a number."""
    return F.nullif(F.regexp_extract(col(c).cast("string"), r"(\d+)", 1), F.lit("")).cast("double")


def spending_midpoint(c: Column | str, table: dict[str, int] = fixed.SPENDING_MIDPOINTS) -> Column:
    return lookup(c, table, "double")


def satisfaction_score(c: Column | str, table: dict[str, int] = fixed.SATISFACTION_SCORES) -> Column:
    return lookup(c, table, "double")


def satisfaction_from_recommendation(nps: Column | str) -> Column:
    """0–10 recommendation to a 1–5 score, one decimal, half to even."""
    return F.bround(clipped(col(nps) / 2, 1, 5), 1)


def prefecture_label(c: Column | str, labels: tuple[str, ...] = ("石川", "福井", "富山")) -> Column:
    """First label contained in the text, NULL if there is none."""
    text = col(c)
    return F.coalesce(*[F.when(text.contains(k), F.lit(k)) for k in labels])


def coerce_scores(df: DataFrame, column: str, out: str = "score", threshold: float = 0.1) -> DataFrame:
    """Scores from whatever the column holds.

    Plain numbers; when under ``threshold`` of the rows are, the first number in the text;
    when still too few, a label map. One aggregate decides for the whole column, as a
    scalar subquery, so no row leaves the executors.
    """
    text = F.col(column).cast("string")
    plain = number(text)
    extracted = F.nullif(F.regexp_extract(text, r"(\d+\.?\d*)", 1), F.lit("")).try_cast("double")
    labelled = lookup(text, fixed.SATISFACTION_LABELS, "double")
    enough = F.count(F.lit(1)) * threshold
    rung = df.select(
        F.when(F.count(plain) >= enough, 0).when(F.count(extracted) >= enough, 1).otherwise(2)
        .alias("rung"),
    ).scalar()
    return (
        df.withColumn("_rung", rung)
        .withColumn(out, F.when(F.col("_rung") == 0, plain)
                    .when(F.col("_rung") == 1, extracted).otherwise(labelled))
        .drop("_rung")
    )
