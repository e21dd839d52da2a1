"""Opportunity gap, lost visitors and the ranking what-if."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.calendar import SUMMER, WINTER
from ..functions.values import flag
from .ordered import panel_quantile


def flag_gap_days(panel: DataFrame, intent: str, count: str = "count",
                  keys: Sequence[str] = ("node",)) -> DataFrame:
    """High intent (above its median) with a low count (below its median), per node."""
    medians = panel.groupBy(*keys).agg(
        panel_quantile(intent, 0.5).alias("_intent_median"),
        panel_quantile(count, 0.5).alias("_count_median"),
    )
    return (
        panel.join(medians, list(keys))
        .withColumns({
            "high_intent": flag(F.col(intent) > F.col("_intent_median")),
            "low_count": flag(F.col(count) < F.col("_count_median")),
        })
        .withColumn("opportunity_gap", F.col("high_intent") * F.col("low_count"))
        .drop("_intent_median", "_count_median")
    )


def top_gap_days(flagged: DataFrame, intent: str, n: int = 10, keys: Sequence[str] = ("node",)) -> DataFrame:
    """The ``n`` gap days of each node with the highest intent."""
    w = Window.partitionBy(*keys).orderBy(F.col(intent).desc(), "date")
    return flagged.where("opportunity_gap = 1").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def compare_gap_days(flagged: DataFrame, columns: Sequence[str] = (
        "precip", "weather_severity", "is_weekend_or_holiday", "temp", "wind"),
        keys: Sequence[str] = ("node",)) -> DataFrame:
    """Mean on gap days, on other days, and the difference, for several columns at once."""
    present = [c for c in columns if c in flagged.columns]
    gap = F.col("opportunity_gap") == 1
    wide = flagged.groupBy(*keys).agg(
        *[F.avg(F.when(gap, F.col(c))).alias(f"_g{i}") for i, c in enumerate(present)],
        *[F.avg(F.when(~gap, F.col(c))).alias(f"_o{i}") for i, c in enumerate(present)],
    )
    parts = ", ".join(f"'{c}', _g{i}, _o{i}" for i, c in enumerate(present))
    return (
        wide.select(*keys, F.expr(f"stack({len(present)}, {parts}) as (metric, gap_mean, other_mean)"))
        .withColumn("difference", F.col("gap_mean") - F.col("other_mean"))
    )


def lost_visitors(predicted: DataFrame, flagged: DataFrame, keys: Sequence[str] = ("node",),
                  count: str = "count") -> DataFrame:
    """Gap days with predicted minus actual visitors, not clipped."""
    flags = flagged.select(*keys, "date", F.col("opportunity_gap").alias("_gap")).distinct()
    return (
        predicted.join(flags, [*keys, "date"], "left")
        .where(F.coalesce("_gap", F.lit(0)) == 1).drop("_gap")
        .withColumn("lost_population", F.col("predicted") - F.col(count))
    )


def loss_totals(lost: DataFrame, keys: Sequence[str] = ("node",)) -> DataFrame:
    return lost.groupBy(*keys).agg(
        F.sum("lost_population").alias("total_lost"),
        F.avg("lost_population").alias("mean_lost"),
        F.count(F.lit(1)).alias("gap_days"),
    )


def monthly_loss(lost: DataFrame, keys: Sequence[str] = ("node",)) -> DataFrame:
    return lost.groupBy(*keys, F.month("date").alias("month")).agg(F.sum("lost_population").alias("monthly_lost"))


def mean_spend_loss(survey: DataFrame, lost_total: float, column: str = "spending_midpoint") -> DataFrame:
    """Mean spend per visitor and the yen value of a loss."""
    return survey.agg(F.avg(column).alias("mean_spend")).withColumn(
        "loss_yen", F.abs(F.lit(float(lost_total))) * F.col("mean_spend"))


def ranking_baseline(spark, ranks: Sequence[int] = fixed.RANK_BY_MONTH,
                     visitors_k: Sequence[int] = fixed.VISITORS_K_BY_MONTH,
                     gap_k: Sequence[int] = fixed.GAP_K_BY_MONTH,
                     weights: Sequence[float] = fixed.SEASON_WEIGHTS) -> DataFrame:
    """Twelve months: rank, visitors, gap to the wanted rank and seasonal weight."""
    rows = [(m + 1, int(ranks[m]), float(visitors_k[m]), float(gap_k[m]), float(weights[m])) for m in range(12)]
    return spark.createDataFrame(rows, "month int, rank int, visitors_k double, gap_k double, weight double")


def ranking_what_if(baseline: DataFrame, *, totals: DataFrame | None = None, monthly: DataFrame | None = None,
                    even: bool = False, keys: Sequence[str] = ("node",), cap: int = 12,
                    factor: float | None = None, floor_rank: int = 1,
                    whole_visitors: bool = False) -> DataFrame:
    """Ranks gained per node and month if the lost visitors came back.

    ``totals`` (keys, total_lost) is spread over the months by weight, or evenly; ``monthly``
    (keys, month, monthly_lost) is taken as it is, absent months 0. Ranks gained are
    ⌊share of the gap closed × 12⌋, or ⌊thousands × ``factor``⌋, up to ``cap``.
    """
    if totals is not None:
        all_weight = F.sum("weight").over(Window.partitionBy(F.lit(1)))
        share = F.lit(1 / 12) if even else F.col("weight") / F.col("_w")
        months = baseline.withColumn("_w", all_weight)
        # Every node gets the same twelve months: explode them, no join at all.
        calendar = months.agg(F.collect_list(F.struct(*months.columns)).alias("_months")).scalar()
        sim = (
            totals.select(*keys, "total_lost", F.explode(calendar).alias("_m"))
            .select(*keys, "total_lost", "_m.*")
            .withColumn("monthly_lost", F.col("total_lost") * share)
        )
    else:
        calendar = baseline.agg(F.collect_list(F.struct(*baseline.columns)).alias("_months")).scalar()
        nodes = monthly.select(*keys).distinct()
        sim = (
            nodes.select(*keys, F.explode(calendar).alias("_m")).select(*keys, "_m.*")
            .join(monthly.select(*keys, "month", "monthly_lost"), [*keys, "month"], "left")
            .withColumn("monthly_lost", F.coalesce("monthly_lost", F.lit(0.0)))
        )
    if whole_visitors:
        sim = sim.withColumn("monthly_lost", F.bround("monthly_lost", 0))
    extra, gap = F.col("monthly_lost") / 1000, F.col("gap_k")
    counts = (gap > 0) & (extra > 0)
    coverage = extra / F.nullif(gap, F.lit(0.0))
    if factor is None:
        gained = F.when(counts, F.least(F.floor(coverage * 12), F.lit(cap))).otherwise(F.lit(0))
    else:
        gained = F.least(F.floor(extra * factor), F.lit(cap))
    return sim.select(
        *keys, "month", "rank", "gap_k", "monthly_lost",
        F.when(counts, coverage * 100).otherwise(F.lit(0.0)).alias("closure_pct"),
        gained.cast("bigint").alias("ranks_gained"),
    ).withColumn("hypo_rank", F.greatest(F.col("rank") - F.col("ranks_gained"), F.lit(floor_rank)).cast("bigint"))


def ranking_totals(sim: DataFrame, keys: Sequence[str] = ("node",)) -> DataFrame:
    """Winter means, best gain and the month it falls in, closure over months with a gap."""
    winter = F.col("month").isin(*WINTER)
    closure = F.when(F.col("gap_k") > 0, F.col("closure_pct"))
    return sim.groupBy(*keys).agg(
        F.avg(F.when(winter, F.col("rank"))).alias("mean_actual_rank"),
        F.avg(F.when(winter, F.col("hypo_rank"))).alias("mean_hypo_rank"),
        F.max("ranks_gained").alias("best_improvement"),
        F.max_by("month", F.struct("ranks_gained", -F.col("month"))).alias("best_month"),
        F.coalesce(F.min(closure), F.lit(0.0)).alias("min_closure_pct"),
        F.coalesce(F.max(closure), F.lit(0.0)).alias("max_closure_pct"),
    )


def scenario_losses(scenarios: DataFrame) -> DataFrame:
    """gap_days × visitors × spend."""
    total = F.col("gap_days") * F.col("visitors")
    return scenarios.withColumns({"total_lost": total, "total_yen": total * F.col("spend")})


def monthly_severity(daily: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """Mean severity, severe days (> 0.5) and their share per month."""
    s = F.col("severity_score")
    return daily.groupBy(*keys, F.month("date").alias("month")).agg(
        F.avg(s).alias("mean_sev"), F.count_if(s > 0.5).alias("severe_days"), F.count(s).alias("total"),
    ).withColumn("severe_pct", F.col("severe_days") / F.nullif(F.col("total"), F.lit(0)) * 100)


def season_ratio(monthly: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """Winter over summer severity, means of month means, NULL if summer is next to nothing."""
    def mean(months):
        return F.avg(F.when(F.col("month").isin(*months), F.col("mean_sev")))

    return monthly.groupBy(*keys).agg(mean(WINTER).alias("winter"), mean(SUMMER).alias("summer")).withColumn(
        "ratio", F.when(F.col("summer") > 0.001, F.col("winter") / F.nullif(F.col("summer"), F.lit(0.0))))
