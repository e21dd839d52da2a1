"""All sites at once: node models, wind nudge, shield effect, rankings and heat table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed
from ..functions.values import percent_change
from . import gram as g
from .correlation import best_lag, cross_correlation, safe_corr
from .ordered import panel_quantile

NODE_FEATURES = ("temp", "precip", "wind", "snow_depth")


def node_frame(counts: DataFrame, weather: DataFrame, intent: DataFrame, route: str) -> DataFrame:
    """Counts ⋈ weather ⋈ intent with complete core columns; missing snow depth is 0."""
    rows = counts.join(weather, ["node", "date"]).join(intent.select("date", route), "date")
    rows = rows.dropna(subset=["count", route, "temp", "precip", "wind"])
    snow = F.coalesce(F.col("snow_depth").cast("double"), F.lit(0.0)) if "snow_depth" in rows.columns else F.lit(0.0)
    return rows.withColumn("snow_depth", snow)


def node_models(frame: DataFrame, route: str, spend: float = fixed.SPEND_PER_VISITOR,
                min_rows: int = 60, min_standardised: int = 30) -> DataFrame:
    """One row per node: fit quality, weather lift, wind and snow effects, clipped loss.

    Both models come from one Gram row and travel as one row per node; the clipped loss reads
    the rows a second and last time.
    """
    features = [route, *NODE_FEATURES]
    moments = g.gram(frame, "count", features).where(F.col("n") >= min_rows)
    fits = g.solutions(moments, features, {"full": features, "intent": [route]})

    def of(term: str, column: str, before: int = 0):
        return F.get(column, F.lit(features.index(term) + before))

    fits = fits.select(
        "node", "n", F.col("full_r2").alias("r2"), F.col("full_adj_r2").alias("adj_r2"),
        (F.col("full_r2") - F.col("intent_r2")).alias("weather_lift"),
        F.when(F.col("n") > min_standardised, of("snow_depth", "full_beta_z")).alias("snow_beta_std"),
        of("wind", "full_coefs", 1).alias("wind_coef"),
        F.get("intent_coefs", F.lit(0)).alias("_base"), F.get("intent_coefs", F.lit(1)).alias("_slope"),
    )
    short = F.greatest(F.col("_base") + F.col("_slope") * F.col(route) - F.col("count"), F.lit(0.0))
    kept = ["n", "r2", "adj_r2", "weather_lift", "snow_beta_std", "wind_coef"]
    out = frame.select("node", route, "count").join(fits, "node").groupBy("node").agg(
        *[F.any_value(c).alias(c) for c in kept], F.sum(short).alias("lost_visitors"))
    return out.withColumn("lost_yen", F.col("lost_visitors") * spend)


def loss_over_nodes(models: DataFrame, spend: float = fixed.SPEND_PER_VISITOR) -> DataFrame:
    return models.agg(
        F.sum("lost_visitors").alias("lost_visitors"),
        (F.sum("lost_visitors") * spend).alias("lost_yen"),
        F.count(F.lit(1)).alias("nodes"),
    )


def snow_ranking(models: DataFrame) -> DataFrame:
    """The most and the least snow-sensitive node; an unknown β counts as 0."""
    s = F.coalesce(F.abs("snow_beta_std"), F.lit(0.0))
    return models.agg(
        F.min_by("node", F.struct(-s, "node")).alias("most_sensitive"),
        F.max_by("node", F.struct(-s, "node")).alias("most_resilient"),
    )


def heat_table(models: DataFrame) -> DataFrame:
    """Node effects and each column divided by its largest value (a zero maximum divides by 1)."""
    raw = models.select(
        "node", F.abs("snow_beta_std").alias("snow_sensitivity_abs"), F.abs("wind_coef").alias("wind_sensitivity_abs"),
        F.col("weather_lift").alias("weather_lift_r2"), (F.col("lost_visitors") / 1000).alias("lost_visitors_k"),
    )
    return normalise_by_max(raw, raw.columns[1:])


def normalise_by_max(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``<c>_norm`` = c / max(c). The maxima are one aggregate, not an unpartitioned window."""
    if keys:
        w = Window.partitionBy(*keys)
        top = {c: F.max(c).over(w) for c in columns}
    else:
        maxima = df.select(F.struct(*[F.max(c).alias(c) for c in columns])).scalar()
        top = {c: maxima.getField(c) for c in columns}
    return df.withColumns({
        f"{c}_norm": F.col(c) / F.when(top[c] == 0, F.lit(1.0)).otherwise(top[c]) for c in columns
    })


def bubble_radius(df: DataFrame, column: str = "lost_visitors", base: float = 0.03, span: float = 0.08) -> DataFrame:
    """Radius growing with the square root of the share of the largest loss."""
    top = df.select(F.max(column)).scalar()
    return df.withColumn("radius", base + span * F.sqrt(F.col(column) / F.nullif(top, F.lit(0.0))))


def align_nodes(panel: DataFrame, nodes: Sequence[str], value: str = "count") -> DataFrame:
    """Days on which all the nodes have a value, one column per node."""
    wide = panel.where(F.col("node").isin(*nodes)).groupBy("date").pivot("node", list(nodes)).agg(F.first(value))
    return wide.dropna(subset=list(nodes))


def wind_nudge(panel: DataFrame, coast: str, city: str, mountain: str, threshold: float = 10.0,
               min_days: int = 10, min_shield_days: int = 8) -> DataFrame:
    """Shift of visitors on days with strong coastal wind, and the buffer of the mountain node.

    One row; empty when either side has under ``min_days`` days.
    """
    def at(node: str, column: str):
        return F.max(F.when(F.col("node") == node, F.col(column)))

    days = panel.where(F.col("node").isin(coast, city, mountain)).groupBy("date").agg(
        at(coast, "count").alias("coast"), at(coast, "wind").alias("wind"),
        at(city, "count").alias("city"), at(mountain, "count").alias("mountain"),
    ).dropna(subset=["coast", "city", "mountain", "wind"])
    median = days.select(panel_quantile("coast", 0.5)).scalar()
    windy, calm = F.col("wind") > threshold, F.col("wind") <= threshold
    shield = windy & (F.col("coast") < F.col("_median"))

    def mean(condition, column):
        return F.avg(F.when(condition, F.col(column)))

    out = days.withColumn("_median", median).agg(
        F.count_if(windy).alias("n_high"), F.count_if(calm).alias("n_normal"), F.count_if(shield).alias("n_shield"),
        *[mean(windy, c).alias(f"_{c}_high") for c in ("coast", "city", "mountain")],
        *[mean(calm, c).alias(f"_{c}_norm") for c in ("coast", "city", "mountain")],
        mean(shield, "mountain").alias("_shield"),
    ).where((F.col("n_high") >= min_days) & (F.col("n_normal") >= min_days))
    return out.select(
        "n_high", "n_normal", "n_shield",
        *[percent_change(f"_{c}_high", f"_{c}_norm").alias(f"{c}_delta_pct") for c in ("coast", "city", "mountain")],
        F.when(F.col("n_shield") >= min_shield_days, percent_change("_shield", "_mountain_norm"))
        .alias("weather_shield_pct"),
    )


def pipeline_lags(panel: DataFrame, source_daily: DataFrame, lead: str, min_rows: int = 20) -> DataFrame:
    """Best lag between an outside daily signal and every node, all nodes in one job."""
    joined = panel.select("node", "date", "count").join(source_daily, "date").dropna()
    return best_lag(cross_correlation(joined, lead, "count", min_rows=min_rows))


def proxy_check(counts: DataFrame, survey_daily: DataFrame, column: str, min_rows: int = 30,
                keys: Sequence[str] = ("node",)) -> DataFrame:
    """Pearson r of counts and survey volume, NULL unless enough days meet."""
    joined = counts.join(survey_daily, "date").dropna(subset=["count", column])
    n = F.count(F.lit(1))
    return joined.groupBy(*keys).agg(F.when(n >= min_rows, safe_corr("count", column)).alias("r"), n.alias("n"))


def station_divergence(daily: DataFrame, value: str = "temp", threshold: float = 5.0) -> DataFrame:
    """Spread between stations per day, on days when every station reports."""
    present = daily.where(F.col(value).isNotNull())
    stations = present.select(F.count_distinct("station")).scalar()
    return (
        present.groupBy("date")
        .agg((F.max(value) - F.min(value)).alias("max_diff"), F.count_distinct("station").alias("_n"))
        .where(F.col("_n") == stations).drop("_n")
        .withColumn("is_shield_day", F.col("max_diff") > threshold)
    )


def divergence_share(divergence: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return divergence.agg(
        F.count_if("is_shield_day").alias("shield_days"), n.alias("days"),
        (F.count_if("is_shield_day") / F.nullif(n, F.lit(0)) * 100).alias("shield_pct"),
    )
