"""Whole studies as one lazy plan per result table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import calendar as cal, comfort as cf, fixed
from ..operators import (
    economics as ec, features as ft, gram as gm, nodes as nd, panel as pn, satisfaction as sa,
)

LOSS_FEATURES = ("directions", "directions_lag1", "directions_lag2", "directions_lag3", "directions_roll7",
                 "precip", "temp", "is_weekend_or_holiday")


def demand_loss(panel: DataFrame, intent: str = "directions", features: Sequence[str] = LOSS_FEATURES) -> DataFrame:
    """Gap days of every node with the visitors they fell short of the model.

    Panel → features → least squares per node → gap flag → predicted minus actual.
    """
    with_features, _ = ft.build_features(panel, intent)
    fitted = gm.ols(with_features, "count", list(features))
    flagged = ec.flag_gap_days(panel, intent)
    return ec.lost_visitors(fitted, flagged)


def crowding_study(panel: DataFrame, survey: DataFrame, keyword: str | None = None) -> dict[str, DataFrame]:
    """Satisfaction against visitor numbers: joined days or months, bins and rank correlations."""
    daily = sa.daily_satisfaction(survey, keyword=keyword)
    joined = sa.crowding_join(panel, daily)
    return {"joined": joined, "bins": sa.visitor_bins(joined), "correlation": sa.crowding_correlation(joined)}


def comfort_study(weather: DataFrame, survey: DataFrame) -> dict[str, DataFrame]:
    """Comfort indices against daily satisfaction: means, rank correlations, the peak bin."""
    comfort = sa.add_comfort(weather)
    daily = sa.daily_satisfaction(survey)
    joined = comfort.select("node", "date", "discomfort_index").join(daily, "date")
    return {
        "means": comfort.groupBy("node").agg(
            F.avg("discomfort_index").alias("di_mean"), F.avg("wind_chill").alias("wc_mean")),
        "correlations": sa.comfort_correlations(comfort, daily),
        "peak": sa.comfort_peak(joined),
    }


def comfort_panel(hourly: DataFrame, keys: Sequence[str] = ("station",)) -> DataFrame:
    """Daily weather of every station with comfort and calendar columns.

    Missing temperature counts as 20 °C, humidity as 50 %, wind as calm.
    """
    daily = pn.daily_weather_by_name(hourly, keys)
    t = F.coalesce("temperature_c", F.lit(20.0))
    out = daily
    if "humidity_pct" in daily.columns:
        out = out.withColumn("discomfort_index", cf.discomfort_index(t, F.coalesce("humidity_pct", F.lit(50.0))))
    if "wind_speed_ms" in daily.columns:
        out = out.withColumn("wind_chill_c", cf.wind_chill(t, F.coalesce("wind_speed_ms", F.lit(0.0))))
    return out.withColumns({
        "month": F.month("date"), "day_of_week": cal.day_of_week("date"), "is_weekend": cal.is_weekend("date"),
    }).withColumn("season", cal.season("month"))


def site_network(counts: DataFrame, weather: DataFrame, intent: DataFrame, route: str, source_daily: DataFrame,
                 lead: str, roles: tuple[str, str, str], threshold: float = 10.0,
                 spend: float = fixed.SPEND_PER_VISITOR, results: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """All sites in one run: models, totals, snow ranking, wind nudge, heat table, outside signal.

    Each result is a query of its own, and only the named ``results`` are planned; a caller that
    runs many may persist the three inputs.
    """
    frame = nd.node_frame(counts, weather, intent, route)
    models = nd.node_models(frame, route, spend)
    valid = frame.join(models.select("node"), "node", "left_semi")
    make = {
        "frame": lambda: frame, "models": lambda: models, "totals": lambda: nd.loss_over_nodes(models, spend),
        "snow": lambda: nd.snow_ranking(models), "heat": lambda: nd.heat_table(models),
        "nudge": lambda: nd.wind_nudge(valid, *roles, threshold=threshold),
        "signal": lambda: nd.pipeline_lags(valid, source_daily, lead),
    }
    return {name: make[name]() for name in (make if results is None else results)}


def report_tables(panel: DataFrame, features: Sequence[str]) -> dict[str, DataFrame]:
    """Tables of a report: coefficients with stars, β ranking, key metrics, model comparison."""
    from ..operators import regression as rg
    from ..sources.sinks import metric_rows

    return {
        "coefficients": rg.coefficient_table(panel, "count", features),
        "betas": rg.standardised_betas(panel, "count", features),
        "metrics": metric_rows(rg.effect_size(panel, "count", features), "ols", ["node"]),
        "models": model_comparison(panel, features),
    }


def model_comparison(panel: DataFrame, features: Sequence[str], target: str = "count", digits: int = 4) -> DataFrame:
    """The simple models beside least squares on one chronological split, one row per node and model."""
    from ..operators import regression as rg

    rows = ft.mark_split(ft.causal_mean(ft.naive_previous(gm.complete(panel, [target, *features]))))
    coefs = gm.wide_coefficients(gm.gram(rows.where("is_train"), target, features), features)
    scored = gm.predict(rows, coefs, features, out="pred_ols")
    return rg.comparison_table(scored, target, {"naive_lag1": "pred_naive_lag1", "rolling_mean_7": "pred_rolling_mean_7", "ols": "pred_ols"}, digits=digits)

