"""Weather severity and human comfort indices."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from . import fixed
from .values import clipped, col, flag


def discomfort_index(temp: Column | str, humidity: Column | str, terms: Mapping[str, float] | None = None) -> Column:
    """The index as a polynomial 1, t, h, t·h; ``terms`` replaces some of its coefficients."""
    t, h = col(temp), col(humidity)
    c = {**fixed.DISCOMFORT_TERMS, **(terms or {})}
    return F.lit(c["1"]) + t * c["t"] + h * c["h"] + t * h * c["th"]


def wind_chill(temp: Column | str, wind_ms: Column | str) -> Column:
    """Felt temperature; outside T ≤ 10 °C and V > 4.8 km/h it is the air temperature."""
    t, v = col(temp), col(wind_ms) * 3.6
    p = F.pow(F.greatest(v, F.lit(0.1)), F.lit(0.16))
    return F.when((t <= 10) & (v > 4.8), 13.12 + 0.6215 * t - 11.37 * p + 0.3965 * t * p).otherwise(t)


def comfort_label(di: Column | str) -> Column:
    d = col(di)
    return (
        F.when(d < 55, "Cold").when(d < 70, "Comfortable").when(d < 80, "Uncomfortable")
        .when(d.isNotNull(), "Dangerous")
    )


def severity_level(
    precip: Column | str,
    wind: Column | str,
    *,
    precip_light: float = 0,
    precip_heavy: float = 10,
    wind_strong: float = 8,
) -> Column:
    """0 fine … 3 stormy."""
    p, w = col(precip), col(wind)
    score = flag(p > precip_light) + flag(p > precip_heavy) + flag(w > wind_strong)
    return F.least(score, F.lit(3))


def severity_score(temp: Column | str, precip: Column | str, snow: Column | str | None = None) -> Column:
    """0–1 score: 0.4 cold + 0.35 rain + 0.25 snow. Missing temperature costs nothing."""
    t = clipped(temp, -10, 35)
    cold = F.when(t < 5, (5 - t) / 15).otherwise(F.lit(0.0))
    rain = clipped(col(precip) / 50, 0, 1)
    deep = F.lit(0.0) if snow is None else clipped(col(snow) / 50, 0, 1)
    return clipped(cold * 0.4 + rain * 0.35 + deep * 0.25, 0, 1)


def severity_class(score: Column | str) -> Column:
    s = col(score)
    return (
        F.when((s > -0.01) & (s <= 0.2), "Good")
        .when((s > 0.2) & (s <= 0.5), "Moderate")
        .when((s > 0.5) & (s <= 1.0), "Severe")
    )
