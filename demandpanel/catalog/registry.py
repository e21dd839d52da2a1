"""Registry and the column helpers that keep both engines' results comparable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name`` with its SQL, if there is one."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


# A nudge far below the last digit kept, so that exact decimal ties fall the same way in
# engines that round them differently.
NUDGE = 1.3e-9


def r6(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + F.lit(NUDGE), digits) + F.lit(0.0)


def q6(expression: str, digits: int = 6) -> str:
    return f"(round(CAST({expression} AS DOUBLE) + 1.3e-9, {digits}) + 0.0)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every DOUBLE column rounded."""
    return df.select(*[
        r6(c, digits).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) if t in ("int", "smallint")
        else F.col(c) for c, t in df.dtypes
    ])


def _area(density: str, low: str, width: str, steps: int = 2000) -> str:
    """SQL of the area under ``density``, of the place @, from ``low`` on, by Simpson's rule."""
    at = density.replace("@", f"(({low}) + i * ({width}) / {steps})")
    return f"(list_sum([(CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({at}) FOR i IN range(0, {steps + 1})]) * ({width}) / {3 * steps})"


def t_tail(t: str, dof: str) -> str:
    """SQL of the two-sided tail of Student's t: with t = sqrt(dof) tan(v) it is an area under a power of the cosine."""
    low = f"atan(abs({t}) / sqrt({dof}))"
    width = f"least(pi() / 2 - {low}, 40 / sqrt({dof}))"
    return f"({_area(f'pow(cos(@), ({dof}) - 1)', low, width)} / (sqrt(pi()) / 2 * exp(lgamma(({dof}) / 2.0) - lgamma((({dof}) + 1) / 2.0))))"


def normal_tail(z: str) -> str:
    """SQL of the two-sided tail of the normal distribution."""
    return f"({_area('exp(-@ * @ / 2)', f'abs({z})', '12')} * sqrt(2 / pi()))"


def ks_tails(samples: str) -> str:
    """CTEs ending in ``ks_p``: ``samples`` (ks_statistic, n_a, n_b unrounded) with the two-sample tail.

    Samples of up to 10000 rows: the merged order of both is walked a row at a time, over
    the whole lattice; larger ones: the limiting series.
    """
    z = "sqrt(n_a * n_b / CAST(n_a + n_b AS DOUBLE)) * ks_statistic"
    return f"""ks_in AS MATERIALIZED (SELECT *, row_number() OVER () AS ks_id, least(n_a, n_b) AS km, greatest(n_a, n_b) AS kn, {z} AS kz FROM ({samples})),
    ks_walk AS (SELECT ks_id, km, kn, CAST(round(ks_statistic * km * kn) AS BIGINT) AS kd, 0::BIGINT AS ks, [1.0::DOUBLE] || [0.0::DOUBLE FOR i IN range(km)] AS kp FROM ks_in WHERE kn <= 10000 AND kz <= 6
        UNION ALL SELECT ks_id, km, kn, kd, ks + 1, [CASE WHEN i > ks + 1 OR ks + 1 - i > kn OR abs(i * (km + kn) - (ks + 1) * km) >= kd THEN 0.0::DOUBLE
            ELSE ((CASE WHEN i > 0 THEN kp[i] * (km - i + 1) ELSE 0 END) + kp[i + 1] * (kn - ks + i)) / (km + kn - ks) END FOR i IN range(0, km + 1)] FROM ks_walk WHERE ks < km + kn),
    ks_p AS (SELECT k.* EXCLUDE (ks_id, km, kn), CASE WHEN w.kp IS NOT NULL THEN least(greatest(CASE WHEN w.kd <= 0 THEN 1 ELSE 1 - w.kp[w.km + 1] END, 0), 1)
        WHEN kz < 1.18 THEN 1 - sqrt(2 * pi()) / kz * list_sum([exp(-pow(2 * j - 1, 2) * pi() * pi() / (8 * kz * kz)) FOR j IN range(1, 21)])
        ELSE 2 * list_sum([(2 * (j % 2) - 1) * exp(-2.0 * j * j * kz * kz) FOR j IN range(1, 101)]) END AS ks_pvalue
        FROM ks_in k LEFT JOIN (SELECT * FROM ks_walk WHERE ks = km + kn) w USING (ks_id))"""
