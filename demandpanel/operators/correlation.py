"""Correlations, lag profiles and two-sample tests. All pairs or lags share one aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.tails import chi2_p, correlation_p, ks_p
from ..session import staged
from .features import add_shifts
from .ordered import average_ranks, cumulative

CCF_LAGS = tuple(range(-3, 8))


def safe_corr(a: str, b: str) -> Column:
    """Pearson r over complete pairs, NULL when a side is constant.

    ``corr`` itself divides by zero there, which is an error in ANSI mode.
    """
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
    return F.covar_pop(x, y) / F.nullif(spread, F.lit(0.0))


def pair_count(a: str, b: str) -> Column:
    return F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1))


def _long(df: DataFrame, keys: Sequence[str], rows: dict[str, tuple], names: str) -> DataFrame:
    """Unpivot aggregates; ``rows`` maps a label to its aggregate columns."""
    aggs, parts = [], []
    for i, (label, columns) in enumerate(rows.items()):
        aggs += [c.alias(f"_v{i}_{j}") for j, c in enumerate(columns)]
        parts.append(", ".join([label, *[f"_v{i}_{j}" for j in range(len(columns))]]))
    wide = df.groupBy(*keys).agg(*aggs)
    return wide.select(*keys, F.expr(f"stack({len(rows)}, {', '.join(parts)}) as ({names})"))


def _floored(df: DataFrame, enough: Column) -> DataFrame:
    """r is NULL where there are too few rows; n stays and tells why."""
    return df.withColumn("r", F.when(enough, F.col("r")))


def pearson_pairs(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("node",),
                  against: str | None = None) -> DataFrame:
    """Pearson r and n of every pair (or of every column with ``against``), pairwise complete."""
    pairs = [(against, c) for c in columns if c != against] if against else [
        (a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    rows = {f"'{a}', '{b}'": (safe_corr(a, b), pair_count(a, b)) for a, b in pairs}
    return _long(df, keys, rows, "a, b, r, n")


def pearson_test(df: DataFrame, a: str, b: str, keys: Sequence[str] = ("node",), min_rows: int = 3) -> DataFrame:
    """Pearson r, n and p per key; r and p are NULL under ``min_rows`` pairs."""
    out = _floored(df.groupBy(*keys).agg(safe_corr(a, b).alias("r"), pair_count(a, b).alias("n")), F.col("n") >= min_rows)
    return out.withColumn("p", correlation_p(F.col("r"), F.col("n")))


def lag_profile(df: DataFrame, target: str, column: str, max_lag: int = 7,
                keys: Sequence[str] = ("node",)) -> DataFrame:
    """r of the target with the column 0 … max_lag rows earlier."""
    return cross_correlation(df, column, target, range(max_lag + 1), keys, min_rows=0)


def lag_by_flag(df: DataFrame, target: str, lagged: str, flag: str, keys: Sequence[str] = ("node",)) -> DataFrame:
    """r at one lag, split by a 0/1 flag such as weekend."""
    return df.groupBy(*keys, flag).agg(safe_corr(target, lagged).alias("r"), pair_count(target, lagged).alias("n"))


def cross_correlation(df: DataFrame, lead: str, target: str, lags: Sequence[int] = CCF_LAGS,
                      keys: Sequence[str] = ("node",), min_rows: int = 10) -> DataFrame:
    """r and n per lag, r NULL unless n > ``min_rows``; negative lags look ahead."""
    lags = list(lags)
    shifted = add_shifts(df, lead, lags, keys)
    rows = {str(k): (safe_corr(f"`{lead}_s{k}`", target), pair_count(f"`{lead}_s{k}`", target)) for k in lags}
    return _floored(_long(shifted, keys, rows, "lag, r, n"), F.col("n") > min_rows)


def best_lag(profile: DataFrame, keys: Sequence[str] = ("node",), by: str = "abs") -> DataFrame:
    """Lag with the largest |r| (``abs``) or the largest r (``signed``); the smaller lag wins ties.

    The value at lag 0 comes from the same aggregate.
    """
    size = F.abs("r") if by == "abs" else F.col("r")
    best = F.max_by(F.struct("lag", "r", "n"), F.struct(size, -F.col("lag")))
    return (
        profile.where(F.col("r").isNotNull()).groupBy(*keys)
        .agg(best.alias("_b"), F.max(F.when(F.col("lag") == 0, F.col("r"))).alias("lag0_r"))
        .select(*keys, "_b.lag", "_b.r", "_b.n", "lag0_r")
    )


def _panel_rank(value: str, keys: Sequence[str]) -> Column:
    up = Window.partitionBy(*keys).orderBy(value)
    same = Window.partitionBy(*keys, value)
    return F.rank().over(up) + (F.count(F.lit(1)).over(same) - 1) / 2


def spearman(df: DataFrame, a: str, b: str, keys: Sequence[str] = ("node",), min_rows: int = 3,
             panel: bool = True) -> DataFrame:
    """Spearman r and n per key, ties sharing their mean rank; r is NULL under ``min_rows`` pairs.

    ``panel`` ranks by window and suits frames of at most one row per day and node. For raw
    rows pass ``panel=False``: pairs are counted first and ranks come from the distributed
    running totals, so neither a hot value nor a hot key lands in one task.
    """
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    for k in () if panel else keys:
        pairs = pairs.where(F.col(k).isNotNull())
    if panel:
        ranked = pairs.select(*keys, _panel_rank(a, keys).alias("_ra"), _panel_rank(b, keys).alias("_rb"))
        out = ranked.groupBy(*keys).agg(safe_corr("_ra", "_rb").alias("r"), F.count(F.lit(1)).alias("n"))
    else:
        counted = staged(pairs.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("_w")))
        ranked = (
            counted.join(average_ranks(counted, a, keys, "_ra", weight="_w"), [*keys, a])
            .join(average_ranks(counted, b, keys, "_rb", weight="_w"), [*keys, b])
        )
        w, x, y = F.col("_w"), F.col("_ra"), F.col("_rb")
        out = ranked.groupBy(*keys).agg(
            F.sum("_w").alias("n"),
            F.sum(w * x * y).alias("_xy"), F.sum(w * x * x).alias("_xx"), F.sum(w * y * y).alias("_yy"),
        )
        centre = F.col("n") * F.pow((F.col("n") + 1) / 2, F.lit(2))
        spread = F.sqrt((F.col("_xx") - centre) * (F.col("_yy") - centre))
        out = out.select(*keys, ((F.col("_xy") - centre) / F.nullif(spread, F.lit(0.0))).alias("r"), "n")
    return _floored(out, F.col("n") >= min_rows)


def with_p(df: DataFrame) -> DataFrame:
    """Two-sided p of columns r and n."""
    return df.withColumn("p", correlation_p(F.col("r"), F.col("n")))


def ks_two_sample(counted: DataFrame, value: str, keys: Sequence[str], n_a: str = "n_a", n_b: str = "n_b") -> DataFrame:
    """Largest distance of two empirical distributions.

    ``counted`` holds each (keys, value) once with its count in either sample.
    """
    steps = cumulative(counted, value, [n_a, n_b], keys)
    f_a = F.col(f"cum_{n_a}") / F.nullif(F.col(f"total_{n_a}"), F.lit(0))
    f_b = F.col(f"cum_{n_b}") / F.nullif(F.col(f"total_{n_b}"), F.lit(0))
    return steps.groupBy(*keys).agg(
        F.max(F.abs(f_a - f_b)).alias("ks_statistic"),
        F.max(f"total_{n_a}").alias("n_a"), F.max(f"total_{n_b}").alias("n_b"),
    )


def with_ks_p(df: DataFrame) -> DataFrame:
    """Its tail: exact for samples of up to ``tails.EXACT_ROWS`` rows, the limiting distribution beyond."""
    p = ks_p(F.col("ks_statistic"), F.col("n_a").cast("double"), F.col("n_b").cast("double"))
    return df.withColumn("ks_pvalue", p)


def chi_square_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Chi-square of the table [[a, b], [c, d]] with the continuity correction.

    The correction never moves a cell past its expectation. NULL if a margin is empty.
    """
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    distance = F.abs(a * d - b * c)
    corrected = F.greatest(distance - F.least(distance, n / 2), F.lit(0.0))
    return n * corrected * corrected / F.nullif(margins, F.lit(0.0))


def with_chi_p(df: DataFrame, column: str = "chi2") -> DataFrame:
    return df.withColumn(f"{column}_p", chi2_p(F.col(column)))
