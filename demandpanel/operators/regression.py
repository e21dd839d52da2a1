"""Regression reports built on the Gram rows: effect sizes, hold-out, robustness, seasons."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions import fixed
from ..functions.calendar import SUMMER, WINTER
from ..functions.tails import normal_p, unit_root_p
from ..functions.values import effect_size_label, significance_stars
from . import gram as g
from .features import add_differences, mark_split
from .gram import fit, unpack


def weather_free(features: Sequence[str]) -> list[str]:
    return [f for f in features if f not in fixed.WEATHER_FEATURES]


def coefficient_table(df: DataFrame, target: str, features: Sequence[str],
                      keys: Sequence[str] = ("node",)) -> DataFrame:
    """Coefficients with errors, p-values and stars."""
    out = g.coefficients(g.gram(df, target, features, keys), features, keys=keys)
    return out.withColumn("stars", significance_stars("p"))


def standardised_betas(df: DataFrame, target: str, features: Sequence[str],
                       keys: Sequence[str] = ("node",)) -> DataFrame:
    """Standardised β (divisor n−1) ranked by absolute size."""
    out = g.coefficients(g.gram(df, target, features, keys), features, keys=keys)
    w = Window.partitionBy(*keys).orderBy(F.abs("beta").desc_nulls_last(), "term")
    return (
        out.where("term <> 'const'").select(*keys, "term", "beta")
        .withColumn("rank", F.row_number().over(w))
    )


def effect_size(df: DataFrame, target: str, features: Sequence[str],
                keys: Sequence[str] = ("node",)) -> DataFrame:
    """R², adjusted R² and Cohen's f² with its label."""
    out = g.fit_summary(g.gram(df, target, features, keys), features, keys=keys)
    return out.withColumn("magnitude", F.when(F.col("f2").isNotNull(), effect_size_label("f2")))


def weather_value(df: DataFrame, target: str, features: Sequence[str],
                  keys: Sequence[str] = ("node",)) -> DataFrame:
    """R² with and without weather features, both from one Gram row per node."""
    models = {"full": list(features), "no_weather": weather_free(features)}
    fits = g.fit_summary(g.gram(df, target, features, keys), features, models, keys)
    return fits.groupBy(*keys).agg(
        F.max(F.when(F.col("model") == "full", F.col("r2"))).alias("r2_full"),
        F.max(F.when(F.col("model") == "no_weather", F.col("r2"))).alias("r2_no_weather"),
    ).withColumn("weather_value", F.col("r2_full") - F.col("r2_no_weather"))


def hold_out(df: DataFrame, target: str, features: Sequence[str], train_pct: float = 0.8,
             keys: Sequence[str] = ("node",), rounding: str = "down") -> DataFrame:
    """Fit on the first part in date order, measure on the rest."""
    rows = mark_split(g.complete(df, [target, *features]), train_pct, keys, rounding)
    coefs = g.wide_coefficients(g.gram(rows.where("is_train"), target, features, keys), features, keys=keys)
    scored = g.predict(rows, coefs, features, keys, "_fit")
    sizes = rows.groupBy(*keys).agg(
        F.count_if("is_train").alias("train_n"), F.count_if(~F.col("is_train")).alias("holdout_n"))
    test = g.accuracy(scored.where("not is_train"), target, "_fit", keys).drop("n")
    return sizes.join(test, list(keys), "left")


def residual_autocorrelation(df: DataFrame, target: str, features: Sequence[str],
                             keys: Sequence[str] = ("node",)) -> DataFrame:
    fitted = g.ols(df, target, features, keys, "_fit").withColumn("_e", F.col(target) - F.col("_fit"))
    return g.durbin_watson(fitted, "_e", keys)


def first_difference(df: DataFrame, target: str, features: Sequence[str],
                     keys: Sequence[str] = ("node",)) -> DataFrame:
    """R² and Durbin–Watson of the model in first differences."""
    diff = add_differences(df.select(*keys, "date", target, *features), [target, *features], keys)
    return _r2_and_dw(diff, target, features, keys)


def lagged_target(df: DataFrame, target: str, features: Sequence[str],
                  keys: Sequence[str] = ("node",)) -> DataFrame:
    """R², Durbin–Watson and the lag coefficient of the model with yesterday's target."""
    lag = f"{target}_lag1"
    w = Window.partitionBy(*keys).orderBy("date")
    rows = df.select(*keys, "date", target, *features).withColumn(lag, F.lag(target, 1).over(w))
    names = [*features, lag]
    moments = g.gram(rows, target, names, keys)
    term = (
        g.coefficients(moments, names, keys=keys).where(F.col("term") == lag)
        .select(*keys, F.col("coef").alias("lag_coef"), F.col("p").alias("lag_p"))
    )
    return _r2_and_dw(rows, target, names, keys).join(term, list(keys))


def _r2_and_dw(rows: DataFrame, target: str, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    fits = g.fit_summary(g.gram(rows, target, features, keys), features, keys=keys).select(*keys, "n", "r2")
    return fits.join(residual_autocorrelation(rows, target, features, keys), list(keys))


def newey_west(df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str] = ("node",),
               max_lag: int | None = None, alpha: float = 0.05) -> DataFrame:
    """Autocorrelation-robust errors: Bartlett weights, lag max(1, ⌊0.75·n^⅓⌋), normal p-values.

    Row products with their weighted lags are summed in one aggregate per node; only the
    k × k sandwich is solved outside the scan. ``max_lag`` bounds the number of lag columns
    and is read from the largest node when absent (one number).
    """
    rows = g.complete(df, [target, *features])
    group, by_day = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("date")
    if max_lag is None:
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.agg(F.max("n")).first()[0] or 1
        max_lag = max(1, int(0.75 * largest ** (1 / 3)))
    scored = g.ols(rows, target, features, keys, "_fit")
    e = F.col(target) - F.col("_fit")
    band = F.greatest(F.lit(1.0), F.floor(0.75 * F.pow(F.count(F.lit(1)).over(group), F.lit(1 / 3))))
    k = len(features) + 1
    products = F.array(e, *[e * F.col(c) for c in features])
    scored = scored.select(*keys, "date", products.alias("_u"), band.alias("_band"))
    scored = scored.withColumns({f"_l{lag}": F.lag("_u", lag).over(by_day) for lag in range(1, max_lag + 1)})

    def weighted(x, i):
        out = 0.5 * x
        for lag in range(1, max_lag + 1):
            weight = F.greatest(F.lit(0.0), 1 - lag / (F.col("_band") + 1))
            out = out + weight * F.coalesce(F.get(f"_l{lag}", i), F.lit(0.0))
        return out

    scored = scored.select(*keys, "_band", "_u", F.transform("_u", weighted).alias("_v"))
    meat = _sum_outer(scored, keys)
    moments = g.gram(rows, target, features, keys).join(meat, list(keys))
    features = list(features)
    schema = [
        T.StructField("term", T.StringType()), T.StructField("bandwidth", T.LongType()),
        T.StructField("coef", T.DoubleType()), T.StructField("std_err", T.DoubleType()),
    ]
    out_schema = T.StructType([moments.schema[c] for c in keys] + schema)

    def solve(batches):
        for batch in batches:
            parts = []
            for row in batch.to_dict("records"):
                mean, cov = unpack(row["mean"], row["cov"])
                n = int(row["n"])
                r = fit(mean, cov, n, range(k - 1))
                m = mean[:-1]
                # (X'X)^-1 with the intercept, from the centred inverse.
                bread = np.empty((k, k))
                bread[1:, 1:] = r["inv_xx"]
                bread[0, 1:] = bread[1:, 0] = -r["inv_xx"] @ m
                bread[0, 0] = 1.0 / n + m @ r["inv_xx"] @ m
                half = np.asarray(row["meat"], dtype=float).reshape(k, k)
                sandwich = bread @ (half + half.T) @ bread
                coefs = [r["intercept"], *r["slope"]]
                for i, term in enumerate(["const", *features]):
                    se = math.sqrt(max(sandwich[i, i], 0.0))
                    parts.append([row[c] for c in keys] + [term, int(row["bandwidth"]), float(coefs[i]), se])
            yield pd.DataFrame(parts, columns=out_schema.names)

    out = moments.mapInPandas(solve, out_schema).withColumn("p", F.when(F.col("std_err") > 0, normal_p(F.col("coef") / F.col("std_err"))))
    return out.withColumn("is_significant", F.coalesce(F.col("p") < alpha, F.lit(False)))


def _sum_outer(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Σ u vᵀ per key: one matrix per task and key, then the matrices are added up."""
    keys = list(keys)
    schema = T.StructType([*[scored.schema[c] for c in keys], T.StructField("bandwidth", T.LongType()),
                           T.StructField("meat", T.ArrayType(T.DoubleType()))])

    def reduce_batches(batches):
        held: dict = {}
        for batch in batches:
            for key, part in batch.groupby(keys, sort=False):
                u, v = np.array(part["_u"].tolist()), np.array(part["_v"].tolist())
                held[key] = (int(part["_band"].iloc[0]), held.get(key, (0, 0.0))[1] + (u.T @ v).ravel())
        yield pd.DataFrame([[*key, b, m.tolist()] for key, (b, m) in held.items()], columns=schema.names)

    def add_up(key: tuple[Any, ...], parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, band = 0.0, 0
        for part in parts:
            total = total + np.sum(part["meat"].tolist(), axis=0)
            band = int(part["bandwidth"].iloc[0])
        yield pd.DataFrame([[*key, band, total.tolist()]], columns=schema.names)

    return scored.mapInPandas(reduce_batches, schema).groupBy(*keys).applyInPandas(add_up, schema)


def unit_root(df: DataFrame, value: str, keys: Sequence[str] = ("node",), max_lag: int | None = None,
              min_rows: int = 20) -> DataFrame:
    """Augmented Dickey–Fuller test with a constant, lag chosen by AIC.

    One Gram of the longest design gives every candidate's AIC (nested sub-matrices); a
    second Gram on the rows the chosen lag allows gives the statistic.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, "date", F.col(value).cast("double").alias("_y"))
    by_day, group = Window.partitionBy(*keys).orderBy("date"), Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(group)
    limit = F.least(
        F.floor(n / 2) - 2, F.ceil(12.0 * F.pow(n / 100.0, F.lit(0.25))),
    ).cast("int")
    if max_lag is None:
        largest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        max_lag = max(0, min(largest // 2 - 2, math.ceil(12 * (largest / 100) ** 0.25)))
    limit = F.least(limit, F.lit(max_lag))
    width = max_lag + 2
    design = rows.withColumns({
        "_rows": n, "_limit": limit, "_pos": F.row_number().over(by_day),
        "_y1": F.lag("_y", 1).over(by_day),
    }).where(F.col("_rows") >= min_rows)
    earlier = F.reverse(F.collect_list("_d0").over(by_day.rowsBetween(-max_lag, -1))) if max_lag else F.array().cast("array<double>")
    design = design.withColumn("_d0", F.col("_y") - F.col("_y1")).withColumn("_lags", earlier).where("_d0 is not null")
    # Lags before the start are 0; no candidate of their node uses them.
    padding = F.array_repeat(F.lit(0.0), F.lit(max_lag) - F.size("_lags"))
    design = design.select(
        *keys, "_rows", "_limit", "_pos",
        F.concat(F.array("_y1"), "_lags", padding, F.array("_d0")).alias("_x"),
    )

    first = g.gram_of_array(design.where(F.col("_pos") > F.col("_limit") + 1), "_x", width, keys)
    limits = design.groupBy(*keys).agg(F.max("_limit").alias("_limit"), F.max("_rows").alias("rows"))
    chosen = first.join(limits.select(*keys, "_limit"), list(keys)).mapInPandas(
        _lag_chooser(keys), T.StructType([first.schema[c] for c in keys] + [T.StructField("lag", T.LongType())]),
    )
    second = g.gram_of_array(
        design.join(chosen, list(keys)).where(F.col("_pos") > F.col("lag") + 1), "_x", width, [*keys, "lag"])
    schema = [T.StructField("adf", T.DoubleType())]
    out_schema = T.StructType([second.schema[c] for c in [*keys, "lag"]] + schema)

    def statistic(batches):
        for batch in batches:
            parts = []
            for row in batch.to_dict("records"):
                mean, cov = unpack(row["mean"], row["cov"])
                r = fit(mean, cov, int(row["n"]), range(1 + int(row["lag"])))
                stat = float(r["slope"][0] / r["se"][0]) if r["se"][0] > 0 else None
                parts.append([row[c] for c in keys] + [int(row["lag"]), stat])
            yield pd.DataFrame(parts, columns=out_schema.names)

    return (
        second.mapInPandas(statistic, out_schema).withColumn("p", unit_root_p(F.col("adf")))
        .join(limits.select(*keys, F.col("rows").alias("n")), list(keys))
        .withColumn("is_stationary", F.col("p") < 0.05)
    )


def _lag_chooser(keys: Sequence[str]):
    """Smallest AIC over lags 0 … limit of each Gram row; the shorter lag wins a tie."""
    def choose(batches):
        for batch in batches:
            parts = []
            for row in batch.to_dict("records"):
                mean, cov = unpack(row["mean"], row["cov"])
                n, best = int(row["n"]), (math.inf, 0)
                for lag in range(int(row["_limit"]) + 1):
                    r = fit(mean, cov, n, range(1 + lag))
                    aic = n * math.log(max(r["sse"], 1e-300) / n) + 2 * (r["rank"] + 1)
                    best = min(best, (aic, lag))
                parts.append([row[c] for c in keys] + [best[1]])
            yield pd.DataFrame(parts, columns=[*keys, "lag"])
    return choose


def seasonal_sensitivity(df: DataFrame, target: str, features: Sequence[str],
                         keys: Sequence[str] = ("node",), min_rows: int = 15) -> DataFrame:
    """R² lift of weather in summer and winter, and their ratio (infinite if summer ≤ 0).

    A season of fewer than ``min_rows`` days lifts nothing; its key keeps its row.
    """
    m = F.month("date")
    seasonal = df.withColumn("_season", F.when(m.isin(*SUMMER), "summer").when(m.isin(*WINTER), "winter"))
    models = {"full": list(features), "no_weather": weather_free(features)}
    fits = g.fit_summary(
        g.gram(seasonal.where("_season is not null"), target, features, [*keys, "_season"]),
        features, models, [*keys, "_season"],
    )

    def lift(season):
        def r2(model):
            known = (F.col("n") >= min_rows) & (F.col("model") == model) & (F.col("_season") == season)
            return F.max(F.when(known, F.col("r2")))
        return F.coalesce(r2("full") - r2("no_weather"), F.lit(0.0))

    return fits.groupBy(*keys).agg(
        lift("summer").alias("summer_lift"), lift("winter").alias("winter_lift"),
    ).withColumn("ratio", F.when(
        F.col("summer_lift") > 0, F.col("winter_lift") / F.nullif(F.col("summer_lift"), F.lit(0.0)),
    ).otherwise(F.lit(float("inf"))))


def quadratic_peak(df: DataFrame, x: str, y: str, keys: Sequence[str] = ("node",)) -> DataFrame:
    """Second-degree fit y = a·x² + b·x + c and its turning point −b / 2a."""
    squared = df.withColumn("_x2", F.col(x) * F.col(x))
    c = g.wide_coefficients(g.gram(squared, y, [x, "_x2"], keys), [x, "_x2"], keys=keys)
    a, b = F.get("coefs", F.lit(2)), F.get("coefs", F.lit(1))
    return c.select(
        *keys, a.alias("a"), b.alias("b"), F.get("coefs", F.lit(0)).alias("c"),
        (-b / F.nullif(2 * a, F.lit(0.0))).alias("peak"),
    )


def compare_models(df: DataFrame, target: str, predictions: Mapping[str, str],
                   keys: Sequence[str] = ("node",)) -> DataFrame:
    """MAE, RMSE and R² of several prediction columns on the same rows, in one aggregate."""
    pairs = ", ".join(f"'{name}', cast(`{column}` as double)" for name, column in predictions.items())
    long = df.select(*keys, target, F.expr(f"stack({len(predictions)}, {pairs}) as (model, _yhat)"))
    return g.accuracy(long, target, "_yhat", [*keys, "model"])


def comparison_table(df: DataFrame, target: str, predictions: Mapping[str, str], train: str = "is_train",
                     keys: Sequence[str] = ("node",), digits: int = 4) -> DataFrame:
    """One row per model: hold-out n, MAE, RMSE and R², in-sample R², their gap, rank by RMSE.

    Both sides of the split come from one aggregate. A model without hold-out pairs stays, with
    NULL scores, and ranks last; equal errors rank by name.
    """
    pairs = ", ".join(f"'{name}', cast(`{column}` as double)" for name, column in predictions.items())
    long = df.select(*keys, train, target, F.expr(f"stack({len(predictions)}, {pairs}) as (model, _yhat)"))
    both = g.accuracy(long, target, "_yhat", [*keys, "model", train])
    models = long.select(*keys, "model").distinct()

    def at(flag: bool, column: str):
        return F.max(F.when(F.col(train) == F.lit(flag), F.col(column)))

    scores = both.groupBy(*keys, "model").agg(
        *[at(False, c).alias(c) for c in ("n", "mae", "rmse", "r2")], at(True, "r2").alias("insample_r2"))
    order = Window.partitionBy(*keys).orderBy(F.col("rmse").asc_nulls_last(), "model")
    return (
        models.join(scores, [*keys, "model"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0))).withColumn("gap", F.col("r2") - F.col("insample_r2"))
        .withColumn("rank", F.row_number().over(order))
        .withColumns({c: F.round(c, digits) for c in ("mae", "rmse", "r2", "insample_r2", "gap")})
    )


def generalisation_gap(in_sample: DataFrame, hold_out_: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Hold-out R² minus in-sample R² per model."""
    return (
        in_sample.select(*keys, F.col("r2").alias("insample_r2"))
        .join(hold_out_.select(*keys, F.col("r2").alias("holdout_r2"), F.col("mae").alias("holdout_mae")), list(keys))
        .withColumn("gap", F.col("holdout_r2") - F.col("insample_r2"))
    )


def subset_ablation(df: DataFrame, target: str, features: Sequence[str], families: Mapping[str, Sequence[str]],
                    keys: Sequence[str] = ("node",)) -> DataFrame:
    """R² of the linear model without each feature family, all from one Gram row."""
    models = {"full": list(features)}
    for name, members in families.items():
        rest = [f for f in features if f not in set(members)]
        if members and rest:
            models[f"no_{name}"] = rest
    fits = g.fit_summary(g.gram(df, target, features, keys), features, models, keys)
    full = F.max(F.when(F.col("model") == "full", F.col("r2"))).over(Window.partitionBy(*keys))
    return fits.select(*keys, F.col("model").alias("scenario"), "r2", (F.col("r2") - full).alias("delta_r2"))
