"""Grouped least squares from one aggregate.

``gram`` reduces the rows of every node to n, means and covariances in a single pass
(``covar_pop`` merges centred moments, so nothing cancels and partial aggregation keeps the
shuffle to one row per node and task). Everything else — coefficients, errors, effect sizes,
variance inflation, any feature subset — is solved from that one small row per node.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.tails import t_p


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


# Up to this many columns the moments are aggregates of one pass without any expansion; the plan of
# wider designs would grow with the square of the width, so their pairs become rows.
WIDE = 8


def gram(df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str] = ("node",)) -> DataFrame:
    """keys, n, mean ARRAY, cov ARRAY (row-wise upper triangle over features, then target)."""
    names = [*features, target]
    rows = complete(df, names)
    x = [F.col(c).cast("double") for c in names]
    if len(names) > WIDE:
        return gram_of_array(rows.withColumn("_x", F.array(*x)), "_x", len(names), keys)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(c).alias(f"_m{i}") for i, c in enumerate(x)]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    aggs += [
        (F.var_pop(x[i]) if i == j else F.covar_pop(x[i], x[j])).alias(f"_c{i}_{j}") for i, j in pairs
    ]
    return rows.groupBy(*keys).agg(*aggs).select(
        *keys, "n",
        F.array(*[F.col(f"_m{i}") for i in range(len(x))]).alias("mean"),
        F.array(*[F.col(f"_c{i}_{j}") for i, j in pairs]).alias("cov"),
    )


def gram_of_array(rows: DataFrame, column: str, width: int, keys: Sequence[str] = ("node",)) -> DataFrame:
    """:func:`gram` of an ARRAY column (features, then target) without missing entries.

    Each row gives its pairs of entries, and one covariance is taken for each pair: the plan is
    the same for any width, and partial aggregation leaves one row for each pair and key of a
    task. The pairs of a key are put together to one row at the end.
    """
    lines = rows.select(*keys, F.posexplode(column).alias("_i", "_v"), column)
    after = F.slice(column, F.col("_i") + 1, F.lit(width) - F.col("_i"))
    pairs = lines.select(*keys, "_i", "_v", F.posexplode(after).alias("_j", "_w"))
    moments = pairs.groupBy(*keys, "_i", "_j").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_v").alias("m"), F.covar_pop("_v", "_w").alias("c"))
    whole = moments.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.sort_array(F.collect_list(F.when(F.col("_j") == 0, F.struct("_i", "m")))).alias("_means"),
        F.sort_array(F.collect_list(F.struct("_i", "_j", "c"))).alias("_pairs"),
    )
    return whole.select(*keys, "n", F.col("_means.m").alias("mean"), F.col("_pairs.c").alias("cov"))


def unpack(row_mean, row_cov) -> tuple[np.ndarray, np.ndarray]:
    mean = np.asarray(row_mean, dtype=float)
    k = len(mean)
    cov = np.zeros((k, k))
    cov[np.triu_indices(k)] = np.asarray(row_cov, dtype=float)
    return mean, cov + np.triu(cov, 1).T


def fit(mean: np.ndarray, cov: np.ndarray, n: int, use: Sequence[int]) -> dict:
    """Least squares with intercept from moments; constant or collinear columns are allowed."""
    use, y = list(use), len(mean) - 1
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    scale = np.array([sd[i] if sd[i] > 1e-12 * max(1.0, abs(mean[i])) else 0.0 for i in use])
    inv = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)
    corr = cov[np.ix_(use, use)] * np.outer(inv, inv)
    pinv = np.linalg.pinv(corr, rcond=1e-12, hermitian=True) if use else np.zeros((0, 0))
    cxy = cov[use, y] * inv
    slope_z = pinv @ cxy
    slope = slope_z * inv
    rank = int(np.linalg.matrix_rank(corr, tol=1e-10, hermitian=True)) if use else 0
    sst, sse = n * cov[y, y], n * max(cov[y, y] - float(cxy @ slope_z), 0.0)
    dof = n - rank - 1
    sigma2 = sse / dof if dof > 0 else np.nan
    inv_xx = pinv * np.outer(inv, inv) / n
    m = mean[use]
    se = np.sqrt(np.clip(sigma2 * np.diag(inv_xx), 0, None))
    se0 = np.sqrt(max(sigma2 * (1.0 / n + float(m @ inv_xx @ m)), 0.0)) if dof > 0 else np.nan
    r2 = 1 - sse / sst if sst > 0 else np.nan
    return {
        "intercept": mean[y] - float(m @ slope), "slope": slope, "se": se, "se0": se0,
        "sse": sse, "sst": sst, "dof": dof, "rank": rank, "r2": r2,
        "adj_r2": 1 - (1 - r2) * (n - 1) / dof if dof > 0 else np.nan,
        "sd": sd, "use": use, "inv_xx": inv_xx,
    }


def _per_row(gram_rows: DataFrame, keys: Sequence[str], schema: list[T.StructField], build) -> DataFrame:
    """Run ``build(mean, cov, n) -> rows`` on each Gram row; rows stay where they are."""
    out = T.StructType([gram_rows.schema[k] for k in keys] + schema)
    names = [f.name for f in schema]

    def solve(batches):
        for batch in batches:
            parts = []
            for row in batch.to_dict("records"):
                mean, cov = unpack(row["mean"], row["cov"])
                for record in build(mean, cov, int(row["n"])):
                    parts.append([row[k] for k in keys] + [record[c] for c in names])
            frame = pd.DataFrame(parts, columns=[*keys, *names])
            doubles = [f.name for f in schema if isinstance(f.dataType, T.DoubleType)]
            for c in doubles:
                v = frame[c].astype("float64")
                frame[c] = v.where(np.isfinite(v), np.nan).astype(object).where(v.notna(), None)
            yield frame

    return gram_rows.mapInPandas(solve, out)


def _f(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


def coefficients(
    gram_rows: DataFrame, features: Sequence[str], models: Mapping[str, Sequence[str]] | None = None,
    keys: Sequence[str] = ("node",),
) -> DataFrame:
    """Long table per (keys, model, term) of every named feature subset.

    coef, std_err, t, p; ``beta`` uses sample deviations (divisor n−1); ``beta_z`` is the
    coefficient of the fit on z-scores and NULL when any column is constant.
    """
    features = list(features)
    chosen = {m: [features.index(c) for c in cols] for m, cols in (models or {"full": features}).items()}
    schema = [
        T.StructField("model", T.StringType()), T.StructField("term", T.StringType()),
        T.StructField("position", T.LongType()),
        _f("coef"), _f("std_err"), _f("t"), _f("dof"), _f("beta"), _f("beta_z"),
    ]

    def build(mean, cov, n):
        for model, use in chosen.items():
            r = fit(mean, cov, n, use)
            y_sd = r["sd"][-1]
            regular = y_sd > 0 and all(r["sd"][i] > 0 for i in use)
            terms = [("const", r["intercept"], r["se0"], None)]
            terms += [(features[i], r["slope"][j], r["se"][j], r["sd"][i]) for j, i in enumerate(use)]
            for pos, (term, coef, se, sd) in enumerate(terms):
                t = coef / se if se and se > 0 else np.nan
                beta = coef * sd / y_sd if sd is not None and y_sd > 0 else np.nan
                yield {
                    "model": model, "term": term, "position": pos, "coef": coef, "std_err": se,
                    "t": t, "dof": r["dof"], "beta": beta,
                    "beta_z": beta if regular else np.nan,
                }

    rows = _per_row(gram_rows, keys, schema, build)
    return rows.select(*keys, "model", "term", "position", "coef", "std_err", "t", t_p(F.col("t"), F.col("dof")).alias("p"), "beta", "beta_z")


def fit_summary(
    gram_rows: DataFrame, features: Sequence[str], models: Mapping[str, Sequence[str]] | None = None,
    keys: Sequence[str] = ("node",),
) -> DataFrame:
    """n, k, r2, adj_r2, f2, sse and sst per (keys, model)."""
    features = list(features)
    chosen = {m: [features.index(c) for c in cols] for m, cols in (models or {"full": features}).items()}
    schema = [
        T.StructField("model", T.StringType()), T.StructField("n", T.LongType()),
        T.StructField("k", T.LongType()), _f("r2"), _f("adj_r2"), _f("f2"), _f("sse"), _f("sst"),
    ]

    def build(mean, cov, n):
        for model, use in chosen.items():
            r = fit(mean, cov, n, use)
            f2 = r["r2"] / (1 - r["r2"]) if r["r2"] < 1 else np.nan
            yield {"model": model, "n": n, "k": len(use), "r2": r["r2"], "adj_r2": r["adj_r2"],
                   "f2": f2, "sse": r["sse"], "sst": r["sst"]}

    return _per_row(gram_rows, keys, schema, build)


def variance_inflation(gram_rows: DataFrame, features: Sequence[str], keys: Sequence[str] = ("node",),
                       high: float = 10.0) -> DataFrame:
    """Variance inflation of each feature given the others, with the flag above ``high``."""
    features = list(features)
    schema = [T.StructField("feature", T.StringType()), _f("vif"), T.StructField("is_high", T.BooleanType())]

    def build(mean, cov, n):
        for i, name in enumerate(features):
            order = [j for j in range(len(features)) if j != i] + [i]
            r = fit(mean[order], cov[np.ix_(order, order)], n, range(len(features) - 1))
            free = 1 - r["r2"]
            vif = 1 / free if free > 0 else np.inf
            yield {"feature": name, "vif": vif, "is_high": bool(vif > high)}

    return _per_row(gram_rows, keys, schema, build)


def wide_coefficients(
    gram_rows: DataFrame, features: Sequence[str], use: Sequence[str] | None = None,
    keys: Sequence[str] = ("node",),
) -> DataFrame:
    """keys, ``coefs`` ARRAY: intercept, then one slope per feature (one row per node)."""
    features, use = list(features), list(use or features)
    idx = [features.index(c) for c in use]
    schema = [T.StructField("coefs", T.ArrayType(T.DoubleType()))]

    def build(mean, cov, n):
        r = fit(mean, cov, n, idx)
        yield {"coefs": [float(r["intercept"]), *map(float, r["slope"])]}

    return _per_row(gram_rows, keys, schema, build)


def solutions(
    gram_rows: DataFrame, features: Sequence[str], models: Mapping[str, Sequence[str]],
    keys: Sequence[str] = ("node",),
) -> DataFrame:
    """All models of a Gram row in one row: keys, n and, per model, ``<m>_r2``, ``<m>_adj_r2``,
    ``<m>_coefs`` (intercept, then slopes) and ``<m>_beta_z`` (fit on z-scores; NULL where a column is constant)."""
    features = list(features)
    chosen = {m: [features.index(c) for c in cols] for m, cols in models.items()}
    schema = [T.StructField("n", T.LongType())]
    for m in chosen:
        schema += [_f(f"{m}_r2"), _f(f"{m}_adj_r2"), T.StructField(f"{m}_coefs", T.ArrayType(T.DoubleType())),
                   T.StructField(f"{m}_beta_z", T.ArrayType(T.DoubleType()))]

    def build(mean, cov, n):
        row = {"n": n}
        for m, use in chosen.items():
            r = fit(mean, cov, n, use)
            sd, y_sd = r["sd"][use], r["sd"][-1]
            regular = y_sd > 0 and bool((sd > 0).all())
            row |= {f"{m}_r2": r["r2"], f"{m}_adj_r2": r["adj_r2"], f"{m}_coefs": [float(r["intercept"]), *map(float, r["slope"])],
                    f"{m}_beta_z": [float(b) if regular else None for b in r["slope"] * sd / (y_sd or 1.0)]}
        yield row

    return _per_row(gram_rows, keys, schema, build)


def predict(
    df: DataFrame, coefs: DataFrame, features: Sequence[str], keys: Sequence[str] = ("node",),
    out: str = "predicted",
) -> DataFrame:
    """Fitted value as a column expression over one joined coefficient row per node."""
    value = F.get("_coefs", F.lit(0))
    for i, c in enumerate(features, start=1):
        value = value + F.get("_coefs", F.lit(i)) * F.col(c)
    return (
        df.join(coefs.withColumnRenamed("coefs", "_coefs"), list(keys), "left")
        .withColumn(out, value).drop("_coefs")
    )


def ols(
    df: DataFrame, target: str, features: Sequence[str], keys: Sequence[str] = ("node",),
    out: str = "predicted", fit_on: DataFrame | None = None,
) -> DataFrame:
    """Rows with complete features plus the fitted value."""
    rows = complete(df, [target, *features])
    coefs = wide_coefficients(gram(rows if fit_on is None else fit_on, target, features, keys), features, keys=keys)
    return predict(rows, coefs, features, keys, out)


def accuracy(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ("node",)) -> DataFrame:
    """n, mae, rmse and r2 over pairs that are both present; NULL below two pairs."""
    y, e = F.col(actual).cast("double"), F.col(actual) - F.col(predicted)
    pairs = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    enough = F.col("n") >= 2
    return (
        pairs.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("_mae"),
            F.avg(e * e).alias("_mse"), F.var_pop(y).alias("_var"),
        )
        .select(
            *keys, "n",
            F.when(enough, F.col("_mae")).alias("mae"),
            F.when(enough, F.sqrt("_mse")).alias("rmse"),
            F.when(enough, 1 - F.col("_mse") / F.nullif(F.col("_var"), F.lit(0.0))).alias("r2"),
        )
    )


def durbin_watson(df: DataFrame, residual: str, keys: Sequence[str] = ("node",), date: str = "date") -> DataFrame:
    """dw and the flag 1.5 ≤ dw ≤ 2.5, residuals in date order."""
    step = F.col(residual) - F.lag(residual, 1).over(Window.partitionBy(*keys).orderBy(date))
    return (
        df.withColumn("_step", step).groupBy(*keys)
        .agg((F.sum(F.col("_step") * F.col("_step"))
              / F.nullif(F.sum(F.col(residual) * F.col(residual)), F.lit(0.0))).alias("dw"))
        .withColumn("dw_clean", F.col("dw").between(1.5, 2.5))
    )
