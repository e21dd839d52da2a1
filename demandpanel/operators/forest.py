"""Random forests through Spark ML: fit, folds, importances, ablation.

Fits are distributed; only loops over *fits* run on the driver. Folds, permutations and
scores are columns, so no row is pulled out of the executors.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F

from .features import without_family
from .gram import accuracy, complete

PARAMS = {"numTrees": 500, "maxDepth": 10, "minInstancesPerNode": 5, "seed": 42}


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    rows = complete(df, features)
    ready = rows.withColumns({f"_x{i}": F.col(c).cast("double") for i, c in enumerate(features)})
    names = [f"_x{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=names, outputCol="_features").transform(ready).drop(*names)


def fit_forest(df: DataFrame, target: str, features: Sequence[str], **params):
    rows = assemble(complete(df, [target]), features).withColumn("_label", F.col(target).cast("double"))
    return RandomForestRegressor(
        featuresCol="_features", labelCol="_label", predictionCol="pred_random_forest",
        **{**PARAMS, **params},
    ).fit(rows)


def score_forest(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    return model.transform(assemble(df, features)).drop("_features")


def impurity_importance(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    values = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray(), strict=True)]
    return df.sparkSession.createDataFrame(values, "feature string, importance double")


def assign_folds(df: DataFrame, folds: int = 5, keys: Sequence[str] = ("node",)) -> DataFrame:
    """Contiguous folds in date order; the first n mod k folds hold one row more."""
    w = Window.partitionBy(*keys).orderBy("date")
    return df.withColumn("fold", F.ntile(folds).over(w))


def cross_validate(df: DataFrame, target: str, features: Sequence[str], folds: int = 5,
                   keys: Sequence[str] = ("node",), **params) -> DataFrame:
    """R² of each held-out fold."""
    rows = assign_folds(complete(df, [target, *features]), folds, keys)
    scored = None
    for k in range(1, folds + 1):
        model = fit_forest(rows.where(F.col("fold") != k), target, features, **params)
        part = score_forest(model, rows.where(F.col("fold") == k), features)
        scored = part if scored is None else scored.unionByName(part)
    return accuracy(scored, target, "pred_random_forest", ["fold"])


#: Rows of one cell of a shuffle, about.
CELL_ROWS = 50_000


def shuffled_values(rows: DataFrame, value: Column, id_: Column, groups: Sequence[str] = (), seed: int = 42,
                    cells: int | None = None) -> DataFrame:
    """``rows`` with ``_moved``: the column's values permuted over all rows of each group.

    Rows stand in the order of a seeded digest of their id, and each takes the value of the
    next one, the last that of the first: one cycle through all rows in random order. The
    order is cut into ``cells`` ranges of the digest (from the number of rows when absent);
    a range's last row takes the first value of the next range that has rows, so no task
    holds a group.
    """
    if cells is None:
        cells = 1 + rows.count() // CELL_ROWS
    groups = list(groups)
    digest = F.md5(F.concat_ws(":", id_.cast("string"), *[F.col(g).cast("string") for g in groups], F.lit(str(seed))))
    placed = rows.withColumns({"_value": value, "_key": digest})
    placed = placed.withColumn("_cell", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * cells / F.lit(2.0 ** 32)).cast("long"))
    inside = Window.partitionBy(*groups, "_cell").orderBy("_key")
    # One row a cell here: its first value, handed to the cell before it, around the end to the last.
    edges = placed.groupBy(*groups, "_cell").agg(F.min_by(F.struct("_value"), "_key").alias("_head"))
    order, whole = Window.partitionBy(*groups).orderBy("_cell"), Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.withColumn("_after", F.coalesce(F.lead("_head").over(order), F.first("_head").over(whole))).drop("_head")
    moved = placed.withColumn("_next", F.lead(F.struct("_value")).over(inside)).join(edges, [*groups, "_cell"])
    return moved.withColumn("_moved", F.coalesce("_next", "_after")["_value"]).drop("_next", "_after", "_value", "_key", "_cell")


def permutation_importance(model, df: DataFrame, target: str, features: Sequence[str], repeats: int = 10, seed: int = 42) -> DataFrame:
    """Mean and deviation of the R² drop when one feature is shuffled over all rows.

    Every (feature, repeat) variant is scored in one job.
    """
    rows = complete(df, [target, *features]).withColumn("_id", F.md5(F.to_json(F.struct(*df.columns))))
    plan = F.array(*[
        F.struct(F.lit(i).alias("f"), F.lit(r).alias("r"))
        for i in range(len(features)) for r in range(repeats)
    ])
    own = F.array(*[F.col(c).cast("double") for c in features])
    variants = rows.select("_id", F.col(target), own.alias("_x"), F.explode(plan).alias("_v")).select("_id", target, "_x", "_v.f", "_v.r")
    moved = shuffled_values(variants, F.get("_x", F.col("f")), F.col("_id"), ["f", "r"], seed, cells=1 + rows.count() // CELL_ROWS)
    shuffled = moved.withColumn(
        "_features",
        array_to_vector(F.transform("_x", lambda x, i: F.when(i == F.col("f"), F.col("_moved")).otherwise(x))),
    )
    broken = accuracy(model.transform(shuffled.select("f", "r", target, "_features")), target,
                      "pred_random_forest", ["f", "r"])
    base = accuracy(score_forest(model, rows, features).withColumn("f", F.lit(0)), target,
                    "pred_random_forest", ["f"]).select("r2").scalar()
    names = F.array(*[F.lit(c) for c in features])
    return (
        broken.withColumn("_drop", base - F.col("r2")).groupBy("f")
        .agg(F.avg("_drop").alias("importance_mean"), F.stddev_pop("_drop").alias("importance_std"))
        .select(F.get(names, F.col("f")).alias("feature"), "importance_mean", "importance_std")
    )


def family_ablation(split: DataFrame, target: str, features: Sequence[str],
                    families: Mapping[str, Sequence[str]], full_scored: DataFrame | None = None,
                    **params) -> DataFrame:
    """Test scores of the forest without each feature family, and the change against all.

    ``split`` carries ``is_train``. Families that are empty or the whole list are skipped.
    """
    rows = complete(split, [target, *features])
    train, test = rows.where("is_train"), rows.where("not is_train")
    scenarios = {"full": list(features)}
    for name in families:
        rest = without_family(features, name, dict(families))
        if rest and len(rest) < len(features):
            scenarios[f"no_{name}"] = rest
    scored = None
    for name, columns in scenarios.items():
        if name == "full" and full_scored is not None:
            part = full_scored
        else:
            part = score_forest(fit_forest(train, target, columns, **params), test, columns)
        part = part.select(F.lit(name).alias("scenario"), target, "pred_random_forest")
        scored = part if scored is None else scored.unionByName(part)
    out = accuracy(scored, target, "pred_random_forest", ["scenario"])
    full = {c: F.max(F.when(F.col("scenario") == "full", F.col(c))).over(Window.partitionBy(F.lit(1)))
            for c in ("mae", "r2")}
    return out.withColumns({
        "delta_mae_vs_full": F.col("mae") - full["mae"], "delta_r2_vs_full": F.col("r2") - full["r2"],
    })
