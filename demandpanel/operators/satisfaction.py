"""Satisfaction against crowding and comfort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import fixed, text
from ..functions.comfort import discomfort_index, wind_chill
from ..functions.values import known, right_closed_bin
from .correlation import chi_square_2x2, spearman


def daily_satisfaction(survey: DataFrame, keys: Sequence[str] = (), keyword: str | None = None) -> DataFrame:
    """Mean satisfaction, its count, mean recommendation and mean service score per day."""
    rows = survey if keyword is None else survey.where(known(F.col("prefecture").contains(keyword)))
    aggs = [F.avg("satisfaction").alias("mean_satisfaction"), F.count("satisfaction").alias("n_responses")]
    for column, name in (("nps_raw", "mean_nps"), ("satisfaction_service", "mean_service")):
        if column in survey.columns:
            aggs.append(F.avg(column).alias(name))
    out = rows.groupBy(*keys, "date").agg(*aggs)
    return out if "mean_nps" in out.columns else out.withColumn("mean_nps", F.lit(None).cast("double"))


def monthly_satisfaction(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of daily means (not weighted) and the sum of responses per month."""
    return daily.groupBy(*keys, F.trunc("date", "MM").alias("date")).agg(
        F.avg("mean_satisfaction").alias("mean_satisfaction"),
        F.sum("n_responses").alias("n_responses"), F.avg("mean_nps").alias("mean_nps"),
    )


def crowding_join(panel: DataFrame, sat_daily: DataFrame, grain: str = "day", min_days: int = 20) -> DataFrame:
    """Counts with satisfaction by exact ``day`` or by ``month``, as the caller says.

    ``grain="auto"`` takes days, or months when at most ``min_days`` days meet: a scalar
    subquery on the exact join then decides which rows pass.
    """
    days = panel.select("date", F.col("count").cast("double").alias("count"))
    columns = ["date", "count", "mean_satisfaction", "n_responses", "mean_nps"]
    exact = days.join(sat_daily, "date").select(*columns)
    monthly_counts = days.groupBy(F.trunc("date", "MM").alias("date")).agg(F.avg("count").alias("count"))
    monthly = monthly_counts.join(monthly_satisfaction(sat_daily), "date").select(*columns)
    if grain in ("day", "month"):
        return (exact if grain == "day" else monthly).withColumn("grain", F.lit(grain))
    if grain != "auto":
        raise ValueError(f"unknown grain {grain!r}")
    met = exact.select(F.count(F.lit(1))).scalar()
    return (
        exact.where(met > min_days).withColumn("grain", F.lit("day"))
        .unionByName(monthly.where(met <= min_days).withColumn("grain", F.lit("month")))
    )


def visitor_bins(joined: DataFrame, edges: Sequence[float] = fixed.VISITOR_EDGES,
                 labels: Sequence[str] = fixed.VISITOR_LABELS) -> DataFrame:
    """Mean satisfaction, mean recommendation and rows per right-closed visitor bin."""
    binned = joined.withColumn("visitor_bin", right_closed_bin("count", edges, labels))
    return binned.where("visitor_bin is not null").groupBy("visitor_bin").agg(
        F.avg("mean_satisfaction").alias("mean_satisfaction"), F.avg("mean_nps").alias("mean_nps"),
        F.count(F.lit(1)).alias("n"),
    )


def crowding_correlation(joined: DataFrame, min_rows: int = 4) -> DataFrame:
    """Spearman of counts with satisfaction and with recommendation (missing → satisfaction)."""
    rows = joined.where("mean_satisfaction is not null and count is not null").select(
        "count",
        F.explode(F.array(
            F.struct(F.lit("satisfaction").alias("measure"), F.col("mean_satisfaction").alias("score")),
            F.struct(F.lit("nps").alias("measure"), F.coalesce("mean_nps", "mean_satisfaction").alias("score")),
        )).alias("_s"),
    ).select("count", "_s.*")
    return spearman(rows, "count", "score", ["measure"], min_rows)


def add_comfort(weather: DataFrame, *, humidity: str = "given", min_humidity: int = 30, assumed: float = 60.0,
                coefficients: dict | None = None) -> DataFrame:
    """discomfort_index and, with wind, wind_chill.

    ``humidity`` is "given" (the column, where the frame has one), "assumed" (a fixed value and
    the standard coefficients), or "auto": assumed when the whole frame has at most
    ``min_humidity`` values.
    """
    if humidity not in ("given", "assumed", "auto"):
        raise ValueError(f"unknown humidity {humidity!r}")
    temp_only = discomfort_index("temp", F.lit(assumed))
    index = temp_only
    if "humidity" in weather.columns and humidity != "assumed":
        index = discomfort_index("temp", "humidity", coefficients)
        if humidity == "auto":
            index = F.when(weather.select(F.count("humidity")).scalar() > min_humidity, index).otherwise(temp_only)
    out = weather.withColumn("discomfort_index", index)
    return out.withColumn("wind_chill", wind_chill("temp", "wind")) if "wind" in weather.columns else out


def comfort_correlations(comfort: DataFrame, sat_daily: DataFrame, min_pairs: int = 10) -> DataFrame:
    """Spearman of comfort with satisfaction and recommendation, all pairs in one pass.

    Every measure keeps its row and n; r is NULL under its least number of pairs.
    """
    joined = comfort.select("date", "discomfort_index", "wind_chill").join(sat_daily, "date")
    pairs = [("di_satisfaction", "discomfort_index", "mean_satisfaction", 1),
             ("wc_satisfaction", "wind_chill", "mean_satisfaction", min_pairs + 1),
             ("di_nps", "discomfort_index", "mean_nps", min_pairs + 1)]
    rows = joined.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("measure"), F.col(x).alias("x"), F.col(y).alias("y"), F.lit(need).alias("need"))
        for name, x, y, need in pairs
    ])).alias("_p")).select("_p.*")
    need = F.create_map(*[F.lit(v) for name, _, _, k in pairs for v in (name, k)])
    return spearman(rows, "x", "y", ["measure"], 1).withColumn("r", F.when(F.col("n") >= need[F.col("measure")], F.col("r")))


def comfort_peak(joined: DataFrame, value: str = "discomfort_index", score: str = "mean_satisfaction",
                 bins: int = 5, min_rows: int = 30, keys: Sequence[str] = ("node",)) -> DataFrame:
    """Quantile bins of ``value``, their mean score, and the bin where it peaks.

    Bins are right-closed, the lowest value belongs to the first, equal edges merge.
    """
    rows = joined.where(F.col(value).isNotNull() & F.col(score).isNotNull())
    steps = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    edges = rows.groupBy(*keys).agg(
        F.array_distinct(F.percentile(value, steps)).alias("_edges"), F.count(F.lit(1)).alias("_rows"),
    ).where(F.col("_rows") > min_rows)
    inner = F.filter("_edges", lambda e, i: (i > 0) & (e < F.col(value)))
    binned = rows.join(edges, list(keys)).withColumn("bin", F.size(inner) + 1)
    per_bin = binned.groupBy(*keys, "bin").agg(
        F.avg(score).alias("mean_score"), F.count(F.lit(1)).alias("n"), F.first("_edges").alias("_edges"))
    peak = F.max_by(F.struct("bin", "mean_score", "n", "_edges"), F.struct("mean_score", -F.col("bin")))
    left = F.get("_p._edges", F.col("_p.bin") - 1)
    right = F.get("_p._edges", F.col("_p.bin"))
    return per_bin.groupBy(*keys).agg(peak.alias("_p")).select(
        *keys, F.col("_p.bin").cast("bigint").alias("bin"), "_p.mean_score", "_p.n",
        left.alias("low"), right.alias("high"), ((left + right) / 2).alias("mid"),
    )


def complaint_mining(texts: DataFrame, keywords: Sequence[str] = fixed.UNDERVIBRANCY_KEYWORDS,
                     keys: Sequence[str] = (), parts: Sequence[str] = ("reason", "inconvenience", "freetext"),
                     ) -> DataFrame:
    """Keyword hits among low and high scores in one scan.

    The low share counts texts longer than three characters, the high share counts all rows.
    """
    joined = text.join_with_spaces(*parts)
    rows = texts.withColumns({
        "_low": known(F.col("satisfaction").isin(1, 2)), "_high": known(F.col("satisfaction").isin(4, 5)),
    }).where("_low or _high").withColumn("_text", joined)
    length = F.length(text.stripped("_text"))
    rows = rows.select(*keys, "_low", "_high", length.alias("_len"),
                       text.contains_any("_text", keywords).alias("_hit"))
    low, high, hit = F.col("_low") & (F.col("_len") > 3), F.col("_high"), F.col("_hit")
    out = rows.groupBy(*keys).agg(
        F.count_if(low).alias("n_low"), F.count_if(low & hit).alias("hits_low"),
        F.count_if(high).alias("n_high"), F.count_if(high & hit & (F.col("_len") >= 3)).alias("hits_high"),
    )
    pct_low = F.when(F.col("n_low") > 0, F.col("hits_low") / F.nullif(F.col("n_low"), F.lit(0)) * 100).otherwise(0.0)
    pct_high = F.when(F.col("n_high") > 0, F.col("hits_high") / F.nullif(F.col("n_high"), F.lit(0)) * 100).otherwise(0.01)
    return out.withColumns({"pct_low": pct_low, "pct_high": pct_high}).withColumns({
        "ratio_vs_high": F.col("pct_low") / F.greatest(F.col("pct_high"), F.lit(0.1)),
        "chi2": chi_square_2x2(
            F.col("hits_low"), F.col("n_low") - F.col("hits_low"),
            F.col("hits_high"), F.col("n_high") - F.col("hits_high"),
        ),
    })


def complaint_examples(texts: DataFrame, order: str, keywords: Sequence[str] = fixed.UNDERVIBRANCY_KEYWORDS,
                       n: int = 5, chars: int = 200,
                       parts: Sequence[str] = ("reason", "inconvenience", "freetext")) -> DataFrame:
    """The first ``n`` low-score texts with a hit, the keyword found, and the text cut short."""
    rows = texts.where(F.col("satisfaction").isin(1, 2)).withColumn("_text", text.join_with_spaces(*parts))
    rows = rows.where(F.length(text.stripped("_text")) > 3).withColumn("keyword", text.first_keyword("_text", keywords))
    return (
        rows.where("keyword is not null").orderBy(order).limit(n)
        .select(order, "satisfaction", "keyword", F.substring("_text", 1, chars).alias("sample"))
    )


def complaint_drivers(survey: DataFrame, classify, order: str, *, labels: Sequence[str] = fixed.COMPLAINT_LABELS,
                      max_samples: int | None = None, text_max_chars: int | None = None,
                      parts: Sequence[str] = ("reason", "inconvenience", "freetext")) -> DataFrame:
    """Share of each complaint label among detractors (score ≤ 2).

    ``classify`` is the caller's Column function, usually a ``pandas_udf`` that loads its
    model once per task. All detractors and whole texts are read, unless the caller sets a
    sample size or a text length; labels nobody got stay with 0.
    """
    present = [c for c in parts if c in survey.columns]
    rows = survey.where(F.col("satisfaction") <= 2).withColumn(
        "_text", F.coalesce(text.join_non_empty(present, " "), F.lit("")))
    rows = rows.where(F.length("_text") > 3)
    if max_samples is not None:
        rows = rows.orderBy(order).limit(max_samples)
    shown = F.col("_text") if text_max_chars is None else F.substring("_text", 1, text_max_chars)
    found = rows.select(classify(shown).alias("label"))
    known_labels = survey.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    counts = found.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return (
        known_labels.join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("pct", F.col("n") / F.nullif(total, F.lit(0)) * 100)
        .orderBy(F.col("pct").desc(), "label")
    )


def site_resilience(survey: DataFrame, site: str, *, min_per_day: int = 3, min_days: int = 10,
                    min_responses: int = 20, place: str = "location",
                    parts: Sequence[str] = ("reason", "inconvenience", "freetext"),
                    congestion: Sequence[str] = fixed.CONGESTION_KEYWORDS,
                    quiet: Sequence[str] = fixed.QUIETNESS_KEYWORDS) -> DataFrame:
    """Satisfaction rate, density against score, and complaint shares of one site, one row."""
    label = F.col("satisfaction").cast("string")
    plain = F.regexp_replace(label, r"\.0+$", "")
    score = F.coalesce(
        F.create_map(*[F.lit(v) for kv in fixed.SATISFACTION_SCORES.items() for v in kv])[label].cast("double"),
        plain.try_cast("double"),
    )
    rows = survey.where(known(F.col(place).cast("string").contains(site))).withColumns({
        "_high": known(plain.isin(*fixed.HIGH_LABELS)), "_low": known(plain.isin(*fixed.LOW_LABELS)),
        "_score": score, "_text": text.join_with_spaces(*[p for p in parts if p in survey.columns]),
    }).withColumns({
        "_busy": text.contains_any("_text", congestion), "_quiet": text.contains_any("_text", quiet),
    }).withColumn("site", F.lit(site))

    def pct(part, whole):
        return F.bround(part / F.nullif(whole, F.lit(0)) * 100, 1)

    n, low = F.count(F.lit(1)), F.count_if("_low")
    shares = rows.groupBy("site").agg(
        n.alias("n_responses"), pct(F.count_if("_high"), n).alias("sat_rate_pct"), low.alias("n_low_sat"),
        pct(F.count_if("_busy"), n).alias("congestion_pct"),
        pct(F.count_if(F.col("_busy") & F.col("_low")), low).alias("congestion_low_sat_pct"),
        F.count_if(F.col("_quiet") & F.col("_low")).alias("undervibrancy_low_sat"),
    ).where(F.col("n_responses") >= min_responses)
    daily = rows.where("date is not null and _score is not null").groupBy("site", "date").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_score").alias("mean_sat")).where(F.col("n") >= min_per_day)
    dense = relative_density(daily, ["site"])
    link = spearman(dense, "rel_density", "mean_sat", ["site"], 1).select(F.struct(
        F.col("n").alias("n_days"), F.when(F.col("n") >= min_days, F.bround("r", 3)).alias("spearman_r"),
    )).scalar()
    return shares.withColumn("_link", link).select(*shares.columns, "_link.n_days", "_link.spearman_r")


def relative_density(daily: DataFrame, keys: Sequence[str] = ("site",)) -> DataFrame:
    """n as a percentage of the site's largest n."""
    return daily.withColumn("rel_density", F.col("n") / F.max("n").over(Window.partitionBy(*keys)) * 100)
