"""The given tables in the roles of the panel's sources, as frames and as SQL.

counts: orders per day and priority; intent: shipped quantity per day; weather: shipped
lines per day; hourly readings: events; survey: documents with their labels. Measures are
ratios of integer sums, so both engines hold the very same doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.panel import master_panel, with_node


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _cents(c: str):
    return F.round(F.col(c) * 100).cast("bigint")


def node_counts(spark, folder) -> DataFrame:
    """(node, date, count) by order priority."""
    o = table(spark, folder, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("node"), F.col("o_orderdate").cast("date").alias("date")).agg(
        (F.sum(_cents("o_totalprice")) / F.lit(100000.0)).alias("count"))


def counts(spark, folder) -> DataFrame:
    """(node, date, count) of one site called ``all``."""
    o = table(spark, folder, "orders")
    return with_node(o.groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        (F.sum(_cents("o_totalprice")) / F.lit(100000.0)).alias("count")))


def intent(spark, folder) -> DataFrame:
    li = table(spark, folder, "lineitem")
    return li.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.sum("l_quantity").alias("directions"))


def _weather_measures():
    n = F.count(F.lit(1))
    return [
        (F.sum(_cents("l_discount")) / n * 4.0 - 5.0).alias("temp"),
        F.greatest(F.sum(_cents("l_tax")) / n * 5.0 - 18.0, F.lit(0.0)).alias("precip"),
        (F.sum(F.col("l_quantity").cast("bigint")) / n / 5.0).alias("sun"),
        (F.sum(F.col("l_suppkey") % 17) / n).alias("wind"),
        F.nullif(F.sum((F.col("l_returnflag") == "R").cast("bigint")) / n * 10.0, F.lit(0.0)).alias("snow_depth"),
        (F.sum(F.col("l_partkey") % 50) / n + 40.0).alias("humidity"),
    ]


def weather(spark, folder) -> DataFrame:
    li = table(spark, folder, "lineitem")
    return with_node(li.groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(*_weather_measures()))


def node_weather(spark, folder) -> DataFrame:
    """Station weather under the node it serves: line number n serves priority (n - 1) mod 5 + 1."""
    li = table(spark, folder, "lineitem")
    station = ((F.col("l_linenumber") - 1) % 5 + 1).cast("string")
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    node = F.coalesce(*[F.when(station == x[0], F.lit(x)) for x in names])
    return li.groupBy(
        node.alias("node"), F.col("l_shipdate").cast("date").alias("date")).agg(*_weather_measures())


def panel(spark, folder) -> DataFrame:
    return master_panel(counts(spark, folder), weather(spark, folder), intent(spark, folder))


def node_panel(spark, folder) -> DataFrame:
    return master_panel(node_counts(spark, folder), node_weather(spark, folder), intent(spark, folder))


def hourly(spark, folder) -> DataFrame:
    """Readings of five stations under the canonical hourly names."""
    e = table(spark, folder, "events")
    v = _cents("value")
    return e.select(
        F.col("event_type").alias("station"), F.col("ts").alias("timestamp"), F.col("event_id"),
        ((v % 4500) / 100.0 - 5.0).alias("temp_c"),
        F.when(v % 7 != 0, F.greatest(v - 6000, F.lit(0)) / 1000.0).alias("precip_1h_mm"),
        ((v % 100) / 100.0).alias("sun_1h_h"),
        ((v % 1500) / 100.0).alias("wind_speed_ms"),
        ((v % 2500) / 100.0).alias("snow_depth_cm"),
        ((v % 300) / 100.0).alias("snowfall_1h_cm"),
        F.when(v % 11 != 0, (v % 7000) / 100.0 + 30.0).alias("humidity_pct"),
    )


def survey(spark, folder) -> DataFrame:
    d, lab = table(spark, folder, "documents"), table(spark, folder, "labels")
    good, bad = F.col("quality") == 1, F.col("toxic") == 1
    score = (F.when(good & ~bad, 4 + F.col("n_chars") % 2).when(good, 3).when(F.col("quality").isNull(), None)
             .when(bad, 1).otherwise(2).cast("double"))
    return d.join(lab, "doc_id", "left").select(
        "doc_id", F.col("lang").alias("prefecture"), F.col("source").alias("location"),
        F.date_add(F.lit("1995-01-01").cast("date"), (F.col("doc_id") % 120).cast("int")).alias("date"),
        score.alias("satisfaction"), (F.col("n_chars") % 5 + 1).cast("double").alias("satisfaction_service"),
        (F.col("n_chars") % 11).cast("double").alias("nps_raw"),
        F.col("text").alias("reason"), F.col("source").alias("inconvenience"), F.lit(None).cast("string").alias("freetext"),
    )


_MEASURES = """
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / count(*) * 4.0 - 5.0 AS temp,
    greatest(CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / count(*) * 5.0 - 18.0, 0.0) AS precip,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) / 5.0 AS sun,
    CAST(sum(l_suppkey % 17) AS DOUBLE) / count(*) AS wind,
    nullif(CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) / count(*) * 10.0, 0.0) AS snow_depth,
    CAST(sum(l_partkey % 50) AS DOUBLE) / count(*) + 40.0 AS humidity"""

SQL = {
    "node_counts": """SELECT o_orderpriority AS node, CAST(o_orderdate AS DATE) AS date,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100000.0 AS count FROM orders GROUP BY 1, 2""",
    "counts": """SELECT 'all' AS node, CAST(o_orderdate AS DATE) AS date,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100000.0 AS count FROM orders GROUP BY 1, 2""",
    "intent": "SELECT CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS directions FROM lineitem GROUP BY 1",
    "weather": f"SELECT 'all' AS node, CAST(l_shipdate AS DATE) AS date, {_MEASURES} FROM lineitem GROUP BY 1, 2",
    "node_weather": f"""SELECT CASE (l_linenumber - 1) % 5 + 1 WHEN 1 THEN '1-URGENT' WHEN 2 THEN '2-HIGH' WHEN 3 THEN '3-MEDIUM'
    WHEN 4 THEN '4-NOT SPECIFIED' WHEN 5 THEN '5-LOW' END AS node, CAST(l_shipdate AS DATE) AS date, {_MEASURES}
    FROM lineitem GROUP BY 1, 2""",
    "panel": """SELECT c.*, w.* EXCLUDE (node, date), i.directions FROM counts c
    LEFT JOIN weather w ON c.node = w.node AND c.date = w.date LEFT JOIN intent i ON c.date = i.date""",
    "node_panel": """SELECT c.*, w.* EXCLUDE (node, date), i.directions FROM node_counts c
    LEFT JOIN node_weather w ON c.node = w.node AND c.date = w.date LEFT JOIN intent i ON c.date = i.date""",
    "hourly": """SELECT event_type AS station, ts AS timestamp, event_id,
    CAST(v % 4500 AS DOUBLE) / 100.0 - 5.0 AS temp_c,
    CASE WHEN v % 7 <> 0 THEN CAST(greatest(v - 6000, 0) AS DOUBLE) / 1000.0 END AS precip_1h_mm,
    CAST(v % 100 AS DOUBLE) / 100.0 AS sun_1h_h, CAST(v % 1500 AS DOUBLE) / 100.0 AS wind_speed_ms,
    CAST(v % 2500 AS DOUBLE) / 100.0 AS snow_depth_cm, CAST(v % 300 AS DOUBLE) / 100.0 AS snowfall_1h_cm,
    CASE WHEN v % 11 <> 0 THEN CAST(v % 7000 AS DOUBLE) / 100.0 + 30.0 END AS humidity_pct
    FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS v FROM events)""",
    "survey": """SELECT d.doc_id, lang AS prefecture, source AS location,
    DATE '1995-01-01' + CAST(d.doc_id % 120 AS INTEGER) AS date,
    CAST(CASE WHEN quality = 1 AND toxic <> 1 THEN 4 + n_chars % 2 WHEN quality = 1 THEN 3 WHEN quality IS NULL THEN NULL
         WHEN toxic = 1 THEN 1 ELSE 2 END AS DOUBLE) AS satisfaction,
    CAST(n_chars % 5 + 1 AS DOUBLE) AS satisfaction_service, CAST(n_chars % 11 AS DOUBLE) AS nps_raw,
    text AS reason, source AS inconvenience, CAST(NULL AS VARCHAR) AS freetext
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
}

_NEEDS = {"panel": ("counts", "weather", "intent"), "node_panel": ("node_counts", "node_weather", "intent")}


def with_(*names: str, body: str, recursive: bool = False) -> str:
    """``body`` preceded by the named relations and what they need."""
    order: list[str] = []
    for name in names:
        for n in (*_NEEDS.get(name, ()), name):
            if n not in order:
                order.append(n)
    head = ", ".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = ", " + body[5:]
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {body}"


def least_squares(rows: str, target: str, features: list[str], keys: list[str], tag: str = "") -> str:
    """CTEs ``m{tag}`` (moments) and ``fit{tag}`` (swept matrix ``a``) of a regression.

    After the sweep a[i][k+1] is the slope of feature i, a[k+1][k+1] the residual variance
    and −a[i][i] the inverse of the feature covariance.
    """
    names = [*features, target]
    k = len(names)
    where = " AND ".join(f"{c} IS NOT NULL" for c in names)
    means = ", ".join(f"avg({c})" for c in names)
    matrix = ", ".join("[" + ", ".join(f"covar_pop({a}, {b})" for b in names) + "]" for a in names)
    by = ", ".join(keys)
    d = "a[p][p]"
    swept = (f"[[CASE WHEN i = p AND j = p THEN -1.0 / {d} WHEN i = p OR j = p THEN a[i][j] / {d} "
             f"ELSE a[i][j] - a[i][p] * a[p][j] / {d} END FOR j IN range(1, {k + 1})] FOR i IN range(1, {k + 1})]")
    return f"""m{tag} AS (SELECT {by}, count(*) AS n, [{means}] AS mean, [{matrix}] AS a
        FROM ({rows}) WHERE {where} GROUP BY {by}),
    sweep{tag} AS (SELECT {by}, n, mean, a, a[{k}][{k}] AS var_y, list_transform(range(1, {k + 1}), lambda i: a[i][i]) AS var, 1 AS p FROM m{tag}
        UNION ALL SELECT {by}, n, mean, {swept} AS a, var_y, var, p + 1 FROM sweep{tag} WHERE p < {k}),
    fit{tag} AS (SELECT *, 1 - a[{k}][{k}] / var_y AS r2, n * a[{k}][{k}] AS sse,
        mean[{k}] - list_sum(list_transform(range(1, {k}), lambda i: a[i][{k}] * mean[i])) AS intercept
        FROM sweep{tag} WHERE p = {k})"""


def fitted(fit: str, features: list[str]) -> str:
    k = len(features) + 1
    return f"{fit}.intercept" + "".join(f" + {fit}.a[{i}][{k}] * {c}" for i, c in enumerate(features, 1))
