"""Data quality: schema, profile, gaps, drift, domain rules, roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import quality as qu
from . import standins as st
from .registry import ks_tails, q6, register, rounded
from .standins import with_


@register("audit_schema_difference", """SELECT 'orders' AS source, 'missing' AS kind, 'o_comment' AS "column"
    UNION ALL SELECT 'orders', 'extra', unnest(['o_custkey', 'o_orderpriority', 'o_orderstatus', 'o_totalprice'])""")
def audit_schema_difference(spark, folder):
    return qu.schema_report(st.table(spark, folder, "orders"), "orders", ["o_orderkey", "o_orderdate", "o_comment"])


_PROFILED = {"precip_1h_mm": "hourly", "humidity_pct": "hourly", "temp_c": "hourly"}


def _profile_sql(column: str) -> str:
    x = column
    return f"""SELECT station, '{x}' AS "column", count(*) AS n_total, count(*) - count({x}) AS n_missing, round_even((count(*) - count({x})) * 100.0::DOUBLE / count(*), 2) AS pct_missing,
    {q6('max(m)')} AS mean, {q6('max(s)')} AS std, {q6(f'min({x})')} AS min, {q6(f'max({x})')} AS max, {q6('max(a)')} AS q25, {q6('max(b)')} AS q75,
    CAST(count(*) FILTER ({x} < a - 1.5 * (b - a) OR {x} > b + 1.5 * (b - a)) AS BIGINT) AS n_outliers_iqr,
    CAST(count(*) FILTER (s > 0 AND abs({x} - m) / s > 3.5) AS BIGINT) AS n_outliers_zscore
    FROM (SELECT station, {x}, avg({x}) OVER p AS m, stddev_samp({x}) OVER p AS s, quantile_cont({x}, 0.25) OVER p AS a, quantile_cont({x}, 0.75) OVER p AS b
        FROM hourly WINDOW p AS (PARTITION BY station)) GROUP BY station"""


@register("audit_column_profile", with_("hourly", body=" UNION ALL ".join(_profile_sql(c) for c in _PROFILED)))
def audit_column_profile(spark, folder):
    return rounded(qu.profile_columns(st.hourly(spark, folder), list(_PROFILED), keys=["station"]))


@register("audit_column_profile_raw", f"""WITH hourly AS (SELECT l_returnflag AS station, l_extendedprice AS x, l_extendedprice FROM lineitem) {_profile_sql('l_extendedprice')}""")
def audit_column_profile_raw(spark, folder):
    li = st.table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("station"), "l_extendedprice")
    return rounded(qu.profile_columns(li, ["l_extendedprice"], keys=["station"]))


_DRIFT = """months AS (SELECT node, m, floor((row_number() OVER (PARTITION BY node ORDER BY m) - 1) / 3) AS block FROM (SELECT DISTINCT node, m FROM v)),
    r AS MATERIALIZED (SELECT v.node, v.m, x, block FROM v JOIN months USING (node, m)),
    sides AS MATERIALIZED (SELECT node, block AS pair, true AS is_a, m, x FROM r UNION ALL SELECT node, block - 1, false, m, x FROM r),
    c AS (SELECT node, pair, x, count(*) FILTER (is_a) AS a, count(*) FILTER (NOT is_a) AS b FROM sides GROUP BY 1, 2, 3),
    f AS (SELECT node, pair, sum(a) OVER w / nullif(sum(a) OVER p, 0) AS fa, sum(b) OVER w / nullif(sum(b) OVER p, 0) AS fb, sum(a) OVER p AS n_a, sum(b) OVER p AS n_b
        FROM c WINDOW p AS (PARTITION BY node, pair), w AS (PARTITION BY node, pair ORDER BY x)),
    ks AS (SELECT node, pair, max(abs(fa - fb)) AS ks_statistic, CAST(max(n_a) AS BIGINT) AS n_a, CAST(max(n_b) AS BIGINT) AS n_b FROM f GROUP BY 1, 2 HAVING max(n_a) >= 10 AND max(n_b) >= 10),
    s AS (SELECT node, pair, strftime(min(m) FILTER (is_a), '%Y-%m') || '–' || strftime(max(m) FILTER (is_a), '%Y-%m') AS period_a,
        strftime(min(m) FILTER (NOT is_a), '%Y-%m') || '–' || strftime(max(m) FILTER (NOT is_a), '%Y-%m') AS period_b,
        avg(x) FILTER (is_a) AS mean_a, avg(x) FILTER (NOT is_a) AS mean_b, stddev_pop(x) FILTER (is_a) AS std_a, stddev_pop(x) FILTER (NOT is_a) AS std_b FROM sides GROUP BY 1, 2)"""


@register("audit_drift", f"""WITH v AS MATERIALIZED (SELECT o_orderpriority AS node, date_trunc('month', o_orderdate) AS m, o_totalprice AS x FROM orders), {_DRIFT}
    SELECT node, 'o_totalprice' AS "column", CAST(pair AS BIGINT) AS pair, period_a, period_b, n_a, n_b, {q6('mean_a', 4)} AS mean_a, {q6('mean_b', 4)} AS mean_b,
    {q6('std_a', 4)} AS std_a, {q6('std_b', 4)} AS std_b, {q6('ks_statistic', 4)} AS ks_statistic FROM ks JOIN s USING (node, pair)""")
def audit_drift(spark, folder):
    o = st.table(spark, folder, "orders").select(F.col("o_orderpriority").alias("node"), "o_orderdate", "o_totalprice")
    return rounded(qu.drift(o, "o_orderdate", ["o_totalprice"], keys=["node"]), 4)


@register("audit_drift_flags", f"""WITH RECURSIVE v AS MATERIALIZED (SELECT o_orderpriority AS node, date_trunc('month', o_orderdate) AS m, o_totalprice AS x FROM orders), {_DRIFT}, {ks_tails('SELECT * FROM ks')}
    SELECT node, CAST(pair AS BIGINT) AS pair, {q6('ks_pvalue')} AS ks_pvalue, ks_pvalue < 0.05 AS drift_detected FROM ks_p""")
def audit_drift_flags(spark, folder):
    """Drift with p-values and flags; the tail is checked in tests."""
    o = st.table(spark, folder, "orders").select(F.col("o_orderpriority").alias("node"), "o_orderdate", "o_totalprice")
    d = qu.drift_report(o, "o_orderdate", ["o_totalprice"], keys=["node"])
    return rounded(d.select("node", "pair", "ks_pvalue", "drift_detected"))


@register("audit_domain_rules", with_("hourly", body="""SELECT 'temp_too_low' AS rule, 'warning' AS severity, CAST(count(*) FILTER (temp_c < -40) AS BIGINT) AS violations FROM hourly
    UNION ALL SELECT 'temp_too_high', 'warning', count(*) FILTER (temp_c > 50) FROM hourly UNION ALL SELECT 'negative_precipitation', 'error', count(*) FILTER (precip_1h_mm < 0) FROM hourly
    UNION ALL SELECT 'extreme_wind', 'warning', count(*) FILTER (wind_speed_ms > 60) FROM hourly UNION ALL SELECT 'warm', 'warning', count(*) FILTER (temp_c > 30) FROM hourly"""))
def audit_domain_rules(spark, folder):
    h = st.hourly(spark, folder)
    rules = qu.weather_rules(h.columns) | {"warm": ("warning", F.col("temp_c") > 30)}
    return qu.domain_violations(h, rules)


@register("audit_score_range", with_("survey", body="""SELECT 'score_outside_1_to_5' AS rule, 'warning' AS severity, CAST(count(*) FILTER (nps_raw < 1 OR nps_raw > 5) AS BIGINT) AS violations FROM survey"""))
def audit_score_range(spark, folder):
    v = F.col("nps_raw")
    return qu.domain_violations(st.survey(spark, folder), {"score_outside_1_to_5": ("warning", (v < 1) | (v > 5))})


def findings(spark, folder):
    """Three sources and one that can't be read, which is a finding and stops nothing."""
    return qu.guarded(spark, {
        "camera": lambda: qu.audit_camera(st.counts(spark, folder).select("date", "count"), "camera"),
        "weather": lambda: qu.audit_weather(st.hourly(spark, folder), "weather", fixed.HOURLY_COLUMNS),
        "survey": lambda: qu.audit_survey(st.survey(spark, folder), "survey", ["satis", "no such heading"], score="nps_raw"),
        "archive": lambda: qu.audit_weather(spark.read.parquet(f"{folder}/no such table.parquet"), "archive", fixed.HOURLY_COLUMNS),
    })


def _profile_lines_sql(source: str, table: str, columns) -> str:
    return " ".join(f"UNION ALL SELECT '{source}', 'profile', '{c}: ' || count(*) || ' rows, ' || count(*) FILTER ({c} IS NULL) || ' missing' FROM {table}" for c in columns)


def findings_sql(select: str) -> str:
    """``select`` from ``found``: every line of every source."""
    return with_("counts", "hourly", "survey", recursive=True, body=f"""WITH g AS (SELECT datediff('day', min(date), max(date)) + 1 - count(DISTINCT date) AS k FROM counts),
    v AS MATERIALIZED (SELECT 'count' AS node, date_trunc('month', date) AS m, count AS x FROM counts), {_DRIFT}, {ks_tails('SELECT * FROM ks')},
    found AS (SELECT 'camera' AS source, 'rows' AS severity, CAST(count(*) AS VARCHAR) AS message FROM counts
    UNION ALL SELECT 'camera', 'warning', k || ' date gaps' FROM g WHERE k > 0
    UNION ALL SELECT 'camera', 'drift', concat_ws(' ', node, period_a, period_b) FROM ks_p JOIN s USING (node, pair) WHERE ks_pvalue < 0.05
    UNION ALL SELECT 'weather', 'rows', CAST(count(*) AS VARCHAR) FROM hourly UNION ALL SELECT 'weather', 'warning', 'missing column weather_type'
    UNION ALL SELECT 'survey', 'rows', CAST(count(*) AS VARCHAR) FROM survey UNION ALL SELECT 'survey', 'warning', 'no column containing no such heading'
    UNION ALL SELECT 'survey', 'warning', 'score_outside_1_to_5: ' || count(*) || ' rows' FROM survey WHERE nps_raw < 1 OR nps_raw > 5 HAVING count(*) > 0
    {_profile_lines_sql('camera', 'counts', ['count'])} {_profile_lines_sql('weather', 'hourly', ['temp_c', 'precip_1h_mm', 'wind_speed_ms'])}
    {_profile_lines_sql('survey', 'survey', ['prefecture', 'nps_raw'])}
    UNION ALL SELECT 'archive', 'error', 'could not be audited: AnalysisException') {select}""")


@register("audit_findings", findings_sql("SELECT * FROM found"))
def audit_findings(spark, folder):
    return findings(spark, folder)


@register("audit_rollup", findings_sql("""SELECT count(DISTINCT source) AS sources, CAST(sum(CAST(message AS BIGINT)) FILTER (severity = 'rows') AS BIGINT) AS total_rows, count(*) FILTER (severity = 'warning') AS warnings,
    count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'drift') AS drift_events, count(*) FILTER (severity = 'error') = 0 AS passed FROM (SELECT source, severity, CASE WHEN severity = 'rows' THEN message END AS message FROM found)"""))
def audit_rollup(spark, folder):
    return qu.audit_rollup(findings(spark, folder))


@register("audit_source_status", with_("hourly", "survey", "counts", body="""SELECT 'weather' AS source, count(*) AS rows, count(DISTINCT station) AS groups, true AS available FROM hourly
    UNION ALL SELECT 'survey', count(*), count(DISTINCT prefecture), true FROM survey UNION ALL SELECT 'camera', CAST(0 AS BIGINT), CAST(0 AS BIGINT), false"""))
def audit_source_status(spark, folder):
    return qu.source_status({
        "weather": (st.hourly(spark, folder), "station"), "survey": (st.survey(spark, folder), "prefecture"),
        "camera": (st.counts(spark, folder).where("count < 0"), None),
    })
