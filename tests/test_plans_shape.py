"""What the physical plans must not contain."""

from __future__ import annotations

import pytest

from demandpanel.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
PYTHON_OK = ("ols", "effect", "betas", "hold_out", "durbin", "weather_value", "variance", "newey", "difference_model", "lagged", "unit_root",
             "seasonal", "quadratic", "benchmark", "gap_", "generalisation", "family", "node_", "network", "lost_", "report_", "p_values", "drift_flags",
             "forest", "complaint_drivers_model", "sink_report", "source_enc", "source_raw_exports")
# Queries that run jobs while they are being built (fits, files, streams).
EAGER = ("forest", "topic", "tfidf", "full_analysis", "source_", "sink_", "stream_")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


LAZY = [n for n in QUERIES if not n.startswith(EAGER) and not any(e in n for e in EAGER)]


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_product_and_no_row_python(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text
    if name not in ("proxy_when_camera_empty",):
        assert "BroadcastNestedLoopJoin" not in text
    if not name.startswith(PYTHON_OK) and not any(p in name for p in PYTHON_OK):
        assert "ArrowEvalPython" not in text and "InPandas" not in text


def test_filters_and_columns_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from demandpanel.operators.panel import in_range
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    text = plan(in_range(orders, F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz"), "o_orderdate").select("o_orderkey"))
    assert "GreaterThanOrEqual(o_orderdate" in text and "o_totalprice" not in text


@pytest.mark.parametrize("name", ["quantiles_raw_column", "box_numbers_raw", "spearman_raw_rows", "ks_two_sample_raw", "audit_column_profile_raw"])
def test_raw_order_statistics_never_meet_in_one_task(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert "SinglePartition" not in text and "percentile(" not in text


def test_node_models_read_their_rows_twice(spark):
    """Once for the Gram row, once for the clipped loss: counts, weather and intent each."""
    assert plan(QUERIES["node_models"](spark, FOLDER)).count("FileScan parquet") <= 8
