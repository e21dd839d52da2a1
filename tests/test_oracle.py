"""Every registered query with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_queries as check

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
SLOW = ("forest_", "topic_", "source_camera")


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


def test_registry_matches():
    assert set(check.ORACLES) <= set(check.QUERIES) and len(check.QUERIES) > 100


@pytest.mark.parametrize("name", [n for n in check.ORACLES if not n.startswith(SLOW)])
def test_query_equals_sql(spark, con, name):
    verdict, _, _ = check.compare(spark, con, name, FOLDER)
    assert verdict == "ok", verdict
