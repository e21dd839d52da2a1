from __future__ import annotations

import os

import duckdb
import pytest

from demandpanel.llm import queries as q

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
TABLES = ("documents", "pages", "benchmark", "conversations", "embeddings")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_one_query_of_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in q.QUERIES) == list(range(1, 14)) and set(q.ORACLES) <= set(q.QUERIES)


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_sql(spark, con, name):
    out = q.QUERIES[name](spark, FOLDER)
    cur = con.execute(q.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(out.columns)
    want = sorted((tuple(r) for r in cur.fetchall()), key=str)
    assert sorted((tuple(r) for r in out.select(*names).collect()), key=str) == want


COLUMNS = {
    "op2_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op3_decontamination": ["doc_id", "item_id", "edits", "item_words", "start_word", "end_word"],
    "op5_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op7_pii_surrogates": ["doc_id", "text", "n_entities", "entities"],
    "op8_minhash_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op9_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op12_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op10_language_id": ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    out = q.QUERIES[name](spark, FOLDER)
    assert out.columns == COLUMNS[name]
    whole = {"op9_html_extraction": "pages"}.get(name, "documents")
    rows = out.count()
    if name in ("op3_decontamination", "op5_packing"):
        assert rows > 0
    else:
        assert rows == spark.read.parquet(f"{FOLDER}/{whole}.parquet").count()
