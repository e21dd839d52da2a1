"""The pipeline against plain Python over the same table."""

from __future__ import annotations

import re
from collections import defaultdict

import corpus_pipeline as cp
from demandpanel.llm import decontamination as dc, packing as pk

from test_decontamination import distance
from test_near_dedup import brute

FOLDER = "/root/testdata/sf0.001"


def test_every_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    frames = {}
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, FOLDER).cache()
        frames[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {n: sorted(r["doc_id"] for r in f.select("doc_id").distinct().collect()) for n, f in frames.items()}

    assert ids["language ID"] == sorted(i for i, t in left.items() if re.search(r"[^\W\d_]", t or ""))
    first = {}
    for i in sorted(ids["language ID"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i] or ""), i)
    assert ids["exact dedup"] == sorted(first.values())
    alike = brute([(i, left[i]) for i in ids["exact dedup"]], 5, 80)
    assert ids["MinHash near-dedup"] == sorted(i for i, (_, c) in alike.items() if c == i)
    items = [dc.WORD.findall(r["text"].lower()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    words = lambda i: dc.WORD.findall(left[i].lower())

    def holds(i):
        own = words(i)
        seen = set(zip(own, own[1:], own[2:], strict=False))
        return any(len(p) >= dc.GRAM and seen & set(zip(p, p[1:], p[2:], strict=False)) and distance(p, own) <= dc.edits(len(p)) for p in items)
    assert ids["benchmark decontamination"] == [i for i in ids["MinHash near-dedup"] if not holds(i)]
    assert ids["packing"] == ids["benchmark decontamination"]

    encode, held = pk.encoder(*pk.vocabulary()), defaultdict(int)
    for r in frames["packing"].collect():
        held[r["doc_id"]] += r["length"]
    assert dict(held) == {i: len(encode(left[i])) + 1 for i in ids["packing"]}


def test_run_gives_the_last_stages_rows_and_empty_tables_pass(spark, tmp_path):
    out = cp.run(spark, FOLDER)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []
