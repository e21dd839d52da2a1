from __future__ import annotations

import random
import zlib
from collections import defaultdict

from demandpanel.llm import sharding as sh


def check(rows, out, shards, tolerance=sh.TOLERANCE):
    size = lambda t: len((t or "").encode()) + 8
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out), key=str) == sorted(((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    total, most = sum(size(t) for _, t in rows), max((size(t) for _, t in rows), default=0)
    running = 0
    for k in range(shards):
        assert sorted(r["slot"] for r in by[k]) == list(range(len(by[k])))
        running += sum(r["size"] for r in by[k])
        assert abs(running - (k + 1) * total / shards) <= most / 2 + tolerance * total / shards + 1


def test_sizes_are_near_equal_and_equal_texts_are_together(docs, prose):
    rng = random.Random(5)
    rows = [(rng.randrange(10**12), " ".join(prose(rng.choice([1, 5, 60, 400]), i))) for i in range(600)]
    rows += [(i, "twin text") for i in range(10)] + [(10**13, None), (10**13 + 1, ""), (-5, "ß" * 50_000)]
    out = sh.assign(docs(*rows), 24).collect()
    check(rows, out, 24)
    assert len({r["shard"] for r in out if r["text_crc32"] == zlib.crc32(b"twin text")}) == 1


def test_a_hot_group_is_cut_by_id(docs):
    rows = [(i * 7 - 3000, "same") for i in range(900)] + [(-(1 << 63), "same"), ((1 << 63) - 1, "same")] + [(i + 10**6, f"text {i}") for i in range(300)]
    out = sh.assign(docs(*rows), 8).collect()
    check(rows, out, 8)
    hot = sorted((r["shard"], r["slot"], r["doc_id"]) for r in out if r["text_crc32"] == zlib.crc32(b"same"))
    assert [x[2] for x in hot] == sorted(x[2] for x in hot)


def test_crowded_ranges_get_slots_from_finer_cells(docs, monkeypatch):
    monkeypatch.setattr(sh, "FIRST_PROBES", 64)
    rows = [(i, "same") for i in range(9000)]
    check(rows, sh.assign(docs(*rows), 3).collect(), 3)


def test_repeated_rows_null_ids_and_empty(docs):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, None)]
    out = sh.assign(docs(*rows), 2).collect()
    assert len(out) == 4 and {r["shard"] for r in out} <= {0, 1}
    assert sh.assign(docs(), 24).collect() == []
    assert [r["shard"] for r in sh.assign(docs((1, "x")), 24).collect()] in ([k] for k in range(24))


def test_written_shards_hold_every_row(spark, docs, tmp_path):
    rows = [(i, f"text {i % 50}" * (1 + i % 9)) for i in range(300)]
    frame = docs(*rows).withColumnRenamed("source", "slot_of")
    sh.write_shards(frame, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(frame.columns) <= set(back.columns)
    assert sorted((r["doc_id"], r["text"]) for r in back.collect()) == rows


def test_columns_named_like_the_shard_are_written_whole(spark, docs, prose, tmp_path):
    frame = docs(*[(i, " ".join(prose(5, i))) for i in range(40)]).withColumnsRenamed({"lang": "shard", "source": "_size", "n_chars": "slot"})
    sh.write_shards(frame, str(tmp_path / "out"), shards=3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r["_shard"] for r in back.collect()} == {0, 1, 2}
    assert sorted(map(tuple, back.select(*frame.columns).collect())) == sorted(map(tuple, frame.collect()))
