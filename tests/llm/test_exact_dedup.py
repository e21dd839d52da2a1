from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from demandpanel.llm import exact_dedup as ed
from demandpanel.llm.base import staged


def expected(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(5, "a b"), (3, "a \n\t b"), (9, None), (4, ""), (7, "x"), (7, "x"), (8, "X"), (None, "x"), (None, "only null"), (11, "ü " * 40_000), (10, "ü\t" * 40_000), (12, "a b")]


def test_groups_with_nulls_ties_and_repeats(docs):
    assert sorted(map(tuple, ed.assign(docs(*ROWS)).collect()), key=str) == expected(ROWS)


def test_hot_groups_and_tail_agree_whatever_the_support(docs):
    rows = [(i, "hot" if i % 3 else f"t{i // 6}") for i in range(400)]
    for support in (1 / 1024, 0.2, 0.9):
        assert sorted(map(tuple, ed.assign(docs(*rows), support=support).collect()), key=str) == expected(rows)


def test_deduplicate_keeps_one_of_each_and_all_columns(spark, docs):
    frame = docs(*ROWS).withColumnsRenamed({"source": "_digest", "n_chars": "keep_id"})
    kept = ed.deduplicate(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([3, 4, 7, 8, 10, 12, None], key=str)


def test_empty_table(docs):
    assert ed.assign(docs()).collect() == [] and ed.deduplicate(docs()).collect() == []


def test_summary_never_misses_a_frequent_digest():
    values = [b"f"] * 300 + [b"g"] * 150 + [str(i).encode() for i in range(700)]
    truth, counters = Counter(values), 7
    batches = [pa.RecordBatch.from_arrays([pa.array(values[i::23])], ["_digest"]) for i in range(23)]
    out = next(iter(ed._summaries(iter(batches), counters)))
    held = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    assert len(held) <= counters
    for value, n in truth.items():
        assert n - len(values) / (counters + 1) <= held.get(value, 0) <= n


def test_heavy_hitters_are_counted_exactly(docs):
    rows = [(i, "hot" if i < 200 else f"t{i}") for i in range(500, 0, -1)]
    digests = staged(docs(*rows).select(F.col("doc_id").alias("_id"), ed.digest("text").alias("_digest")))
    assert [(r["_keep"], r["_size"]) for r in ed.heavy_hitters(digests, 0.1).collect()] == [(1, 199)]


def test_a_column_named_like_the_digest_keeps_its_values(docs):
    frame = docs((1, "a b"), (2, "a  b"), (3, "c")).withColumnsRenamed({"source": "__sha", "lang": "__id"})
    rows = sorted(tuple(r) for r in ed.deduplicate(frame).collect())
    assert rows == [(1, "a b", "en", "s", 0), (3, "c", "en", "s", 0)]
