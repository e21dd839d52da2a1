"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries of every partition name the digests that may be frequent;
their exact counts and smallest ids are verified by one partial aggregation and
broadcast, so rows of a large group never meet in one task. All other digests
are shuffled as usual.

Defined results: null text is the empty text; a group's row with the smallest
doc_id stays (null ids count as largest); rows that repeat an id and its text
are one document, so they are kept or dropped together by ``assign`` and
``deduplicate`` returns one of them; empty input gives an empty result; other
columns pass through ``deduplicate`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import SPACES, free_name, staged, text_of

#: A digest with at least this share of all rows is handled without a shuffle.
SUPPORT = 1 / 1024
#: Counters of a partition's summary; what a summary may miss is below rows / (COUNTERS + 1).
COUNTERS = 4095


def digest(text: str | Column) -> Column:
    """SHA-256 of the text with every run of white space replaced by one space (binary)."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(text), SPACES, " "), 256))


def _summaries(batches: Iterator[pa.RecordBatch], counters: int = COUNTERS) -> Iterator[pa.RecordBatch]:
    """Misra-Gries over one partition, a batch at a time."""
    held: dict[bytes, int] = {}
    for batch in batches:
        for entry in batch.column(0).value_counts().to_pylist():
            held[entry["values"]] = held.get(entry["values"], 0) + entry["counts"]
        if len(held) > counters:
            cut = sorted(held.values(), reverse=True)[counters]
            held = {k: n - cut for k, n in held.items() if n > cut}
    yield pa.RecordBatch.from_pydict(
        {"_digest": pa.array(list(held), pa.binary()), "_seen": pa.array(list(held.values()), pa.int64())})


def heavy_hitters(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(_digest, _keep, _size) of every digest with at least ``support`` of all rows.

    Sums of summaries fall short of the true count by rows / (COUNTERS + 1) at
    most and never exceed it, so no frequent digest is missed and the result has
    at most 1 / (support - 1 / (COUNTERS + 1)) rows (about 1366), at any input size.
    """
    rows = digests.count()
    least = max(2, int(rows * (support - 1 / (COUNTERS + 1))))
    # Staged, so that no broadcast waits for the pass over all rows.
    named = staged(digests.select("_digest").mapInArrow(_summaries, "_digest binary, _seen long")
                   .groupBy("_digest").agg(F.sum("_seen").alias("_seen")).filter(F.col("_seen") >= least).select("_digest"))
    return digests.join(F.broadcast(named), "_digest").groupBy("_digest").agg(
        F.min("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``."""
    rows = staged(docs.select(F.col(id_col).alias("_id"), digest(text_col).alias("_digest")))
    heavy = staged(heavy_hitters(rows, support))
    large = rows.join(F.broadcast(heavy), "_digest")
    group = Window.partitionBy("_digest")
    small = rows.join(F.broadcast(heavy.select("_digest")), "_digest", "left_anti").withColumns(
        {"_keep": F.min("_id").over(group), "_size": F.count(F.lit(1)).over(group)})
    return large.unionByName(small).select(
        F.col("_id").alias("doc_id"), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    sha = free_name(docs.columns, "__sha")
    kept = assign(docs, id_col, text_col, support).filter("kept").select(
        F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__digest"))
    own = docs.withColumn(sha, digest(text_col))
    same = own[id_col].eqNullSafe(kept["__id"]) & (own[sha] == kept["__digest"])
    return own.join(kept, same, "left_semi").dropDuplicates([id_col, sha]).select(*[F.col(f"`{c}`") for c in docs.columns])
