"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A document is its tokens and one closing token. It is cut into full sequences and
a rest; the rest is cut into powers of two down to SMALLEST, unless a piece fills
its class nearly. A piece of length l belongs to the class of capacity // l, and
a sequence of that class takes that many pieces. Pieces are dealt over workers
(their number follows the pieces); each worker fills its classes on its own and
puts what is left of all classes together, largest first.

Defined results: null text is the empty text (one closing token); equal rows are
packed each; any doc_id, null too, is carried along; an empty table gives an
empty result; texts are never cut short.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import slices, staged

CAPACITY, CLOSING = 1024, 0
#: Shortest power of two that is cut off, and the share of a class's room a piece may leave.
SMALLEST, SLACK = 64, 1 / 32
#: Pieces of a worker, on average.
PER_WORKER = 50_000
#: A longer run without white space goes to the tokenizer whose time stays near linear.
LONG_RUN = re.compile(r"\S{4000}")

PIECES = "doc_id long, lane long, start long, length long, ids_crc32 long, doc_tokens long"


def vocabulary() -> tuple[str, str]:
    """Files of the one vocabulary: tokenizer description, and its ranks for the faster encoder."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoder(description: str, ranks: str):
    """``text -> ids``. Both libraries give the same ids; the ranks are read by the faster one."""
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(description)
    whole.encode_special_tokens = True
    with open(ranks, "rb") as file:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if len(text) > 4000 and LONG_RUN.search(text):
            return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, np.uint32)
    return encode


@lru_cache(65536)
def cuts(tokens: int, capacity: int = CAPACITY) -> tuple[int, ...]:
    """Lengths of the pieces of a document, in order."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        power = 1 << (rest.bit_length() - 1)
        room = min(2 * power, capacity)
        if rest < SMALLEST or rest >= room * (1 - SLACK):
            out.append(rest)
            break
        out.append(power)
        rest -= power
    return tuple(out)


def _pieces(files: tuple[str, str], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, lane = encoder(*files), 0
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for start, end in slices(texts, 500_000):
                rows, tokens = [], []
                for i in range(start, end):
                    all_ids = np.append(encode(texts[i]), np.uint32(CLOSING)).astype("<u4")
                    at = 0
                    for length in cuts(len(all_ids)):
                        part = all_ids[at:at + length]
                        rows.append((i, lane, at, length, zlib.crc32(part.tobytes()), len(all_ids)))
                        if with_ids:
                            tokens.append(part)
                        at += length
                        lane += 1
                columns = np.array(rows, np.int64).reshape(-1, 6)
                arrays = [ids.take(pa.array(columns[:, 0])), *(pa.array(columns[:, c]) for c in range(1, 6))]
                names = ["doc_id", "lane", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    offsets = np.concatenate(([0], np.cumsum(columns[:, 3]))).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tokens).astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)
    return run


def fill(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece of one worker."""
    room = capacity // lengths
    order = np.argsort(room, kind="stable")
    classes, first, counts = np.unique(room[order], return_index=True, return_counts=True)
    sequence = np.empty(len(lengths), np.int64)
    left, made = [], 0
    for k, start, n in zip(classes, first, counts, strict=True):
        full = n // k
        sequence[order[start:start + full * k]] = made + np.arange(full * k) // k
        made += full
        left.append(order[start + full * k:start + n])
    rest = np.concatenate(left) if left else np.empty(0, np.int64)
    free: list[int] = []  # of the last sequences: fewer than one for each class
    for i in rest[np.argsort(-lengths[rest], kind="stable")]:
        at = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
        if at == len(free):
            free.append(capacity)
        free[at] -= int(lengths[i])
        sequence[i] = made + at
    by = np.argsort(sequence, kind="stable")
    running = np.cumsum(lengths[by]) - lengths[by]
    opens = np.concatenate(([True], sequence[by][1:] != sequence[by][:-1])) if len(by) else np.empty(0, bool)
    offset = np.empty(len(lengths), np.int64)
    offset[by] = running - np.repeat(running[opens], np.diff(np.append(np.flatnonzero(opens), len(by))))
    return sequence, offset


def _worker(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["doc_id", "start", "lane"], kind="stable", ignore_index=True)
    sequence, offset = fill(frame["length"].to_numpy(np.int64))
    frame["sequence_id"] = (frame["worker"].to_numpy(np.int64) << 32) + sequence
    frame["offset"] = offset
    return frame.drop(columns=["worker", "lane"])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    kinds = PIECES + (", ids array<int>" if with_ids else "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = staged(rows.mapInArrow(_pieces(files or vocabulary(), with_ids), kinds))
    workers = max(1, -(-pieces.count() // PER_WORKER))
    dealt = pieces.withColumn("worker", F.pmod(F.xxhash64("lane", "start", "doc_id"), F.lit(workers)))
    names = kinds.replace("lane long, ", "") + ", sequence_id long, offset long"
    return dealt.groupBy("worker").applyInPandas(_worker, names)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed token ids; needs ``pack(..., with_ids=True)``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return pieces.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.doc_id").alias("doc_ids"))
