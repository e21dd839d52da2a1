"""Document fingerprints: a quartile bucket digest, compared by a bounded difference score.

Of every window of five bytes (the text's UTF-8, with four zero bytes before it) the
six triplets that hold the last byte are hashed into BUCKETS counters. Each counter
becomes two bits: how many of the three quartiles of all counters it exceeds. The
digest is a byte for the length on a logarithmic scale, a byte for the first two
quartiles as shares of the third, and the two-bit codes, all in hex.

The difference of two digests is the sum over buckets of 0, 1, 2 or, three codes
apart, 6, plus bounded amounts for length and quartile shares. UNRELATED is the sum
that independent codes are expected to have; a likeness is 1 at difference 0 and 0
from UNRELATED on.

``compare_edited`` also digests each text with its last quarter replaced by the
beginning of the next text in order of id. Texts are dealt by ranges of the id and
sorted; a task walks its rows once and counts the part that a text shares with its
edited form only once. Only the last row of a task needs a row of another task:
those few are written aside and joined.

Defined results: null text is the empty text; rows are ordered by id (null first),
then by the MD5 of the text, so rows that repeat an id follow each other and equal
rows are interchangeable; the last row is followed by the first, a
single row by itself; a text of fewer than four code points is its own edited text;
empty input gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import staged, text_of

BUCKETS = 256
#: Bytes before a window's last byte: the triplets are that byte with any two of them.
CONTEXT = 4
_PAIRS = [(a, b) for a in range(1, CONTEXT + 1) for b in range(a + 1, CONTEXT + 1)]
_rng = np.random.default_rng(20240611)
_ODD = _rng.integers(0, 1 << 32, (len(_PAIRS), 3), np.uint32) | np.uint32(1)
_SALT = _rng.integers(0, 1 << 32, len(_PAIRS), np.uint32)
#: Difference of a bucket whose codes are 0, 1, 2 or 3 apart.
STEP = np.array([0, 1, 2, 6], np.int64)
#: Most that the lengths, and each quartile share, add.
MOST_LENGTH, MOST_SHARE = 64, 15
#: Expected sum over buckets of independent codes, each of the four equally frequent.
UNRELATED = BUCKETS * (6 * 1 + 4 * 2 + 2 * 6) / 16
#: Texts and bytes counted together.
TEXTS, BYTES = 1000, 1_000_000


def bucket_counts(parts: list[tuple[bytes, bytes]]) -> np.ndarray:
    """(parts, BUCKETS) of the triplets that end in each part's second bytes; its first bytes only come before."""
    counts = np.zeros((len(parts), BUCKETS), np.int64)
    start = 0
    while start < len(parts):
        end, held = start, 0
        while end < len(parts) and end - start < TEXTS and (end == start or held + len(parts[end][1]) <= BYTES):
            held += len(parts[end][1])
            end += 1
        _count(parts[start:end], counts[start:end])
        start = end
    return counts


def _count(parts: list[tuple[bytes, bytes]], counts: np.ndarray) -> None:
    """Counts of a few parts, or of one large part in pieces of BYTES."""
    for at in range(0, max((len(own) for _, own in parts), default=0), BYTES):
        pieces = [((own[at - CONTEXT:at] if at else before[-CONTEXT:]), own[at:at + BYTES]) for before, own in parts]
        data = np.frombuffer(b"".join(before.rjust(CONTEXT, b"\0") + own for before, own in pieces), np.uint8).astype(np.uint32)
        lengths = np.array([len(own) for _, own in pieces])
        owner = np.repeat(np.arange(len(pieces)), lengths)
        ends = np.arange(len(owner)) + CONTEXT * owner
        cells, n = owner * BUCKETS, len(data)
        for (a, b), (x, y, z), salt in zip(_PAIRS, _ODD, _SALT, strict=True):
            mixed = data[CONTEXT:] * x + data[CONTEXT - a:n - a] * y + data[CONTEXT - b:n - b] * z + salt
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(cells + (mixed >> np.uint32(24))[ends], minlength=counts.size).reshape(counts.shape)


def digests(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts, 2 + BUCKETS / 4) bytes of the digests of counters and byte lengths."""
    ranked = np.sort(counts, axis=1)
    low, middle, high = (ranked[:, BUCKETS * k // 4 - 1][:, None] for k in (1, 2, 3))
    codes = (counts > low).astype(np.uint8) + (counts > middle) + (counts > high)
    four = codes.reshape(len(counts), -1, 4)
    body = four[:, :, 0] << 6 | four[:, :, 1] << 4 | four[:, :, 2] << 2 | four[:, :, 3]
    length = np.minimum(255, np.floor(12 * np.log1p(sizes))).astype(np.uint8)[:, None]
    top = np.maximum(high, 1)
    shares = (low * 15 // top << 4 | middle * 15 // top).astype(np.uint8)
    return np.concatenate((length, shares, body.astype(np.uint8)), axis=1)


def fingerprints(texts: list[str]) -> list[str]:
    """The digest of each text, in hex."""
    raw = [t.encode() for t in texts]
    found = digests(bucket_counts([(b"", r) for r in raw]), np.array([len(r) for r in raw], np.int64))
    return [f.tobytes().hex() for f in found]


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bounded difference of digests, row by row."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    apart = sum(STEP[np.abs((a[:, 2:] >> shift & 3) - (b[:, 2:] >> shift & 3))].sum(axis=1) for shift in (0, 2, 4, 6))
    shares = np.abs((a[:, 1] >> 4) - (b[:, 1] >> 4)) + np.abs((a[:, 1] & 15) - (b[:, 1] & 15))
    return apart + np.minimum(MOST_LENGTH, np.abs(a[:, 0] - b[:, 0])) + np.minimum(2 * MOST_SHARE, shares)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 for those as different as independent ones."""
    return np.maximum(0.0, 1.0 - difference(a, b) / UNRELATED)


def of_hex(found: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(found)), np.uint8).reshape(len(found), -1)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_MORE = f"{OUT}, head string, tail string, following string"


def _rows(ids: list, texts: list[str], following: list[str]) -> list[pa.Array]:
    """Columns of OUT for texts that are each followed by another."""
    raw = [t.encode() for t in texts]
    keep = [len(t) - len(t) // 4 for t in texts]
    first = [t[:k].encode() for t, k in zip(texts, keep, strict=True)]
    new = [n[:len(t) // 4].encode() for t, n in zip(texts, following, strict=True)]
    # A text that follows the one before it is counted once, as that one's next and as itself.
    shifted = len(texts) > 1 and all(a is b for a, b in zip(texts[1:], following, strict=False))
    beyond = [n.encode() for n in (following[-1:] if shifted else following)]
    edge = [(b"\0" * CONTEXT + f)[-CONTEXT:] for f in first]
    shared = bucket_counts([(b"", f) for f in first])
    whole = shared + bucket_counts([(e, r[len(f):]) for e, r, f in zip(edge, raw, first, strict=True)])
    changed = shared + bucket_counts(list(zip(edge, new, strict=True)))
    after = bucket_counts([(b"", r) for r in beyond])
    own = digests(whole, np.array([len(r) for r in raw], np.int64))
    edited = digests(changed, np.array([len(f) + len(n) for f, n in zip(first, new, strict=True)], np.int64))
    later = digests(after, np.array([len(r) for r in beyond], np.int64))
    later = np.concatenate((own[1:], later)) if shifted else later
    return [pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(f + n).hexdigest() for f, n in zip(first, new, strict=True)]),
            pa.array([f.tobytes().hex() for f in own]), pa.array([f.tobytes().hex() for f in edited]),
            pa.array(likeness(own, edited)), pa.array(likeness(own, later))]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Rows in slices of about BYTES characters, whatever the size of a batch."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = t.as_py()
            ids.append(i)
            texts.append(t)
            held += len(t)
            if held > BYTES or len(ids) >= TEXTS:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every sorted row with the next one; the first and the last text of the task go in a row of their own."""
    names = [c.split()[0] for c in _MORE.split(", ")]
    none = [pa.nulls(1, pa.string()) for _ in range(3)]
    last: tuple[list, list[str]] = ([], [])
    head = None
    for ids, texts in _slices(batches):
        head = texts[0] if head is None else head
        ids, texts = last[0] + ids, last[1] + texts
        if len(texts) > 1:
            columns = _rows(ids[:-1], texts[:-1], texts[1:])
            yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(len(ids) - 1, pa.string()) for _ in range(3))], names)
        last = ids[-1:], texts[-1:]
    if head is not None:
        empty = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(last[0], pa.int64()), *empty, pa.array([head]), pa.array(last[1]), none[0]], names)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, tail, following = (batch.column(c).slice(i, 1).to_pylist() for c in range(3))
            yield pa.RecordBatch.from_arrays(_rows(ids, tail, following), [c.split()[0] for c in OUT.split(", ")])


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    sorted_rows = rows.repartitionByRange("id", F.md5("text")).sortWithinPartitions("id", F.md5("text"))
    walked = staged(sorted_rows.mapInArrow(_walk, _MORE).withColumn("task", F.spark_partition_id()))
    done = walked.filter("tail IS NULL").select(*[c.split()[0] for c in OUT.split(", ")])
    # One row a task that had rows: their numbers, no more than shuffle partitions, are put in order here.
    edges = walked.filter("tail IS NOT NULL")
    numbers = sorted(r["task"] for r in edges.select("task").collect())
    tasks = docs.sparkSession.createDataFrame(list(zip(numbers, numbers[1:] + numbers[:1], strict=True)), "task int, next int")
    heads = edges.select(F.col("task").alias("next"), F.col("head").alias("following"))
    ends = edges.select("task", F.col("doc_id"), "tail").join(tasks, "task").join(heads, "next").select("doc_id", "tail", "following")
    return done.unionByName(ends.mapInArrow(_joined, OUT))
