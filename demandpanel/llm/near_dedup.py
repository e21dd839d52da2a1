"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

A document's set of word shingles becomes COMPONENTS minima of 16 bits each.
The signature is split into CHUNKS parts. Two signatures that differ in at most
``2 * CHUNKS - 1`` components have, by the pigeonhole principle, a part with at
most one differing component, so enumerating each part with each one component
left out gives both a common key: every pair within that distance meets.

Of the documents under one key only pairs with the key's heaviest document are
checked first, one per document; the links join what is alike. Keys whose
documents still lie in different components are then compared across components,
blockwise in memory and on the full sets, and a block hands on a spanning forest of
its links only. So a group of many copies never becomes all its pairs, whether they
are alike or only nearly so, and no pair of different texts under the distance is lost.

Defined results: null text or text without words has an empty set and no links;
with fewer words than a shingle the whole sequence is one shingle; equal sets
form one class before any join; rows that share a doc_id count as one document;
a null doc_id has a null component unless its set equals another's; empty input
gives an empty result; other columns pass through ``deduplicate`` unchanged.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import mixed, slices, staged, word_hashes
from .components import components

COMPONENTS, CHUNKS = 60, 10
PER_CHUNK = COMPONENTS // CHUNKS
#: Distance up to which all pairs are guaranteed to share a key.
GUARANTEED = 2 * CHUNKS - 1
#: Minima of one byte in the wider signature that settles which pairs are checked on full sets.
WIDE = 256
#: Standard deviations of a distance, above its mean at the wanted similarity, up to which
#: a pair of different components is checked on full sets: one pair of a million is farther.
SURE = 4.75
#: Rows of one comparison in memory.
BLOCK, WIDE_BLOCK = 512, 4096
#: Shingles on either side of a comparison in memory, about.
SHINGLES = 1_000_000

_rng = np.random.default_rng(20240607)
_A = _rng.integers(0, 1 << 32, WIDE, np.uint32) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, WIDE, np.uint32)
_KEY = _rng.integers(0, 1 << 63, (CHUNKS, PER_CHUNK), np.uint64) | np.uint64(1)
_SALT = _rng.integers(0, 1 << 63, (CHUNKS, PER_CHUNK), np.uint64)
_ORDER = _rng.integers(0, 1 << 63, 64, np.uint64) | np.uint64(1)


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(width, n)):
        rolled[:n - j] += words[j:] * _ORDER[j % len(_ORDER)]
    whole = mixed(rolled)
    out = []
    for start, end in zip(ends - counts, ends, strict=True):
        if end - start >= width:
            out.append(np.unique(whole[start:end - width + 1]))
        elif end > start:
            short = (words[start:end] * _ORDER[:end - start]).sum(dtype=np.uint64) + np.uint64(end - start)
            out.append(mixed(np.array([short], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], number: int = COMPONENTS, kind=np.uint16) -> np.ndarray:
    """(sets, number) of minima, cut to the bits of ``kind``; all sets must hold something."""
    if not sets:
        return np.empty((0, number), kind)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out, bits = np.empty((len(sets), number), kind), 8 * np.dtype(kind).itemsize
    for i in range(number):
        least = np.minimum.reduceat(x * _A[i] + _B[i], starts)
        out[:, i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    return out


def chunk_keys(signs: np.ndarray) -> np.ndarray:
    """(signatures, COMPONENTS) of keys: each chunk with each of its components left out."""
    parts = signs.reshape(-1, CHUNKS, PER_CHUNK).astype(np.uint64) * _KEY
    return mixed(parts.sum(axis=2, dtype=np.uint64, keepdims=True) - parts + _SALT).reshape(len(signs), -1).view(np.int64)


def _features(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, end in slices(texts):
                sets = shingle_sets(texts[start:end], width)
                full = [i for i, s in enumerate(sets) if len(s)]
                marks: list[bytes | None] = [None] * len(sets)
                signs: list[bytes | None] = [None] * len(sets)
                for i, sign in zip(full, signatures([sets[i] for i in full]), strict=True):
                    marks[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    signs[i] = sign.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(marks, pa.binary()), pa.array(signs, pa.binary())], ["id", "n_shingles", "mark", "sign"])
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, end in slices(texts):
                sets = shingle_sets(texts[start:end], width)
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                flat = pa.array(np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["id", "shingles"])
    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, COMPONENTS)
        keys = chunk_keys(signs)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.ravel()), batch.column(0).take(pa.array(np.repeat(np.arange(len(signs)), COMPONENTS)))], ["key", "id"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets overlap enough."""
    both = (pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right")), "b")
            .join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left")), "a")
            .withColumn("common", F.size(F.array_intersect("left", "right"))))
    return both.filter(100 * F.col("common") >= percent * (F.size("left") + F.size("right") - F.col("common"))).select("a", "b")


def farthest(percent: int, number: int = COMPONENTS) -> int:
    """Largest distance, of ``number`` minima, that is checked on full sets."""
    share = 1 - percent / 100
    return math.ceil(number * share + SURE * math.sqrt(number * share * (1 - share)))


def _wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            sets = [np.asarray(s.values).view(np.uint64) for s in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([w.tobytes() for w in signatures(sets, WIDE, np.uint8)], pa.binary())], ["id", "wide"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as whole blocks (key, i, j): the last block of a batch waits for the next."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy() for c in range(3)])
        edges = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
        for start, end in zip([0, *edges[:-1]], edges, strict=True) if len(edges) else ():
            yield batch.slice(start, end - start)
        held = batch.slice(edges[-1]) if len(edges) else batch
    if held is not None:
        yield held


def _forest(percent: int):
    """Links (a, b) that join the components of each block: of all pairs alike enough, a spanning forest.

    An outsider's possible partners lie in other components, could share enough by
    what either has that isn't its own alone, and are near in both signatures. They
    are settled here, on the full sets, so that pairs that turn out unlike, or that
    join what is joined already, never leave the task.
    """
    near, nearer = farthest(percent), farthest(percent, WIDE)

    def links(block: pa.RecordBatch) -> list[tuple[int, int]]:
        ids, comps, sizes, most, out = (block.column(c).to_numpy(zero_copy_only=False) for c in (3, 4, 5, 6, 7))
        outs = np.flatnonzero(out)
        if not len(outs):
            return []
        signs = np.frombuffer(b"".join(block.column(8).to_pylist()), np.uint16).reshape(-1, COMPONENTS)
        wides = np.frombuffer(b"".join(block.column(9).to_pylist()), np.uint8).reshape(-1, WIDE)
        column = block.column(10)
        offsets, flat = np.asarray(column.offsets), np.asarray(column.values).view(np.uint64)  # sorted as such
        names, comps = np.unique(comps, return_inverse=True)
        tops = np.arange(len(names))  # the component each one is joined to so far
        found = []
        for x in outs:
            able = (tops[comps] != tops[comps[x]]) & (100 * np.minimum(most[x], most) >= percent * (sizes[x] + sizes - np.minimum(most[x], most)))
            some = np.flatnonzero(able)
            some = some[(signs[some] != signs[x]).sum(axis=1) <= near]
            some = some[(wides[some] != wides[x]).sum(axis=1) <= nearer]
            if not len(some):
                continue
            own, lengths = flat[offsets[x]:offsets[x + 1]], offsets[some + 1] - offsets[some]
            step = np.searchsorted(np.cumsum(lengths), np.arange(0, lengths.sum(), 1_000_000), side="right")
            common = np.concatenate([_common(own, [flat[offsets[y]:offsets[y + 1]] for y in part]) for part in np.split(some, step[1:]) if len(part)])
            for y in some[100 * common >= percent * (sizes[x] + sizes[some] - common)]:
                if tops[comps[x]] != tops[comps[y]]:
                    found.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
                    tops[tops == tops[comps[y]]] = tops[comps[x]]
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            found = np.array(links(block), np.int64).reshape(-1, 2)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
    return run


def _common(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many members each of ``others`` shares with the sorted set ``own``."""
    values = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, values), len(own) - 1)
    starts = np.concatenate(([0], np.cumsum([len(o) for o in others])[:-1]))
    return np.add.reduceat((own[at] == values).astype(np.int64), starts)


def _unsettled(shared: DataFrame, comps: DataFrame, signs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across the components that still meet under a common key.

    Only documents outside a key's largest component are set against the others,
    in blocks; blocks grow in number with the key's documents, never in size.
    Documents with too many shingles that no other document here has are out. Of keys
    with the same documents one is enough.
    """
    named = shared.join(comps, shared["id"] == comps["node"], "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    mixed_keys = named.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
    open_rows = staged(named.join(mixed_keys, "key", "left_semi"))
    held = sets.join(open_rows.select("id").distinct(), "id", "left_semi")
    alone = held.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).filter("n = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    bounds = held.select("id", "shingles", F.size("shingles").cast("long").alias("size")).join(alone, "id", "left").select(
        "id", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("most"), "shingles").filter(100 * F.col("most") >= percent * F.col("size"))
    marks = staged(bounds.join(signs, "id").join(held.mapInArrow(_wide, "id long, wide binary"), "id"))
    able = open_rows.join(marks.select("id", F.size("shingles").cast("long").alias("weight")), "id")
    per = (able.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), *[F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"h{k}") for k in (1, 2)])
           .groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.max("n").alias("largest"), F.sum("n").alias("all"),
                               F.sum("w").alias("weight"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
           .filter("largest < all").groupBy("all", "h1", "h2").agg(F.min_by(F.struct("key", "main", "largest", "weight"), "key").alias("k"))
           .select("k.key", "k.main", (F.col("all") - F.col("k.largest")).alias("outside"), "all", F.col("k.weight").alias("in_key")))
    blocked = able.join(per, "key").withColumns({
        "out": F.col("comp") != F.col("main"),
        "wb": F.greatest(F.ceil(F.col("all") / WIDE_BLOCK), F.ceil(F.col("in_key") / SHINGLES)).cast("int"),
        "ob": F.greatest(F.ceil(F.col("outside") / BLOCK), F.ceil(F.col("in_key") / SHINGLES)).cast("int")}).join(marks, "id")
    own = ["id", "comp", "size", "most"]
    here, there = F.pmod(F.xxhash64("id"), F.col("ob")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("wb")).cast("int")
    outsiders = blocked.filter("out").select("key", here.alias("i"), F.explode(F.sequence(F.lit(0), F.col("wb") - 1)).alias("j"), *own, "out", "sign", "wide", "shingles")
    members = blocked.select("key", F.explode(F.sequence(F.lit(0), F.col("ob") - 1)).alias("i"), there.alias("j"), *own, F.lit(False).alias("out"), "sign", "wide", "shingles")
    # A number of partitions of its own, since what costs time here is comparing, not bytes.
    number = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return outsiders.unionByName(members).repartition(number, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_forest(percent), "a long, b long").distinct()


def assign(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: documents of which
    100 * intersection >= percent * union are linked, a component is named by its smallest id."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = staged(own.mapInArrow(_features(width), "id long, n_shingles long, mark binary, sign binary"))
    classes = staged(rows.filter("mark IS NOT NULL").groupBy("mark", "sign").agg(F.min("id").alias("id")).filter("id IS NOT NULL"))

    signs = classes.select("id", "sign")
    keys = signs.mapInArrow(_keys, "key long, id long")
    common = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = staged(keys.join(common, "key"))

    weight = shared.groupBy("id").agg(F.sum("n").alias("w"))
    heaviest = shared.join(weight, "id").groupBy("key").agg(F.max_by("id", F.struct("w", -F.col("id"))).alias("a"))
    best = (shared.join(heaviest, "key").filter("id <> a").groupBy("id", "a").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("id").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", F.col("id").alias("b")))

    sets = staged(own.join(weight.select("id"), "id", "left_semi").mapInArrow(_sets(width), "id long, shingles array<long>"))
    links = staged(_confirmed(best, sets, percent))
    first = staged(components(links))
    more = staged(_unsettled(shared.select("key", "id"), first, signs, sets, percent))
    named = components(links.unionByName(more))

    labels = classes.join(named, classes["id"] == named["node"], "left").select("mark", F.coalesce("component", "id").alias("label"))
    return rows.join(labels, "mark", "left").select(
        F.col("id").alias("doc_id"), "n_shingles", F.coalesce("label", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("label", "id"), F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one document of each component."""
    gone = assign(docs, width, percent, id_col, text_col).filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")
