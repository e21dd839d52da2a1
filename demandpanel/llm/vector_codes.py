"""Product codes of vectors by exact integer k-means; distances by limb-split matrix products.

A component becomes floor(SCALE * x). Vectors are cut into PARTS equal parts, each
part position with a codebook of its own: first the parts of the vectors with the
smallest ids, then ROUNDS times every part goes to its nearest entry and entries
become the componentwise floor of their parts' mean. The nearest entry of x is the
first minimum of |c|^2 - 2 x.c. The dot products go through float64 matrix
products: integers are broken into limbs so short that every sum of limb products
stays below 2^53, where float64 is exact, and the products are put together again
in int64. So codes and errors are those of whole-number arithmetic, however a
library orders its sums and however rows are dealt to tasks.

Each round is one pass: tasks write sums and counts per (part, entry, position),
which Spark adds up; only codebooks, ENTRIES * length numbers, reach the driver.

Defined results: rows whose vector is null, holds null or non-finite components or
has another length than the kept vector of the smallest id are dropped, and a
length that PARTS does not divide raises ValueError; ids that repeat are ordered
by their vectors, null ids come last; with fewer rows than ENTRIES a codebook has
an entry a row; of equal entries the first is used; components so large that a
squared distance may leave int64 raise OverflowError; an empty table gives an
empty result; columns other than the three named play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows of one matrix product: its distances take PARTS * ENTRIES * 8 bytes a row.
ROWS = 4096
#: A label with this share of all rows has its error broadcast: at most 1 / SHARE labels.
SHARE = 1 / 1024


def limb_bits(inner: int) -> int:
    """Bits of a limb, so that ``inner`` products of two limbs sum to less than 2^53."""
    return (53 - max(inner - 1, 1).bit_length() - 1) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 limbs of int64 numbers, lowest first: ``x == sum(limb << (bits * i))``, each within 2^bits."""
    out = []
    while True:
        if not x.size or (int(x.min()) >= -(1 << bits) and int(x.max()) <= 1 << bits):
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits


def exact_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x @ y.T`` of int64 matrices whose result fits in int64, by float64 products of limbs."""
    bits = limb_bits(x.shape[1])
    total = np.zeros((len(x), len(y)), np.int64)
    right = [np.ascontiguousarray(limb.T) for limb in limbs(y, bits)]
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(right):
            total += (a @ b).astype(np.int64) << (bits * (i + j))
    return total


def checked(x: np.ndarray, length: int) -> np.ndarray:
    """Whole components as int64; OverflowError if squared distances of such vectors may leave int64."""
    most = float(np.abs(x).max()) if x.size else 0.0
    if 4 * most * most * max(length, 1) >= 2.0 ** 62:
        raise OverflowError(f"components up to {most:g} are too large for exact 64-bit distances")
    return x.astype(np.int64)


def whole(batch: pa.RecordBatch, column: int, length: int) -> np.ndarray:
    """(rows, length) of floor(SCALE * x)."""
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return checked(np.floor(values * SCALE), length).reshape(-1, length)


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry (rows, PARTS) and squared distance (rows, PARTS) of each part; ``books`` is (PARTS, entries, width)."""
    width = books.shape[2]
    codes, errors = np.empty((len(x), len(books)), np.int64), np.empty((len(x), len(books)), np.int64)
    for p, book in enumerate(books):
        part = np.ascontiguousarray(x[:, p * width:(p + 1) * width])
        apart = (book * book).sum(axis=1) - 2 * exact_products(part, book)
        codes[:, p] = apart.argmin(axis=1)
        errors[:, p] = apart[np.arange(len(x)), codes[:, p]] + (part * part).sum(axis=1)
    return codes, errors


def _sums(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums and counts of each used entry, one row (slot, total, n) a task and component; slot numbers book cells."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                x = whole(batch.slice(start, ROWS), 0, parts * width)
                codes, _ = nearest(x, books)
                slots = (codes + np.arange(parts) * entries).ravel()
                order = np.argsort(slots, kind="stable")
                used, first = np.unique(slots[order], return_index=True)
                total[used] += np.add.reduceat(x.reshape(-1, width)[order], first)
                n += np.bincount(slots, minlength=len(n))
        used = np.flatnonzero(n)
        cells = (used[:, None] * width + np.arange(width)).ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(cells), pa.array(total[used].ravel()), pa.array(np.repeat(n[used], width))], ["cell", "total", "n"])
    return run


def _coded(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                codes, errors = nearest(whole(part, 2, books.shape[0] * books.shape[2]), books)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([row.tobytes().hex() for row in codes.astype(np.uint8)]), pa.array(errors.sum(axis=1))],
                    ["id", "label", "code", "error"])
    return run


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector) of the rows with a whole, finite vector."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"),
                          F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return rows.filter(F.col("vector").isNotNull() & (F.size("vector") > 0)).filter(finite)


def fit(rows: DataFrame) -> np.ndarray | None:
    """Codebooks (PARTS, entries, width) over all ``rows`` (id, label, vector); None if there are none."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).collect()
    if not first:
        return None
    length = len(first[0]["vector"])
    if length % PARTS:
        raise ValueError(f"vectors of {length} components can't be cut into {PARTS} equal parts")
    rows = rows.filter(F.size("vector") == length)
    start = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    x = checked(np.floor(np.array([r["vector"] for r in start]) * SCALE), length)
    books = np.ascontiguousarray(x.reshape(len(x), PARTS, length // PARTS).transpose(1, 0, 2))
    for _ in range(ROUNDS):
        summed = rows.select("vector").mapInArrow(_sums(books), "cell long, total long, n long").groupBy("cell").agg(
            F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # at most ENTRIES * length rows
        flat = books.reshape(-1).copy()
        for cell, total, n in summed:
            flat[cell] = total // n
        books = flat.reshape(books.shape)
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_error(rows: DataFrame) -> DataFrame:
    """``label_error``: the sum of ``error`` over rows of an equal label, nulls together.

    Sums are made before any join. Labels that hold at least SHARE of all rows,
    a bounded number, are broadcast, so that a frequent label never meets in one task.
    """
    keyed = rows.withColumn("key", F.struct("label"))
    sums = staged(keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    number = sums.agg(F.sum("n")).first()[0] or 0
    heavy = sums.filter(F.col("n") >= max(2, int(number * SHARE))).select("key", "label_error")
    rest = keyed.join(F.broadcast(heavy.select("key")), "key", "left_anti")
    return keyed.join(F.broadcast(heavy), "key").unionByName(rest.join(sums.select("key", "label_error"), "key")).drop("key")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector, as the module says."""
    rows = kept_vectors(vectors, id_col, vector_col, label_col)
    label = rows.schema["label"].dataType.simpleString()
    books = fit(rows)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    length = books.shape[0] * books.shape[2]
    coded = staged(rows.filter(F.size("vector") == length).mapInArrow(_coded(books), f"id long, label {label}, code string, error long"))
    return with_label_error(coded).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def compress_sql(table: str = "embeddings") -> str:
    """The same result in DuckDB SQL, one named table a step, distances summed component by component."""
    def assigned(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (SELECT vec_id, label, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d, any_value(x) AS x FROM (
            SELECT v.vec_id, v.label, v.part, v.x, b.entry, list_sum([CAST((v.x[j] - b.c[j]) * (v.x[j] - b.c[j]) AS BIGINT) FOR j IN range(1, len(v.x) + 1)]) AS d
            FROM parts v JOIN b{k} b ON b.part = v.part) GROUP BY 1, 2, 3)"""

    def moved(k: int) -> str:
        return f"""b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (
            SELECT part, entry, list(CAST((s - (s % n + n) % n) / n AS BIGINT) ORDER BY j) AS c FROM (
                SELECT part, entry, j, CAST(sum(x[j]) AS HUGEINT) AS s, count(*) AS n FROM a{k}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS j) GROUP BY 1, 2, 3)
            GROUP BY 1, 2) m ON m.part = b.part AND m.entry = b.entry)"""

    return f"""WITH kept AS (SELECT vec_id, label, [CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS v FROM {table}
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        parts AS MATERIALIZED (SELECT vec_id, label, p AS part, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS x FROM kept, LATERAL (SELECT unnest(range({PARTS})) AS p)),
        b0 AS MATERIALIZED (SELECT part, x AS c, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM parts
            WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
        {", ".join(f"{assigned(k)}, {moved(k)}" for k in range(ROUNDS))}, {assigned(ROUNDS)},
        coded AS (SELECT vec_id, label, string_agg(lower(format('{{:02x}}', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY 1, 2),
        digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM b{ROUNDS})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, digest"""
