"""What several corpus operators share: staged tables, text helpers, word hashing."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..session import shared_folder

SPACES = r"[\x20\x09-\x0D]+"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the folder all executors share and read again.

    Cuts the lineage: what follows survives lost executors and computes nothing
    twice. The files go when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with as many underscores before it as make it differ from ``columns`` in any case of letters."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def text_of(column: str | Column) -> Column:
    """The text, null counted as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def slices(texts: list[str], most: int = 500_000):
    """Runs of ``texts`` of about ``most`` characters, as (start, end): bounds the memory of a task."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.uint64(0x5851F42D4C957F2D)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    up, down = np.full(n, base), np.full(n, inverse)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between white space, A-Z lower-cased, and the number of words of each text.

    One pass of array operations over the bytes of all texts: a word's hash is a
    difference of running sums of byte times power, shifted back to the word's start.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    lower = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _powers(len(data))
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up)))
    hashes = mixed((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _ODD)
    until = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, until))))
    return hashes, counts
