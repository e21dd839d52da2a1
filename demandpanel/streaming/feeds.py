"""Camera counts and hourly weather as streams."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.panel import last_per_key
from ..sources import versions


def stream_daily_counts(counts: DataFrame, time: str = "ts", value: str = "count", keys: Sequence[str] = ("node",),
                        late: str = "2 days", width: str = "1 day") -> DataFrame:
    """Five-minute counts to days as they arrive.

    A day is emitted once, when the watermark passes its end, so ``late`` must exceed the
    upload delay; later rows are dropped.
    """
    window = F.window(time, width)
    return (
        counts.withWatermark(time, late).groupBy(*keys, window)
        .agg(F.sum(value).alias("count"))
        .select(*keys, F.col("window.start").cast("date").alias("date"), "count")
    )


def start_daily_counts(counts: DataFrame, path: str, checkpoint: str, **options):
    """Append closed days to Parquet; processes what is available and stops."""
    return (
        stream_daily_counts(counts, **options).writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _write_batch(path: str, keys: Sequence[str], order: Sequence[str]):
    """foreachBatch function: the batch is reduced to its last row per key and written under
    its own number, so a repeated batch replaces itself."""
    def write(batch: DataFrame, epoch: int) -> None:
        last_per_key(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={epoch}")
    return write


def start_upsert(rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str]):
    """Hourly rows, newest wins. Batches are written apart; :func:`current_rows` resolves them
    and :func:`compact` merges them, so that few stay open."""
    return (
        rows.writeStream.foreachBatch(_write_batch(path, keys, order))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def open_parts(spark: SparkSession, path: str) -> tuple[str | None, list[str]]:
    """The folder of the merged base, if there is one, and those of the batches after it: all that a read touches."""
    base = versions.latest(spark, path)
    later = [n for n in versions.numbers(spark, path, "batch=") if base is None or n > base]
    return None if base is None else f"{path}/base={base}", [f"{path}/batch={n}" for n in later]


def current_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The upserted table: for each key the row of the latest batch."""
    base, later = open_parts(spark, path)
    parts = [spark.read.parquet(folder).withColumn("batch", F.lit(int(folder.rsplit("=", 1)[1]))) for folder in [*([base] if base else []), *later]]
    if not parts:
        raise FileNotFoundError(f"no batch at {path}")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return last_per_key(rows, keys, ["batch"]).drop("batch")


def compact(spark: SparkSession, path: str, keys: Sequence[str]) -> int | None:
    """Merges base and batches into a new base that bears the last batch's number; None if nothing is open.

    The old base and its batches go only with the compaction after this one, when
    readers that began with them are done. Until the new base is marked, it counts for
    nothing, so a compaction that breaks off loses nothing and may just be run again.
    """
    before = versions.latest(spark, path)
    _, later = open_parts(spark, path)
    if not later:
        return None
    number = int(later[-1].rsplit("=", 1)[1])
    current_rows(spark, path, keys).write.mode("overwrite").parquet(f"{path}/base={number}")
    versions.publish(spark, path, number)
    for kind in ("batch=", "base="):
        for n in versions.numbers(spark, path, kind):
            if before is not None and (n < before or n == before and kind == "batch="):
                versions.remove(spark, f"{path}/{kind}{n}")
    return number
