"""Tables kept as whole versions: a folder each, valid once its mark exists.

A version is written under its number and marked afterwards by creating one empty
file, which either happens or doesn't. Readers take the highest marked number, so a
writer that dies leaves the table as it was, and one that runs again writes the same
folder anew.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

MARKS = "_marks"


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, path: str, prefix: str = "") -> list[int]:
    """Sorted numbers of the entries of a folder named ``prefix`` and a number; empty if there is no folder."""
    place, system = _folder(spark, path)
    if not system.exists(place):
        return []
    names = [str(s.getPath().getName()) for s in system.listStatus(place)]
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())


def latest(spark: SparkSession, path: str) -> int | None:
    """The number of the current version, if there is one."""
    marked = numbers(spark, f"{path}/{MARKS}")
    return marked[-1] if marked else None


def publish(spark: SparkSession, path: str, number: int) -> None:
    """Makes the written version ``number`` the current one."""
    place, system = _folder(spark, f"{path}/{MARKS}/{number}")
    system.create(place, True).close()


def remove(spark: SparkSession, path: str) -> None:
    place, system = _folder(spark, path)
    system.delete(place, True)
