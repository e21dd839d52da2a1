"""Shards of near-equal bytes by a histogram sort.

Rows are ordered by (hash of the text, id). Exact bytes below candidate
boundaries are counted across all partitions; intervals around the wanted
splitters are probed again, finer each time, until every splitter meets the
tolerance. Then rows move once. Equal texts are neighbours and stay in one shard
unless their group straddles a splitter by more than the tolerance; then the
group is cut by id. All work is DataFrame expressions; the driver holds interval
bounds only, a number that depends on shards and probes, not on rows.

Defined results: null text has no bytes; null ids sort first; rows that repeat
an id and its text have one key and stay together; an empty table gives an
empty result; other columns pass through ``shard_rows`` whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from .base import free_name, staged, text_of

#: Bytes a splitter may be off its place, as a share of a shard's mean.
TOLERANCE = 0.001
FIRST_PROBES, PROBES = 4096, 64
_NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Interval:
    """Keys from ``low`` to ``high``: of hashes, or of the ids of one hash."""
    hash: int | None
    low: int
    high: int
    below: int
    probes: int
    wanted: tuple[int, ...] = ()

    @property
    def width(self) -> int:
        return (self.high - self.low) // self.probes + 1

    def holds(self) -> str:
        if self.hash is None:
            return f"_hash BETWEEN {self.low} AND {self.high}"
        return f"_hash = {self.hash} AND _key BETWEEN {_long(self.low)} AND {_long(self.high)}"

    def bin(self) -> str:
        """Number of the probed part a row falls in; decimals, since ids may span all of a long."""
        column = "_hash" if self.hash is None else "_key"
        return f"CAST((CAST({column} AS DECIMAL(20,0)) - ({self.low})) DIV {self.width}BD AS BIGINT)"


def _long(v: int) -> str:
    return "(-9223372036854775807L - 1L)" if v == _NO_ID else f"{v}L"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with _hash (63 bits of the text), _key (the id) and _size."""
    return docs.withColumns({
        "_hash": F.shiftrightunsigned(F.xxhash64(text_of(text_col)), 1),
        "_key": F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)),
        "_size": F.octet_length(text_of(text_col)).cast("long") + F.lit(8)})


def _chain(parts: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in parts) + f" ELSE {otherwise} END" if parts else otherwise


@dataclass(frozen=True)
class Plan:
    """Splitters in key order, and the intervals that were probed (for slots)."""
    splitters: tuple[tuple[int, int | None], ...]
    probed: tuple[Interval, ...]

    def shard(self) -> F.Column:
        """Number of splitters at or below the row's key."""
        tests = [f"CAST(_hash >= {h} AS INT)" if k is None else f"CAST(_hash > {h} OR (_hash = {h} AND _key >= {_long(k)}) AS INT)"
                 for h, k in self.splitters]
        return F.expr(" + ".join(tests) if tests else "0").cast("int")

    def cell(self) -> F.Column:
        """A small key range of the row: the finest probed part that holds it."""
        parts = [(i.holds(), f"{n * FIRST_PROBES}L + {i.bin()}") for n, i in enumerate(self.probed)]
        return F.expr(_chain(parts[::-1], "-1L")).cast("long")


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> Plan:
    """Find the shards - 1 splitters over keyed rows (a staged table: it is read once a round)."""
    total = rows.agg(F.sum("_size"), F.count(F.lit(1)), F.min("_hash"), F.max("_hash")).first()
    if not total[1]:
        return Plan((), ())
    size, count = int(total[0]), total[1]
    off = tolerance * size / shards
    crowded = max(2000, 4 * count // FIRST_PROBES)
    found: dict[int, tuple[int, int | None]] = {}
    probed: list[Interval] = []
    todo = [Interval(None, total[2], total[3], 0, FIRST_PROBES, tuple(range(1, shards)))]
    while todo:
        at = F.expr(_chain([(i.holds(), f"{n * FIRST_PROBES}L + {i.bin()}") for n, i in enumerate(todo)]))
        key = F.expr(_chain([(i.holds(), "_hash" if i.hash is None else "_key") for i in todo]))
        bins: dict[int, list] = {}
        for r in rows.groupBy(at.alias("at")).agg(F.sum("_size").alias("size"), F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"),
                                                  F.max(key).alias("hi")).filter("at IS NOT NULL").collect():
            bins.setdefault(r["at"] // FIRST_PROBES, []).append(r)
        probed += todo
        after: list[Interval] = []
        for n, interval in enumerate(todo):
            below = interval.below
            open_ = set(interval.wanted)
            last = None
            for r in sorted(bins.get(n, []), key=lambda r: r["at"]):
                edge = (r["lo"], None) if interval.hash is None else (interval.hash, r["lo"])
                until, inside = below + int(r["size"]), []
                for k in sorted(open_):
                    place = k * size / shards
                    if place >= until:
                        continue
                    open_.discard(k)
                    if place - below <= off:
                        found[k] = edge
                    elif until - place <= off:
                        found[k] = _next(edge, r["hi"], interval)
                    else:
                        inside.append(k)
                one = r["lo"] == r["hi"]
                single = one and interval.hash is not None
                if single:
                    for k in inside:
                        nearer = k * size / shards - below <= until - k * size / shards
                        found[k] = edge if nearer else _next(edge, r["hi"], interval)
                elif inside or r["n"] > crowded:
                    inner = (r["lo"], _NO_ID, (1 << 63) - 1) if one else (interval.hash, r["lo"], r["hi"])
                    after.append(Interval(*inner, below, PROBES, tuple(inside)))
                below, last = until, _next(edge, r["hi"], interval)
            for k in open_:
                found[k] = last
        todo = _tight(rows, after)
    return Plan(tuple(found[k] for k in range(1, shards)), tuple(probed))


def _next(edge, high: int, interval: Interval) -> tuple[int, int | None]:
    """The first key after a part."""
    if interval.hash is None:
        return high + 1, None
    return (interval.hash, high + 1) if high < (1 << 63) - 1 else (interval.hash + 1, None)


def _tight(rows: DataFrame, intervals: list[Interval]) -> list[Interval]:
    """Intervals over the ids of one hash get the ids' real bounds."""
    loose = {i.hash for i in intervals if i.hash is not None and i.low == _NO_ID}
    if not loose:
        return intervals
    bounds = {r[0]: (r[1], r[2]) for r in rows.filter(F.col("_hash").isin(*loose)).groupBy("_hash").agg(F.min("_key"), F.max("_key")).collect()}
    return [Interval(i.hash, *bounds[i.hash], i.below, i.probes, i.wanted) if i.hash in loose and i.low == _NO_ID else i for i in intervals]


def shard_rows(rows: DataFrame, plan: Plan, counted: DataFrame | None = None) -> DataFrame:
    """Keyed rows with shard and slot (gapless from 0 in each shard, in key order); rows move once.

    Ranks are taken inside small key ranges, so no task holds a shard; the ranges'
    counts (``counted``: the same keyed rows without their texts) give where each starts.
    """
    place = {"shard": plan.shard(), "_cell": plan.cell()}
    ranges = (counted if counted is not None else rows).withColumns(place).groupBy("shard", "_cell").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("_hash", "_key")).alias("_from"))
    before = Window.partitionBy("shard").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    starts = staged(ranges.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    inside = Window.partitionBy("shard", "_cell").orderBy("_hash", "_key")
    ranked = rows.withColumns(place).withColumn("_rank", F.row_number().over(inside))
    # At most FIRST_PROBES + PROBES per probed interval + shards rows, whatever the input.
    return ranked.join(F.broadcast(starts), ["shard", "_cell"]).withColumn(
        "slot", (F.col("_start") + F.col("_rank") - 1).cast("long")).drop("_start", "_rank", "_cell")


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    slim = staged(keyed(own).withColumn("text_crc32", F.crc32(text_of("text").cast("binary"))).drop("text"))
    return shard_rows(slim, splitters(slim, shards, tolerance)).select(
        "doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text",
                 tolerance: float = TOLERANCE) -> None:
    """Whole rows as Parquet, one folder a shard, in many files of a bounded key range each.

    The folders' column is ``shard`` and the place in it ``slot``, with underscores before where ``docs`` has such columns.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    rows = keyed(whole, "_id", "_text").drop("_id", "_text")
    slim = staged(rows.select("_hash", "_key", "_size"))
    placed = shard_rows(rows, splitters(slim, shards, tolerance), slim)
    folder, slot = free_name(docs.columns, "shard"), free_name(docs.columns, "slot")
    placed.select("_doc.*", F.col("shard").alias(folder), F.col("slot").alias(slot)).write.partitionBy(folder).parquet(path)
