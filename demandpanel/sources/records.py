"""CSV records of whole folders, cut in parallel however large a file is.

The bytes are read once, as lines, block by block. A line break belongs to a field
if an odd number of quotes comes before it in its file; each block counts its
quotes and record starts for both cases, a running sum over a file's blocks tells
which case holds, and so how many records start in earlier blocks. Every line then
knows its record's number in its file, wherever the blocks were read. Records of
one line, nearly all, are ready; only lines of longer ones are brought together, a
record at a time. No file is parsed by one task, and no list of paths is made.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import staged

FILE, NUMBER, RECORD = "_file", "_row", "_record"
#: Stands for separators between fields; a code point that no text may use.
_CUT = "﷐"


def file_path() -> Column:
    """The file of a row as a plain path; the metadata column holds it percent-encoded."""
    return F.url_decode(F.regexp_replace("_metadata.file_path", r"\+", "%2B"))


def is_unicode(encoding: str) -> bool:
    return encoding.upper().replace("_", "-") in ("UTF-8", "UTF8", "UTF-8-SIG")


def _text(column: pa.Array, encoding: str) -> pa.Array:
    """Whole lines of bytes as text; bytes that are none of the encoding become its replacement mark."""
    if is_unicode(encoding):
        try:
            return column.cast(pa.string())
        except pa.ArrowInvalid:
            encoding = "utf-8"
    return pa.array([b.decode(encoding, errors="replace") for b in column.to_pylist()], pa.string())


class _Block:
    """What has been seen of the file block that is being read."""

    def __init__(self):
        self.name, self.odd, self.lines, self.starts = None, 0, 0, [0, 0]


def _running(flags: np.ndarray, change: np.ndarray, run: np.ndarray, before: int) -> np.ndarray:
    """Running sums that begin anew where ``change`` says so; the first run goes on from ``before``."""
    total = np.cumsum(flags)
    base = (total - flags)[change]
    return total - base[run] + np.where(run == 0, before, 0)


def _scan(encoding: str):
    """Lines with their place and, for both cases of the block's beginning, the number of records started so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Block()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            files, blocks = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
            names, codes = files.dictionary, files.indices.to_numpy()
            text = _text(batch.column(2), encoding)
            quotes = pc.count_substring(text, '"').to_numpy(zero_copy_only=False).astype(np.int64)
            blank = pc.equal(pc.utf8_trim_whitespace(text), "").to_numpy(zero_copy_only=False)
            change = np.concatenate(([True], (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])))
            if (names[codes[0]].as_py(), blocks[0]) != held.name:
                held = _Block()
            of = np.cumsum(change) - 1
            odd_after = _running(quotes, change, of, held.odd)
            before = (odd_after - quotes) & 1
            lines = _running(np.ones(n, np.int64), change, of, held.lines)
            starts = [_running(((before == case) & ~blank).astype(np.int64), change, of, held.starts[case]) for case in (0, 1)]
            held.name = (names[codes[-1]].as_py(), blocks[-1])
            held.odd, held.lines, held.starts = int(odd_after[-1] & 1), int(lines[-1]), [int(s[-1]) for s in starts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lines), text, pa.array(blank), pa.array(before.astype(np.int32)),
                 pa.array((quotes & 1).astype(np.int32)), *map(pa.array, starts)],
                ["file", "block", "line", "text", "blank", "before", "odd", "starts0", "starts1"])
    return run


def records(spark: SparkSession, path, pattern: str = "*.csv", encoding: str = "UTF-8", skip_unreadable: bool = False) -> DataFrame:
    """(_file, _row, _record): every record of every file as text, numbered from 1 in its file; blank lines are none.

    Quotes must be balanced: a file with an odd number of them stops the read, as does one that
    can't be read, unless ``skip_unreadable`` leaves such files out.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("lineSep", "\n")
        .option("ignoreCorruptFiles", skip_unreadable).text(path)
        .select(file_path().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    )
    scanned = staged(lines.mapInArrow(_scan(encoding), "file string, block long, line long, text string, blank boolean, before int, odd int, starts0 long, starts1 long"))
    blocks = scanned.groupBy("file", "block").agg(F.sum("odd").alias("odd"), F.max("starts0").alias("starts0"), F.max("starts1").alias("starts1"))
    # A file has one row a block here, so its running sums are short.
    whole, earlier = Window.partitionBy("file"), Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = blocks.withColumns({"inside": F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2, "uneven": F.sum("odd").over(whole) % 2 == 1})
    begun = begun.withColumn("own", F.when(F.col("inside") == 0, F.col("starts0")).otherwise(F.col("starts1")))
    places = staged(begun.select("file", "block", "inside", "uneven", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("earlier")))
    uneven = places.filter("uneven").select("file")
    if not skip_unreadable and (bad := uneven.first()):
        raise ValueError(f"unbalanced quotes in {bad['file']}")
    known = scanned.join(places.filter("NOT uneven").drop("uneven"), ["file", "block"])
    depth = F.col("before").bitwiseXOR(F.col("inside").cast("int"))
    placed = known.select(
        F.col("file").alias(FILE), (F.col("earlier") + F.when(F.col("inside") == 0, F.col("starts0")).otherwise(F.col("starts1"))).alias(NUMBER),
        "block", "line", "text", "odd", depth.alias("depth"), "blank").filter("NOT (blank AND depth = 0)")
    single = placed.filter("depth = 0 AND odd = 0").select(FILE, NUMBER, F.col("text").alias(RECORD))
    longer = placed.filter("depth = 1 OR odd = 1").groupBy(FILE, NUMBER).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "text"))), lambda x: x["text"]), "\n").alias(RECORD))
    return single.unionByName(longer).withColumn(RECORD, F.regexp_replace(RECORD, "\r$", ""))


def cells(record: Column | str, empty: str | None = None) -> Column:
    """Fields of a record, as many as it has; quotes are taken off, unquoted empty fields are ``empty``."""
    record = F.col(record) if isinstance(record, str) else record
    parts = F.split(record, '"', -1)  # those at odd places stood inside quotes
    cut = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.replace(p, F.lit(","), F.lit(_CUT))).otherwise(p)), '"')

    def plain(c: Column) -> Column:
        return F.when(c == "", F.lit(empty)).otherwise(c)

    def bare(c: Column) -> Column:
        quoted = F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"')) & (F.length(c) > 1)
        return F.when(quoted, F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(plain(c))

    return F.when(F.contains(record, F.lit('"')), F.transform(F.split(cut, _CUT, -1), bare)).otherwise(F.transform(F.split(record, ",", -1), plain))


def headers(rows: DataFrame) -> DataFrame:
    """(_file, names): the fields of each file's first record."""
    first = F.regexp_replace(RECORD, "^﻿", "")
    return rows.filter(F.col(NUMBER) == 1).select(FILE, F.transform(cells(first, ""), lambda c: F.trim(c)).alias("names"))


def unique_names(names: Sequence[str]) -> list[str]:
    """Column names of a header: repeated ones get a number."""
    out: list[str] = []
    for name in names:
        new, k = name, 0
        while new in out:
            k += 1
            new = f"{name}.{k}"
        out.append(new)
    return out


def by_header(rows: DataFrame, required: Sequence[str] = (), leading: Sequence[str] = ()) -> DataFrame | None:
    """Records below each file's header as text columns; files whose header lacks a required name are left out.

    The driver sees the different headers, one row a layout, never the files: those
    join their layout's positions by their own header. ``leading`` names columns that
    hold each file's first fields by position, whatever its header calls them.
    """
    heads = headers(rows)
    if required:
        heads = heads.filter(F.array_size(F.array_intersect("names", F.array(*[F.lit(r) for r in required]))) == len(set(required)))
    heads = staged(heads)
    layouts = [list(r["names"]) for r in heads.select("names").distinct().orderBy(F.array_join("names", ",")).collect()]
    if not layouts:
        return None
    named = [unique_names(layout) for layout in layouts]
    columns = list(dict.fromkeys(name for layout in named for name in layout))
    positions = [(layout, [own.index(c) if c in own else -1 for c in columns]) for layout, own in zip(layouts, named, strict=True)]
    table = rows.sparkSession.createDataFrame(positions, "names array<string>, at array<int>")
    parsed = rows.filter(F.col(NUMBER) > 1).join(heads.join(table, "names").select(FILE, "at"), FILE).select(FILE, NUMBER, "at", cells(RECORD).alias("_cells"))

    def field(i: int) -> Column:
        at = F.get("at", F.lit(i))
        return F.when(at >= 0, F.get("_cells", at))

    return parsed.select(*[field(i).alias(c) for i, c in enumerate(columns)], *[F.get("_cells", F.lit(i)).alias(c) for i, c in enumerate(leading)], FILE, NUMBER)
