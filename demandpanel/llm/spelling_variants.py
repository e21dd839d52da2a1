"""Spelling variants: words that one edit apart, joined by asymmetric q-chunks.

Runs of letters are counted text by text and batch by batch, then per word. Words
are near if one code point inserted, deleted or replaced turns one into the other.
Of a near pair the longer word (of equal ones, either) gives two disjoint chunks, its
first and its last ``length // 2`` code points; the other gives its positional grams
of that size. One edit touches one chunk at most, so the other is a gram of the
second word, shifted by one position at most: a join on the chunk and its place
within shift one finds every pair, and each is verified. Grams too far from both
chunk places to meet any chunk are not written.

A chunk under which more than CROWD words meet on either side, such as a frequent
beginning, isn't paired out: its words also get the word with each one code point
left out, with its place, as part of the key. Equal keys are then near words already,
so no more pairs are made than there are near ones.

Every join sorts and merges: the planner sizes exploded rows as the words before them
and staged rows by their compressed files, and would broadcast more than the driver holds.

Every word takes the form of its most frequent near word that is FACTOR times as
frequent; forms are followed to the last by doubling their length each step, and as
each step multiplies the count by FACTOR at least, there is no circle.

Defined results: null texts have no words; a null id counts as the empty text in the
hash that picks runs to change; rows that repeat an id and text count again, as any
occurrence does; of equal counts the word smallest in code-point order wins; empty
input gives an empty result; other columns play no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .base import slices, staged

RUN = re.compile("[a-zÀ-ÿ]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A run whose hash this number divides loses one code point.
EVERY = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form is this many times as frequent as its word.
FACTOR = 5
#: Words of both sides that may meet under one chunk without further splitting.
CROWD = 64
#: Different words a task holds before it writes their counts.
HELD = 200_000


def runs(text: str) -> Counter:
    """Runs of letters, A-Z lower-cased, with how often they occur."""
    return Counter(RUN.findall(text.encode().translate(_LOWER).decode()))


def changed(doc: str, run: str) -> str:
    """The run, without one code point if the hash of document and run says so."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    if h % EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    for batch in batches:
        ids, texts = (batch.column(c).to_pylist() for c in range(2))
        for start, end in slices(texts):
            for doc, text in zip(ids[start:end], texts[start:end], strict=True):
                for run, n in runs(text).items():
                    word = changed(doc, run)
                    if len(word) >= LEAST_LENGTH:
                        held[word] += n
            if len(held) > HELD:
                yield out()
                held.clear()
    yield out()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, length) of the words long and frequent enough."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    counts = rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= LEAST_COUNT).withColumn("length", F.length("word"))


def _merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """The join of both by sort and merge, no side broadcast whatever the planner takes its size for."""
    return left.join(right.hint("merge"), on, how)


def _gram(word: Column, at: Column, size: Column) -> Column:
    return F.xxhash64(F.substring(word, at + 1, size))


def chunk_rows(words: DataFrame) -> DataFrame:
    """(longer, place, chunk, a): both chunks of every word, at each place within shift one."""
    size = F.floor(F.col("length") / 2).cast("int")
    places = F.transform(F.array(F.lit(0), F.col("length") - size), lambda at: F.struct(at.alias("at"), _gram(F.col("word"), at, size).alias("chunk")))
    shifts = F.flatten(F.transform(places, lambda c: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: F.struct((c["at"] + s).alias("place"), c["chunk"].alias("chunk")))))
    return words.select(F.col("length").alias("longer"), F.col("word").alias("a"), F.explode(shifts).alias("c")).select("longer", "c.place", "c.chunk", "a").filter("place >= 0")


def gram_rows(words: DataFrame) -> DataFrame:
    """(longer, place, chunk, b): positional grams that a chunk of a word as long, or one longer, may meet."""
    length = F.col("length")

    def grams(longer: Column) -> Column:
        size = F.floor(longer / 2).cast("int")
        far = longer - size
        at = F.filter(F.array_distinct(F.array(F.lit(0), F.lit(1), far - 1, far, far + 1)), lambda p: p + size <= length)
        return F.transform(at, lambda p: F.struct(longer.alias("longer"), p.alias("place"), _gram(F.col("word"), p, size).alias("chunk")))

    both = F.concat(grams(length), grams(length + 1))
    return words.select(F.col("word").alias("b"), F.explode(both).alias("g")).select("g.longer", "g.place", "g.chunk", "b")


KEY = ["longer", "place", "chunk"]


def _left_out(word: Column) -> Column:
    """(gap, rest): a hash of the word with each one code point left out."""
    gaps = F.sequence(F.lit(1), F.length(word))
    return F.transform(gaps, lambda p: F.struct(p.alias("gap"), F.xxhash64(F.concat(F.substring(word, F.lit(1), p - 1), F.substring(word, p + 1, F.length(word)))).alias("rest")))


#: Words up to this length are verified by their edit distance, longer ones by their common beginning: a matter of time only.
SHORT = 256


def one_edit(a: Column, b: Column) -> Column:
    """Whether ``b``, as long as ``a`` or one shorter, is ``a`` with one code point replaced or left out."""
    def longer(reach: Column, step: Column) -> Column:
        same = (reach + step <= F.length(b)) & (F.substring(a, reach + 1, step) == F.substring(b, reach + 1, step))
        return F.when(same, reach + step).otherwise(reach)

    shared = F.aggregate(F.transform(F.sequence(F.lit(30), F.lit(0)), lambda k: F.pow(F.lit(2), k).cast("int")), F.lit(0), longer)
    rest_a = F.substring(a, shared + 2, F.length(a))
    rest_b = F.when(F.length(a) == F.length(b), F.substring(b, shared + 2, F.length(b))).otherwise(F.substring(b, shared + 1, F.length(b)))
    return F.when(F.length(a) <= SHORT, F.levenshtein(a, b, 1) == 1).otherwise((a != b) & (rest_a == rest_b))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), once in each order, of all words (word, n, length) that are one edit apart."""
    chunks, grams = chunk_rows(words), gram_rows(words)
    met = _merged(chunks.groupBy(KEY).agg(F.count(F.lit(1)).alias("c")), grams.groupBy(KEY).agg(F.count(F.lit(1)).alias("g")), KEY)
    met = staged(met.withColumn("crowded", F.greatest("c", "g") > CROWD).select(*KEY, "crowded"))
    few, many = met.filter("NOT crowded").select(KEY), met.filter("crowded").select(KEY)
    alike = one_edit(F.col("a"), F.col("b"))
    thin = _merged(_merged(chunks, few, KEY, "left_semi"), grams, KEY).filter(alike).select("a", "b")

    # Crowded chunks: a word as long shares the rest left by the same gap; a word one shorter is such a rest.
    left = _merged(chunks, many, KEY, "left_semi").select(*KEY, "a", F.explode(_left_out(F.col("a"))).alias("l")).select(*KEY, "a", "l.gap", "l.rest")
    right = _merged(grams, many, KEY, "left_semi")
    as_long = right.filter(F.length("b") == F.col("longer")).select(*KEY, "b", F.explode(_left_out(F.col("b"))).alias("l")).select(*KEY, "b", "l.gap", "l.rest")
    shorter = right.filter(F.length("b") < F.col("longer")).withColumn("rest", F.xxhash64("b"))
    replaced = _merged(left, as_long, [*KEY, "gap", "rest"]).filter(alike).select("a", "b")
    deleted = _merged(left.select(*KEY, "a", "rest"), shorter, [*KEY, "rest"]).filter(alike).select("a", "b")
    found = thin.unionByName(replaced).unionByName(deleted)
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form, following forms to the last."""
    links = staged(forms.select("word", F.col("form").alias("root"), F.lit(False).alias("last")))
    while links.filter("NOT last").limit(1).count():
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"), F.col("last").alias("end"))
        links = staged(_merged(links, onward, "root", "left").select(
            "word", F.coalesce("onward", "root").alias("root"), F.coalesce("end", F.lit(True)).alias("last")))
    return links.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs``."""
    words = staged(word_counts(docs, id_col, text_col))
    counts = words.select("word", "n")
    pairs = _merged(near_pairs(words), counts.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = pairs.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min_by(F.struct("b", "m"), F.struct(-F.col("m"), F.col("b"))).alias("best"))
    found = F.col("best.m") >= FACTOR * F.col("n")
    named = staged(_merged(counts, best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(found, F.col("best.b")).alias("form"), F.when(found, F.col("best.m")).alias("form_n")))
    roots = _roots(named.filter("form IS NOT NULL"))
    return _merged(named, roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_sql(table: str = "documents") -> str:
    """The same result in DuckDB SQL: the hash bit by bit, near words by all their rests."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    byte = "CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)"
    return f"""WITH RECURSIVE steps AS (SELECT list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v, i FROM range(256) t(i)),
        crc AS MATERIALIZED (SELECT list(v::BIGINT ORDER BY i) AS t FROM steps),
        found AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all({lower}, '[a-zÀ-ÿ]+')) AS run FROM {table} WHERE text IS NOT NULL),
        once AS MATERIALIZED (SELECT doc, run, count(*) AS n, hex(encode(doc || ':' || run)) AS h FROM found GROUP BY 1, 2),
        hashed AS (SELECT run, n, xor(list_reduce([4294967295::BIGINT] || [{byte} FOR i IN range(length(h) // 2)], lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS h FROM once, crc),
        edited AS (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed),
        words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(n) >= {LEAST_COUNT}),
        rests AS MATERIALIZED (SELECT word, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS p)),
        pairs AS (SELECT x.word AS a, y.word AS b FROM rests x JOIN rests y ON x.p = y.p AND x.rest = y.rest AND length(x.word) = length(y.word) AND x.word <> y.word
            UNION SELECT x.word, y.word FROM rests x JOIN words y ON x.rest = y.word UNION SELECT y.word, x.word FROM rests x JOIN words y ON x.rest = y.word),
        best AS (SELECT a, count(*) AS n_near, arg_min({{'b': b, 'm': w.n}}, (-w.n, encode(b))) AS x FROM pairs JOIN words w ON w.word = b GROUP BY 1),
        named AS MATERIALIZED (SELECT w.word, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CASE WHEN x.m >= {FACTOR} * n THEN x.b END AS form,
            CASE WHEN x.m >= {FACTOR} * n THEN x.m END AS form_n FROM words w LEFT JOIN best ON a = w.word),
        chain(word, root) AS (SELECT word, word FROM named UNION SELECT c.word, f.form FROM chain c JOIN named f ON f.word = c.root WHERE f.form IS NOT NULL)
        SELECT named.word, form, c.root, n, n_near, form_n FROM named JOIN chain c ON c.word = named.word
        WHERE NOT EXISTS (SELECT 1 FROM named f WHERE f.word = c.root AND f.form IS NOT NULL)"""
