"""Benchmark decontamination: documents that hold a benchmark item, a few edits apart.

Words are compared, lower-cased, without punctuation; a character of a script that is
written without spaces is a word. An item is found where some run of the document is
at most ``edits(L)`` word edits from its L words (a fifth).

An item is searched for by its parts: up to PART words it is one part, else parts of
half that size to that size that follow and overlap one another. If the whole is
within its edits, so is one of the parts that follow one another, by counting.
Windows of the size of the parts slide over a document's words. Each is carried
by CGK random walks (Chakraborty, Goldenberg, Koucky, 2016) into strings whose
Hamming distance follows the edit distance, and samples of their positions are
the keys of a locality-sensitive hash. Walks rejoin less often the more edits
there are, which is why parts are short; WALKS x TABLES keys find nearly all parts
at their largest number of edits (a test asks for 0.98 of the items at every size
from 15 to 400 words). Windows that hold too few of the benchmark's three-word runs to be within
the edits of any item (the q-gram lemma) are not embedded. A shared key makes a
candidate; an exact approximate-match automaton confirms it.

The benchmark is the query set: its items are dealt into blocks of BLOCK_WORDS,
and each block's index travels to the tasks; documents stay where they are.

Defined results: null or empty text holds nothing; an item of fewer than three
words names no passage and is never found; an item without text likewise; a null
item id stays null; equal items are found each; rows that repeat a doc_id give their hits each; an empty benchmark
leaves every document; extra columns pass through ``clean`` unchanged.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .base import mixed, slices, text_of

#: Characters of scripts written without spaces: kana, ideographs, Thai, Lao, Myanmar, Khmer.
UNSPACED = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff"
WORD = re.compile(rf"[^\W_{UNSPACED}]+|[{UNSPACED}]")
GRAM = 3
SHARE = 0.2
#: Words of items in one block of the benchmark, about.
BLOCK_WORDS = 200_000
#: Random walks, hash tables of each, and positions sampled for a table.
WALKS, TABLES, SAMPLED = 4, 10, 3
#: Words of the longest part of an item that is searched for as one.
PART = 24
#: Lengths of items of one size class differ by this factor at most.
CLASS_RATIO = 1.5

#: Characters searched side by side.
SLICE = 2_000_000

HITS = "doc_id long, item_id long, edits int, item_words int, start_word int, end_word int"


def edits(length: int, share: float = SHARE) -> int:
    """Word edits allowed: as many as leave one three-word run whole by counting."""
    return max(0, min(int(length * share), (length - GRAM) // GRAM))


def parts(words: list[int], longest: int | None = None) -> list[list[int]]:
    """The words in parts of nearly equal size, at most ``longest``, and the parts halfway between them."""
    longest = longest or PART
    number = -(-len(words) // longest)
    edges = [len(words) * i // number for i in range(number + 1)]
    half = [(a + b) // 2 for a, b in zip(edges, edges[1:], strict=False)]
    return [words[a:b] for a, b in [*zip(edges, edges[1:], strict=False), *zip(half, half[1:], strict=False)]]


def automaton(pattern: list[int]) -> dict[int, int]:
    """Bit mask of the places of each word (Myers, 1999)."""
    masks: dict[int, int] = defaultdict(int)
    for i, word in enumerate(pattern):
        masks[word] |= 1 << i
    return masks


def best_match(masks: dict[int, int], length: int, text: list[int]) -> tuple[int, int]:
    """(edits, end) of the run of ``text`` nearest to the pattern, the first of equals."""
    full, high = (1 << length) - 1, 1 << (length - 1)
    plus, minus, score, best, end = full, 0, length, length, 0
    for at, word in enumerate(text, 1):
        equal = masks.get(word, 0)
        vertical = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up, down = minus | (full & ~(across | plus)), plus & across
        score += bool(up & high) - bool(down & high)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best, end = score, at
    return best, end


class Index:
    """One block of items, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], share: float = SHARE, seed: int = 11):
        self.share = share
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        for item, text in sorted(items, key=lambda i: (i[0] is None, i[0] or 0, i[1] or "")):
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in WORD.findall((text or "").lower())]
            if len(words) >= GRAM:
                self.items.append((item, words))
        self.base = len(self.vocabulary) + 1
        grams = {self._code(w[i], w[i + 1], w[i + 2]) for _, w in self.items for i in range(len(w) - GRAM + 1)}
        self.grams = np.array(sorted(grams), np.int64)
        self.longest = max((len(w) for _, w in self.items), default=0)
        rng = np.random.default_rng(seed)
        self.classes = []
        found = sorted(((i, part) for i, (_, words) in enumerate(self.items) for part in parts(words)), key=lambda p: len(p[1]))
        while found:
            shortest = len(found[0][1])
            members = [p for p in found if len(p[1]) <= shortest * CLASS_RATIO]
            found = found[len(members):]
            self.classes.append(SizeClass([i for i, _ in members], [part for _, part in members], share, rng))

    def _code(self, a, b, c):
        return (a * self.base + b) * self.base + c

    def search(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, place of the item in ``items``, edits, item words, start, end), best place of each item in each text."""
        if not self.items:
            return []
        words = [WORD.findall(t.lower()) for t in texts]
        counts = np.array([len(w) for w in words])
        flat = np.fromiter(map(self.vocabulary.get, chain.from_iterable(words), repeat(0)), np.int64, int(counts.sum()))
        del words
        if len(flat) < GRAM:
            return []
        ends = np.cumsum(counts)
        likely = flat > 0
        likely = np.flatnonzero(likely[:-2] & likely[1:-1] & likely[2:])
        codes = self._code(flat[likely], flat[likely + 1], flat[likely + 2])
        at = np.searchsorted(self.grams, codes)
        seeds = likely[self.grams[np.minimum(at, len(self.grams) - 1)] == codes]
        owner = np.searchsorted(ends, seeds, side="right")
        seeds = seeds[seeds + GRAM <= ends[owner]]
        # Only texts with a seed go on, side by side, so one array step serves the windows of all of them.
        some = np.unique(np.searchsorted(ends, seeds, side="right"))
        if not len(some):
            return []
        firsts, sizes = (ends - counts)[some], counts[some]
        moved = np.concatenate(([0], np.cumsum(sizes)[:-1])) - firsts
        flat = np.concatenate([flat[f:f + n] for f, n in zip(firsts, sizes, strict=True)])
        seeds = seeds + moved[np.searchsorted(some, np.searchsorted(ends, seeds, side="right"))]
        ends = np.cumsum(sizes)
        places: dict[tuple[int, int], set[int]] = defaultdict(set)
        for size in self.classes:
            starts = size.starts(ends, seeds)
            for item, start in size.candidates(flat, starts, ends[np.searchsorted(ends, starts, side="right")]):
                places[int(np.searchsorted(ends, start, side="right")), item].add(start)
        out = []
        for (text, item), found in sorted(places.items()):
            begin = int(ends[text] - sizes[text])
            hit = self._confirm(item, sorted(s - begin for s in found), flat[begin:int(ends[text])])
            if hit:
                out.append((int(some[text]), *hit))
        return out

    def _confirm(self, item: int, starts: list[int], words: np.ndarray):
        pattern = self.items[item][1]
        length, allowed = len(pattern), edits(len(pattern), self.share)
        masks, best = automaton(pattern), None
        regions: list[list[int]] = []
        for s in starts:
            low, high = max(0, s - length - allowed), min(len(words), s + 2 * length + allowed)
            if regions and low <= regions[-1][1]:
                regions[-1][1] = high
            else:
                regions.append([low, high])
        for low, high in regions:
            part = words[low:high].tolist()
            cost, end = best_match(masks, length, part)
            if cost <= allowed and (best is None or cost < best[0]):
                back = part[max(0, end - length - allowed):end][::-1]
                _, reach = best_match(automaton(pattern[::-1]), length, back)
                best = (cost, low + end - reach, low + end)
        return (item, best[0], length, best[1], best[2]) if best else None


class SizeClass:
    """Items of about one length: their walks, samples and keys."""

    def __init__(self, members: list[int], patterns: list[list[int]], share: float, rng):
        lengths = [len(p) for p in patterns]
        self.members = np.array(members)
        self.reach = max(n + edits(n, share) for n in lengths)
        self.needed = min(max(1, n - GRAM + 1 - GRAM * edits(n, share)) for n in lengths)
        steps = 2 * min(lengths)
        self.turn = rng.integers(0, 1 << 63, (WALKS, steps), np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, (WALKS, steps), np.uint64)
        self.sample = np.stack([[rng.permutation(steps)[:SAMPLED] for _ in range(TABLES)] for _ in range(WALKS)])
        self.weigh = rng.integers(0, 1 << 63, (WALKS, TABLES, SAMPLED), np.uint64) | np.uint64(1)
        width = max(lengths)
        padded = np.full((len(patterns), width), -1, np.int64)
        for i, p in enumerate(patterns):
            padded[i, :len(p)] = p
        keys = self.keys(padded.ravel(), np.arange(len(patterns)) * width, np.array(lengths))
        self.order = np.argsort(keys, axis=0, kind="stable")
        self.sorted = np.take_along_axis(keys, self.order, axis=0)

    def starts(self, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """Window starts whose words, inside their text, hold enough of the benchmark's runs."""
        n = int(ends[-1])
        marks = np.zeros(n + 1, np.int32)
        marks[seeds + 1] = 1
        held = np.cumsum(marks, dtype=np.int32)
        near = np.zeros(n + 1, np.int32)  # starts within reach of a seed
        np.add.at(near, np.maximum(seeds - self.reach, 0), 1)
        np.add.at(near, seeds + 1, -1)
        at = np.flatnonzero(np.cumsum(near)[:n] > 0)
        until = np.minimum(at + self.reach, ends[np.searchsorted(ends, at, side="right")])
        return at[held[until] - held[at] >= self.needed]

    def keys(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(windows, WALKS * TABLES) keys: walk over each window, sample the string it writes."""
        out = np.empty((len(starts), WALKS * TABLES), np.uint64)
        for walk in range(WALKS):
            index = np.zeros(len(starts), np.int64)
            written = np.empty((self.turn.shape[1], len(starts)), np.int64)
            for step in range(self.turn.shape[1]):
                inside = index < lengths
                symbol = np.where(inside, words[np.minimum(starts + index, len(words) - 1)], -1)
                written[step] = symbol
                coin = mixed(symbol.astype(np.uint64) * self.turn[walk, step] + self.shift[walk, step]) >> np.uint64(63)
                index += coin.astype(np.int64)
            for table in range(TABLES):
                picked = written[self.sample[walk, table]].astype(np.uint64) + np.uint64(2)
                out[:, walk * TABLES + table] = mixed((picked * self.weigh[walk, table][:, None]).sum(axis=0, dtype=np.uint64))
        return out

    def candidates(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, start) of every shared key."""
        for begin in range(0, len(starts), 20_000):
            part = starts[begin:begin + 20_000]
            keys = self.keys(words, part, ends[begin:begin + 20_000] - part)
            for column in range(keys.shape[1]):
                low = np.searchsorted(self.sorted[:, column], keys[:, column], side="left")
                high = np.searchsorted(self.sorted[:, column], keys[:, column], side="right")
                for i in np.flatnonzero(high > low):
                    for j in range(low[i], high[i]):
                        yield int(self.members[self.order[j, column]]), int(part[i])


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", share: float = SHARE) -> Iterator[Index]:
    """Indexes over the whole benchmark, each of a bounded number of words."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    words = rows.agg(F.sum(F.size(F.split("text", r"[\W_]+")) + F.regexp_count("text", F.lit(f"[{UNSPACED}]")))).first()[0] or 0
    number = max(1, -(-words // BLOCK_WORDS))
    for block in range(number):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(number)) == block)
        yield Index([(r["id"], r["text"]) for r in part.collect()], share)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """One row for each document and item it holds: doc_id, item_id, edits, item_words, start_word, end_word."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    out = None
    for index in blocks(benchmark, share=share):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names = pa.array([name for name, _ in shared.value.items], pa.int64())
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                for start, end in slices(texts, SLICE):
                    hits = np.array(shared.value.search(texts[start:end]), np.int64).reshape(-1, 6)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(hits[:, 0] + start)), names.take(pa.array(hits[:, 1])), *(pa.array(hits[:, c].astype(np.int32)) for c in range(2, 6))],
                        ["doc_id", "item_id", "edits", "item_words", "start_word", "end_word"])

        found = rows.mapInArrow(run, HITS)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` that hold no item, unchanged and without a shuffle."""
    at = docs.columns.index(text_col)
    for index in blocks(benchmark, share=share):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [t or "" for t in batch.column(at).to_pylist()]
                keep = np.ones(len(texts), bool)
                for start, end in slices(texts, SLICE):
                    for hit in shared.value.search(texts[start:end]):
                        keep[start + hit[0]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
