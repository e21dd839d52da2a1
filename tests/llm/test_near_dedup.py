from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from demandpanel.llm import components as cc, near_dedup as nd

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(zip(*(w[i:] for i in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width, percent):
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            common = len(x & y)
            if x and y and 100 * common >= percent * (len(x) + len(y) - common):
                p, q = top(i), top(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), top(i)) for i, s in sets}


def changed(words, n, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"n{rng.random()}"
    return words


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_components_equal_brute_force(docs, prose, width, percent):
    rng = random.Random(4)
    rows, number = [], iter(rng.sample(range(10_000), 900))
    for g in range(12):  # hubs whose copies are mostly unlike each other
        base = prose(120, f"b{g}")
        rows += [(next(number), " ".join(base))]
        rows += [(next(number), " ".join(changed(base, rng.choice([0, 1, 2, 3, 4, 6, 9]), rng))) for _ in range(25)]
    shared = prose(9, "passage")
    rows += [(next(number), " ".join(prose(rng.choice([2, 5, 9]), f"s{k}") + shared)) for k in range(120)]
    rows += [(next(number), t) for t in (None, "", "  \n", "One", "one", "one two", "ONE\tTWO", "two one", "ß ß", "a b c", "A b\nc")]
    want = brute(rows, width, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.assign(docs(*rows), width, percent).collect()}
    assert got == want


def test_a_large_group_and_keys_across_components(docs, prose, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    monkeypatch.setattr(nd, "WIDE_BLOCK", 16)
    rng = random.Random(8)
    base = prose(150, "big")
    rows = [(i, " ".join(changed(base, rng.choice([1, 2, 4, 5, 6, 7]), rng))) for i in range(160)] + [(1000 + i, " ".join(base)) for i in range(60)]
    want = brute(rows, 3, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.assign(docs(*rows), 3, 85).collect()}
    assert got == want


def test_pairs_within_the_guaranteed_distance_share_a_key():
    import numpy as np
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, nd.COMPONENTS).astype(np.uint16)
        b = a.copy()
        at = rng.permutation(nd.COMPONENTS)[:nd.GUARANTEED]
        b[at] ^= 1
        keys = nd.chunk_keys(np.stack([a, b]))
        assert (keys[0] == keys[1]).any()


def test_empty_repeats_null_ids_long_texts_and_clashing_columns(docs, prose):
    assert nd.assign(docs()).collect() == [] and nd.deduplicate(docs()).collect() == []
    long = " ".join(prose(60_000, "l"))
    rows = [(3, long), (1, long + " end"), (3, long), (None, long), (None, None), (7, "x y z")]
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in nd.assign(docs(*rows)).collect()), key=str)
    assert got == sorted([(3, 1, False), (1, 1, True), (3, 1, False), (None, 1, True), (None, None, True), (7, 7, True)], key=str)
    frame = docs((1, "a b c d e f"), (2, "A b c d e f"), (5, "q")).withColumnsRenamed({"source": "id", "n_chars": "mark"})
    out = nd.deduplicate(frame)
    assert out.columns == frame.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 5]


def test_components_of_a_chain_a_star_and_a_ring(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    random.Random(1).shuffle(links)
    got = {r["node"]: r["component"] for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}
    assert cc.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_signatures_estimate_similarity(prose):
    a, b = prose(400, "e1"), prose(400, "e2")
    sets = nd.shingle_sets([" ".join(a), " ".join(a[:300] + b[:100])], 3)
    true = len(set(sets[0]) & set(sets[1])) / len(set(sets[0]) | set(sets[1]))
    signs = nd.signatures(sets)
    assert abs((signs[0] == signs[1]).mean() - true) < 0.2


def test_a_long_chain_of_near_copies(docs, prose):
    """Copies each near to the next only: no one document is near to them all, and each link counts."""
    rng = random.Random(12)
    words, rows = prose(160, "chain"), []
    for i in range(400):
        rows.append((i, " ".join(words)))
        words = changed(words, 2, rng)
    got = {r["doc_id"]: r["component_id"] for r in nd.assign(docs(*rows), 5, 80).collect()}
    assert got == {i: 0 for i in range(400)}


def test_blocks_hand_on_a_forest_only(prose):
    """Of a block of mutual near copies at most one link a component comes out, however many pairs are alike."""
    import numpy as np
    import pyarrow as pa
    rng, base, n = random.Random(5), prose(300, "f"), 60
    sets = nd.shingle_sets([" ".join(changed(base, 2, rng)) for _ in range(n)], 5)
    marks = [pa.array([v] * n) for v in (1, 0, 0)] + [pa.array(range(n)), pa.array(range(n))] + [pa.array([len(s) for s in sets])] * 2 + [pa.array([True] * n)]
    marks += [pa.array([w.tobytes() for w in nd.signatures(sets, *kind)], pa.binary()) for kind in ((), (nd.WIDE, np.uint8))]
    batch = pa.RecordBatch.from_arrays([*marks, pa.array([s.view(np.int64) for s in sets])], ["key", "i", "j", "id", "comp", "size", "most", "out", "sign", "wide", "shingles"])
    links = [row for b in nd._forest(80)(iter([batch])) for row in b.to_pylist()]
    assert len(links) == n - 1
