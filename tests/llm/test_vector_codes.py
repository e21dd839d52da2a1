from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from demandpanel.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    """The result by plain whole-number loops."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return {}
    width = len(kept[0][1]) // 16
    kept = [r for r in kept if len(r[1]) == 16 * width]
    cut = {n: [v[p * width:(p + 1) * width] for p in range(16)] for n, (_, v, _) in enumerate(kept)}
    books = [[cut[n][p] for n in range(min(64, len(kept)))] for p in range(16)]

    def assign():
        out = {}
        for n, parts in cut.items():
            out[n] = [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(books[p])) for p, x in enumerate(parts)]
        return out
    for _ in range(2):
        found = assign()
        for p in range(16):
            for k in range(len(books[p])):
                mine = [cut[n][p] for n in cut if found[n][p][1] == k]
                if mine:
                    books[p][k] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    found = assign()
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    errors = {n: sum(d for d, _ in found[n]) for n in cut}
    per = {}
    for n, (_, _, lab) in enumerate(kept):
        per[lab] = per.get(lab, 0) + errors[n]
    return sorted(((i, "".join(f"{k:02x}" for _, k in found[n]), errors[n], per[lab], digest) for n, (i, _, lab) in enumerate(kept)), key=str)


def got(spark, rows):
    return sorted((tuple(r) for r in vc.compress(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=str)


def made(n, length, seed, scale=0.3):
    rng = random.Random(seed)
    return [(7 * i + 3, [rng.gauss(0, scale) for _ in range(length)], rng.choice([0, 0, 0, 1, 2, None])) for i in range(n)]


def test_equals_brute_force(spark):
    rows = made(150, 48, 1)
    rng = random.Random(2)
    rows += [(5000 + i, list(rows[i % 4][1]), 1) for i in range(60)]  # a group of equal vectors
    rng.shuffle(rows)
    assert got(spark, rows) == brute(rows)


def test_bad_vectors_ties_repeats_null_ids_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = made(9, 16, 3)
    bad = [(900, None, 1), (901, [None] + [0.0] * 15, 1), (902, [nan] + [0.0] * 15, 1), (903, [0.0] * 15 + [-inf], 1), (904, [], 1), (905, [1.0] * 32, 1)]
    rows = good + bad + [(3, [0.5] * 16, 4), (3, [0.5] * 16, 4), (None, [-0.001] * 16, None), (950, [0.5] * 16, None)]
    assert got(spark, rows) == brute(rows) and len(got(spark, rows)) == 13
    assert got(spark, []) == got(spark, bad[:5]) == []


def test_more_than_one_limb(spark):
    rows = made(80, 32, 5, scale=2.0 ** 17)  # components near 2^27: products need two limbs
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("high", [10, 1 << 25, 1 << 28])
def test_limb_products_are_exact(high):
    rng = np.random.default_rng(high)
    x, y = rng.integers(-high, high + 1, (40, 37)), rng.integers(-high, high + 1, (21, 37))
    x[0], y[0], y[1] = high, high, -high
    want = [[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in y] for r in x]
    assert vc.exact_products(x, y).tolist() == want
    bits = vc.limb_bits(37)
    assert 37 << (2 * bits) < 2 ** 53 and all(np.abs(limb).max() <= 1 << bits for limb in vc.limbs(x, bits))


def test_too_large_and_uncut_vectors_fail_clearly(spark):
    with pytest.raises(OverflowError):
        vc.checked(np.array([[2.0 ** 40]]), 1)
    with pytest.raises(ValueError):
        vc.compress(spark.createDataFrame([(1, [0.5] * 17, 1)], SCHEMA))


def test_other_columns_and_label_kinds(spark):
    rows = [(i, [0.01 * i] * 16, f"l{i % 2}", 9, 9) for i in range(5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, id long, code long")
    out = vc.compress(frame)
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and out.count() == 5
