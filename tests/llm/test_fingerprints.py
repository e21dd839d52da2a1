from __future__ import annotations

import hashlib
import math
import random
from itertools import combinations

import numpy as np
import pytest

from demandpanel.llm import fingerprints as fp


def plain_counts(raw):
    """Bucket counters of one text, a triplet at a time."""
    counts, data = [0] * 256, b"\0\0\0\0" + raw
    for end in range(4, len(data)):
        for kind, (a, b) in enumerate(combinations(range(1, 5), 2)):
            x, y, z = (int(v) for v in fp._ODD[kind])
            h = (data[end] * x + data[end - a] * y + data[end - b] * z + int(fp._SALT[kind])) % 2 ** 32
            h = (h ^ h >> 15) * 0x2C1B3C6D % 2 ** 32
            counts[h >> 24] += 1
    return counts


def plain_print(text):
    raw = text.encode()
    counts = plain_counts(raw)
    q = [sorted(counts)[64 * k - 1] for k in (1, 2, 3)]
    codes = [sum(c > x for x in q) for c in counts]
    top = max(q[2], 1)
    head = bytes([min(255, math.floor(12 * math.log1p(len(raw)))), q[0] * 15 // top << 4 | q[1] * 15 // top])
    return (head + bytes(codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, 256, 4))).hex()


def plain_likeness(x, y):
    a, b = bytes.fromhex(x), bytes.fromhex(y)
    total = sum([0, 1, 2, 6][abs((p >> s & 3) - (q >> s & 3))] for p, q in zip(a[2:], b[2:], strict=True) for s in (0, 2, 4, 6))
    total += min(64, abs(a[0] - b[0])) + abs((a[1] >> 4) - (b[1] >> 4)) + abs((a[1] & 15) - (b[1] & 15))
    return max(0.0, 1 - total / 416)


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[:len(t) - cut] + after[:cut]
        a, b, c = map(plain_print, (t, edited, after))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    return sorted(out, key=str)


def got(frame):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in map(tuple, fp.compare_edited(frame).collect())), key=str)


def test_equals_brute_force(docs, prose):
    rng = random.Random(3)
    rows = [(rng.randrange(10 ** 9), " ".join(prose(rng.choice([1, 3, 20, 150]), k))) for k in range(120)]
    rows += [(5, None), (6, ""), (7, "é"), (8, "abc"), (9, "abcd"), (10, "日本語の文章、🎈🎈🎈🎈。"), (11, "x" * 3000), (11, "y z"), (11, "y z"), (None, "no id"), (None, "second")]
    assert got(docs(*rows)) == brute(rows)


def test_long_texts_in_pieces(docs, prose, monkeypatch):
    monkeypatch.setattr(fp, "BYTES", 700)
    rows = [(k, " ".join(prose(n, f"l{k}"))) for k, n in enumerate((400, 3, 250, 60, 60, 1))] + [(9, "ä" * 900)]
    assert got(docs(*rows)) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, "alone in the table, followed by itself")], [(1, None)], [(2, "twice"), (2, "twice")]])
def test_empty_single_and_repeated(docs, rows):
    assert got(docs(*rows)) == brute(rows)


def test_counters_of_pieces_add_up(prose):
    raw = " ".join(prose(500, "sum")).encode()
    whole = fp.bucket_counts([(b"", raw)])
    for cut in (0, 1, 3, 4, 1000):
        assert (whole == fp.bucket_counts([(b"", raw[:cut])]) + fp.bucket_counts([((b"\0" * 4 + raw[:cut])[-4:], raw[cut:])])).all()
    assert whole.sum() == 6 * len(raw)


def test_likeness_falls_with_the_share_changed(prose):
    base, other = prose(1500, "a"), prose(1500, "b")
    prints = fp.of_hex(fp.fingerprints([" ".join(base[:1500 - n] + other[:n]) for n in (0, 15, 150, 375, 1500)]))
    near = fp.likeness(np.repeat(prints[:1], len(prints), axis=0), prints)
    assert near[0] == 1 and all(near[i] > near[i + 1] for i in range(4)) and near[1] > 0.95
    unlike = fp.of_hex(fp.fingerprints(["".join(random.Random(k).choices(letters, k=4000)) for k, letters in enumerate(("aeiou dns", "0123456789 ."))]))
    assert fp.likeness(unlike[:1], unlike[1:])[0] < 0.3


def test_difference_is_bounded():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 256, (500, 66), np.uint8), rng.integers(0, 256, (500, 66), np.uint8)
    found = fp.difference(a, b)
    assert (found >= 0).all() and found.max() <= 6 * 256 + 64 + 30 and abs((found - np.minimum(64, np.abs(a[:, 0].astype(int) - b[:, 0]))).mean() - fp.UNRELATED) < 30
    assert (fp.difference(a, a) == 0).all() and (fp.difference(a, b) == fp.difference(b, a)).all()


def test_other_columns_do_not_matter(docs):
    frame = docs((1, "a b c d e f"), (2, "A b c d e f")).withColumnsRenamed({"source": "id", "n_chars": "task", "lang": "head"})
    assert got(frame) == brute([(1, "a b c d e f"), (2, "A b c d e f")])
