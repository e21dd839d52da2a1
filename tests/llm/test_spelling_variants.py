from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from demandpanel.llm import spelling_variants as sv


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    form, out = {}, []
    partners = {w: [v for v in words if near(w, v)] for w in words}
    for w, n in words.items():
        best = min(partners[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(partners[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def got(frame):
    return sorted((tuple(r) for r in sv.variants(frame).collect()), key=str)


def edited(word, rng, letters):
    at, kind = rng.randrange(len(word) + 1), rng.randrange(3)
    return word[:at] + (rng.choice(letters) if kind else "") + word[at + (kind != 1):]


def corpus(seed, bases=40, letters="abcdeéßÿ"):
    rng = random.Random(seed)
    words = ["".join(rng.choices(letters, k=rng.choice([5, 6, 7, 8, 11, 14]))) for _ in range(bases)]
    for _ in range(3):
        words += [edited(rng.choice(words), rng, letters) for _ in range(bases)]
    return rng, [w for w in words if w]


@pytest.mark.parametrize("crowd", [64, 1])
def test_equals_brute_force(docs, monkeypatch, crowd):
    monkeypatch.setattr(sv, "CROWD", crowd)
    rng, words = corpus(crowd)
    weights = [6 ** rng.randrange(5) for _ in words]
    rows = [(i, rng.choice([" ", "-", "1", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, weights, k=400))) for i in range(60)]
    want = brute(rows)
    assert got(docs(*rows)) == want
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] and w[2] != w[1] for w in want)


def test_crowded_beginning_and_ending(docs):
    """Hundreds of words share their first half and hundreds their last: pairs are found through what is left out."""
    rng = random.Random(7)
    words = {"common" + "".join(rng.choices("abc", k=5)) for _ in range(220)} | {"".join(rng.choices("abc", k=6)) + "ending" for _ in range(220)}
    rows = [(i, " ".join(sorted(words))) for i in range(6)]
    assert got(docs(*rows)) == brute(rows)


def test_every_edit_of_a_word_keeps_a_chunk(spark):
    base = "abcdefgh"
    others = {base[:i] + x + base[i + d:] for i in range(9) for d in (0, 1) for x in ("", "z") if base[:i] + x + base[i + d:] != base}
    frame = spark.createDataFrame([(w, 5, len(w)) for w in {base, *others}], "word string, n long, length int")
    pairs = {tuple(r) for r in sv.near_pairs(frame).collect()}
    assert {b for a, b in pairs if a == base} == others and pairs == {(b, a) for a, b in pairs} == {(a, b) for a in {base, *others} for b in {base, *others} if near(a, b)}


def test_long_words_are_verified_by_their_common_beginning(spark, monkeypatch):
    monkeypatch.setattr(sv, "SHORT", 0)
    rng, base = random.Random(6), "abcdefghijé" * 40
    pairs = [(base, base[:i] + x + base[i + 1:]) for i in (0, 1, 217, len(base) - 1) for x in ("", "Z")] + [(base, base), (base, base[2:] + "ab"), (base, "x" + base[1:-1] + "y"), (base, base[1:-1] + "q")]
    pairs += [("aaaaaaa", "aaaaaa"), ("abababab", "babababa"), ("abcabcab", "abcabab")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sv.one_edit(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r["x"] for r in got] == [near(a, b) for a, b in pairs]


def test_forms_are_followed_to_the_last(spark):
    chain = [("w%d" % i, "w%d" % (i + 1)) for i in range(9)] + [("x", "w4"), ("y", "z")]
    got = {r["word"]: r["root"] for r in sv._roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {**{"w%d" % i: "w9" for i in range(9)}, "x": "w9", "y": "z"}


def test_empty_nulls_repeats_long_runs_and_other_columns(docs):
    assert got(docs()) == got(docs((1, None), (2, ""), (3, "short words only"))) == []
    long = "ab" * 1_500
    rows = [(1, long + " " + long + "x"), (1, long + " " + long + "x"), (None, "Straße straße STRASSE strasse strasse"), (None, "Straße straße")] + [(k, long + " " + long + "x ×÷×÷×÷ ×÷×÷×÷×") for k in range(2, 7)]
    want = brute(rows)
    assert len(want) >= 4 and got(docs(*rows)) == want
    frame = docs(*rows).withColumnsRenamed({"source": "word", "n_chars": "n", "lang": "a"})
    assert got(frame) == want


def test_no_side_of_a_join_is_broadcast(docs, monkeypatch):
    """Exploded rows pass for as small as their words, so a small table shows which sides the planner would broadcast."""
    keep, plans = sv.staged, []

    def planned(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return frame

    monkeypatch.setattr(sv, "staged", lambda frame: keep(planned(frame)))
    rows = [(i, "colouring colouring colouring colouring colouring " + "colourin " * (i == 0)) for i in range(10)] + [(i, "colourin") for i in range(11, 18)]
    assert planned(sv.variants(docs(*rows))).count() == 2
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)
