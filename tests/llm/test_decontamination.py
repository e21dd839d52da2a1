from __future__ import annotations

import random

import pytest

from demandpanel.llm import decontamination as dc

BENCH = "item_id long, text string"


def distance(pattern, words):
    """Least word edits between the pattern and any run of words, cell by cell."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for w in words:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (p != w)))
        row = new
        best = min(best, row[-1])
    return best


def brute(rows, items):
    words = lambda t: dc.WORD.findall((t or "").lower())
    out = set()
    for i, t in rows:
        for j, p in items:
            pattern = words(p)
            if len(pattern) >= dc.GRAM:
                d = distance(pattern, words(t))
                if d <= dc.edits(len(pattern)):
                    out.add((i, j, d))
    return out


def edited(words, edits, rng, prose):
    words = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = prose(1, rng.random())[0]
        elif kind == 1:
            words.insert(at, prose(1, rng.random())[0])
        else:
            del words[at]
    return words


def test_edited_passages_are_found_as_brute_force_finds_them(spark, docs, prose):
    rng = random.Random(3)
    items = [(j, " ".join(prose(n, f"item{j}"))) for j, n in enumerate([3, 4, 5, 8, 12, 16, 20, 25, 30, 37, 45, 60, 90, 140])]
    rows = []
    for i in range(240):
        j = i % len(items)
        pattern = items[j][1].split()
        inner = edited(pattern, rng.randint(0, dc.edits(len(pattern)) + 1), rng, prose)
        body = prose(rng.randint(0, 40), f"a{i}") + inner + prose(rng.randint(0, 40), f"b{i}")
        rows.append((i, ", ".join(body).upper() if i % 5 == 0 else "###".join(body) if i % 7 == 0 else " ".join(body)))
    rows += [(1000 + i, " ".join(prose(80, f"clean{i}"))) for i in range(40)]
    want = brute(rows, items)
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in dc.find(docs(*rows), spark.createDataFrame(items, BENCH)).collect()}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 150
    assert not {i for i, *_ in got if i >= 1000}
    exact = {(i, j) for i, j, d in want if d == 0}
    assert exact <= {(i, j) for i, j, _ in got}


@pytest.mark.parametrize("length", [15, 24, 32, 60, 120, 200, 300, 400])
def test_recall_at_the_largest_number_of_edits(prose, length):
    """Items of one size, each edited as often as allowed: nearly all that brute force would find are found."""
    rng, n = random.Random(length), 150 if length < 100 else 60
    items = [(j, " ".join(prose(length, f"r{length}.{j}"))) for j in range(n)]
    texts = [" ".join(prose(30, f"a{j}") + edited(p.split(), dc.edits(length), rng, prose) + prose(30, f"b{j}")) for j, p in items]
    found = {(h[0], h[1]) for h in dc.Index(items).search(texts)}
    assert sum((j, j) in found for j in range(n)) >= 0.98 * n


def test_scripts_without_spaces_are_compared_by_characters(spark, docs):
    item = "人工智能的发展正在改变我们的生活方式和工作方式"
    rows = [(1, "前言。" + item + "！后记"), (2, "前言" + item.replace("正在", "一直") + "后"), (3, "完全不同的一段文字与基准没有任何关系"), (4, "人工智能")]
    got = {r["doc_id"]: r["edits"] for r in dc.find(docs(*rows), spark.createDataFrame([(9, item), (None, "two words")], BENCH)).collect()}
    assert got == {1: 0, 2: 2}


def test_places_are_the_matched_words(spark, docs, prose):
    item = prose(20, "x")
    text = prose(7, "y") + item + prose(9, "z")
    hit = dc.find(docs((1, " ".join(text))), spark.createDataFrame([(5, " ".join(item))], BENCH)).first()
    assert tuple(hit) == (1, 5, 0, 20, 7, 27)


def test_blocks_of_the_benchmark_find_the_same(spark, docs, prose, monkeypatch):
    items = [(j, " ".join(prose(20, f"i{j}"))) for j in range(12)]
    rows = [(j, " ".join(prose(10, f"p{j}") + items[j][1].split())) for j in range(12)] + [(99, " ".join(prose(30, "no")))]
    bench = spark.createDataFrame(items, BENCH)
    whole = sorted(map(tuple, dc.find(docs(*rows), bench).collect()))
    monkeypatch.setattr(dc, "BLOCK_WORDS", 40)
    assert sorted(map(tuple, dc.find(docs(*rows), bench).collect())) == whole and len(whole) == 12
    assert [r["doc_id"] for r in dc.clean(docs(*rows), bench).collect()] == [99]


def test_nulls_short_items_repeats_and_long_texts(spark, docs, prose):
    item = " ".join(prose(18, "q"))
    rows = [(1, None), (2, ""), (3, "two words"), (4, item), (4, item), (None, item), (5, " ".join(prose(150_000, "long")) + " " + item), (6, " ".join([item] * 300))]
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (4, item), (7, item), (None, "x"), (None, item), (-1, item + " z")], BENCH)
    got = sorted(((r["doc_id"], r["item_id"]) for r in dc.find(docs(*rows), bench).collect()), key=str)
    assert got == sorted([(i, j) for i in (4, 4, None, 5, 6) for j in (4, 7, None, -1)], key=str)
    frame = docs(*rows).withColumnRenamed("source", "item_id")
    left = dc.clean(frame, bench)
    assert left.columns == frame.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3]


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], BENCH)
    assert dc.find(docs(), none).collect() == [] and dc.find(docs((1, "a b c d")), none).collect() == []
    assert dc.clean(docs((1, "a b c d")), none).count() == 1 and dc.clean(docs(), none).count() == 0


def test_automaton_equals_the_table():
    rng = random.Random(1)
    for _ in range(300):
        pattern = [rng.randrange(4) for _ in range(rng.randint(1, 70))]
        text = [rng.randrange(4) for _ in range(rng.randint(0, 90))]
        assert dc.best_match(dc.automaton(pattern), len(pattern), text)[0] == distance(pattern, text)
