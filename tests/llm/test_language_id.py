from __future__ import annotations

import random
import zlib

import numpy as np

from demandpanel.llm import language_id as li

SYLLABLES = {"aa": "ka to mi ru so na".split(), "bb": "sch ein ung ver lich keit".split(), "cc": "ção nho ará que dos lim".split()}


def text(label, n, seed):
    rng = random.Random(f"{label}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[label]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def frame(spark, extra=()):
    rows = [(i, text(label, 30, i), label, "s", 0) for i, label in enumerate(["aa"] * 120 + ["bb"] * 60 + ["cc"] * 20)]
    return spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


EXTRA = [(900, None, "aa", "s", 0), (901, "", "bb", "s", 0), (902, "12 34 ?!", None, "s", 0), (903, text("bb", 40_000, 1), None, "s", 0), (904, "ka to mi", None, "s", 0), (904, "ka to mi", None, "s", 0),
         (None, text("cc", 20, 5), "cc", "s", 0)]


def test_held_out_accuracy_unknowns_and_repeats(spark):
    docs = frame(spark, EXTRA)
    rows = li.identify(docs, li.train(docs)).collect()
    want = {r["doc_id"]: r["lang"] for r in docs.collect() if r["doc_id"] is not None and r["doc_id"] < 900}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows if r["doc_id"] is not None)
    known = [r for r in held if r["doc_id"] in want]
    assert len(known) > 30 and all(r["lang_pred"] == want[r["doc_id"]] for r in known)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert by[900] == by[901] == by[902] == [("und", 0.0)]
    assert by[903][0][0] == "bb" and len(by[904]) == 2 and len(set(by[904])) == 1 and by[None][0][0] == "cc"
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_only_the_text_decides(spark):
    docs = frame(spark)
    model = li.train(docs)
    other = docs.selectExpr("doc_id + 5000 AS doc_id", "text", "'zz' AS lang", "'t' AS source", "n_chars")
    same = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in li.identify(docs, model).collect()}
    assert {r["doc_id"] - 5000: (r["lang_pred"], r["score"]) for r in li.identify(other, model).collect()} == same


def test_identified_keeps_rows_and_nothing_to_learn(spark):
    docs = frame(spark, EXTRA).withColumnRenamed("source", "lang_pred")
    left = li.identified(docs, li.train(docs))
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in left.collect()} == {900, 901, 902}
    empty = docs.limit(0)
    model = li.train(empty)
    assert li.identify(empty, model).collect() == []
    assert {tuple(r)[2:] for r in li.identify(docs, model).collect()} == {("und", 0.0)}


def test_counts_equal_plain_counting():
    texts = ["Ab, ab!", "", None, "é1é", "x" * 5]
    row, bucket, count = li.ngrams(texts)
    per = np.bincount(row, count, len(texts))
    # "ab ab " has 4 letters, 5 pairs and 4 triples; "é é " 2, 3 and 2; "xxxxx " 5, 5 and 4.
    assert per.tolist() == [4 + 5 + 4, 0, 0, 2 + 3 + 2, 5 + 5 + 4]


def test_a_texts_counts_do_not_depend_on_its_neighbours():
    texts = ["!ab", "ab", "", "?? ab.", "ab"]
    row, bucket, count = li.ngrams(texts)
    own = [sorted(zip(bucket[row == i].tolist(), count[row == i].tolist(), strict=True)) for i in range(5)]
    assert own[0] == own[1] == own[3] == own[4] != own[2]


def test_elastic_net_leaves_most_weights_zero(spark):
    model = li.train(frame(spark))
    assert (model.weights == 0).mean() > 0.9 and model.temperature > 0


def test_noise_and_unlearned_languages_go_and_short_clean_texts_stay(spark):
    rng = random.Random(3)
    noise = ["".join(rng.choice("bcdfghjklmnpqrstvwxyz   ") for _ in range(n)) for n in (80, 300, 3000)]
    other = [" ".join("".join(rng.choice("vry dze lgy ubw ofp yhm".split()) for _ in range(3)) for _ in range(n)) for n in (10, 60, 400)]
    script = ["мы все идём домой и там поём " * n for n in (3, 20)]
    clean = [text(c, n, 7000 + k) for c in ("aa", "bb") for n in (1, 2, 5, 200) for k in range(40)]
    bad = [(2000 + i, t, None, "s", 0) for i, t in enumerate(noise + other + script)]
    good = [(3000 + i, t, None, "s", 0) for i, t in enumerate(clean)]
    docs = frame(spark, bad + good)
    kept = {r["doc_id"] for r in li.identified(docs, li.train(docs)).collect()}
    assert not kept & {b[0] for b in bad}
    assert kept == {r["doc_id"] for r in docs.collect()} - {b[0] for b in bad}


def test_labels_of_copies_are_learned_from_distinct_texts(spark):
    # Of each text 300 copies; texts whose hash places them highest, so a share of the rows would draw none.
    high = {}
    rows = spark.createDataFrame([(c, text(c, 30, k)) for c in ("aa", "bb") for k in range(40)], "label string, text string")
    for r in rows.selectExpr("label", "text", "pmod(xxhash64(text), 1 << 30) AS place").orderBy("place").collect():
        high[r["label"]] = r["text"]
    copies = [(i, high["aa" if i % 2 else "bb"], "aa" if i % 2 else "bb", "s", 0) for i in range(600)]
    docs = spark.createDataFrame(copies, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for frame_, labels in ((docs, ["aa", "bb"]), (docs.filter("lang = 'aa'"), ["aa"])):
        model = li.train(frame_, per_language=1)
        assert model.labels == labels
        said = {(r["lang"], r["lang_pred"]) for r in li.identify(frame_, model).join(frame_, "doc_id").select("lang", "lang_pred").collect()}
        assert said == {(c, c) for c in labels}
    assert li.identified(docs, li.train(docs, per_language=1)).count() == 600
