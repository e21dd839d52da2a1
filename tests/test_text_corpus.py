from __future__ import annotations

import math
from collections import Counter

import pytest

from demandpanel.operators import textmining as tm

TEXTS = ["crab crab view 温泉", "view castle", "", "the the", "カニ・温泉 view", None]


@pytest.fixture
def corpus(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, t string")
    return tm.tokenise(df, "t")


DOCS = [["温泉", "crab", "crab", "view"], ["view", "castle"], [], [], ["カニ", "温泉", "view"]]


def test_keywords_against_brute_force(corpus):
    docs = [d for d in DOCS if d]
    n, df = len(docs), Counter(t for d in docs for t in set(d))
    scores = Counter()
    for d in docs:
        w = {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in Counter(d).items()}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for t, v in w.items():
            scores[t] += v / norm / n
    got = {r.term: r.score for r in tm.tfidf_keywords(corpus).collect()}
    assert got.keys() == scores.keys() and all(got[t] == pytest.approx(scores[t]) for t in got)
    few = tm.tfidf_keywords(corpus, size=2).collect()
    assert {r.term for r in few} == {"view", "crab"}


def test_keywords_need_two_documents(corpus):
    assert tm.tfidf_keywords(corpus.where("id = 1")).count() == 0
    assert tm.tfidf_keywords(corpus.where("id = 2")).count() == 0


def test_counts(corpus, rows):
    top = [tuple(r) for r in tm.word_weights(corpus, 3).collect()]
    assert top == [("view", 3, 1.0), ("crab", 2, 2 / 3), ("castle", 1, 1 / 3)]
    grams = {r.term: r.n for r in tm.ngram_counts(corpus, 2).collect()}
    # n-grams run over the tokens themselves, a kana run stays whole.
    assert grams["crab crab"] == 1 and grams["カニ・温泉 view"] == 1 and len(grams) == 5


def test_leading_ngrams_of_frequent_words_are_those_of_all(spark, monkeypatch):
    """Frequent words that meet rarely, a phrase of rarer words that comes often, ties, and words no set holds."""
    import random
    rng = random.Random(5)
    often = ["".join(p) for p in zip("abcdefgh", "ijklmnop", strict=True)]
    texts = [rng.choices(often, k=30) + ["it's", "a\\b", "it's", "カニ・温泉"][: i % 5] + ["rare", "phrase", "here"] * (i % 2) + [f"once{i}"] for i in range(60)] + [[], ["ai"]]
    df = spark.createDataFrame([(t,) for t in texts], "tokens array<string>")
    words = tm.term_frequencies(df).cache()
    for n in (2, 3):
        grams = Counter(" ".join(t[i:i + n]) for t in texts for i in range(len(t) - n + 1))
        for top in (1, 20, 10_000):
            want = sorted(grams.items(), key=lambda g: (-g[1], g[0]))[:top]
            for leading, looked_up in ((2000, 20_000), (8, 20_000), (3, 20_000), (3, 4), (1, 0)):
                monkeypatch.setattr(tm, "LEADING", leading)
                monkeypatch.setattr(tm, "LOOKED_UP", looked_up)
                assert [tuple(r) for r in tm.ngram_counts(df, n, top, words=words).collect()] == want, (n, top, leading, looked_up)


def test_norms_are_the_same_however_many_terms_are_frequent(corpus, monkeypatch):
    want = {r.term: r.score for r in tm.tfidf_keywords(corpus).collect()}
    for frequent in (0, 2):
        monkeypatch.setattr(tm, "FREQUENT", frequent)
        assert {r.term: r.score for r in tm.tfidf_keywords(corpus).collect()} == pytest.approx(want)


def test_full_analysis_counts_words_and_terms_once(spark, monkeypatch):
    """N-grams with a word too rare to lead are not written out; tokens are neither staged nor counted twice."""
    from demandpanel.functions import text as tx
    calls = Counter()
    for module, name in ((tm, "term_frequencies"), (tm, "staged"), (tx, "term_counts"), (tx, "ngrams")):
        monkeypatch.setattr(module, name, lambda *a, _f=getattr(module, name), _n=name, **k: (calls.update([_n]), _f(*a, **k))[1])
    texts = ["crab sea boat fish", "castle temple garden moss"] * 30 + [f"{a}once{b}" for a in "abc" for b in "def"]
    parts = tm.full_analysis(spark.createDataFrame([(t,) for t in texts], "t string"), "t", k=2)
    assert parts["bigrams"].count() == 6 and parts["wordcloud"].count() > 8 and parts["topics"].count() == 2
    # Staged: tokens, word counts, documents counted, term counts, vectors, norms.
    assert calls == {"term_frequencies": 1, "staged": 6, "term_counts": 1}


def test_topics_structure(spark):
    df = spark.createDataFrame([(i, "crab sea boat fish" if i % 2 else "castle temple garden moss") for i in range(30)], "id int, t string")
    words, counts = tm.topics(tm.tokenise(df, "t"), k=2, top_words=4, iterations=5)
    got = words.collect()
    assert len(got) == 2 and all(len(r.words) == 4 for r in got) and sum(r.docs for r in counts.collect()) == 30
    assert tm.topics(tm.tokenise(df.limit(3), "t"), k=2)[0].count() == 0


def test_topics_tokenise_each_text_once_and_fit_on_all_cores(spark):
    from pyspark.sql import functions as F
    read = spark.sparkContext.accumulator(0)

    def words(i):
        read.add(1)
        return ["crab", "sea", "boat", "fish"] if i % 2 else ["castle", "temple", "garden", "moss"]

    tokens = F.udf(words, "array<string>").asNondeterministic()
    df = spark.range(6000, numPartitions=1).select("id", tokens("id").alias("tokens"))
    stages = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("topics", "topics")
    try:
        found, counts = tm.topics(df, k=2, top_words=4, iterations=2)
        assert found.count() == 2 and sum(r.docs for r in counts.collect()) == 6000
        widest = max(info.numTasks for job in stages.getJobIdsForGroup("topics") for stage in stages.getJobInfo(job).stageIds if (info := stages.getStageInfo(stage)))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert read.value == 6000 and widest >= 5


def test_full_analysis_tokenises_each_text_once(spark):
    from pyspark.sql import functions as F
    read = spark.sparkContext.accumulator(0)

    def text(i):
        read.add(1)
        return ["crab sea boat fish", "castle temple garden moss", None][i % 3]

    df = spark.range(300).select("id", F.udf(text, "string").asNondeterministic()("id").alias("t"))
    parts = tm.full_analysis(df, "t", k=2)
    got = {name: parts[name].count() for name in ("keywords", "topics", "bigrams", "trigrams", "wordcloud")}
    assert got == {"keywords": 8, "topics": 2, "bigrams": 6, "trigrams": 4, "wordcloud": 8}
    assert parts["doc_count"].first().docs == 200 and sum(r.docs for r in parts["topic_counts"].collect()) == 200
    assert read.value == 300
    sentiment = parts["sentiment"]
    assert sentiment.count() == 200 and {"id", "t", "tokens", "polarity", "label"} <= set(sentiment.columns)


def test_sentiment_stays_with_its_row(spark, rows):
    df = spark.createDataFrame([(1, "x", "excellent view"), (2, "y", None), (3, "y", "terrible")], "id int, pref string, t string")
    assert rows(tm.with_sentiment(df, "t").select("id", "label"), "id") == [(1, "Positive"), (2, "Neutral"), (3, "Negative")]
    assert rows(tm.sentiment_by(df, "t", ["pref"]), "pref", "label") == [("x", "Positive", 1), ("y", "Negative", 1), ("y", "Neutral", 1)]


def test_redaction_touches_only_its_columns(spark):
    df = spark.createDataFrame([("a@b.co", "a@b.co")], "reason string, note string")
    row = tm.redact_columns(df, ["reason", "absent"]).first()
    assert row.reason == "[REDACTED_EMAIL]" and row.note == "a@b.co"


def test_a_classifier_opens_its_model_once_a_task(spark, tmp_path):
    import json

    from demandpanel.operators import classify, satisfaction as sa
    model = {"labels": ["weather", "transport", "other"], "bias": [0, 0, 0.5], "weights": {"cold": [2, 0, 0], "bus": [0, 2, 0], "late": [0, 1, 0]}}
    (tmp_path / "model.json").write_text(json.dumps(model))
    opened = spark.sparkContext.accumulator(0)
    label = classify.from_file(spark, str(tmp_path / "model.json"), on_open=lambda: opened.add(1))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        texts = spark.createDataFrame([(i, ["cold", "late bus", "nothing", None][i % 4]) for i in range(400)], "i int, t string").repartition(3)
        got = {(r.t, r.x) for r in texts.select("t", label("t").alias("x")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got == {("cold", "weather"), ("late bus", "transport"), ("nothing", "other"), (None, None)}
    assert opened.value == 3  # three tasks of many batches each
    survey = spark.createDataFrame([(1, "cold cold", ""), (2, "", "the bus was late"), (2, "nothing", ""), (5, "cold", ""), (1, "ab", "")], "satisfaction int, reason string, freetext string")
    shares = {r.label: r.n for r in sa.complaint_drivers(survey.withColumn("id", survey.satisfaction), label, "id", labels=model["labels"]).collect()}
    assert shares == {"weather": 1, "transport": 1, "other": 1}
