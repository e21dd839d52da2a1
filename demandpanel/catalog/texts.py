"""Free text: tokens, redaction, keywords, n-grams, sentiment, topics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text as tx
from ..operators import textmining as tm
from . import standins as st
from .registry import q6, r6, register, rounded

_STOPS = ", ".join(f"'{w}'" for w in fixed.STOP_WORDS_EN)
_TOKENS = "list_transform(regexp_extract_all(text, '[a-zA-Z]{3,}'), lambda x: lower(x))"
DOCS = f"docs AS MATERIALIZED (SELECT doc_id, lang, text, list_filter({_TOKENS}, lambda x: x NOT IN ({_STOPS})) AS toks FROM documents)"


def docs(spark, folder):
    d = st.table(spark, folder, "documents").select("doc_id", "lang", "text")
    return tm.tokenise(d, "text")


@register("text_tokens", f"WITH {DOCS} SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens, array_to_string(toks, ' ') AS joined FROM docs")
def text_tokens(spark, folder):
    return docs(spark, folder).select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.array_join("tokens", " ").alias("joined"))


_REDACT = "regexp_replace(regexp_replace({c}, '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+', '[REDACTED_EMAIL]', 'g'), '\\b0\\d{{1,4}}(?:[-()\\s]?\\d{{1,4}}){{1,2}}\\b', '[REDACTED_PHONE]', 'g')"


@register("text_redaction", f"""SELECT doc_id AS id, 'document' AS kind, CAST(length({_REDACT.format(c='text')}) AS BIGINT) AS chars, md5({_REDACT.format(c='text')}) AS digest FROM documents
    UNION ALL SELECT conv_id * 1000 + turn, 'turn', length({_REDACT.format(c='text')}), md5({_REDACT.format(c='text')}) FROM conversations""")
def text_redaction(spark, folder):
    d = tm.redact_columns(st.table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"), ["text"]).withColumn("kind", F.lit("document"))
    c = st.table(spark, folder, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    both = d.unionByName(tm.redact_columns(c, ["text", "absent"]).withColumn("kind", F.lit("turn")))
    return both.select("id", "kind", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


_KW = ("ering", "ment", "ung", "xqz")


@register("keyword_hits", "SELECT doc_id, " + "(" + " OR ".join(f"contains(text, '{k}')" for k in _KW) + ") AS hit, CASE "
          + " ".join(f"WHEN contains(text, '{k}') THEN '{k}'" for k in _KW) + " END AS keyword FROM documents")
def keyword_hits(spark, folder):
    return st.table(spark, folder, "documents").select("doc_id", tx.contains_any("text", _KW).alias("hit"), tx.first_keyword("text", _KW).alias("keyword"))


@register("text_any_column_match", "SELECT doc_id, (regexp_matches(lang, 'fr|de') OR regexp_matches(source, 'src1$')) AS hit FROM documents")
def text_any_column_match(spark, folder):
    return st.table(spark, folder, "documents").select("doc_id", tx.matches_any_column(["lang", "source"], "fr|de|src1$").alias("hit"))


@register("word_weights", f"""WITH {DOCS}, c AS (SELECT unnest(toks) AS term FROM docs), g AS (SELECT term, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, term LIMIT 150)
    SELECT term, n, {q6('n * 1.0::DOUBLE / max(n) OVER ()')} AS weight FROM g""")
def word_weights(spark, folder):
    return rounded(tm.word_weights(docs(spark, folder)))


def _grams(n: int) -> str:
    gram = "array_to_string(toks[i:i + " + str(n - 1) + "], ' ')"
    return f"""WITH {DOCS}, g AS (SELECT unnest([{gram} FOR i IN range(1, len(toks) - {n - 2})]) AS term FROM docs WHERE len(toks) >= {n})
    SELECT term, count(*) AS n FROM g GROUP BY 1 ORDER BY n DESC, term LIMIT 20"""


@register("bigram_counts", _grams(2))
def bigram_counts(spark, folder):
    return tm.ngram_counts(docs(spark, folder), 2)


@register("trigram_counts", _grams(3))
def trigram_counts(spark, folder):
    return tm.ngram_counts(docs(spark, folder), 3)


_VOCAB = f"""{DOCS}, tf AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM docs) GROUP BY 1, 2),
    vocab AS (SELECT term, CAST(sum(tf) AS BIGINT) AS n, count(*) AS docs FROM tf GROUP BY 1 ORDER BY n DESC, term LIMIT 500)"""


@register("tfidf_vocabulary", f"WITH {_VOCAB} SELECT term, n, docs FROM vocab")
def tfidf_vocabulary(spark, folder):
    return tm.vocabulary(docs(spark, folder))


def _tfidf_sql(vocabulary: str) -> str:
    return f"""WITH {vocabulary}, nd AS (SELECT count(*) AS n FROM docs WHERE len(toks) > 0),
    w AS (SELECT doc_id, tf.term, tf * (ln((1 + nd.n) / (1.0 + vocab.docs)) + 1) AS w FROM tf JOIN vocab USING (term), nd),
    u AS (SELECT term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS u FROM w)
    SELECT term, {q6('sum(u) / (SELECT n FROM nd)')} AS score FROM u GROUP BY 1 ORDER BY sum(u) DESC, term LIMIT 25"""


@register("tfidf_keywords", _tfidf_sql(_VOCAB.replace(" LIMIT 500", "")))
def tfidf_keywords(spark, folder):
    return rounded(tm.tfidf_keywords(docs(spark, folder)))


@register("tfidf_keywords_500", _tfidf_sql(_VOCAB))
def tfidf_keywords_500(spark, folder):
    return rounded(tm.tfidf_keywords(docs(spark, folder), size=500))


@register("topic_words")
def topic_words(spark, folder):
    words, _ = tm.topics(docs(spark, folder), k=5, iterations=20)
    return rounded(words.withColumn("words", F.array_join("words", " ")))


@register("topic_document_counts")
def topic_document_counts(spark, folder):
    _, counts = tm.topics(docs(spark, folder), k=5, iterations=20)
    return rounded(counts)


# The invented words get weights here; the lexicon is the caller's.
LEXICON = {"ering": 0.8, "thaner": 0.6, "ndernt": -0.7, "eaux": 1.0, "ment": -0.5, "nicht": -0.9, "und": 0.4, "que": -0.4, "ing": 0.9, "erent": -0.6}
_WEIGHT = "CASE x " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in LEXICON.items()) + " ELSE 0.0::DOUBLE END"
_POS = ", ".join(f"'{k}'" for k, v in LEXICON.items() if v > 0)
_NEG = ", ".join(f"'{k}'" for k, v in LEXICON.items() if v < 0)
_SENT = f"""sent AS (SELECT doc_id, lang, t, coalesce(list_sum(list_transform(t, lambda x: {_WEIGHT})), 0) / greatest(len(t), 1) AS p
    FROM (SELECT doc_id, lang, {_TOKENS} AS t FROM documents))"""
_LABEL = "CASE WHEN p > 0.1 THEN 'Positive' WHEN p < -0.1 THEN 'Negative' ELSE 'Neutral' END"


@register("text_sentiment", f"""WITH {_SENT} SELECT doc_id, {q6('p', 4)} AS polarity, {_LABEL} AS label,
    array_to_string(list_filter(t, lambda x: x IN ({_POS})), ' ') AS positive, array_to_string(list_filter(t, lambda x: x IN ({_NEG})), ' ') AS negative FROM sent""")
def text_sentiment(spark, folder):
    d = st.table(spark, folder, "documents").select("doc_id", "text")
    s = d.withColumn("s", tx.sentiment("text", LEXICON, digits=None))
    return s.select("doc_id", r6("s.polarity", 4).alias("polarity"), "s.label", F.array_join("s.positive_terms", " ").alias("positive"),
                    F.array_join("s.negative_terms", " ").alias("negative"))


_FIXED = "CASE x " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in fixed.SENTIMENT_LEXICON.items()) + " ELSE 0.0::DOUBLE END"


@register("text_sentiment_fixed_lexicon", f"""WITH sent AS (SELECT doc_id, coalesce(list_sum(list_transform(t, lambda x: {_FIXED})), 0) / greatest(len(t), 1) AS p
    FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)) SELECT doc_id, round_even(p, 3) AS polarity, {_LABEL} AS label FROM sent""")
def text_sentiment_fixed_lexicon(spark, folder):
    """The built-in tourism lexicon; its words are rare in the invented texts, so more cases sit in tests."""
    return tm.with_sentiment(st.table(spark, folder, "documents").select("doc_id", "text"), "text").select("doc_id", "polarity", "label")


@register("sentiment_by_language", f"WITH {_SENT} SELECT lang, {_LABEL} AS label, count(*) AS n FROM sent GROUP BY 1, 2")
def sentiment_by_language(spark, folder):
    d = st.table(spark, folder, "documents").withColumn("s", tx.sentiment("text", LEXICON))
    return d.groupBy("lang", F.col("s.label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("text_full_analysis", f"""WITH {DOCS} SELECT 'doc_count' AS part, count(*) AS n FROM docs UNION ALL SELECT 'keywords', 25 UNION ALL SELECT 'bigrams', 20
    UNION ALL SELECT 'trigrams', 20 UNION ALL SELECT 'wordcloud', 150 UNION ALL SELECT 'sentiment', count(*) FROM docs UNION ALL SELECT 'topics', 5""")
def text_full_analysis(spark, folder):
    parts = tm.full_analysis(st.table(spark, folder, "documents").select("doc_id", "text"), "text")
    out = parts["doc_count"].select(F.lit("doc_count").alias("part"), F.col("docs").alias("n"))
    for name in ("keywords", "bigrams", "trigrams", "wordcloud", "sentiment", "topics"):
        out = out.unionByName(parts[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n"))
    return out
