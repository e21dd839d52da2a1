"""Corpus statistics over token arrays: keywords, topics, n-grams, weights, sentiment."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as tx
from ..session import staged

#: Words among which leading n-grams are looked for first.
LEADING = 2000
#: More words than this are not looked up one by one: then all n-grams are counted.
LOOKED_UP = 20_000
#: Terms whose idf goes to every task; the others' rows meet theirs in a shuffle.
FREQUENT = 100_000
#: Different n-grams a task holds before it writes their counts.
HELD = 500_000


def tokenise(df: DataFrame, text: str, out: str = "tokens", remove_stops: bool = True) -> DataFrame:
    """Add the token array of each text; blank text gives an empty array."""
    tokens = tx.tokens(text)
    return df.withColumn(out, tx.drop_stop_words(tokens) if remove_stops else tokens)


def term_frequencies(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(term, n): map-side combine keeps the shuffle to one row per term and task."""
    return df.select(F.explode(tokens).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _grams_of(words: Sequence[str], n: int):
    """Counts the n-grams made of ``words`` alone, as numbers in base ``len(words)``, batch by batch of token arrays."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base = pa.array(words, pa.string()), len(words)
        grams = times = np.empty(0, np.int64)

        def out() -> pa.RecordBatch:
            parts = [known.take(pa.array(grams // base**k % base)) for k in reversed(range(n))]
            return pa.RecordBatch.from_arrays([pc.binary_join_element_wise(*parts, " "), pa.array(times)], ["term", "n"])

        for batch in batches:
            lists = batch.column(0)
            place = pc.index_in(lists.flatten(), value_set=known).fill_null(-1).to_numpy()
            doc = pc.list_parent_indices(lists).to_numpy()
            last = max(len(place) - n + 1, 0)
            whole, gram = doc[:last] == doc[len(doc) - last:], np.zeros(last, np.int64)
            for k in range(n):
                at = place[k:k + last]
                whole, gram = whole & (at >= 0), gram * base + at
            new, often = np.unique(gram[whole], return_counts=True)
            grams, where = np.unique(np.concatenate((grams, new)), return_inverse=True)
            times = np.bincount(where, np.concatenate((times, often)), len(grams)).astype(np.int64)
            if len(grams) > HELD:
                yield out()
                grams = times = np.empty(0, np.int64)
        yield out()

    return counted


def _gram_counts(df: DataFrame, n: int, tokens: str, words: Sequence[str] | None = None) -> DataFrame:
    """(term, n) of all n-grams, with ``words`` of those made of these words alone."""
    if words is None or len(words) ** n >= 2**62:
        grams = df.select(F.explode(tx.ngrams(tokens, n)).alias("term"))
        return grams.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return df.select(tokens).mapInArrow(_grams_of(words, n), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def ngram_counts(df: DataFrame, n: int = 2, top: int = 20, tokens: str = "tokens", words: DataFrame | None = None) -> DataFrame:
    """The ``top`` most frequent n-grams of all documents, equal counts by term.

    With ``words``, the (term, n) of all tokens, only n-grams that can lead are written out. No n-gram
    is more frequent than the rarest of its words, so where T is the count of the last of ``top``
    n-grams of the LEADING words, none that has a word with a count under T is among the leading ones. If all words
    that reach T are LEADING ones, these n-grams are the answer; else those of the words that reach
    T are counted, or all if the words are too many. Each count is exact and covers every document.
    """
    def leading(counted: DataFrame) -> DataFrame:
        return counted.orderBy(F.col("n").desc(), "term").limit(top)

    if words is None:
        return leading(_gram_counts(df, n, tokens))
    frequent = words.orderBy(F.col("n").desc(), "term")
    some = [r["term"] for r in frequent.limit(LEADING).select("term").collect()]
    best = leading(_gram_counts(df, n, tokens, some)).collect()
    least = best[-1]["n"] if len(best) == top else 0
    reach = words.where(F.col("n") >= least)
    many = reach.count()
    if many <= len(some):
        return df.sparkSession.createDataFrame(best, "term string, n bigint")
    among = [r["term"] for r in reach.select("term").collect()] if many <= LOOKED_UP else None
    return leading(_gram_counts(df, n, tokens, among))


def word_weights(df: DataFrame, top: int = 150, tokens: str = "tokens", words: DataFrame | None = None) -> DataFrame:
    """The most frequent words with their count as a share of the largest count; ``words`` are their counts if known."""
    counted = term_frequencies(df, tokens) if words is None else words
    best = counted.orderBy(F.col("n").desc(), "term").limit(top)
    return best.withColumn("weight", F.col("n") / F.max("n").over(Window.partitionBy(F.lit(1))))  # at most ``top`` rows


def _term_totals(df: DataFrame, tokens: str, with_documents: bool) -> DataFrame:
    """(term, n, docs) over the corpus from one scan and one small shuffle.

    Each document is counted inside its own row. ``with_documents`` adds a NULL term counting
    the documents that have any term.
    """
    counted = tx.term_counts(tx.vector_terms(tokens))
    if with_documents:
        marker = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).cast("bigint").alias("n")))
        counted = F.concat(counted, F.when(F.size(tokens) > 0, marker).otherwise(F.slice(marker, 1, 0)))
    return (
        df.select(F.explode(counted).alias("_t")).groupBy("_t.term")
        .agg(F.sum("_t.n").alias("n"), F.count(F.lit(1)).alias("docs"))
    )


def vocabulary(df: DataFrame, size: int = 500, tokens: str = "tokens") -> DataFrame:
    """The ``size`` most frequent vector terms with their count and document count."""
    return _term_totals(df, tokens, False).orderBy(F.col("n").desc(), "term").limit(size)


def _leading_terms(df: DataFrame, size: int, tokens: str) -> tuple[list, int]:
    """At most ``size`` vocabulary rows on the driver and the number of non-empty documents."""
    order = [F.col("term").isNull().desc(), F.col("n").desc(), "term"]
    rows = _term_totals(df, tokens, True).orderBy(*order).limit(size + 1).collect()
    if not rows:
        return [], 0
    return rows[1:], rows[0]["docs"]


def counted_documents(df: DataFrame, tokens: str = "tokens") -> tuple[DataFrame, DataFrame]:
    """Documents with terms as (_d, _t), each counted once inside its own row, and (term, n, docs) of all terms; both staged."""
    counted = tx.term_counts(tx.vector_terms(tokens))
    held = staged(df.select(F.monotonically_increasing_id().alias("_d"), counted.alias("_t")).where(F.size("_t") > 0))
    each = held.select(F.explode("_t").alias("_t")).groupBy("_t.term")
    return held, staged(each.agg(F.sum("_t.n").alias("n"), F.count(F.lit(1)).alias("docs")))


def _squares(held: DataFrame, idf: DataFrame) -> DataFrame:
    """(_d, _s): the sum of squared weights of each document.

    The FREQUENT terms, most of the rows of real texts, find their idf in the task that reads them,
    and a document's sum combines there; only rows of other terms are shuffled by term.
    """
    rows = held.select("_d", F.explode("_t").alias("_p")).select("_d", F.col("_p.term").alias("term"), F.col("_p.n").alias("_n"))
    weight = F.col("_n") * F.col("_idf")
    total = F.sum(weight * weight).alias("_s")
    frequent = F.broadcast(idf.orderBy(F.col("docs").desc(), "term").limit(FREQUENT).select("term", "_idf"))
    common = rows.join(frequent, "term").groupBy("_d").agg(total)
    rare = rows.join(frequent, "term", "left_anti").join(idf.select("term", "_idf"), "term").groupBy("_d").agg(total)
    return common.unionByName(rare).groupBy("_d").agg(F.sum("_s").alias("_s"))


def _all_terms_keywords(df: DataFrame, top: int, tokens: str, counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """TF-IDF over every term: no vocabulary reaches the driver.

    Each document is counted once, inside its own row, and staged. A term's score is its idf
    times the sum of tf / norm, so only the norms need the idf of every (document, term) row;
    that join ends in one number for each document. The sums of the terms combine before their
    shuffle. The planner broadcasts the idf table or the norms only where their files are small.
    """
    held, totals = counted or counted_documents(df, tokens)
    n = held.count()
    if n < 2:
        return df.sparkSession.createDataFrame([], "term string, score double")
    idf = totals.select("term", "docs", (F.log((1 + n) / (1 + F.col("docs"))) + 1).alias("_idf"))
    norms = staged(_squares(held, idf).select("_d", F.sqrt("_s").alias("_norm")))
    parts = held.join(norms, "_d").select(F.explode("_t").alias("_p"), "_norm")
    sums = parts.groupBy(F.col("_p.term").alias("term")).agg(F.sum(F.col("_p.n") / F.col("_norm")).alias("_s"))
    scored = sums.join(idf, "term").select("term", (F.col("_s") * F.col("_idf") / n).alias("score"))
    return scored.orderBy(F.col("score").desc(), "term").limit(top)


def tfidf_keywords(df: DataFrame, top: int = 25, size: int | None = None, tokens: str = "tokens",
                   counted: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Mean TF-IDF of the leading terms: idf ln((1+n)/(1+df))+1, unit length per document.

    With ``size`` only that many most frequent terms make the vectors: they are read once;
    weighting, normalising and the mean then stay inside each document's row, with two scans
    of the texts in all. Fewer than two non-empty documents give no keywords. ``counted`` are the
    ``counted_documents`` if known.
    """
    if size is None:
        return _all_terms_keywords(df, top, tokens, counted)
    spark = df.sparkSession
    terms, n = _leading_terms(df, size, tokens)
    if n < 2 or not terms:
        return spark.createDataFrame([], "term string, score double")
    names = [r["term"] for r in terms]
    idf = Vectors.dense([_idf(n, r["docs"]) for r in terms])
    docs = df.select(tx.vector_terms(tokens).alias("_terms"))
    counts = CountVectorizerModel.from_vocabulary(names, inputCol="_terms", outputCol="_tf").transform(docs)
    weighted = ElementwiseProduct(scalingVec=idf, inputCol="_tf", outputCol="_w").transform(counts)
    unit = Normalizer(p=2.0, inputCol="_w", outputCol="_u").transform(weighted)
    # Empty documents add a zero vector, so the sum over all is the sum over the n others.
    total = unit.agg(vector_to_array(Summarizer.sum(unit["_u"])).alias("_m"))
    labels = F.array(*[F.lit(w) for w in names])
    scored = total.select(F.posexplode("_m").alias("_i", "s")).select(
        F.get(labels, F.col("_i")).alias("term"), (F.col("s") / n).alias("score"))
    return scored.orderBy(F.col("score").desc(), "term").limit(top)


def _idf(n: int, df: int) -> float:
    return math.log((1 + n) / (1 + df)) + 1


def topics(df: DataFrame, k: int = 5, top_words: int = 8, size: int = 500, seed: int = 42,
           iterations: int = 20, tokens: str = "tokens", totals: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Online LDA: (topic words and weights, dominant-topic counts).

    Texts are tokenised once: their terms are staged, counted for the vocabulary and turned into
    sparse vectors. These are staged too, a few hundredths of the texts; the fit keeps them in
    memory, every iteration reads every document, and the counts read the vectors again. Too few
    documents (< max(k, 5)) or terms (< k) give an empty first frame. With ``totals``, the (term, n) of
    all vector terms, the tokens of ``df`` are staged already and are not staged again.
    """
    spark = df.sparkSession
    schema = "topic int, words array<string>, weight double"
    held = df.select(tx.vector_terms(tokens).alias("_terms"), F.size(tokens).alias("_size"))
    # The filter follows the files: before them it would tokenise each text once more.
    docs = (staged(held) if totals is None else held).where("_size > 0").select("_terms")
    counted = term_frequencies(docs, "_terms") if totals is None else totals
    leading = counted.orderBy(F.col("n").desc(), "term").limit(size).collect()
    names = [r["term"] for r in leading]
    if len(names) < k or docs.limit(max(k, 5)).count() < max(k, 5):
        return spark.createDataFrame([], schema), None
    vectors = staged(CountVectorizerModel.from_vocabulary(names, inputCol="_terms", outputCol="features").transform(docs).select("features"))
    # A large row group leaves one file and the reader packs small ones into few tasks; the fit needs all cores.
    tasks = max(len(vectors.inputFiles()), min(4 * spark.sparkContext.defaultParallelism, vectors.count() // 1024))
    spread = vectors.repartition(tasks)
    model = LDA(k=k, maxIter=iterations, seed=seed, optimizer="online", subsamplingRate=1.0).fit(spread)
    labels = F.array(*[F.lit(w) for w in names])
    words = model.describeTopics(top_words).select(
        "topic", F.transform("termIndices", lambda i: F.get(labels, i)).alias("words"),
        F.aggregate("termWeights", F.lit(0.0), lambda acc, x: acc + x).alias("weight"),
    )
    mix = model.transform(vectors).select(vector_to_array("topicDistribution").alias("_p"))
    dominant = mix.select((F.array_position("_p", F.array_max("_p")) - 1).alias("topic"))
    return words, dominant.groupBy("topic").agg(F.count(F.lit(1)).alias("docs"))


def with_sentiment(df: DataFrame, text: str) -> DataFrame:
    """polarity, label, positive_terms and negative_terms beside the row's own key."""
    return df.withColumn("_s", tx.sentiment(text)).select(*df.columns, "_s.*")


def sentiment_by(df: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    return with_sentiment(df, text).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))


def redact_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """E-mail and phone redaction on the listed columns that exist."""
    return df.withColumns({c: tx.redact(c) for c in columns if c in df.columns})


def full_analysis(df: DataFrame, text: str, k: int = 5) -> dict[str, DataFrame]:
    """All corpus results, each its own query. Texts are tokenised once: all but the sentiment reads their staged tokens.

    Words are counted once for weights and n-grams, terms once inside each document's row for keywords and topics.
    """
    whole = df.where(F.col(text).isNotNull())
    docs = staged(tokenise(whole, text).select("tokens"))
    frequencies = staged(term_frequencies(docs))
    counted = counted_documents(docs)
    words, counts = topics(docs, k, totals=counted[1])
    return {
        "keywords": tfidf_keywords(docs, counted=counted), "topics": words, "topic_counts": counts,
        "sentiment": with_sentiment(tokenise(whole, text), text), "bigrams": ngram_counts(docs, 2, words=frequencies),
        "trigrams": ngram_counts(docs, 3, words=frequencies), "wordcloud": word_weights(docs, words=frequencies),
        "doc_count": docs.agg(F.count(F.lit(1)).alias("docs")),
    }
