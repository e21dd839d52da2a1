"""Free text: joining, keyword hits, redaction, tokens. All JVM-side expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import fixed
from .values import any_of, col, known

# Redaction patterns and markers (fixed values).
EMAIL = r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+"
PHONE = r"(?U)\b0\d{1,4}(?:[-()\s]?\d{1,4}){1,2}\b"
EMAIL_MARK, PHONE_MARK = "[REDACTED_EMAIL]", "[REDACTED_PHONE]"

# Token patterns (fixed values).
CJK_RUN = "[\\u4e00-\\u9fff\\u3040-\\u309f\\u30a0-\\u30ff]{2,}"
LATIN_WORD = "[a-zA-Z]{3,}"
WORD = r"[\p{L}\p{N}_]+"


def stripped(text: Column | str) -> Column:
    """Text without white space (of any script) at either end."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def is_blank(text: Column | str) -> Column:
    """NULL, empty or only white space."""
    return ~known(col(text).rlike(r"(?U)\S"))


def join_with_spaces(*parts: Column | str) -> Column:
    """Parts joined by single spaces, a missing part as the empty text."""
    return F.concat_ws(" ", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])


def join_non_empty(parts: Sequence[Column | str], separator: str = "。") -> Column:
    """Non-blank parts joined; NULL when all are blank."""
    texts = F.array(*[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])
    kept = F.filter(texts, lambda s: ~is_blank(s))
    return F.nullif(F.array_join(kept, separator), F.lit(""))


def contains_any(text: Column | str, keywords: Sequence[str]) -> Column:
    """True if any keyword occurs as a substring; keywords are literals, not patterns."""
    t = col(text)
    return known(any_of([t.contains(k) for k in keywords]))


def first_keyword(text: Column | str, keywords: Sequence[str]) -> Column:
    """First keyword of the list found in the text, else NULL."""
    t = col(text)
    return F.coalesce(*[F.when(t.contains(k), F.lit(k)) for k in keywords])


def matches_any_column(columns: Sequence[Column | str], pattern: str) -> Column:
    """True if the pattern is found in at least one of the columns."""
    return any_of([known(col(c).cast("string").rlike(pattern)) for c in columns])


def redact(text: Column | str) -> Column:
    """E-mail addresses, then phone numbers, replaced by markers; blank text unchanged."""
    t = col(text)
    cleaned = F.regexp_replace(F.regexp_replace(t, EMAIL, EMAIL_MARK), PHONE, PHONE_MARK)
    return F.when(is_blank(t), t).otherwise(cleaned)


def tokens(text: Column | str) -> Column:
    """Han/kana runs of two or more, then Latin words of three or more in lower case."""
    t = F.coalesce(col(text), F.lit(""))
    cjk = F.regexp_extract_all(t, F.lit(CJK_RUN), F.lit(0))
    latin = F.transform(F.regexp_extract_all(t, F.lit(LATIN_WORD), F.lit(0)), lambda w: F.lower(w))
    return F.concat(cjk, latin)


def drop_stop_words(tokens_: Column | str, stop_words: Sequence[str] = fixed.STOP_WORDS) -> Column:
    """Tokens without stop words, duplicates kept."""
    return F.filter(col(tokens_), lambda t: ~t.isin(*stop_words))


def vector_terms(tokens_: Column | str) -> Column:
    """Tokens split again at characters that are neither letters nor digits.

    Only kana runs can hold such characters; documents without them keep their tokens.
    """
    joined = F.array_join(col(tokens_), " ")
    resplit = F.regexp_extract_all(joined, F.lit(WORD), F.lit(0))
    return F.when(joined.rlike(r"[^\p{L}\p{N}_ ]"), resplit).otherwise(col(tokens_))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` (a one-element transform)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def term_counts(tokens_: Column | str) -> Column:
    """ARRAY<STRUCT<term, n>> of one document, counted inside its own row.

    Sort, find where each run of equal terms ends, subtract neighbouring ends: the
    document is never exploded and regrouped, so nothing is shuffled per document.
    """
    def ends_of(s: Column) -> Column:
        last = F.size(s)
        return F.filter(
            F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
            lambda i: (last > 0) & ((i == last) | (F.get(s, i - 1) != F.get(s, i))),
        )

    def runs(s: Column) -> Column:
        return _let(ends_of(s), lambda ends: F.transform(
            ends,
            lambda e, k: F.struct(
                F.get(s, e - 1).alias("term"),
                (e - F.coalesce(F.get(ends, k - 1), F.lit(0))).cast("bigint").alias("n"),
            ),
        ))

    return _let(F.sort_array(col(tokens_)), runs)


def ngrams(tokens_: Column | str, n: int) -> Column:
    """Space-joined runs of ``n`` neighbouring tokens."""
    def runs(t: Column) -> Column:
        joined = F.transform(t, lambda x, i: F.concat_ws(" ", x, *[F.get(t, i + k) for k in range(1, n)]))
        return F.slice(joined, F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(0)))

    return _let(col(tokens_), runs)


def _matched(tokens_: Column, lexicon: dict[str, float], positive: bool) -> Column:
    words = [w for w, v in lexicon.items() if (v > 0) == positive]
    return F.filter(tokens_, lambda t: t.isin(*words))


def sentiment(text: Column | str, lexicon: dict[str, float] = fixed.SENTIMENT_LEXICON,
              digits: int | None = 3) -> Column:
    """STRUCT<polarity, label, positive_terms, negative_terms> of one text.

    The score is the sum of the matched weights over the token count; stop words count.
    The label is taken before rounding.
    """
    by_weight: dict[float, list[str]] = {}
    for word, weight in lexicon.items():
        by_weight.setdefault(weight, []).append(word)

    def weight_of(token: Column) -> Column:
        out = None
        for weight, words in by_weight.items():
            hit = token.isin(*words)
            out = F.when(hit, F.lit(weight)) if out is None else out.when(hit, F.lit(weight))
        return F.coalesce(out, F.lit(0.0))

    def score(z: Column) -> Column:
        hits = z["hits"]
        total = F.aggregate(hits, F.lit(0.0), lambda acc, x: acc + weight_of(x))
        polarity = total / F.greatest(z["size"], F.lit(1))
        return F.struct(
            (polarity if digits is None else F.bround(polarity, digits)).alias("polarity"),
            F.when(polarity > 0.1, "Positive").when(polarity < -0.1, "Negative")
            .otherwise("Neutral").alias("label"),
            _matched(hits, lexicon, True).alias("positive_terms"),
            _matched(hits, lexicon, False).alias("negative_terms"),
        )

    def hits_of(t: Column) -> Column:
        # Few tokens are in the lexicon: find them once, weigh only those.
        return F.struct(F.size(t).alias("size"), F.filter(t, lambda x: x.isin(*lexicon)).alias("hits"))

    return _let(_let(tokens(text), hits_of), score)
