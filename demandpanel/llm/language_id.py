"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies come from all labelled documents. The weights are fitted by
follow-the-regularised-leader with elastic-net penalties (McMahan et al., 2013)
in one task, on a sample bounded by PER_LANGUAGE distinct texts of each label, drawn
by a hash of the text, one at least; copies count once in it; a fifth of it sets the temperature. Predicting is a map
over whole texts, without a shuffle.

``identified`` also rejects texts that are in none of the learned languages. A
text's evidence is its surprise: the mean -log probability of its n-grams, each in
the label of the sample where it is likeliest (a text may mix learned languages),
once over all n-grams and once over the distinct ones (a text may repeat an odd
word). The bounds are set for each label and band of n-gram count from the sample
itself, whole texts and pieces of them, each without its own counts: above the
median by SLACK times what all but TAIL of them reach. A text goes that exceeds
both. Where too few texts tell, nothing is rejected.

Defined results: null text, text without a letter, and every text when nothing
could be learned, is ``und`` with score 0; null labels are not learned from;
ties go to the label first in order; equal texts get equal results; texts are
never cut; empty input gives an empty result; other columns pass through ``identified``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


UNKNOWN = "und"
#: Hashed n-grams of one to ORDERS characters.
BUCKETS, ORDERS = 1 << 14, 3
#: Sampled distinct texts of a label, at most about so many.
PER_LANGUAGE = 1500
#: Follow-the-regularised-leader: learning rate, its offset, and the two penalties.
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.05, 0.05, 3
#: Pseudo count of a bucket in a label's n-grams, share of the labelled texts above the quantile, how far beyond it the bound is, texts that a bound needs.
PSEUDO, TAIL, SLACK, NEEDED = 0.05, 0.005, 2.0, 10
#: Letters of the pieces that stand for short texts, and bands of n-gram counts (powers of two).
PIECES, BANDS = (8, 16, 32, 64, 128, 256, 512), 32
_STEP = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
_SLICE = 128


@cache
def _letters() -> np.ndarray:
    """Code point → its lower-case letter, 0 for all that is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse counts of hashed n-grams: (text, bucket, count), by text; a run of non-letters after a letter, and a text's end, is one blank."""
    points = np.frombuffer("".join([(t or "") + "\x00" for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t or "") for t in texts])
    owner = np.repeat(np.arange(len(texts)), lengths + 1)
    low = _letters()[points]
    keep = (low > 0) | np.concatenate(([False], low[:-1] > 0)) if len(low) else np.zeros(0, bool)
    low, owner = low[keep], owner[keep]
    totals = np.zeros(len(texts) * BUCKETS, np.int32)
    rolled = np.zeros(len(low), np.uint32)
    for n in range(min(ORDERS, len(low))):
        size = len(low) - n
        rolled = rolled[:size] * _STEP[0] + (low[n:] + np.uint32(n)) * _STEP[1]
        spread = (rolled ^ (rolled >> np.uint32(15))) * _STEP[2]
        bucket = (spread >> np.uint32(32 - 14)).astype(np.int64)
        inside = (owner[:size] == owner[n:]) & (low[:size] > 0 if n == 0 else True)
        totals += np.bincount((owner[:size] * BUCKETS + bucket)[inside], minlength=len(totals)).astype(np.int32)
    found = np.flatnonzero(totals)
    return found // BUCKETS, found % BUCKETS, totals[found]


def _pieces(texts: list[str | None], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and (held + len(t or "") > most or i - start >= _SLICE):
            yield start, i
            start, held = i, 0
        held += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def _weighted(texts: list[str | None], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit-length TF-IDF rows as (text, bucket, value)."""
    row, bucket, count = ngrams(texts)
    return row, bucket, _unit(row, bucket, count, len(texts), idf)


def _unit(row, bucket, count, rows: int, idf: np.ndarray) -> np.ndarray:
    value = (1 + np.log(count)) * idf[bucket]
    norm = np.sqrt(np.bincount(row, value * value, rows))
    return value / np.maximum(norm, 1e-12)[row]


def _band(size) -> np.ndarray:
    """Band of an n-gram count."""
    return np.minimum(np.log2(np.maximum(size, 1)).astype(np.int64), BANDS - 1)


@dataclass
class Model:
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    #: Of each bucket and label, -log probability; of each label, the most surprise of a text in a learned language: by band over all n-grams, then by band over distinct ones.
    surprise: np.ndarray | None = None
    bounds: np.ndarray | None = None

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Label and calibrated probability of each text."""
        labels, scores, _ = self.judge(texts, False)
        return labels, scores

    def judge(self, texts: list[str | None], bounded: bool = True) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Label and calibrated probability of each text, and whether it is in a learned language."""
        labels, scores, within = [], [np.zeros(0)], [np.zeros(0, bool)]
        for start, end in _pieces(texts):
            part = texts[start:end]
            if not self.labels:
                labels += [UNKNOWN] * len(part)
                scores.append(np.zeros(len(part)))
                within.append(np.zeros(len(part), bool))
                continue
            row, bucket, count = ngrams(part)
            value = _unit(row, bucket, count, len(part), self.idf)
            p = _softmax(_logits(row, bucket, value, len(part), self.weights, self.bias) / self.temperature)
            size = np.bincount(row, count, len(part))
            best, known = p.argmax(axis=1), size > 0
            labels += [self.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            scores.append(np.where(known, p.max(axis=1), 0.0))
            if bounded and self.bounds is not None:
                least, distinct = self.surprise.min(axis=1)[bucket], np.bincount(row, minlength=len(part))
                every = np.bincount(row, least * count, len(part)) / np.maximum(size, 1)
                once = np.bincount(row, least, len(part)) / np.maximum(distinct, 1)
                within.append(known & ((every <= self.bounds[best, _band(size)]) | (once <= self.bounds[best, BANDS + _band(distinct)])))
            else:
                within.append(known)
        return labels, np.concatenate(scores), np.concatenate(within)


def _logits(row, bucket, value, rows: int, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(row, value * weights[bucket, c], rows) for c in range(weights.shape[1])], axis=1) + bias


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Leader:
    """Follow-the-regularised-leader, one coordinate per (bucket, label)."""

    def __init__(self, shape):
        self.z, self.n = np.zeros(shape), np.zeros(shape)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at, gradient: np.ndarray, weights: np.ndarray) -> None:
        squared = gradient * gradient
        self.z[at] += gradient - (np.sqrt(self.n[at] + squared) - np.sqrt(self.n[at])) / ALPHA * weights
        self.n[at] += squared


def fit(texts: list[str], labels: list[str], held: np.ndarray, idf: np.ndarray, seed: int = 7) -> Model:
    """Weights from the texts not held, temperature from the held ones."""
    names = sorted(set(labels))
    y = np.array([names.index(label) for label in labels])
    lead, base = Leader((BUCKETS, len(names))), Leader((1, len(names)))
    rows = [_weighted([t], idf)[1:] for t in texts]
    rng = np.random.default_rng(seed)
    order = np.flatnonzero(~held)
    for _ in range(EPOCHS):
        for i in rng.permutation(order):
            bucket, value = rows[i]
            w, b = lead.weights(bucket), base.weights()
            error = _softmax(value @ w + b[0])
            error[y[i]] -= 1
            lead.learn(bucket, value[:, None] * error, w)
            base.learn(slice(None), error[None, :], b)
    weights, bias = lead.weights(), base.weights()[0]
    check = np.flatnonzero(held) if held.any() else order
    logits = np.array([value_bucket[1] @ weights[value_bucket[0]] + bias for value_bucket in (rows[i] for i in check)]).reshape(len(check), len(names))
    model = Model(names, idf, weights, bias, _temperature(logits, y[check]))
    model.surprise, model.bounds = _typical(model, texts, y)
    return model


def _typical(model: Model, texts: list[str], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Surprise of each (bucket, label), and the two bounds of each (label, band), each text and its pieces judged without its own counts."""
    names = len(model.labels)
    grams = [ngrams([t])[1:] for t in texts]
    counts = np.zeros((BUCKETS, names))
    for (bucket, count), label in zip(grams, y, strict=True):
        counts[bucket, label] += count
    totals = counts.sum(axis=0)
    seen: list[list[list[float]]] = [[[] for _ in range(2 * BANDS)] for _ in range(names)]
    for i, (text, label) in enumerate(zip(texts, y, strict=True)):
        own, own_count = grams[i]
        others = np.zeros(BUCKETS)
        others[own] = own_count
        sizes = (PIECES[i % len(PIECES)], PIECES[(i + 3) % len(PIECES)])
        start = i * 97 % max(1, len(text) - max(sizes) + 1)
        for bucket, count in [grams[i], *(ngrams([text[start:start + n]])[1:] for n in sizes if n < len(text))]:
            if not len(bucket):
                continue
            size = count.sum()
            held, total = counts[bucket].copy(), totals.copy()
            held[:, label] -= others[bucket]
            total[label] -= own_count.sum()
            least = -np.log(((held + PSEUDO) / (total + PSEUDO * BUCKETS)).max(axis=1))
            seen[label][_band(size)].append(float(count @ least / size))
            seen[label][BANDS + _band(len(bucket))].append(float(least.mean()))
    bounds = np.full((names, 2 * BANDS), np.inf)
    for label in range(names):
        for at in range(2 * BANDS):
            first, band = at - at % BANDS, at % BANDS
            near = [x for b in range(max(0, band - 1), min(BANDS, band + 2)) for x in seen[label][first + b]]
            if len(near) >= NEEDED:
                middle, high = np.quantile(near, (0.5, 1 - TAIL), method="higher")
                bounds[label, at] = middle + SLACK * (high - middle)
            elif band:
                bounds[label, at] = bounds[label, at - 1]
    return -np.log((counts + PSEUDO) / (totals + PSEUDO * BUCKETS)), bounds


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least cross entropy, by golden-section search over its logarithm.

    Targets are smoothed as Platt (1999) does, by one unseen error, so a faultless
    check set doesn't make the model certain.
    """
    rows, names = logits.shape
    if not rows or names < 2:
        return 1.0
    target = np.full((rows, names), 1 / (rows + 2) / (names - 1))
    target[np.arange(rows), y] = (rows + 1) / (rows + 2)

    def loss(log_t: float) -> float:
        x = logits / np.exp(log_t)
        top = x.max(axis=1, keepdims=True)
        return float(-np.mean((target * (x - top - np.log(np.exp(x - top).sum(axis=1, keepdims=True)))).sum(axis=1)))

    low, high, ratio = np.log(0.05), np.log(10.0), (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of one partition that hold each bucket; bucket -1 counts the documents."""
    held, documents = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        texts = batch.column(0).to_pylist()
        documents += len(texts)
        for start, end in _pieces(texts):
            held += np.bincount(ngrams(texts[start:end])[1], minlength=BUCKETS)
    some = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(held[some], documents))], ["bucket", "n"])


def is_held_out(id_col: str = "doc_id") -> Column:
    """Documents that are never learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from every labelled row that isn't held out; bounded tables (buckets, labels, weights) reach the driver."""
    known = docs.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull() & ~is_held_out(id_col)).select(
        F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    counted = known.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    documents = int(counted.loc[counted["bucket"] == -1, "n"].sum())
    idf = np.full(BUCKETS, np.log(1.0 + documents) + 1)
    seen = counted[counted["bucket"] >= 0]
    idf[seen["bucket"].to_numpy()] = np.log((1.0 + documents) / (1.0 + seen["n"].to_numpy())) + 1
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / (1 << 30)
    distinct = known.select("label", F.xxhash64("text").alias("hash"), place.alias("place")).distinct()
    sizes = {r["label"]: r for r in distinct.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("lowest")).collect()}
    nothing = Model([], idf, np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    if not sizes:
        return nothing
    share = F.lit(-1.0)
    for label, r in sizes.items():
        # The text placed lowest is always in, so no label is without one.
        share = F.when(F.col("label") == label, max(min(1.0, per_language / r["n"]), r["lowest"])).otherwise(share)
    sample = known.filter(place <= share).groupBy("label", F.xxhash64("text").alias("hash")).agg(F.min("text").alias("text")).select(
        "label", "text", (F.pmod(F.xxhash64("text", F.lit(1)), F.lit(5)) == 0).alias("held"))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["label", "text"], kind="stable")
        # A label whose texts are all held would not be learned.
        held = frame["held"] & ~frame.groupby("label")["held"].transform("all")
        m = fit(frame["text"].tolist(), frame["label"].tolist(), held.to_numpy(bool), idf)
        return pd.DataFrame({"label": m.labels, "bias": m.bias, "temperature": m.temperature, "weights": [w.tobytes() for w in m.weights.T],
                             "surprise": [w.tobytes() for w in m.surprise.T], "bounds": [w.tobytes() for w in m.bounds]})

    rows = sample.withColumn("all", F.lit(True)).groupBy("all").applyInPandas(
        learn, "label string, bias double, temperature double, weights binary, surprise binary, bounds binary").toPandas()
    if rows.empty:
        return nothing
    rows = rows.sort_values("label")
    weights, surprise, bounds = (np.stack([np.frombuffer(w) for w in rows[c]]) for c in ("weights", "surprise", "bounds"))
    return Model(rows["label"].tolist(), idf, weights.T, rows["bias"].to_numpy(), float(rows["temperature"].iloc[0]), surprise.T, bounds)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; only the text enters the prediction."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = shared.value.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(labels, pa.string()), pa.array(scores)],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), is_held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identified(docs: DataFrame, model: Model, least: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is a learned one, with at least ``least`` probability, unchanged.

    Texts without a letter go, and texts more surprising than the labelled ones of their label and size.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores, within = shared.value.judge(batch.column(at).to_pylist())
            yield batch.filter(pa.array([a != UNKNOWN and w and s >= least for a, s, w in zip(labels, scores, within, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
