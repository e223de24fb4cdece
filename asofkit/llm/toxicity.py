"""Operator 2: toxicity by multiple-instance learning with noisy-or.

Only documents carry labels. A sentence gets the logistic of a bias and its word weights; a document is toxic if any of
its sentences is, so its score is ``1 - prod(1 - sentence score)``. The weights are trained from document labels by
gradient ascent on the likelihood of that noisy-or, and afterwards each sentence has a score of its own, which locates
the offending sentences.

Features of a sentence are its distinct lower-cased words and, for each of them, its first four and five letters if it is
longer; they are known by 32-bit hashes (of the words outside the sample, one in a million at most shares a hash with a weight). The classifier is fitted on a bounded sample: ``most_labels`` labelled documents,
drawn by a hash of their id and the same at every run (default 8,000; the parameter bounds the task that fits). Every
feature of the sample takes part. The L1 prior is applied as a proximal step, so weights that the labels do not support are
exactly zero. Scoring covers every document, whole.

Defined cases: null and empty texts have no sentence and score the model's base rate for a text without sentences
(0.0); labels that are null are not learned from; several labels of one document count as the largest; without any
usable label all scores are 0; of repeated ids the smallest text is learned from. Ties cannot arise. Extra columns are kept by ``drop_toxic`` and ignored by ``score_toxicity``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import cut

MOST_LABELS = 8_000
THRESHOLD = 0.3

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")
_MEMO = 400_000  # words whose weight a task remembers; more are worked out again


def word_features(word: str) -> list[int]:
    """Hashes of the word and of its beginnings."""
    return [xxhash.xxh32_intdigest(word), *(xxhash.xxh32_intdigest(word[:k], seed=k) for k in (4, 5) if len(word) > k)]


class NoisyOr:
    """Weights of word and beginning hashes, and a bias, for the logistic score of a sentence."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias
        self.memo: dict[str, float] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "memo": {}}

    def word_weight(self, word: str) -> float:
        value = self.memo.get(word)
        if value is None:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            value = self.memo[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return value

    def sentence_sums(self, text: str) -> list[float]:
        """Bias and weights of every sentence of a lower-cased text."""
        weigh, bias = self.word_weight, self.bias
        return [sum(map(weigh, set(_WORD.findall(s))), bias) for s in _SENTENCE.findall(text)]

    def sentence_scores(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of every sentence, in code points."""
        out = []
        for m in _SENTENCE.finditer(text):
            z = sum(map(self.word_weight, set(_WORD.findall(m[0].lower()))), self.bias)
            out.append((m.start(), m.end(), float(1 / (1 + np.exp(-z)))))
        return out

    def document_score(self, text: str | None) -> float:
        """The noisy-or of all sentences."""
        sums = self.sentence_sums((text or "").lower())
        return float(-np.expm1(-np.logaddexp(0.0, sums).sum())) if sums else 0.0


def encode(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the features of all sentences in a row, how many each sentence has)."""
    flat, lengths = [], []
    for sentence in _SENTENCE.findall((text or "").lower()):
        before = len(flat)
        for word in sorted(set(_WORD.findall(sentence))):
            flat.extend(word_features(word))
        lengths.append(len(flat) - before)
    return np.asarray(flat, np.uint32), np.asarray(lengths, np.int32)


def _sums(edge: np.ndarray, source: np.ndarray, at: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Sums of ``source[at]`` between the edges, in portions that bound the temporary arrays."""
    out = np.zeros(len(edge) - 1)
    cuts = np.unique(np.append(np.searchsorted(edge, np.arange(0, len(at), step)), len(out)))
    for a, b in zip(cuts, cuts[1:]):
        if edge[b] > edge[a]:
            full = np.flatnonzero(edge[a + 1 : b + 1] > edge[a:b]) + a  # reduceat gives no 0 for an empty stretch
            out[full] = np.add.reduceat(source[at[edge[a] : edge[b]]], edge[full] - edge[a])
    return out


def fit_noisy_or(encoded: list[tuple[np.ndarray, np.ndarray]], labels: list[int], *, steps: int = 120, prior: float = 0.03) -> NoisyOr:
    """Full-batch Adam on the noisy-or likelihood with a proximal L1 step, in sparse numpy arrays. Empties ``encoded``."""
    y = np.asarray(labels, dtype=np.float64)
    if not len(y) or y.sum() == 0:
        return NoisyOr({}, -60.0)
    hashes = np.concatenate([f for f, _ in encoded])
    names = np.unique(hashes)
    feature = np.empty(len(hashes), np.int32)
    for k in range(0, len(hashes), 1 << 20):
        feature[k : k + (1 << 20)] = np.searchsorted(names, hashes[k : k + (1 << 20)])
    del hashes
    lengths = np.concatenate([n for _, n in encoded])
    by_sentence = np.concatenate(([0], np.cumsum(lengths)))
    order = np.argsort(feature, kind="stable")
    sentence = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[order]
    by_feature = np.searchsorted(feature[order], np.arange(len(names) + 1))
    del order
    document = np.repeat(np.arange(len(encoded), dtype=np.int32), [len(n) for _, n in encoded])
    encoded.clear()  # frees what is not needed any more
    l1 = l2 = max(2e-5, prior / len(y))  # a prior counts for less the more documents there are
    n_docs, n_sentences, n = len(y), len(document), len(names)
    if not n_sentences:
        return NoisyOr({}, -60.0)
    w = np.zeros(n + 1)
    w[n] = np.log(max(y.mean(), 1e-4) / max(1.0, n_sentences / n_docs) / 4)
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        z = np.clip(w[n] + _sums(by_sentence, w, feature), -40, 40)
        silent = np.bincount(document, weights=np.logaddexp(0, z), minlength=n_docs)
        pd = np.clip(-np.expm1(-silent), 1e-9, 1)
        pull = np.where(y > 0, np.minimum((1 - pd) / pd, 50.0), -1.0)
        g = pull[document] / (1 + np.exp(-z))
        grad = np.append(_sums(by_feature, g, sentence), g.sum()) / n_docs
        grad[:n] -= l2 * w[:n]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        rate = 0.12 * min(1.0, 2 * (1 - step / (steps + 1))) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w += rate * m / (1 - 0.9**step)
        w[:n] = np.sign(w[:n]) * np.maximum(np.abs(w[:n]) - rate[:n] * l1, 0)
    used = np.flatnonzero(w[:n])
    return NoisyOr(dict(zip(names[used].tolist(), w[used].tolist())), float(w[n]))


def labelled_sample(docs: DataFrame, labels: DataFrame, learn_from, most_labels: int, *, id_col: str, text_col: str, label_col: str, label_id: str) -> DataFrame:
    """At most ``most_labels`` labelled documents (text, label), chosen by a hash of the id."""
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(label_id).isNotNull() & learn_from(F.col(label_id))).groupBy(F.col(label_id).alias("__id")).agg(F.max(label_col).alias("__y"))
    chosen = usable.withColumn("__h", F.xxhash64(F.lit(7), "__id")).orderBy("__h", "__id").limit(most_labels).drop("__h")
    # broadcast: most_labels rows of two numbers
    found = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id")
    return found.groupBy("__id").agg(F.min("text").alias("text"), F.max(F.col("__y").cast("int")).alias("y"))


def train_toxicity(
    docs: DataFrame, labels: DataFrame, *, learn_from=lambda c: F.lit(True), most_labels: int = MOST_LABELS,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id: str = "doc_id",
) -> NoisyOr:
    """Fit on the bounded sample. Texts are encoded by Spark, one task fits the model, and the driver gets its weights only."""
    sample = labelled_sample(docs, labels, learn_from, most_labels, id_col=id_col, text_col=text_col, label_col=label_col, label_id=label_id)

    def encoded(batches):
        for batch in batches:
            rows = [encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("y"), *[pa.array([r[k].tobytes() for r in rows], pa.binary()) for k in (0, 1)]], ["id", "y", "f", "n"])

    def fit(batches):
        texts, y = [], []
        for batch in batches:
            texts += [(np.frombuffer(f.as_py(), np.uint32), np.frombuffer(n.as_py(), np.int32)) for f, n in zip(batch.column("f"), batch.column("n"))]
            y += batch.column("y").to_pylist()
        m = fit_noisy_or(texts, y)
        yield pa.RecordBatch.from_arrays([pa.array([list(m.weights)], pa.list_(pa.int64())), pa.array([list(m.weights.values())], pa.list_(pa.float64())), pa.array([m.bias])], ["names", "weights", "bias"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = cut(sample.select("__id", "text", "y").mapInArrow(encoded, f"id {kind}, y int, f binary, n binary"))
    # the sample is bounded, so one task holds it
    found = rows.repartition(1).sortWithinPartitions("id").mapInArrow(fit, "names array<bigint>, weights array<double>, bias double").first()
    return NoisyOr(dict(zip(found["names"], found["weights"])), found["bias"]) if found else NoisyOr({}, -60.0)


def score_toxicity(docs: DataFrame, model: NoisyOr, *, id_col: str = "doc_id", text_col: str = "text", locate: float | None = 0.3) -> DataFrame:
    """One row per document: ``doc_id, score, sentences``; sentences of at least ``locate`` as (start, end, score).

    ``locate=None`` leaves the sentences out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def score(batches):
        model = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = [model.document_score(t) for t in texts]
            where = [
                [{"start": a, "end": b, "score": p} for a, b, p in model.sentence_scores(t) if p >= locate] if locate is not None and t and s >= locate else []
                for t, s in zip(texts, scores)
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(where, span)], ["doc_id", "score", "sentences"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(score, f"doc_id {kind}, score double, sentences array<struct<start:int,end:int,score:double>>")


def drop_toxic(docs: DataFrame, model: NoisyOr, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        model = sent.value
        for batch in batches:
            yield batch.filter(pa.array([model.document_score(t) < threshold for t in batch.column(text_col).to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
