"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence scores sigmoid(bias + sum of its words' weights); the
document scores by noisy-or, 1 - prod(1 - sentence score).  Word and bias weights are trained from
document labels alone, by gradient descent on the document's log loss; the sentence scores then
locate the sentences that offend.

The fit uses at most features.MAX_TRAIN_ROWS labelled rows (a documented bound); every row is scored
on its whole text, however long.  Null and empty texts have no sentence and score 0; repeated rows are scored each;
of sentences that score alike the first is the worst; empty tables give empty results; a corpus without labels gives score 0 to
all; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as tx
from .features import VIEWS, Vocabulary, held_out, training_rows

BITS = 18


class Model:
    """Weights of hashed word features, and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(logit of every sentence, offsets of the texts in them)."""
        v = Vocabulary(texts, BITS)
        score = np.where(v.is_word, self.weights[v.features].sum(1), 0.0)
        off, text_off = v.sentences()
        return tx.segments(np.add, score[v.code], off, 0.0) + self.bias, text_off

    def score(self, texts: pa.Array) -> np.ndarray:
        z, off = self.logits(texts)
        clean = tx.segments(np.add, -np.logaddexp(0, z), off, 0.0)  # log prod(1 - sigmoid)
        return -np.expm1(clean)


def _parts(texts: list[str], size: int = 400):
    """(place of the first, vocabulary) of runs of the texts, so that memory does not grow with their number."""
    for i in range(0, len(texts), size):
        yield i, Vocabulary(pa.array(texts[i : i + size], pa.large_string()), BITS)


def fit(texts: list[str], y: np.ndarray, epochs: int = 80, rate: float = 0.1, l2: float = 1e-5, sure: float = 4.0) -> Model:
    """Full-batch Adam on the noisy-or log loss, from the log odds of the features that stand in more toxic
    training documents than chance puts there, by `sure` standard deviations; other features weigh nothing."""
    weights = np.zeros(1 << BITS)
    if not len(y) or y.min() == y.max():
        return Model(weights, -60.0 if not len(y) or y.max() == 0 else 0.0)
    with_it, without = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for first, v in _parts(texts):
        text = np.repeat(np.arange(len(v.off) - 1), np.diff(v.off))
        keep = v.is_word[v.code]
        pairs = np.unique(text[keep] * len(v.raw) + v.code[keep])
        owner, word = pairs // len(v.raw), pairs % len(v.raw)
        held = np.unique((owner[:, None] << BITS) | v.features[word])
        toxic = y[first + (held >> BITS)] == 1
        feature = held & ((1 << BITS) - 1)
        with_it += np.bincount(feature[toxic], minlength=1 << BITS)
        without += np.bincount(feature[~toxic], minlength=1 << BITS)
    share, seen = y.mean(), with_it + without
    used = with_it - seen * share > sure * np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    used &= with_it >= 3
    odds = np.log((with_it + 0.1) / (y.sum() + 0.2)) - np.log((without + 0.1) / (len(y) - y.sum() + 0.2))
    # only words with a feature in use take part from here on
    codes, sentences, owners, views, n_words, n_sent = [], [], [], [], 0, 0
    for first, v in _parts(texts):
        off, text_off = v.sentences()
        live = v.is_word & used[v.features].any(1)
        place = np.cumsum(live) - 1 + n_words
        at = np.flatnonzero(live[v.code])
        codes.append(place[v.code[at]])
        sentences.append(np.searchsorted(off, at, side="right") - 1 + n_sent)
        owners.append(first + np.repeat(np.arange(len(text_off) - 1), np.diff(text_off)))
        views.append(v.features[live])
        n_words += int(live.sum())
        n_sent += len(off) - 1
    code, sentence, text, local = (np.concatenate(x) for x in (codes, sentences, owners, views))
    slots, local = np.unique(local, return_inverse=True)
    local = local.reshape(-1, len(VIEWS))
    used = used[slots]
    w, b = np.where(used, odds[slots] / len(VIEWS), 0.0), -6.0
    m, s, mb, sb = np.zeros(len(slots)), np.zeros(len(slots)), 0.0, 0.0
    for t in range(1, epochs + 1):
        word = w[local].sum(1)
        z = np.bincount(sentence, word[code], n_sent) + b
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        clean = np.bincount(text, -np.logaddexp(0, z), len(y))
        doc = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
        # d loss / d z of sentence j: p_j for clean documents, -p_j (1 - doc) / doc for toxic ones
        g_doc = np.where(y == 1, -(1 - doc) / doc, 1.0)
        g = p * g_doc[text]
        g_word = np.bincount(code, g[sentence], n_words)
        gw = np.bincount(local.ravel(), np.repeat(g_word, local.shape[1]), len(slots)) / len(y) + l2 * w
        gb = g.sum() / len(y)
        m, s = 0.9 * m + 0.1 * gw, 0.99 * s + 0.01 * gw**2
        mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb**2
        w -= used * rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        b -= 0.05 * (mb / (1 - 0.9**t)) / (np.sqrt(sb / (1 - 0.99**t)) + 1e-8)
    weights[slots] = w
    return Model(weights, float(b))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*training_rows(docs, labels, "toxic"))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending (how many sentences score at least the threshold by themselves) and
    worst_sentence (the place of the one with the highest score, -1 if there is none) of every row of docs(doc_id, text)."""
    weights, bias = model.weights.astype(np.float32), model.bias

    @tx.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(weights.astype(np.float64), bias)
        for batch in batches:
            for part in tx.chunks(batch, "text"):
                z, off = m.logits(tx.column(part, "text"))
                clean = tx.segments(np.add, -np.logaddexp(0, z), off, 0.0)
                score = np.clip(-np.expm1(clean), 0.0, 1.0)
                bad = tx.segments(np.add, (z >= np.log(threshold / (1 - threshold))).astype(np.int64), off, 0)
                top = tx.segments(np.maximum, z, off, -np.inf)
                worst = np.full(len(score), -1, np.int64)
                at_top = np.flatnonzero(z == np.repeat(top, np.diff(off)))[::-1]
                text = np.repeat(np.arange(len(score)), np.diff(off))
                worst[text[at_top]] = at_top - off[:-1][text[at_top]]
                cols = [part.column(0), part.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(bad), pa.array(worst)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted", "n_offending", "worst_sentence"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = rows.withColumn("held_out", held_out(rows["doc_id"]))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_offending long, worst_sentence long")


def offending_sentences(model: Model, text: str, threshold: float = 0.5) -> list[tuple[int, float]]:
    """(index, score) of the sentences of one text that score at least the threshold."""
    z, _ = model.logits(pa.array([text or ""], pa.large_string()))
    p = 1 / (1 + np.exp(-z))
    return [(i, float(x)) for i, x in enumerate(p) if x >= threshold]


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score below the threshold, all columns kept."""
    names = docs.columns
    weights, bias = model.weights.astype(np.float32), model.bias

    @tx.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(weights.astype(np.float64), bias)
        for batch in batches:
            for part in tx.chunks(batch, "text"):
                yield part.filter(pa.array(m.score(tx.column(part, "text")) < threshold))

    return docs.mapInArrow(run, docs.schema).select(*names)
