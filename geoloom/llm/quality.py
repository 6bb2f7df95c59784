"""Quality by a factorisation machine.

logit(x) = w0 + sum w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ], which is all pairwise
interactions of rank `RANK`, in time linear in the features (the sum-of-squares identity).  Features: hashed
words (as their share of the text, by word and by first four letters), structure statistics and the
metadata of the text (its length in characters, words, lines).  doc_id, lang, source and labels are no inputs.

The fit uses at most features.MAX_TRAIN_ROWS labelled rows (a documented bound); every row is scored on
its whole text, however long.  Null and empty texts are scored from their statistics (all zero); repeated rows are scored
each; there are no ties; empty tables give empty results; without labels every row scores 0.5; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import text as tx
from .features import Vocabulary, held_out, training_rows

BITS = 15
RANK = 4
WORDS = 1 << BITS
#: Statistics of a text, each in 16 steps of its own (one-hot), after the hashed words.
STATS = ("chars", "words", "lines", "word length", "distinct share", "upper share", "letter share", "digit share", "mark share", "repeated line share", "line length", "ends in mark", "top word share", "strange word share")
STEPS = 16
SIZE = WORDS + len(STATS) * STEPS


def _stat_steps(texts: pa.Array, v: Vocabulary) -> np.ndarray:
    """(texts, statistics) of steps in 0..STEPS-1."""
    n = len(texts)
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.float64)
    count = lambda p: pc.count_substring_regex(texts, pattern=p).to_numpy(zero_copy_only=False).astype(np.float64)
    safe = np.maximum(chars, 1)
    nw = np.diff(v.off).astype(np.float64)
    text = np.repeat(np.arange(n), np.diff(v.off))
    pairs, times = np.unique(text * max(len(v.raw), 1) + v.code, return_counts=True) if len(text) else (np.empty(0, np.int64), np.empty(0, np.int64))
    owner = pairs // max(len(v.raw), 1)
    kinds = np.bincount(owner, minlength=n).astype(np.float64)
    top = np.zeros(n)
    np.maximum.at(top, owner, times)
    lists = pc.split_pattern(texts, "\n")
    line_off = tx.offsets_of(lists)
    lines = np.diff(line_off).astype(np.float64)
    coded = lists.flatten().dictionary_encode()
    line_text = np.repeat(np.arange(n), np.diff(line_off))
    own = np.unique(line_text * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False)) // max(len(coded.dictionary), 1)
    own_lines = np.bincount(own, minlength=n)
    marks = np.bincount(text, v.ends_sentence[v.code], n) if len(text) else np.zeros(n)
    odd = pc.match_substring_regex(v.raw, r"[^\p{L}\p{N}]{2,}").to_numpy(zero_copy_only=False)
    strange = np.bincount(text, odd[v.code], n) if len(text) else np.zeros(n)
    letters, digits = count(r"\p{L}"), count(r"\p{N}")
    share = lambda a, b: a / np.maximum(b, 1)
    values = [
        np.log2(chars + 1), np.log2(nw + 1), np.log2(lines + 1) * 2, share(chars, nw) * 1.2, share(kinds, nw) * 15.9, share(count(r"\p{Lu}"), safe) * 40,
        share(letters, safe) * 15.9, share(digits, safe) * 60, share(chars - letters - digits - nw, safe) * 40, (1 - share(own_lines, lines)) * 15.9, np.log2(share(chars, lines) + 1),
        share(marks, nw) * 40, share(top, nw) * 60, share(strange, nw) * 15.9,
    ]
    return np.clip(np.stack(values, 1), 0, STEPS - 1).astype(np.int64)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: (feature, value, offsets of the texts).  Word features weigh sqrt(share of the text's words)."""
    v = Vocabulary(texts, BITS)
    n = len(texts)
    text = np.repeat(np.arange(n), np.diff(v.off))
    views = 2  # the word, and its first letters
    keep = v.is_word[v.code] if len(text) else np.empty(0, bool)
    pairs, times = np.unique(text[keep] * max(len(v.raw), 1) + v.code[keep], return_counts=True)
    owner, word = pairs // max(len(v.raw), 1), pairs % max(len(v.raw), 1)
    nw = np.maximum(np.bincount(owner, times, n), 1)
    value = np.sqrt(times / nw[owner] / views)
    stats = WORDS + np.arange(len(STATS)) * STEPS + _stat_steps(texts, v)
    row = np.concatenate([np.repeat(owner, views), np.repeat(np.arange(n), len(STATS))])
    feature = np.concatenate([v.features[word, :views].ravel(), stats.ravel()])
    value = np.concatenate([np.repeat(value, views), np.ones(n * len(STATS))])
    order = np.argsort(row, kind="stable")
    return feature[order], value[order], np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int64)


class Model:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def logits(self, feature: np.ndarray, value: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = self.w0 + tx.segments(np.add, self.w[feature] * value, off, 0.0)
        for f in range(self.v.shape[1]):
            part = self.v[feature, f] * value
            out += 0.5 * (tx.segments(np.add, part, off, 0.0) ** 2 - tx.segments(np.add, part**2, off, 0.0))
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*features(texts)), -60, 60)))


def fit(texts: list[str], y: np.ndarray, epochs: int = 40, rate: float = 0.1, l2: float = 2e-5) -> Model:
    """Full-batch Adam on the log loss.  Start values of the factors come from a fixed seed."""
    w0, w, v = 0.0, np.zeros(SIZE), np.random.default_rng(7).normal(0, 0.02, (SIZE, RANK))
    if not len(y):
        return Model(0.0, w, v * 0)
    parts = [features(pa.array(texts[i : i + 500], pa.large_string())) for i in range(0, len(texts), 500)]
    feature, value = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    off = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))]).astype(np.int64)
    row = np.repeat(np.arange(len(y)), np.diff(off))
    state = [np.zeros(SIZE), np.zeros(SIZE), np.zeros((SIZE, RANK)), np.zeros((SIZE, RANK)), 0.0, 0.0]
    for t in range(1, epochs + 1):
        z = w0 + np.bincount(row, w[feature] * value, len(y))
        sums = []
        for f in range(RANK):
            part = v[feature, f] * value
            sums.append(np.bincount(row, part, len(y)))
            z += 0.5 * (sums[-1] ** 2 - np.bincount(row, part**2, len(y)))
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) / len(y)
        gx = g[row] * value
        gw = np.bincount(feature, gx, SIZE) + l2 * w
        gv = np.stack([np.bincount(feature, gx * (sums[f][row] - v[feature, f] * value), SIZE) for f in range(RANK)], 1) + l2 * v
        g0 = g.sum()
        for k, grad in ((0, gw), (2, gv), (4, g0)):
            state[k] = 0.9 * state[k] + 0.1 * grad
            state[k + 1] = 0.99 * state[k + 1] + 0.01 * grad**2
        step = lambda k: rate * (state[k] / (1 - 0.9**t)) / (np.sqrt(state[k + 1] / (1 - 0.99**t)) + 1e-8)  # noqa: B023, E731
        w, v, w0 = w - step(0), v - step(2), w0 - step(4)
    return Model(float(w0), w, v)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*training_rows(docs, labels, "quality", rows=2_500))


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text)."""
    w0, w, v = model.w0, model.w.astype(np.float32), model.v.astype(np.float32)

    @tx.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(w0, w.astype(np.float64), v.astype(np.float64))
        for batch in batches:
            for part in tx.chunks(batch, "text", 3 << 20):
                score = m.score(tx.column(part, "text"))
                cols = [part.column(0), part.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = rows.withColumn("held_out", held_out(rows["doc_id"]))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
