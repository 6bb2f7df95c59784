"""Training rows and hashed word features for the two text classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: Labelled rows a classifier is fitted on at most, and the characters of text they hold at most.
MAX_TRAIN_ROWS = 8_000
MAX_TRAIN_CHARS = 30_000_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, rows: int = MAX_TRAIN_ROWS, chars: int = MAX_TRAIN_CHARS) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most `rows` labelled rows outside the held-out fold, in the order of a hash of
    doc_id; those that do not fit in what is left of `chars` are passed over.  Null texts, labels and ids are left out; a doc_id with
    several labels has its least one."""
    lab = labels.select(F.col("doc_id").cast("long"), F.col(target).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    lab = lab.withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id", "y").limit(rows)
    # at most `rows` rows of three numbers, whatever the input; their lengths tell how many fit
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).where("text is not null")
    # joined first: only labelled texts are measured and hashed
    size = own.join(F.broadcast(lab), "doc_id").select("doc_id", F.length("text").alias("n"), F.xxhash64("text").alias("th"), "o", "y").groupBy("doc_id", "th").agg(F.first("n").alias("n"), F.min("o").alias("o"), F.min("y").alias("y"))
    chosen, held = [], 0
    for r in size.orderBy("o", "doc_id", "th").limit(rows).collect():
        if held + r["n"] > chars:
            continue
        held += r["n"]
        chosen.append((r["doc_id"], r["th"], len(chosen), r["y"]))
    if not chosen:
        return [], np.empty(0)
    wanted = docs.sparkSession.createDataFrame(chosen, "doc_id long, th long, place int, y int")
    named = own.join(F.broadcast(wanted.withColumnRenamed("th", "wanted")), "doc_id")
    got = named.where(F.xxhash64("text") == F.col("wanted")).select("place", "text")
    texts = dict.fromkeys(range(len(chosen)), "")
    for r in got.toLocalIterator():
        texts[r["place"]] = r["text"]
    return list(texts.values()), np.array([c[3] for c in chosen], np.float64)


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve, ties counted half."""
    order = np.argsort(score, kind="stable")
    s = score[order]
    rank = np.empty(len(s))
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    ends = np.r_[starts[1:], len(s)]
    for a, b in zip(starts, ends):
        rank[order[a:b]] = (a + b + 1) / 2
    n1 = y.sum()
    return float((rank[y == 1].sum() - n1 * (n1 + 1) / 2) / max(n1 * (len(y) - n1), 1))


#: What a word is seen as: itself, its first four, five and six letters, and its last four.
VIEWS = ("word", "first 4", "first 5", "first 6", "last 4")


class Vocabulary:
    """Texts as codes of distinct words; each word as a few hashed features: itself, and its first and last
    letters, so that inflected and unseen forms share some."""

    def __init__(self, texts: pa.Array, bits: int):
        breaks = pc.replace_substring(pc.utf8_lower(texts), "\n", " . ")
        lists = pc.utf8_split_whitespace(breaks)
        self.off = tx.offsets_of(lists)
        coded = lists.flatten().dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False) if len(coded) else np.empty(0, np.int32)
        self.raw = coded.dictionary
        self.word = pc.replace_substring_regex(self.raw, pattern=tx._TRIM, replacement="")
        self.ends_sentence = pc.match_substring_regex(self.raw, r"[.!?]$").to_numpy(zero_copy_only=False)
        self.is_word = pc.greater(pc.binary_length(self.word), 0).to_numpy(zero_copy_only=False)
        mask = np.uint64((1 << bits) - 1)
        views = [self.word, *(pc.utf8_slice_codeunits(self.word, 0, n) for n in (4, 5, 6)), pc.utf8_slice_codeunits(self.word, -4, None)]
        self.features = np.stack([(tx.mix(tx.hashes(v), i) & mask).astype(np.int64) for i, v in enumerate(views)], 1) if len(self.word) else np.empty((0, 5), np.int64)

    def sentences(self) -> tuple[np.ndarray, np.ndarray]:
        """(offsets of the sentences in the codes, offsets of the texts in the sentences).  A sentence ends with
        a word that ends in . ! or ?, with a line, or with the text; what holds no word is none, and counts to the next one."""
        n = len(self.code)
        last = np.zeros(n, bool)
        if n:
            last |= self.ends_sentence[self.code]
            last[self.off[1:][np.diff(self.off) > 0] - 1] = True
            words = np.concatenate([[0], np.cumsum(self.is_word[self.code])])
            ends = np.flatnonzero(last) + 1
            last[ends - 1] = np.diff(words[np.concatenate([[0], ends])]) > 0
        ends = np.flatnonzero(last) + 1
        text_off = np.concatenate([[0], np.cumsum(last)])[self.off]
        return np.concatenate([[0], ends]).astype(np.int64), text_off
