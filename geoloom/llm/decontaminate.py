"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles into ranges that double.  For a range up to u, every text is
read in windows of 2u shingles that advance by u, so that a passage of up to u shingles lies whole in some
window, and its Jaccard similarity to an item of the range is at least t q / (2u + q - t q) however long the
text is.  Single-row MinHash bands (as many as the target recall needs at that similarity) propose items;
exact containment, |item's shingles in the document| / |item's shingles|, verifies them.

One pass over the texts: a window's band values, and the text's shingles, are checked against bitmaps of fixed
size made from the items, so that only what may match leaves the pass; the items are joined, not broadcast,
and may be many.

An item of fewer than k words is one shingle of all its words, and is found where a text has that run of words.
Null texts, empty ones and those without words match nothing, and items like them are never found; repeated rows and items each
give their own matches, so there are no ties; empty tables give empty results; extra columns are ignored, whatever
their names; texts are read whole, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import bitmap, cut, hit

#: Ranges of item sizes in shingles: up to 1, 2, 4, ... ; the last, of a million, takes what is larger.
RANGES = tuple(1 << i for i in range(21))


def bands_for(u: int, threshold: float, recall: float) -> int:
    """Bands for an item of u/2 + 1 shingles, the least of its range, in a window of 2u."""
    q = u // 2 + 1
    j = threshold * q / (2 * u + q - threshold * q)
    return int(np.ceil(np.log(1 - recall) / np.log(1 - j)))


def _permuted(base: np.ndarray, b: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = base * np.uint32((0x9E3779B1 * (2 * b + 1)) & 0xFFFFFFFF) + np.uint32((b * 0x7FEB352D) & 0xFFFFFFFF)
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x846CA68B)
        return x ^ (x >> np.uint32(13))


def _key(values: np.ndarray, r: int, b: int) -> np.ndarray:
    return tx.mix(values.astype(np.uint64) | (np.uint64(r) << np.uint64(56)) | (np.uint64(b) << np.uint64(40))).view(np.int64)


def _run_keys(word: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(key of every run of n words, offsets), for items of n words, fewer than a shingle's."""
    run, run_off = tx.shingles(word, off, n)
    return tx.mix(run, 100 + n), run_off


def _items(items: DataFrame, k: int, threshold: float, recall: float) -> DataFrame:
    """(item_id, size range, shingles, band keys) of every item that can be found; of a short item minus its words, and its run."""

    @tx.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.chunks(batch, "text"):
                word, w_off = tx.words(tx.column(part, "text"))
                shingle, off = tx.distinct(*tx.shingles(word, w_off, k))
                rows, keys, sets = [], [], []
                for i in np.flatnonzero(np.diff(w_off) >= k):
                    own = shingle[off[i] : off[i + 1]]
                    r = min(int(np.searchsorted(RANGES, len(own))), len(RANGES) - 1)
                    base = (tx.mix(own, 98) >> np.uint64(32)).astype(np.uint32)
                    rows.append((i, r))
                    keys.append([int(_key(_permuted(base, b).min()[None], r, b)[0]) for b in range(bands_for(RANGES[r], threshold, recall))])
                    sets.append(own.view(np.int64).tolist())
                for n in range(1, k):
                    for i in np.flatnonzero(np.diff(w_off) == n):
                        rows.append((i, -n))
                        sets.append(_run_keys(word[w_off[i] : w_off[i + 1]], np.array([0, n]), n)[0].view(np.int64).tolist())
                        keys.append(sets[-1])
                if rows:
                    at = [i for i, _ in rows]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(at, pa.int64())), pa.array([r for _, r in rows], pa.int32()), pa.array(sets, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                        ["item_id", "size_range", "grams", "keys"],
                    )

    rows = items.select(items["item_id"].cast("long"), items["text"].cast("string"))
    return rows.mapInArrow(run, "item_id long, size_range int, grams array<long>, keys array<long>")


def _window_hits(shingle: np.ndarray, off: np.ndarray, r: int, bands: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, band key) of windows whose band value may be an item's."""
    u = RANGES[r]
    length = np.diff(off)
    blocks = -(-length // u)
    starts = tx.ragged(np.zeros(len(length), np.int64), blocks) * u + np.repeat(off[:-1], blocks)
    text = np.repeat(np.arange(len(length)), blocks)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    base = (tx.mix(shingle, 98) >> np.uint64(32)).astype(np.uint32)
    last = np.ones(len(text), bool)
    last[:-1] = text[1:] != text[:-1]
    texts, keys = [], []
    for b in range(bands):
        low = np.minimum.reduceat(_permuted(base, b), starts)
        after = np.append(low[1:], np.uint32(0xFFFFFFFF))
        key = _key(np.where(last, low, np.minimum(low, after)), r, b)
        found = hit(wanted, key)
        texts.append(text[found])
        keys.append(key[found])
    return np.concatenate(texts), np.concatenate(keys)


def _run_hits(word: np.ndarray, off: np.ndarray, n: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of runs of n words that may be an item."""
    key, run_off = _run_keys(word, off, n)
    found = hit(wanted, key)
    return np.repeat(np.arange(len(off) - 1), np.diff(run_off))[found], key[found]


def find_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.999) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of every document row and item whose containment is at
    least the threshold."""
    return _found(docs, items, threshold, k, recall).drop("th")


def _found(docs: DataFrame, items: DataFrame, threshold: float, k: int, recall: float) -> DataFrame:
    known = cut(_items(items, k, threshold, recall))
    ranges = sorted(x[0] for x in known.select("size_range").distinct().collect())  # k - 1 and 21 at most
    shorts, ranges = [-r for r in ranges if r < 0], [r for r in ranges if r >= 0]
    bands = [bands_for(RANGES[r], threshold, recall) for r in ranges]
    keys = known.select("item_id", F.explode("keys").alias("key"))
    grams = known.select(F.explode("grams").alias("gram"))
    key_bits, gram_bits = bitmap(keys, "key"), bitmap(grams, "gram")

    @tx.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.chunks(batch, "text"):
                word, w_off = tx.words(tx.column(part, "text"))
                shingle, off = tx.shingles(word, w_off, k)
                got = [_window_hits(shingle, off, r, n, key_bits) for r, n in zip(ranges, bands)]
                runs = [_run_hits(word, w_off, n, key_bits) for n in shorts]
                got += [(text, key.view(np.int64)) for text, key in runs]
                if not got:
                    continue
                text, key = (np.concatenate(x) for x in zip(*got))
                if not len(text):
                    continue
                pairs = np.unique(np.stack([text, key]), axis=1)
                rows, cuts = np.unique(pairs[0], return_index=True)
                length = np.diff(off)[rows]
                mine = shingle[tx.ragged(off[rows], length)]
                may = hit(gram_bits, mine)
                owner = np.concatenate([np.repeat(np.arange(len(rows)), length)[may], *[np.searchsorted(rows, text) for text, _ in runs]])
                mine = np.concatenate([mine[may], *[key for _, key in runs]])[np.argsort(owner, kind="stable")]
                mine, m_off = tx.distinct(mine, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(rows)))]).astype(np.int64))
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(2).take(take), tx.list_array(pairs[1], np.append(cuts, len(pairs[1]))), tx.list_array(mine.view(np.int64), m_off)],
                    ["doc_id", "th", "keys", "found"],
                )

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    hits = cut(rows.mapInArrow(run, "doc_id long, th long, keys array<long>, found array<long>").withColumn("row", F.monotonically_increasing_id()))
    pairs = hits.select("row", F.explode("keys").alias("key")).join(keys, "key").select("row", "item_id").distinct()
    checked = pairs.join(known.select("item_id", "grams"), "item_id").join(hits.select("row", "doc_id", "th", "found"), "row")
    shared = F.size(F.array_intersect("grams", "found")).cast("long")
    checked = checked.select("doc_id", "item_id", shared.alias("n_shared"), F.size("grams").cast("long").alias("n_shingles"), "th")
    return checked.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= threshold).select("doc_id", "item_id", "n_shared", "n_shingles", "containment", "th")


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.999) -> DataFrame:
    """The rows of docs, all columns kept, that hold no item."""
    found = cut(_found(docs, items, threshold, k, recall).select(F.col("doc_id").alias("_d"), F.col("th").alias("_h")).distinct())
    th = F.xxhash64(docs["text"].cast("string"))
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["_d"]) & (th == found["_h"]), "left_anti").select(*docs.columns)
