"""N-gram Jaccard join of documents: MinHash banding, verified on full n-gram sets.

1. One pass over the texts: each gives a hash of its word sequence and, from its shingles, MinHash bands.
   Texts with one word sequence are one class; classes are gathered with pre-aggregation.
2. Classes that share a band are joined to the band's least class (a star, not all pairs), and the stars'
   components are the blocks in which links can lie.
3. A second pass over the texts gathers the full shingle sets of classes in blocks.  A block is verified as a
   whole in one task, or, when large, dealt as pairs of bounded sub-blocks; common shingles are counted by
   matrix products, so that links are counted, never emitted as pairs.  Each pair of classes is verified once.
4. Components of the verified links give the class ids.

Bands and rows are chosen for the target recall at the threshold, taking the most selective choice whose
signature is at most `most_hashes` long.

Null and empty texts (no word) have no n-grams and are linked to nothing; texts of fewer than k words have one
n-gram, of all their words; repeated rows are members of one class and linked to each other; null doc_ids
take part, and a class id is the least doc_id in it (null if it has none); ties cannot change any result;
empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .store import bitmap, cut, hit

#: Classes and shingles in a sub-block at most; bounds a task's memory.
BLOCK_CLASSES = 1500
BLOCK_SHINGLES = 1_500_000
#: Smaller blocks are dealt in parts of so many classes, too, up to so many parts: a block is the work of several tasks.
PART_CLASSES = 200
PARTS = 12


def bands_for(threshold: float, recall: float, most_hashes: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows for which enough bands to reach the recall at the threshold fit."""
    best = (1, 1)
    for rows in range(1, most_hashes + 1):
        miss = np.log1p(-min(threshold**rows, 1 - 1e-12))
        bands = int(np.ceil(np.log(1 - recall) / miss))
        if bands * rows > most_hashes:
            break
        best = (bands, rows)
    return best


def signatures(shingle: np.ndarray, off: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(texts, bands) of band hashes; texts without shingles get zeros."""
    full = np.diff(off) > 0
    starts = off[:-1][full]
    base = (tx.mix(shingle, 99) >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(off) - 1, bands), np.uint64)
    rng = np.random.default_rng(20)
    with np.errstate(over="ignore"):
        for b in range(bands):
            band = np.full(int(full.sum()), b + 1, np.uint64)
            for _ in range(rows):
                mul, add = (np.uint32(rng.integers(1, 1 << 32, dtype=np.uint64) | 1), np.uint32(rng.integers(0, 1 << 32, dtype=np.uint64)))
                x = base * mul + add
                x ^= x >> np.uint32(15)
                x *= np.uint32(0x2C1B3C6D)
                if len(starts):
                    band = tx.mix(band ^ np.minimum.reduceat(x, starts).astype(np.uint64), b)
            out[full, b] = band
    return out


def _sequence(word: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's word sequence."""
    place = np.arange(len(word)) - np.repeat(off[:-1], np.diff(off))
    with np.errstate(over="ignore"):
        each = tx.mix(word + tx.mix(place.astype(np.uint64), 5))
        size = np.diff(off).astype(np.uint64)
        return tuple(tx.mix(tx.segments(np.add, tx.mix(each, s), off, np.uint64(0)) + size, s).view(np.int64) for s in (6, 7))


def _sketch(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    @tx.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.chunks(batch, "text"):
                word, off = tx.words(tx.column(part, "text"))
                h1, h2 = _sequence(word, off)
                shingle, s_off = tx.shingles(word, off, k)
                sig = signatures(shingle, s_off, bands, rows).view(np.int64)
                n = np.diff(s_off)
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(h1, mask=none), pa.array(h2, mask=none), pa.array(n), tx.list_array(sig.ravel(), np.arange(len(n) + 1) * bands)],
                    ["doc_id", "th", "h", "h2", "n", "bands"],
                )

    return docs.mapInArrow(run, "doc_id long, th long, h long, h2 long, n long, bands array<long>")


def _sets(docs: DataFrame, k: int, wanted: np.ndarray) -> DataFrame:
    """(h, grams: the distinct shingles, as bytes) of texts whose h may be wanted; each once per task."""

    @tx.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            for part in tx.chunks(batch, "text"):
                word, off = tx.words(tx.column(part, "text"))
                h, _ = _sequence(word, off)
                rows = [i for i in np.flatnonzero(hit(wanted, h)) if h[i] not in given and not given.add(h[i])]
                if not rows:
                    continue
                rows = np.array(rows)
                length = np.diff(off)[rows]
                picked = word[tx.ragged(off[rows], length)]
                shingle, s_off = tx.distinct(*tx.shingles(picked, np.concatenate([[0], np.cumsum(length)]), k))
                grams = [shingle[a:b].tobytes() for a, b in zip(s_off, s_off[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(h[rows]), pa.array(grams, pa.binary())], ["h", "grams"])

    return docs.mapInArrow(run, "h long, grams binary")


def _common(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of every left with every right set (of every two left sets, if None)."""
    sets = left + (right or [])
    n = len(left)
    out = np.zeros((n, len(right) if right is not None else n), np.float32)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    owner, code = owner[shared], code[shared]
    names, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    step = 2048
    cuts = np.searchsorted(code, np.arange(0, len(names) + step, step))
    for j, (a, b) in enumerate(zip(cuts, cuts[1:])):
        x = np.zeros((len(sets), step), np.float32)
        x[owner[a:b], code[a:b] - j * step] = 1
        out += x[:n] @ (x if right is None else x[n:]).T
    return out


def _roots(linked: np.ndarray) -> np.ndarray:
    """Components of a symmetric boolean matrix, as the least index in each."""
    root = np.arange(len(linked))
    todo = np.ones(len(linked), bool)
    for i in range(len(linked)):
        if not todo[i]:
            continue
        seen = np.zeros(len(linked), bool)
        front = seen.copy()
        front[i] = True
        while front.any():
            seen |= front
            front = linked[front].any(0) & ~seen
        root[seen] = i
        todo &= ~seen
    return root


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """One row per class and task: its links there, weighted by members, and an edge to a linked class."""
    ratio = threshold / (1 + threshold)
    h_out: list[int] = []
    links: list[int] = []
    edge: list[int] = []
    for table in tx.groups(batches, ["block", "i", "j"]):
        same = table["i"][0].as_py() == table["j"][0].as_py()
        h = table["h"].to_numpy()
        weight = table["members"].to_numpy().astype(np.float64)
        sets = [np.frombuffer(g, np.uint64) for g in table["grams"].to_pylist()]
        size = np.array([len(s) for s in sets], np.float64)
        first = np.flatnonzero(table["part"].to_numpy() == table["i"][0].as_py())
        second = first if same else np.flatnonzero(table["part"].to_numpy() == table["j"][0].as_py())
        if len(first) and len(second) and (len(first) > 1 or not same):
            common = _common([sets[i] for i in first], None if same else [sets[i] for i in second])
            need = np.ceil(ratio * (size[first][:, None] + size[second][None, :]) - 1e-9)
            linked = common >= np.maximum(need, 1)
            if same:
                np.fill_diagonal(linked, False)
                root = first[_roots(linked)]
                h_out += h[first].tolist()
                links += (linked @ weight[first]).astype(np.int64).tolist()
                edge += h[root].tolist()
            else:
                for a, b, m in ((first, second, linked), (second, first, linked.T)):
                    h_out += h[a].tolist()
                    links += (m @ weight[b]).astype(np.int64).tolist()
                both = np.concatenate([first, second])
                whole = np.zeros((len(both), len(both)), bool)
                whole[: len(first), len(first) :] = linked
                whole |= whole.T
                edge += h[both[_roots(whole)]].tolist()
        if len(h_out) >= 10_000:
            yield pa.RecordBatch.from_pydict({"h": pa.array(h_out, pa.int64()), "links": pa.array(links, pa.int64()), "to": pa.array(edge, pa.int64())})
            h_out, links, edge = [], [], []
    yield pa.RecordBatch.from_pydict({"h": pa.array(h_out, pa.int64()), "links": pa.array(links, pa.int64()), "to": pa.array(edge, pa.int64())})


def link_documents(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.999) -> DataFrame:
    """doc_id, class_id (the least doc_id linked to it, directly or through others), n_links (rows with a Jaccard
    similarity of at least the threshold), n_copies (rows of its very word sequence, itself included) of every row
    of docs(doc_id, text)."""
    return _linked(docs, threshold, k, recall).drop("th")


def _linked(docs: DataFrame, threshold: float, k: int, recall: float) -> DataFrame:
    """link_documents with th, a hash of the text."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    bands, rows = bands_for(threshold, recall)
    sketch = cut(_sketch(docs, k, bands, rows))
    classes = cut(sketch.where("n > 0").groupBy("h", "h2").agg(F.count("*").alias("members"), F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")))

    banded = classes.select("h", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("h").alias("b"), F.max("h").alias("top")).where("top > b").select("band", "b")
    stars = banded.join(least, "band").where("h <> b").select(F.col("h").alias("a"), "b").distinct()
    blocks = components(stars).withColumnsRenamed({"node": "h", "root": "block"})

    own = blocks.join(classes.select("h", "members", "n"), "h")
    several = F.least(F.lit(PARTS), F.ceil(F.count("*") / PART_CLASSES))
    sizes = own.groupBy("block").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("n") / BLOCK_SHINGLES), several).cast("int").alias("parts"))
    own = own.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int"))
    grams = _sets(docs, k, bitmap(blocks, "h")).groupBy("h").agg(F.first("grams").alias("grams"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    dealt = own.join(grams, "h").select("*", other)
    dealt = dealt.select("block", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "h", "members", "grams")
    dealt = dealt.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "h")
    found = cut(dealt.mapInArrow(lambda it: _verify(it, threshold), "h long, links long, to long"))

    roots = components(found.select(F.col("h").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("h").agg(F.sum("links").alias("links"))
    known = classes.select("h", "h2", "rep", "members").join(links, "h", "left").join(roots.withColumnRenamed("node", "h"), "h", "left")
    known = known.select("h", "h2", "rep", "members", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "h").alias("root"))
    ids = known.groupBy("root").agg(F.min("rep").alias("class_id"))
    known = known.join(ids, "root").select("h", "h2", "members", "links", "class_id")
    out = sketch.select("doc_id", "th", "h", "h2").join(known, ["h", "h2"], "left")
    linked = F.col("members").isNotNull()
    return out.select(
        "doc_id",
        F.when(linked, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(linked, F.col("links") + F.col("members") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("members", F.lit(1)).cast("long").alias("n_copies"),
        "th",
    )


def keep_one(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.999) -> DataFrame:
    """The rows of docs, all columns kept, of which one of each class stays: the row with the least doc_id (of rows
    that repeat it, the one with the least hash of its text, once).  Rows without words, and rows without doc_id,
    which nothing names, stay."""
    names = docs.columns
    linked = cut(_linked(docs, threshold, k, recall).where("n_links > 0 and doc_id is not null"))
    gone = linked.where("class_id is not null and doc_id <> class_id").select(F.col("doc_id").alias("__geoloom_d"), F.col("th").alias("__geoloom_h")).distinct()
    th = F.xxhash64(F.col("text").cast("string"))
    kept = docs.join(gone, (docs["doc_id"].cast("long") == gone["__geoloom_d"]) & (th == gone["__geoloom_h"]), "left_anti")
    again = linked.where("doc_id = class_id").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("th").alias("__geoloom_h")).where("rows > 1").select(F.col("doc_id").alias("__geoloom_d"), "__geoloom_h")
    if again.isEmpty():
        return kept.select(*names)
    # ids that several rows of a class carry: the first of them stays, once
    members = linked.select(F.col("doc_id").alias("__geoloom_d"), F.col("th").alias("__geoloom_t")).distinct().join(again, "__geoloom_d")
    tagged = kept.withColumn("__geoloom_k", th).join(F.broadcast(members) if members.count() < 10_000 else members, (F.col("doc_id").cast("long") == F.col("__geoloom_d")) & (F.col("__geoloom_k") == F.col("__geoloom_t")), "left")
    plain, several = tagged.where("__geoloom_d is null"), tagged.where("__geoloom_d is not null and __geoloom_k = __geoloom_h").dropDuplicates(["__geoloom_d"])
    return plain.select(*names).unionByName(several.select(*names))
