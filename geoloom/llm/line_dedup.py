"""Line dedup by an exact set-similarity join.

A line is the set of its words.  Tokens are ordered by rarity, and lines are joined on the tokens of their
prefix, under the length and positional filters; Jaccard similarity on the whole sets verifies.  A line goes
if an earlier line (in order of doc_id, then hash of the text, then place) has a similarity of at least the threshold,
whether or not that one stays.

Rarity comes from tables of fixed size that count all words: words that no other line can hold (seen once)
come first, then by the count of a word's cell, ties by hash; any such order is the same for all lines, so
shared cells cost time but no result.  Words seen once join nothing and are not emitted.  The join carries
32-bit hashes of words (shared ones cost time only) and a parity signature of each set: sets differ in at least
as many words as their signatures do in bits, which rules out nearly all pairs that share a rare word by chance.

Groups of copies cost no pairs: equal sets are one class, whose first line stands for it; and a class is first
compared to BEFORE earlier ones that share one of two least hashes of their prefixes (in one of SALTS shares of those), which decides
nearly all of a large group; what is left undecided is compared to all earlier ones.  Only lines in candidate pairs are read again for their whole sets.

Lines are separated by "\\n".  Lines without words always stay.  Null texts stay null; documents of which no
line with words stays keep their blank lines, or go in `dedup_documents(drop_emptied=True)`.  Rows that repeat
doc_id and text are one document given twice, and get the same lines back; null doc_ids sort first; empty
tables give empty results; extra columns are kept (one named n_lines_removed gives way to the result).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import bitmap, cut, hit, settle, small

#: Cells of the count table (2 MB), and bits of the tables of words seen once and twice (2 MB each): all that the
#: driver gathers, whatever the data.
COUNT_BITS = 18
SEEN_BITS = 24
_SLICES = 64
#: Shares of the classes of a least hash in the first comparison, so that a large group is several tasks' work, and the
#: earlier classes that a class is then compared to.
SALTS = 8
BEFORE = 16
#: A class that has so many likely earlier ones in its share is not compared to more there: what is left undecided is compared to all afterwards.
LIKELY = 4


class _Rarity:
    """Mergeable tables: counts by cell, and bits of words seen, and seen again."""

    def __init__(self):
        self.count = np.zeros(1 << COUNT_BITS, np.int64)
        self.once = np.zeros(1 << (SEEN_BITS - 3), np.uint8)
        self.again = np.zeros(1 << (SEEN_BITS - 3), np.uint8)

    def add(self, known: np.ndarray, times: np.ndarray) -> None:
        self.count += np.bincount((known & np.uint64(len(self.count) - 1)).astype(np.int64), times, len(self.count)).astype(np.int64)
        cell, n = np.unique((known >> np.uint64(64 - SEEN_BITS)).astype(np.int64), return_inverse=True)
        n = np.bincount(n, times)
        bit = np.uint8(1) << (cell & 7).astype(np.uint8)
        twice = ((self.once[cell >> 3] & bit) > 0) | (n > 1)
        np.bitwise_or.at(self.again, cell[twice] >> 3, bit[twice])
        np.bitwise_or.at(self.once, cell >> 3, bit)

    def rows(self) -> pa.RecordBatch:
        cuts = lambda a: [x.tobytes() for x in np.split(a, _SLICES)]
        return pa.RecordBatch.from_pydict({"slice": pa.array(range(_SLICES), pa.int32()), "count": pa.array(cuts(self.count), pa.binary()), "once": pa.array(cuts(self.once), pa.binary()), "again": pa.array(cuts(self.again), pa.binary())})


def _seen(bits: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set."""
    cell = (known >> np.uint64(64 - SEEN_BITS)).astype(np.int64)
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0


def _worded(docs: DataFrame) -> DataFrame:
    """A row for each chunk of texts: doc_id and th of each, and as bytes the number of its lines, the number of words of each line, the
    words as places in `known` (their low two bytes, and the third and fourth), the hashes `known` and how often each occurs.  Texts are
    split into words only here."""

    @tx.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.chunks(batch, "text"):
                lists = pc.split_pattern(tx.column(part, "text"), "\n")
                code, off, known = tx.coded(lists.flatten())
                n = [0, part.num_rows]
                blobs = [np.diff(tx.offsets_of(lists)).astype(np.int32), np.diff(off).astype(np.int32), (code & 0xFFFF).astype(np.uint16), (code >> 16).astype(np.uint8 if len(known) < 1 << 24 else np.uint16), known, np.bincount(code, minlength=len(known))]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(n, pa.int32()), part.column(i)) for i in (0, 2)] + [pa.array([x.tobytes()], pa.binary()) for x in blobs], _WORDED)

    return docs.mapInArrow(run, f"doc_id array<long>, th array<long>, {', '.join(f'{c} binary' for c in _WORDED[2:])}")


_WORDED = ["doc_id", "th", "lines", "words", "low", "high", "known", "times"]


def _rarity(worded: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(count by cell, whether a word may be seen twice by bit) over all words."""
    schema = "slice int, count binary, once binary, again binary"

    @tx.lean
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Rarity()
        for batch in batches:
            for known, times in zip(batch.column(0), batch.column(1)):
                table.add(np.frombuffer(known.as_buffer(), np.uint64), np.frombuffer(times.as_buffer(), np.int64))
        yield table.rows()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                count, once, again = np.frombuffer(r["count"], np.int64), np.frombuffer(r["once"], np.uint8), np.frombuffer(r["again"], np.uint8)
                old = held.get(r["slice"])
                held[r["slice"]] = [old[0] + count, old[1] | once, old[2] | again | (old[1] & once)] if old else [count, once, again]
        names = list(held)
        yield pa.RecordBatch.from_pydict({"slice": pa.array(names, pa.int32()), **{c: pa.array([held[k][i].tobytes() for k in names], pa.binary()) for i, c in enumerate(("count", "once", "again"))}})

    out = worded.select("known", "times").mapInArrow(gather, schema).repartition(_SLICES // 8, "slice").mapInArrow(merge, schema)
    rows = sorted((r["slice"], r["count"], r["again"]) for r in out.toLocalIterator())
    if not rows:
        return np.zeros(1 << COUNT_BITS, np.int64), np.zeros(1 << (SEEN_BITS - 3), np.uint8)
    return np.frombuffer(b"".join(bytes(r[1]) for r in rows), np.int64), np.frombuffer(b"".join(bytes(r[2]) for r in rows), np.uint8)


def _line_key(th: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A hash of a line's place: the hash of its text, and its number."""
    return tx.mix(th.view(np.uint64) ^ tx.mix(line.astype(np.uint64), 2)).view(np.int64)


def _signatures(known: np.ndarray, code: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two words of parity bits for each set of places in `known`: the low and the high half of 128."""
    place = tx.mix(known, 8)
    bit = np.uint64(1) << (place & np.uint64(63))
    low = (place >> np.uint64(6)) & np.uint64(1) == 0
    halves = (np.where(low, bit, np.uint64(0)), np.where(low, np.uint64(0), bit))
    return tuple(tx.segments(np.bitwise_xor, h[code], off, np.uint64(0)) for h in halves)


def _classes(worded: DataFrame, rarity: tuple[np.ndarray, np.ndarray], threshold: float) -> DataFrame:
    """A row for each distinct token set: id (in no order), doc_id, th, line of its first line, size, low and high (a parity
    signature), m1 and m2 (least hashes of its prefix under two orders), and the prefix: words seen twice, each a number of
    its hash (high half) and place (low half)."""
    count = np.minimum(rarity[0], (1 << 31) - 1).astype(np.int32)
    again = rarity[1]
    least = threshold / (1 - threshold)  # a smaller set is similar to none but itself

    @tx.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                doc, th = batch.column(0)[r].values, batch.column(1)[r].values
                held = [x[r].as_buffer() for x in batch.columns[2:]]
                lines, words, code, known = (np.frombuffer(x, d) for x, d in zip((held[0], held[1], held[2], held[4]), (np.int32, np.int32, np.uint16, np.uint64)))
                code = code + (np.frombuffer(held[3], np.uint8 if len(known) < 1 << 24 else np.uint16).astype(np.int64) << 16)
                off = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
                twice = _seen(again, known)
                order = np.lexsort((known, count[(known & np.uint64(len(count) - 1)).astype(np.int64)], twice))
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                known, twice = known[order], twice[order]
                code, off = tx.distinct_codes(place[code] if len(code) else code, off)
                size = np.diff(off)
                some = np.flatnonzero(size > 0)
                with np.errstate(over="ignore"):
                    key = tx.mix(tx.segments(np.add, tx.mix(known, 3)[code], off, np.uint64(0)) + size.astype(np.uint64), 4).view(np.int64)[some]
                text = np.repeat(np.arange(len(lines)), lines)[some]
                line = some - (np.cumsum(lines, dtype=np.int64) - lines)[text]
                # the first line of each set in the chunk, so that a very common line is a row a chunk
                named = doc.is_valid().to_numpy(zero_copy_only=False)[text]
                first = np.lexsort((line, th.to_numpy()[text], pc.fill_null(doc, 0).to_numpy()[text], named, key))
                new = np.ones(len(first), bool)
                new[1:] = key[first][1:] != key[first][:-1]
                first = np.sort(first[new])
                some, key, text, line = some[first], key[first], text[first], line[first]
                length = np.where(size >= least - 1e-9, size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1, 0)[some]
                at = tx.ragged(off[:-1][some], length)
                owner = np.repeat(np.arange(len(some)), length)
                pos = at - np.repeat(off[:-1][some], length)
                live = twice[code[at]] if len(at) else np.empty(0, bool)
                cuts = np.concatenate([[0], np.cumsum(np.bincount(owner[live], minlength=len(some)))])
                low, high = (x[some].view(np.int64) for x in _signatures(known, code, off))
                rare = code[at[live]]
                least_two = [tx.segments(np.minimum, tx.mix(known, k)[rare], cuts, np.uint64(0)).view(np.int64) for k in (31, 32)]
                prefix = ((tx.mix(known, 9)[rare] >> np.uint64(32) << np.uint64(32)) | pos[live].astype(np.uint64)).view(np.int64)
                row = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), doc.take(row), th.take(row), pa.array(line.astype(np.int32)), pa.array(size[some].astype(np.int32)), pa.array(low), pa.array(high), pa.array(least_two[0]), pa.array(least_two[1]), tx.list_array(prefix, cuts)],
                    ["key", "doc_id", "th", "line", "size", "low", "high", "m1", "m2", "prefix"],
                )

    rows = worded.select(*[c for c in _WORDED if c != "times"]).mapInArrow(run, "key long, doc_id long, th long, line int, size int, low long, high long, m1 long, m2 long, prefix array<long>")
    # dealt out first: nearly all sets are different, and a sort before they are dealt would find few that are not
    rows = rows.repartition("key").groupBy("key").agg(F.min(F.struct(*rows.columns[1:])).alias("f")).select("f.*")
    return rows.withColumn("id", F.monotonically_increasing_id())


def _sets(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(k, tokens) of lines whose place may be wanted; each once per task.  Other lines are not read for words."""

    @tx.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in batches:
            for part in tx.chunks(batch, "text"):
                lists = pc.split_pattern(tx.column(part, "text"), "\n")
                off = tx.offsets_of(lists)
                text = np.repeat(np.arange(part.num_rows), np.diff(off))
                k = _line_key(part.column(2).to_numpy()[text], np.arange(len(text)) - off[text])
                rows = [i for i in np.flatnonzero(hit(wanted, k)) if k[i] not in given and not given.add(k[i])]
                if rows:
                    code, w_off, known = tx.coded(lists.flatten().take(pa.array(rows)))
                    code, w_off = tx.distinct_codes(code, w_off)
                    yield pa.RecordBatch.from_arrays([pa.array(k[rows]), tx.list_array(known[code].view(np.int64) if len(code) else np.empty(0, np.int64), w_off)], ["k", "tokens"])

    return docs.mapInArrow(run, "k long, tokens array<long>").groupBy("k").agg(F.first("tokens").alias("tokens"))


def _similar(pairs: DataFrame, classes: DataFrame, docs: DataFrame, threshold: float, gone: DataFrame | None = None) -> DataFrame:
    """The ids of the later ones of those pairs (id, other) whose sets are similar; without those in `gone`."""
    pairs = cut(pairs)
    ids = cut(pairs.select(F.explode(F.array("id", "other")).alias("id")).distinct())
    classes = cut(classes.select("id", "doc_id", "th", "line").join(small(ids), "id", "left_semi"))
    own = lambda n, s: classes.select(F.col("id").alias(n), *[F.col(c).alias(c[0] + s) for c in ("doc_id", "th", "line")])
    named = pairs.join(own("id", "a"), "id").join(own("other", "b"), "other")
    later = F.struct("da", "ta", "la") > F.struct("db", "tb", "lb")  # null doc_ids first, as in the least struct of a class
    named = named.withColumn("id", F.when(later, F.col("id")).otherwise(F.col("other")))
    if gone is not None:
        named = named.join(small(gone), "id", "left_anti")

    @tx.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ka, kb = (_line_key(b.column(i).to_numpy(), b.column(i + 1).to_numpy()) for i in (1, 3))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ka), pa.array(kb)], ["id", "ka", "kb"])

    named = cut(named.select("id", "ta", "la", "tb", "lb").mapInArrow(run, "id long, ka long, kb long"))
    wanted = bitmap(named.select(F.explode(F.array("ka", "kb")).alias("k")), "k")
    if not wanted.any():
        return named.select("id").where("false")
    texts = cut(classes.select("th").distinct())
    sets = cut(_sets(docs.join(small(texts), "th", "left_semi").select("doc_id", "text", "th"), wanted))
    both = named.join(sets.withColumnsRenamed({"k": "ka", "tokens": "a"}), "ka").join(sets.withColumnsRenamed({"k": "kb", "tokens": "b"}), "kb")
    common = F.size(F.array_intersect("a", "b"))
    return both.where(common / (F.size("a") + F.size("b") - common) >= threshold - 1e-12).select("id").distinct()


def _prefixes(classes: DataFrame, x: str) -> DataFrame:
    """A row (token, x_id, x_low, x_high, x_doc, x_of) for each token of a prefix.  x_doc is a doc_id, x_of holds size, words from the token on, and open, in one number."""
    doc = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc")  # nulls are first
    rows = classes.select("id", "low", "high", doc, "size", "open", F.explode("prefix").alias("p"))
    of = F.expr("shiftleft(cast(size as bigint), 32) | shiftleft(cast(size as bigint) - (p & 4294967295L), 1) | cast(open as bigint)")
    return rows.select(F.shiftright("p", 32).cast("int").alias("token"), *[F.col(c).alias(f"{x}_{c}") for c in ("id", "low", "high", "doc")], of.alias(f"{x}_of"))


def _first_pairs(classes: DataFrame, threshold: float) -> DataFrame:
    """(id, other): each class with up to BEFORE earlier ones that share one of two least hashes, in its share of
    theirs.  Copies with small changes mostly do."""
    share = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    rows = classes.where(F.size("prefix") > 0).select(F.explode(F.array("m1", "m2")).alias("least"), share.alias("share"), "doc_id", "id", "size", "low", "high")
    rows = rows.select(F.xxhash64("least", "share").alias("group"), "doc_id", "id", "size", "low", "high")
    rows = rows.repartition("group").sortWithinPartitions("group", "doc_id").drop("doc_id")

    @tx.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[np.ndarray] = []  # the rows before a batch
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            before = len(last[0]) if last else 0
            cols = [np.concatenate(c) for c in zip(last, cols)] if last else cols
            group, row, size, low, high = cols
            size = size.astype(np.int64)
            a = np.arange(max(before, 1), len(group))
            found = np.zeros(len(group), np.int64)
            for k in range(1, BEFORE + 1):
                a = a[(a >= k) & (found[a] < LIKELY)]
                a = a[group[a] == group[a - k]]  # groups are runs of rows: none so far back, none farther
                if not len(a):
                    break
                b = a - k
                near = np.bitwise_count(low[a] ^ low[b]).astype(np.int64) + np.bitwise_count(high[a] ^ high[b]) <= (1 - threshold) / (1 + threshold) * (size[a] + size[b]) + 1e-9
                near &= (np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9) & (row[a] != row[b])
                found[a[near]] += 1
                if near.any():
                    yield pa.RecordBatch.from_arrays([pa.array(row[a[near]]), pa.array(row[b[near]])], ["id", "other"])
            last = [c[-BEFORE:] for c in cols]

    return rows.mapInArrow(run, "id long, other long").distinct()


def _other_pairs(classes: DataFrame, gone: DataFrame, threshold: float) -> DataFrame:
    """(id, other): classes of which the later is not gone (of one doc_id, either).  The smaller set of a pair (that of the smaller id, of two of one size)
    needs a shorter prefix than the larger.  Adaptive execution splits the partitions of frequent tokens."""
    marked = classes.join(small(gone).withColumn("gone", F.lit(True)), "id", "left").withColumn("open", F.col("gone").isNull())
    size, rest = "shiftright({0}_of, 32)", "shiftright({0}_of & 4294967295L, 1)"
    index = f"{size} - {rest} <= {size} - {2 * threshold / (1 + threshold)!r}D * {size} + 1e-9D".format("x")
    both = _prefixes(marked, "x").where(index).join(_prefixes(marked, "y"), "token")
    x, y = size.format("x"), size.format("y")
    differ = f"bit_count(x_low ^ y_low) + bit_count(x_high ^ y_high) <= {(1 - threshold) / (1 + threshold)!r}D * ({x} + {y}) + 1e-9D"
    places = f"least({rest.format('x')}, {rest.format('y')}) >= {threshold / (1 + threshold)!r}D * ({x} + {y}) - 1e-9D"
    both = both.where(f"{differ} and ({x} < {y} or ({x} = {y} and x_id < y_id)) and {x} >= {threshold}D * {y} - 1e-9D and {places} and (case when x_doc > y_doc then x_of when x_doc < y_doc then y_of else x_of | y_of end & 1L) = 1L")
    return both.select(F.col("x_id").alias("id"), F.col("y_id").alias("other")).distinct()


def kept_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, th: hash of the text, line) of every line with words that stays."""
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    docs = docs.withColumn("th", F.coalesce(F.xxhash64("text"), F.lit(0)))

    def made() -> DataFrame:
        worded = cut(_worded(docs))
        return _classes(worded, _rarity(worded), threshold)

    classes = settle(made)
    gone = settle(lambda: _similar(_first_pairs(classes, threshold), classes, docs, threshold))
    more = settle(lambda: _similar(_other_pairs(classes, gone, threshold), classes, docs, threshold, gone))
    gone = gone.unionByName(more)
    return classes.select("id", "doc_id", "th", "line").join(small(gone), "id", "left_anti").drop("id")


def dedup_documents(docs: DataFrame, threshold: float = 0.8, drop_emptied: bool = False) -> DataFrame:
    """All rows and columns of docs, `text` without the lines that go, with n_lines_removed (null text: null, 0).
    drop_emptied: without the rows that lose every line with words."""
    docs = docs.drop("n_lines_removed")
    names = docs.columns
    kept = kept_lines(docs, threshold).groupBy("doc_id", "th").agg(F.collect_list("line").alias("__geoloom_kept"))
    kept = kept.withColumnsRenamed({"doc_id": "__geoloom_d", "th": "__geoloom_h"})
    th = F.coalesce(F.xxhash64(docs["text"].cast("string")), F.lit(0))
    # a row a document on the kept side, so that its share of a partition fits in a hash table and no text is sorted
    kept = kept.hint("shuffle_hash")
    out = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["__geoloom_d"]) & (th == kept["__geoloom_h"]), "left")
    stays = F.coalesce("__geoloom_kept", F.array().cast("array<int>"))
    lines = F.split(docs["text"], "\n", -1)
    left = F.filter(lines, lambda x, i: F.array_contains(F.col("__geoloom_stays"), i) | ~x.rlike(r"[\p{L}\p{N}]"))
    out = out.withColumn("__geoloom_stays", stays).withColumn("__geoloom_left", left)
    removed = F.coalesce(F.size(lines) - F.size("__geoloom_left"), F.lit(0))
    if drop_emptied:
        out = out.where((F.size("__geoloom_stays") > 0) | (F.coalesce(F.size("__geoloom_left") == F.size(lines), F.lit(True))))
    return out.select(*[F.array_join("__geoloom_left", "\n").alias("text") if c == "text" else F.col(c) for c in names], removed.cast("long").alias("n_lines_removed"))
