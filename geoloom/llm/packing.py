"""Best-fit packing of token pieces into sequences, by swaps.

Documents are tokenized, closed with an end id and cut into pieces of at most `capacity` tokens.
Pieces are dealt by a hash of their row into shards of at most about `shard_bins` sequences and `shard_items` pieces,
independent of any key, and each shard is packed in one task of bounded size by local search: from a plain placement, items
are moved or exchanged (one for one, one for two, two for one) between underfull bins, each step increasing the sum of
squared fills, until bins empty and go; it ends when the free room is below one bin, where no packing of the shard has
fewer, or when no step is left (then it starts once more, from best fit in decreasing order, and the fewer sequences count).

Null texts are empty (the end id alone); empty tables give no rows; rows that repeat a doc_id are packed each, and lie in any
shards; ties between steps go to the emptiest, then the lowest bin; extra columns are ignored, whatever their names; long texts
are cut, never shortened.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import cut
from .tokens import CACHE, TOKEN_BYTES, encode_each, load, split_marks

CAPACITY = 4096
END_ID = 1


class WordIds:
    """Token ids of texts whose tokenizer never joins across a blank, through a table of distinct words."""

    def __init__(self, path: str, words: int = CACHE):
        self.library, self.words = load(path), words
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = [np.empty(0, np.uint32)]
        self.ends = [np.zeros(1, np.int64)]

    def _places(self, names: pa.Array) -> np.ndarray:
        """The entry of each name in the table."""
        coded = names.dictionary_encode()
        words = coded.dictionary.to_pylist()
        place = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            new = [words[i] for i in fresh]
            alpha = pc.utf8_is_alpha(coded.dictionary.take(pa.array(fresh))).to_numpy(zero_copy_only=False)
            ids, off = encode_each(self.library, new, alpha, "")
            place[fresh] = np.arange(len(self.at), len(self.at) + len(new))
            self.at.update(zip(new, place[fresh].tolist()))
            self.flat.append(ids)
            self.ends.append(off[1:] + self.ends[-1][-1])
        return place[coded.indices.to_numpy(zero_copy_only=False)]

    def _ids_of(self, names: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all names joined, offsets)."""
        if len(self.at) > self.words:
            self._clear()
        core, tail = split_marks(names)
        place = np.stack([self._places(core), self._places(tail)], 1).ravel()
        self.flat, self.ends = [np.concatenate(self.flat)], [np.concatenate(self.ends)]
        start = self.ends[0][place]
        length = self.ends[0][place + 1] - start
        return self.flat[0][tx.ragged(start, length)], np.concatenate([[0], np.cumsum(length)])[::2]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by end_id; offsets)."""
        lists = pc.split_pattern(pc.ascii_lower(pc.replace_substring(texts, "\n", " ")), " ")
        off = tx.offsets_of(lists)
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        ids, ends = self._ids_of(coded.dictionary)
        start, length = ends[code], np.diff(ends)[code]
        before = np.concatenate([[0], np.cumsum(length)])[off]
        out_off = before + np.arange(len(off))
        out = np.full(int(out_off[-1]), end_id, np.uint32)
        mine = np.ones(len(out), bool)
        mine[out_off[1:] - 1] = False
        out[mine] = ids[tx.ragged(start, length)]
        return out, out_off


_TABLES: dict[tuple[str, int], WordIds] = {}


def _worker_table(path: str, words: int) -> WordIds:
    """The worker's table for a tokenizer: it outlives a task, so that a worker reads the tokenizer and learns a word once."""
    if (path, words) not in _TABLES:
        _TABLES.clear()
        _TABLES[path, words] = WordIds(path, words)
    return _TABLES[path, words]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, words: int = CACHE, chunk: int = TOKEN_BYTES, keep: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of docs(doc_id, text).  A worker remembers up
    to `words` words, keeps them between tasks (or not), and looks at `chunk` bytes of text at a time."""

    @tx.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _worker_table(tokenizer, words) if keep else WordIds(tokenizer, words)
        for batch in batches:
            for part in tx.chunks(batch, "text", chunk):
                ids, off = table.encode(tx.column(part, "text"), end_id)
                size = np.diff(off)
                count = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), count)
                piece = tx.ragged(np.zeros(len(size), np.int64), count)
                start = piece * capacity
                length = np.minimum(capacity, size[row] - start)
                at = off[row] + start
                raw = ids.astype("<u4", copy=False)
                crc = np.fromiter((zlib.crc32(raw[a : a + n].tobytes()) for a, n in zip(at.tolist(), length.tolist())), np.int64, len(row))
                cols = [part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
                if with_ids:
                    cols.append(tx.list_array(ids.astype(np.int32), np.append(at, off[-1])))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, schema)


class _Bins:
    """Bins of item sizes; those with items are found by their free room."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.free = capacity, [], []
        self.by_free: dict[int, dict[int, None]] = defaultdict(dict)
        self.mask = 0

    def _index(self, b: int) -> None:
        if self.items[b]:
            self.by_free[self.free[b]][b] = None
            self.mask |= 1 << self.free[b]

    def _unindex(self, b: int) -> None:
        f = self.free[b]
        self.by_free[f].pop(b, None)
        if not self.by_free[f]:
            self.mask &= ~(1 << f)

    def tightest(self, size: int, but: int = -1) -> int:
        """A bin other than `but` with the least free room of at least `size` (of several, the one that has had it longest),
        or -1."""
        rest = self.mask >> size
        while rest:
            f = (rest & -rest).bit_length() - 1 + size
            for b in self.by_free[f]:
                if b != but:
                    return b
            rest = self.mask >> (f + 1)
            size = f + 1
        return -1

    def new(self) -> int:
        self.items.append([])
        self.free.append(self.capacity)
        return len(self.free) - 1

    def add(self, b: int, item: int, size: int) -> None:
        self._unindex(b)
        self.items[b].append(item)
        self.free[b] -= size
        self._index(b)

    def take(self, b: int, item: int, size: int) -> None:
        self._unindex(b)
        self.items[b].remove(item)
        self.free[b] += size
        self._index(b)

    def underfull(self) -> list[int]:
        """Bins with items and free room, emptiest first."""
        return sorted((b for b in range(len(self.items)) if self.items[b] and self.free[b]), key=lambda b: (-self.free[b], b))


def placed(size: list[int], capacity: int) -> _Bins:
    """Where the search starts: items in their order, each in the latest bin, or a new one if it has no room."""
    bins = _Bins(capacity)
    for i, s in enumerate(size):
        b = len(bins.items) - 1
        bins.add(b if b >= 0 and bins.free[b] >= s else bins.new(), i, s)
    return bins


def best_fit(size: list[int], capacity: int) -> _Bins:
    """The other start: items in decreasing order, each in the tightest room."""
    bins = _Bins(capacity)
    for i in sorted(range(len(size)), key=lambda i: (-size[i], i)):
        b = bins.tightest(size[i])
        bins.add(bins.new() if b < 0 else b, i, size[i])
    return bins


def pack(sizes: np.ndarray, capacity: int = CAPACITY, patience: int | None = None, steps: dict[str, int] | None = None) -> list[list[int]]:
    """Bins as lists of indices into sizes (each at most capacity), by local search from a plain placement in order; where that
    leaves more bins than the least number that could do, also from best fit in decreasing order, and the fewer bins count (ties: the
    first).  `patience` ends a search after so many rounds; no item is ever left out.  `steps` counts the steps of each kind."""
    size = [int(s) for s in sizes]
    least = -(sum(size) // -capacity)
    best: list[list[int]] | None = None
    for start in (placed, best_fit):
        found = improve(start(size, capacity), size, least, patience, {} if steps is None else steps)
        if best is None or len(found) < len(best):
            best = found
        if len(best) <= least:
            break
    return best


def improve(bins: _Bins, size: list[int], least: int, patience: int | None, steps: dict[str, int]) -> list[list[int]]:
    """Local search: steps that move an item between underfull bins, or exchange one for one, one for two or two for one, each
    of which makes the sum of squared fills grow, until bins empty.  It ends when no underfull bin has such a step with any
    other, or the bins are as few as can be."""
    spare = len(bins.items) - least
    offers: list[_Offers] = []

    def moves(donor: int) -> bool:
        """Moves of the donor's items into the tightest rooms, largest first, as long as they make a fuller bin."""
        some = False
        for i in sorted(bins.items[donor], key=lambda i: -size[i]):
            b = bins.tightest(size[i], donor)
            if b >= 0 and bins.free[b] - size[i] < bins.free[donor]:
                bins.take(donor, i, size[i])
                bins.add(b, i, size[i])
                steps["move"] = steps.get("move", 0) + 1
                some = True
        return some

    def exchanges(donor: int) -> bool:
        """Steps of all kinds, found in tables of what underfull bins would hand back: none or one item, and only when
        those have none, two."""
        some = False
        while bins.items[donor]:
            if not offers:
                offers.append(_Offers(bins, size, False))
            found = offers[0].best(donor)
            if not found:
                if len(offers) < 2:
                    offers.append(_Offers(bins, size, True))
                found = offers[1].best(donor)
            if not found:
                break
            b, give, take = found
            for j in take:
                bins.take(b, j, size[j])
            for i in give:
                bins.take(donor, i, size[i])
                bins.add(b, i, size[i])
            for j in take:
                bins.add(donor, j, size[j])
            for table in offers:
                table.put(b)
                table.put(donor)
            kind = f"{len(give)} for {len(take)}" if take else "move"
            steps[kind] = steps.get(kind, 0) + 1
            some = True
        return some

    rounds = 0
    for search in (moves, exchanges):
        moved = True
        while moved and spare > 0 and rounds != patience:
            moved = False
            rounds += 1
            for donor in bins.underfull():
                if bins.items[donor] and search(donor):
                    moved = True
                    if not bins.items[donor]:
                        spare -= 1
                        if spare <= 0:
                            break
    return [b for b in bins.items if b]


def _sums(own: list[int]) -> tuple[list[int], list[int]]:
    """The distinct sizes, and the distinct sums of two items."""
    times = Counter(own)
    values = sorted(times)
    pairs = {v + w for n, v in enumerate(values) for w in values[n + 1 :]} | {2 * v for v in values if times[v] > 1}
    return values, sorted(pairs)


class _Offers:
    """What underfull bins would hand back for larger items, by size: nothing or one item, or (pairs) two.  A bin that
    changes is written anew at the end, so a donor that found nothing looks only at what has come since."""

    def __init__(self, bins: _Bins, size: list[int], pairs: bool):
        self.bins, self.size, self.pairs = bins, size, pairs
        self.n = self.live = 0
        self.table = np.empty((4, 1 << 12), np.int32)  # bin (-1: gone), free room, size handed back, items handed back
        self.at: dict[int, tuple[int, int]] = {}
        self.seen: dict[int, int] = {}
        for b in range(len(bins.items)):
            self.put(b)

    def put(self, b: int) -> None:
        """Write bin b anew, as it is now."""
        first, last = self.at.pop(b, (0, 0))
        self.table[0, first:last] = -1
        self.live -= last - first
        self.seen.pop(b, None)
        room = self.bins.free[b]
        if not room or not self.bins.items[b]:
            return
        own = [self.size[i] for i in self.bins.items[b]]
        back = _sums(own)[1] if self.pairs else [0, *sorted(set(own))]
        if self.n + len(back) > self.table.shape[1]:
            self._tidy(len(back))
        end = self.n + len(back)
        self.table[0, self.n : end] = b
        self.table[1, self.n : end] = room
        self.table[2, self.n : end] = back
        self.table[3, self.n : end] = 2 if self.pairs else [0] + [1] * (len(back) - 1)
        self.at[b] = (self.n, end)
        self.live += len(back)
        self.n = end

    def _tidy(self, more: int) -> None:
        kept = self.table[0, : self.n] >= 0
        place = np.concatenate([[0], np.cumsum(kept)])
        grown = np.empty((4, 2 * (self.live + more)), np.int32)
        grown[:, : self.live] = self.table[:, : self.n][:, kept]
        self.table, self.n = grown, self.live
        self.at = {b: (int(place[i]), int(place[j])) for b, (i, j) in self.at.items()}
        self.seen = {b: int(place[i]) for b, i in self.seen.items()}

    def best(self, donor: int) -> tuple[int, list[int], list[int]] | None:
        """(bin, items to give, items to take) of a step that makes the sum of squared fills grow: the largest item
        that can move, into the tightest room; else the exchange with the emptiest bin that fills it most; ties to the lowest bin."""
        where, room, back, many = self.table[:, self.seen.get(donor, 0) : self.n]
        free, width = self.bins.free[donor], self.bins.capacity + 1
        one, two = _sums([self.size[i] for i in self.bins.items[donor]])
        single = np.array([-1, *one])
        most = back + room
        given = single[np.searchsorted(single, most, "right") - 1]
        if not self.pairs:  # for one item, one or two
            either = np.array([-1, *sorted({*one, *two})])
            given = np.where(many == 1, either[np.searchsorted(either, most, "right") - 1], given)
        good = np.flatnonzero((given > back + np.maximum(0, room - free)) & (where >= 0) & (where != donor))
        if not len(good):
            self.seen[donor] = self.n
            return None
        where, room, back, many, given = where[good], room[good].astype(np.int64), back[good], many[good], given[good]
        rank = np.where(many == 0, width * width + given * width + width - room, room * width + given - back)
        i = np.lexsort((many, back, where, -rank))[0]
        b = int(where[i])
        give = self._items(donor, int(given[i]), 1 if given[i] in one else 2)
        return b, give, self._items(b, int(back[i]), int(many[i]))

    def _items(self, b: int, total: int, many: int) -> list[int]:
        """So many items of bin b that are so large together."""
        own = self.bins.items[b]
        if many < 2:
            return [next(i for i in own if self.size[i] == total)] if many else []
        place = {}
        for i in own:
            if total - self.size[i] in place:
                return [place[total - self.size[i]], i]
            place[self.size[i]] = i
        raise AssertionError("no such items")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, shard_bins: int = 4096, shard_items: int = 50_000, words: int = CACHE, chunk: int = TOKEN_BYTES, keep: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs(doc_id, text)."""
    cut_pieces = cut(pieces(docs, tokenizer, capacity, end_id, words=words, chunk=chunk, keep=keep))
    total, count = cut_pieces.agg(F.sum("length"), F.count("*")).first()
    shards = max(1, round((total or 0) / capacity / shard_bins), -(-count // shard_items))

    @tx.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tx.groups(batches, ["shard"]):
            table = table.combine_chunks().sort_by([(c, "ascending") for c in ("doc_id", "piece", "start", "length", "ids_crc32")])
            length = table["length"].to_numpy()
            shard = int(table["shard"][0].as_py())
            order, seq, offset = [], [], []
            for n, items in enumerate(pack(length, capacity)):
                at = 0
                for i in items:
                    order.append(i)
                    seq.append((shard << 40) + n)
                    offset.append(at)
                    at += int(length[i])
            out = table.drop_columns(["shard"]).take(pa.array(order, pa.int64()))
            out = out.append_column("sequence_id", pa.array(seq, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
            yield from out.combine_chunks().to_batches()

    # the row's number in the written table deals out rows that repeat a document, too
    dealt = cut_pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards)))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
