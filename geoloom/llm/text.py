"""Vectorised word, shingle and hash primitives shared by the text operators.

A *word* is a maximal run without ASCII white space, lower-cased, with everything that is neither
a letter nor a digit stripped from both ends; what is empty then is no word.  A null text
counts as the empty text.  Words and shingles are carried as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import ctypes
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once in a Python worker; bounds its memory whatever the batch holds.
CHUNK_BYTES = 2 << 20
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_TRIM = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def u64(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's published constants)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + u64(0x9E3779B97F4A7C15 * (seed + 1))
        x = (x ^ (x >> np.uint64(30))) * u64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * u64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None
_BYTES = mix(np.arange(256), 17)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column without nulls."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")


def trim() -> None:
    """Give freed memory back to the system: workers live on, and share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def lean(run):
    """A function over batches that gives its memory back when its partition is done, also what it held in tables."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole


def chunks(batch: pa.RecordBatch, name: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, each with about `most` bytes of text or a single row."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
    trim()


def offsets_of(lists: pa.Array) -> np.ndarray:
    off = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    return off - off[0]


def hashes(strings: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of each string: of its bytes through a fixed table, weighted by place."""
    strings = strings.cast(pa.large_string())
    n = len(strings)
    ends = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    off = ends - ends[0]
    size = np.diff(off)
    with np.errstate(over="ignore"):
        step = np.full(int(size.max(initial=0)) + 1, u64(0x9E3779B97F4A7C15), np.uint64)
        step[0] = 1
        power = np.multiply.accumulate(step)
        value = _BYTES[data] * power[np.arange(len(data)) - np.repeat(off[:-1], size)]
        return mix(segments(np.add, value, off, np.uint64(0)) + size.astype(np.uint64))


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of every word, offsets of the texts in them, hash of every code).  Codes are ascending by hash."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    off = offsets_of(lists)
    flat = lists.flatten()
    if not len(flat):
        return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64), np.empty(0, np.uint64)
    raw = flat.dictionary_encode()
    trimmed = _trimmed(raw.dictionary)
    keep = pc.greater(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    known, place = np.unique(hashes(trimmed), return_inverse=True)
    codes = raw.indices.to_numpy(zero_copy_only=False)
    if keep.all():
        return place[codes], off, known
    kept = keep[codes]
    return place[codes[kept]], np.concatenate([[0], np.cumsum(kept)])[off], known


def _trimmed(names: pa.Array) -> pa.Array:
    """Without what is neither letter nor digit at either end; most names have none, or marks that need no pattern, and only
    the others are searched."""
    names = pc.ascii_trim(names, characters=_MARKS)
    other = pc.invert(pc.utf8_is_alnum(names))
    at = np.flatnonzero(other.to_numpy(zero_copy_only=False))
    if not len(at):
        return names
    return pc.replace_with_mask(names, other, pc.replace_substring_regex(names.take(pa.array(at)), pattern=_TRIM, replacement=""))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of the texts in it)."""
    code, off, known = coded(texts)
    return known[code] if len(code) else np.empty(0, np.uint64), off


def plain_words(text: str | None) -> list[str]:
    """The same words one text at a time, for tests and fixtures."""
    out = []
    for raw in re.split(r"[ \t\n\r\f\v]+", (text or "").lower()):
        kept = [i for i, ch in enumerate(raw) if ch.isalpha() or ch.isnumeric()]
        if kept:
            out.append(raw[kept[0] : kept[-1] + 1])
    return out


def shingles(word: np.ndarray, off: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every k-word shingle in order, offsets).  A text of 1 to k-1 words has one shingle of all of them."""
    length = np.diff(off)
    count = np.where(length >= k, length - k + 1, np.minimum(length, 1))
    out_off = np.concatenate([[0], np.cumsum(count)])
    total = int(out_off[-1])
    if not total:
        return np.empty(0, np.uint64), out_off
    with np.errstate(over="ignore"):
        at = np.repeat(off[:-1] - out_off[:-1], count) + np.arange(total)
        end = np.repeat(off[1:], count)
        out = np.zeros(total, np.uint64)
        padded = np.concatenate([word, np.zeros(k, np.uint64)])
        for j in range(k):
            part = mix(padded, j + 1)[at + j]
            out += np.where(at + j < end, part, np.uint64(0))
    return mix(out), out_off


def plain_shingles(text: str | None, k: int = 5) -> set[tuple[str, ...]]:
    w = plain_words(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def segments(reduce: np.ufunc, values: np.ndarray, off: np.ndarray, empty) -> np.ndarray:
    """reduce over each [off[i], off[i+1]); `empty` where that is empty."""
    out = np.full(len(off) - 1, empty, values.dtype)
    full = np.diff(off) > 0
    if full.any():
        out[full] = reduce.reduceat(values, off[:-1][full])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[0]..starts[0]+lengths[0]-1, starts[1].., joined."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.repeat(starts - before, lengths) + np.arange(total)


def distinct(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each segment's distinct values, ascending, with new offsets."""
    n = len(off) - 1
    if n == 1:
        v = np.unique(values)
        return v, np.array([0, len(v)])
    known, code = np.unique(values, return_inverse=True)
    code, new_off = distinct_codes(code, off)
    return known[code], new_off


def distinct_codes(code: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """distinct() for small non-negative integers: one sort of (segment, code)."""
    n = len(off) - 1
    bits = int(code.max(initial=0)).bit_length()
    key = np.repeat(np.arange(n, dtype=np.int64) << bits, np.diff(off)) | code.astype(np.int64)
    key.sort()
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    key = key[first]
    return key & ((1 << bits) - 1), np.concatenate([[0], np.cumsum(np.bincount(key >> bits, minlength=n))]).astype(np.int64)


def list_array(values: np.ndarray, off: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in a stream of batches that is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
