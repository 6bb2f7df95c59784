"""Token counts by prefix dynamic programming.

The count at a prefix is the count at an earlier prefix plus that of the tokens between them:
over a text, from chunk to chunk (a chunk starts at a single blank between visible characters,
where byte-level BPE always starts a new piece); inside a piece, from token to token (the last
token of every prefix's encoding is stored, so each prefix's encoding is that of a shorter prefix
plus one token).  n_tokens and over_limit are look-ups in those tables, as are truncation and budget questions.

Nulls count as empty texts (0 tokens); empty tables give empty results; repeated rows are counted
each; extra columns are ignored, whatever their names; long texts are counted whole; there are no ties.  Texts whose blanks stand beside other white space, and texts with
special tokens, are summed up piece by piece.
"""

from __future__ import annotations

import bisect
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import text as tx

#: Distinct chunks remembered by a worker before it starts afresh; bounds its memory.
CACHE = 1_000_000
#: Bytes of text whose distinct words are looked up at once.
TOKEN_BYTES = 6 << 20
#: Words encoded as one text.
RUN = 256
_WHITE = r"[\pZ\s\x0b\x1c-\x1f\x{85}]"
_ODD = rf"{_WHITE} {_WHITE}|  |^ | $|^$|<\|"


#: Closing marks that both tokenizers take as a piece of their own after letters.
MARKS = ".,;:!?"


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_each(library, parts: list[str], alpha: np.ndarray, lead: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all parts joined, offsets), each part encoded as lead + part.  Parts of letters alone (alpha) are
    encoded many at a time, as words of one text, which is what the tokenizer makes of them."""
    words = np.flatnonzero(alpha)
    runs = [words[i : i + RUN] for i in range(0, len(words), RUN)]
    flat, sizes, order, alone = [], [], [], [np.flatnonzero(~alpha)]
    for run, e in zip(runs, library.encode_batch([lead + " ".join([parts[i] for i in run]) for run in runs], add_special_tokens=False)):
        word = np.asarray(e.word_ids, np.int64)
        if not len(word) or word[-1] != len(run) - 1:  # the library sees other words in it: one by one
            alone.append(run)
            continue
        flat.append(np.asarray(e.ids, np.uint32))
        sizes.append(np.bincount(word, minlength=len(run)))
        order.append(run)
    rest = np.concatenate(alone)
    ids = [e.ids for e in library.encode_batch([lead + parts[i] for i in rest], add_special_tokens=False)]
    sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
    flat.append(np.fromiter((i for own in ids for i in own), np.uint32, int(sizes[-1].sum())))
    order.append(rest)
    where = np.concatenate(order)
    size = np.concatenate(sizes)
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else size
    place = np.empty(len(parts), np.int64)
    place[where] = np.arange(len(parts))
    return np.concatenate(flat)[tx.ragged(start[place], size[place])], np.concatenate([[0], np.cumsum(size[place])])


def split_marks(names: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Each name without its closing marks, if that is letters alone (else whole), and the marks taken off.  Letters are
    those that all Unicode tables and normalisers agree on: a name outside their old ranges, or with other than letters when it
    is composed and in lower case, stays whole."""
    bare = pc.utf8_rtrim(names, characters=MARKS)
    letters = pc.utf8_is_alpha(bare)
    marked = pc.not_equal(pc.binary_length(bare), pc.binary_length(names))
    wide = np.flatnonzero(pc.and_(pc.and_(letters, marked), pc.invert(pc.string_is_ascii(bare))).to_numpy(zero_copy_only=False))
    if len(wide):
        sure = letters.to_numpy(zero_copy_only=False).copy()
        sure[wide] = [max(n) < "\u0530" and unicodedata.normalize("NFC", n).lower().isalpha() for n in bare.take(pa.array(wide)).to_pylist()]
        letters = pa.array(sure)
    core = pc.if_else(letters, bare, names)
    cut = pc.subtract(pc.binary_length(names), pc.binary_length(core)).to_numpy(zero_copy_only=False)
    tails = np.full(len(names), "", object)
    some = np.flatnonzero(cut)
    tails[some] = [n[-k:] for n, k in zip(names.take(pa.array(some)).to_pylist(), cut[some].tolist())]
    return core, pa.array(tails, pa.large_string())


class PiecePrefixes:
    """Token counts at every prefix of a piece (in the byte-level alphabet), by the recurrence on the last token: it is the one
    token that ends the prefix, is encoded as itself, and stays apart from the last token of what is before it."""

    def __init__(self, library):
        import json

        spec = json.loads(library.to_str())
        model = spec["model"]
        if spec["normalizer"] or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or model.get("ignore_merges"):
            raise ValueError("prefix counts need a byte-level BPE without normaliser")
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        made = {a + b for a, b in merges}
        if len(made) < len(merges):
            raise ValueError("a token is made by two merges")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.names = [t for t in model["vocab"] if t not in made and t not in self.special]
        self.first = len(self.names)  # tokens are numbered by rank, after the bytes
        self.names += [a + b for a, b in merges]
        self.number = {t: i for i, t in enumerate(self.names)}
        self.parts = [(i, i) for i in range(self.first)] + [(self.number[a], self.number[b]) for a, b in merges]
        self.merged = {part: i for i, part in enumerate(self.parts) if i >= self.first}
        self.longest = max(map(len, self.names))
        self.own: dict[int, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.latest: tuple[str, list[int], list[int]] = ("", [0], [0])
        byte = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = dict(zip(byte, byte)) | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(byte))}
        self.pre_tokenizer = library.pre_tokenizer

    def pieces(self, text: str) -> list[str]:
        if text[:1] == " " and text[1:].isalpha() and max(text) < "\u0250":  # one piece, as it has letters alone
            return [text.encode().decode("latin-1").translate(self.alphabet)]
        return [p for p, _ in self.pre_tokenizer.pre_tokenize_str(text)]

    def _whole(self, token: int) -> bool:
        """Whether the text of a token is encoded as just this token."""
        if token not in self.own:
            parts = [self.number[c] for c in self.names[token]]
            while len(parts) > 1:
                best, i = min((self.merged.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if best == 1 << 60:
                    break
                parts[i : i + 2] = [best]
            self.own[token] = parts == [token]
        return self.own[token]

    def _apart(self, a: int, b: int) -> bool:
        """Whether no merge crosses from token a to token b: their merges are undone from the last on, and a pair
        that would have been merged before them crosses."""
        limit = 1 << 60
        merged, parts = self.merged, self.parts
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            if a > b:
                limit = a
                a = parts[a][1]
                if a == limit:
                    limit = b + 1
                    b = parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = parts[b][0]
                if b + 1 == limit:
                    limit = a
                    a = parts[a][1]
                    if a == limit:
                        return True

    def prefixes(self, piece: str) -> list[int]:
        """Token counts of piece[:1], piece[:2], ..."""
        before, last, count = self.latest
        n = len(os.path.commonprefix((before, piece)))  # what a piece shares with the one before it is as it was there
        last, count = last[: n + 1], count[: n + 1]
        known, whole, apart, longest, pairs, width = self.number.get, self._whole, self._apart, self.longest, self.pairs, len(self.names)
        if len(pairs) > CACHE:
            pairs.clear()
        for j in range(n + 1, len(piece) + 1):
            for i in range(max(0, j - longest), j):
                t = known(piece[i:j])
                if t is None or not whole(t):
                    continue
                if i:
                    pair = last[i] * width + t
                    fits = pairs.get(pair)
                    if fits is None:
                        fits = pairs[pair] = apart(last[i], t)
                    if not fits:
                        continue
                last.append(t)
                count.append(count[i] + 1)
                break
            else:
                raise ValueError(f"no token ends {piece[:j]!r}")
        self.latest = piece, last, count
        return count[1:]

    def of_text(self, text: str) -> list[int]:
        """Token counts at every byte of a text without special tokens, piece after piece."""
        out: list[int] = []
        for piece in self.pieces(text):
            before = out[-1] if out else 0
            out += [before + n for n in self.prefixes(piece)] if before else self.prefixes(piece)
        return out


def _packed(counts: list[int]):
    return bytes(counts) if not counts or counts[-1] < 256 else array("I", counts)


class ChunkCounts:
    """Token counts at the prefixes of texts, through a table of the prefix counts of distinct chunks."""

    def __init__(self, path: str):
        self.library = load(path)
        self.dp = PiecePrefixes(self.library)
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.dp.special, key=len, reverse=True))) + ")") if self.dp.special else None
        self.seen: dict[str, bytes | array] = {}

    def _table(self, name: str):
        """Token counts at every byte of a chunk, or of a piece of a text."""
        found = self.seen.get(name)
        if found is None:
            found = self.seen[name] = _packed(self.dp.of_text(name))
        return found

    def _each(self, names: list[str]) -> np.ndarray:
        if len(self.seen) > CACHE:
            self.seen.clear()
        for name in sorted(n for n in names if n not in self.seen):  # neighbours share what they begin with
            self._table(name)
        return np.fromiter((t[-1] if t else 0 for t in map(self._table, names)), np.int64, len(names))

    def _odd(self, text: str) -> tuple[list[int], list[int]]:
        """(bytes, tokens) at the end of every piece or special token of a text."""
        at, total, ends, sums = 0, 0, [], []
        for k, part in enumerate(self.special.split(text) if self.special else [text]):
            for piece in [None] if k % 2 else self.dp.pieces(part):
                at += len(part.encode()) if piece is None else len(piece)
                total += 1 if piece is None else self.dp.prefixes(piece)[-1]
                ends.append(at)
                sums.append(total)
        return ends, sums

    def prefixes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, tokens) at the end of every chunk of all texts, each from its own start, and the offsets of the texts."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~odd))
        lists = pc.split_pattern(plain, " ")
        off = tx.offsets_of(lists)
        flat = lists.flatten()
        first = np.zeros(len(flat), bool)
        first[off[:-1]] = True
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        core, tail = split_marks(coded.dictionary)
        inner = np.zeros(len(coded.dictionary), bool)
        inner[codes[~first]] = True
        count = np.zeros(len(inner), np.int64)
        some = pa.array(np.flatnonzero(inner))
        for part, lead in ((core, " "), (tail, "")):
            distinct = part.take(some).dictionary_encode()
            own = self._each([lead + n for n in distinct.dictionary.to_pylist()])
            count[inner] += own[distinct.indices.to_numpy(zero_copy_only=False)]
        tokens = count[codes]
        heads, where = np.unique(codes[first], return_inverse=True)
        tokens[first] = self._each(coded.dictionary.take(pa.array(heads)).to_pylist())[where]
        size = pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False).astype(np.int64)[codes] + ~first
        n = np.diff(off)
        ends, sums = (np.cumsum(x) for x in (size, tokens))
        start = np.repeat(off[:-1], n)
        ends, sums = (x - (np.concatenate([[0], x])[start]) for x in (ends, sums))
        if not odd.any():
            return ends, sums, off
        others = [self._odd(texts[int(i)].as_py()) for i in np.flatnonzero(odd)]
        length = np.zeros(len(texts), np.int64)
        length[~odd], length[odd] = n, [len(e) for e, _ in others]
        here = np.repeat(odd, length)
        out = np.zeros((2, len(here)), np.int64)
        out[:, ~here] = ends, sums
        out[:, here] = [v for e, _ in others for v in e], [v for _, c in others for v in c]
        return out[0], out[1], np.concatenate([[0], np.cumsum(length)])

    def count(self, texts: pa.Array) -> np.ndarray:
        """Token counts of whole texts: the last entries of their tables."""
        return self.totals(*self.prefixes(texts)[1:])

    @staticmethod
    def totals(sums: np.ndarray, off: np.ndarray) -> np.ndarray:
        return np.where(np.diff(off) > 0, np.concatenate([sums, [0]])[off[1:] - 1], 0)


_TABLES: dict[str, ChunkCounts] = {}


def _worker_table(path: str) -> ChunkCounts:
    """The worker's table for a tokenizer: it outlives a task, so that a worker reads the tokenizer and learns a word once."""
    if path not in _TABLES:
        _TABLES.clear()
        _TABLES[path] = ChunkCounts(path)
    return _TABLES[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) and bytes_in_limit (bytes of the longest start of the text, in whole
    words, that the first `limit` tokens cover; n_bytes if that is all) of every row of docs(doc_id, text)."""

    @tx.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _worker_table(tokenizer)
        for batch in batches:
            for part in tx.chunks(batch, "text", TOKEN_BYTES):
                texts = tx.column(part, "text")
                ends, sums, off = table.prefixes(texts)
                n = table.totals(sums, off)
                passed = np.concatenate([[0], np.cumsum(sums > limit)])  # a text is over the limit where a prefix is
                over = np.diff(passed[off]) > 0
                kept = tx.segments(np.maximum, np.where(sums <= limit, ends, 0), off, 0)
                size = pc.binary_length(texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n), pa.array(over), pa.array(kept)], ["doc_id", "n_bytes", "n_tokens", "over_limit", "bytes_in_limit"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, bytes_in_limit long")


class PrefixTable:
    """Exact token counts at every prefix of a text, in bytes, for a byte-level BPE without normaliser.

    Built once; `count(b)` and `longest(budget)` then encode nothing.  Exact for prefixes as texts of
    their own: the piece boundaries before the last two pieces cannot change when a text is cut, and the
    cut tail is looked up piece by piece in the tables made while building.
    """

    def __init__(self, library, text: str):
        self.library = library
        self.dp = PiecePrefixes(library)
        self.made: dict[str, list[int]] = {}
        self.text = text
        self.bounds = [0]
        self.sums = [0]
        for piece, (_, end) in library.pre_tokenizer.pre_tokenize_str(text):
            self.bounds.append(end)
            self.sums.append(self.sums[-1] + self.prefixes(piece)[-1])

    def prefixes(self, piece: str) -> list[int]:
        """Token counts of piece[:1], piece[:2], ..., by the recurrence on the last token."""
        if piece not in self.made:
            self.made[piece] = self.dp.prefixes(piece)
        return self.made[piece]

    def count(self, chars: int) -> int:
        """Tokens of text[:chars]."""
        chars = max(0, min(chars, len(self.text)))
        k = max(0, bisect.bisect_right(self.bounds, chars) - 3)
        tail = self.library.pre_tokenizer.pre_tokenize_str(self.text[self.bounds[k] : chars])
        return self.sums[k] + sum(self.prefixes(p)[-1] for p, _ in tail)

    def longest(self, budget: int) -> int:
        """Characters of the longest prefix, at a piece boundary or inside the next piece, within the budget."""
        k = bisect.bisect_right(self.sums, budget) - 1
        end = self.bounds[k + 1] if k + 1 < len(self.bounds) else len(self.text)
        return max((c for c in range(self.bounds[k], end + 1) if self.count(c) <= budget), default=self.bounds[k])
