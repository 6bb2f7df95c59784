"""Approximate nearest neighbours by cosine: a robust-pruned directed graph per shard.

Equal vectors are one point, which keeps the least ids only as far as k and the query's own id need (more could
not be among the k nearest, as ties go to the smaller id), so copies cost nothing.  Points are dealt by a hash of the
vector into shards of about `shard_points`; points of one direction are one node of their shard's graph.  Nodes enter the
graph in batches: a greedy search from the medoid proposes neighbours, pruning with relaxed distances (a candidate goes if
a kept neighbour is `alpha` times nearer to it than the node is) keeps diverse edges, and edges back are pruned the same way.
Every query goes to every shard and streams past its graph; a beam search finds nodes there, whose vectors are scored
in double precision as they are given; the best k over all shards are the result, ties to the smaller vec_id.  Where ties may be more
than the beam holds, the query scans the shard instead.

Vectors that are null, empty, zero, or hold null or non-finite components take no part; vectors of different
lengths are not compared; rows without an id take no part; rows that repeat an id and vector count once; empty tables give
empty results; extra columns are ignored, whatever their names; long vectors are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .store import cut

#: Points in a shard; a graph of 20,000 points of 64 numbers takes 20 MB of a task.
SHARD_POINTS = 20_000
#: Queries that stream past one copy of a shard's graph.
QUERY_BLOCK = 50_000
DEGREE = 28
BUILD_BEAM = 48
SEARCH_BEAM = 96
ALPHA = 1.2


def _search(x: np.ndarray, near: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries at once: ids and squared distances, nearest first (id -1: none)."""
    n = len(queries)
    rows = np.arange(n)
    ids = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, np.float32)
    done = np.zeros((n, beam), bool)
    seen = np.zeros((n, len(x)), bool)
    ids[:, 0], seen[:, entry] = entry, True
    dist[:, 0] = 2 - 2 * queries @ x[entry]
    while True:
        open_ = np.where(done | (ids < 0), np.inf, dist)
        pick = open_.argmin(1)
        live = np.isfinite(open_[rows, pick])
        if not live.any():
            return ids, dist
        r = rows[live]
        done[r, pick[live]] = True
        fresh = near[ids[r, pick[live]]]
        ok = fresh >= 0
        safe = np.where(ok, fresh, 0)
        ok &= ~seen[r[:, None], safe]
        seen[r[:, None], safe] |= ok
        d = 2 - 2 * np.einsum("bnd,bd->bn", x[safe], queries[r])
        d[~ok] = np.inf
        all_d = np.concatenate([dist[r], d], 1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[r] = np.take_along_axis(all_d, best, 1)
        ids[r] = np.where(np.isfinite(dist[r]), np.take_along_axis(np.concatenate([ids[r], fresh], 1), best, 1), -1)
        done[r] = np.take_along_axis(np.concatenate([done[r], np.zeros(fresh.shape, bool)], 1), best, 1)


def _prune(x: np.ndarray, points: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each point, up to `degree` of its candidates (-1: none), near and diverse."""
    n = len(points)
    rows = np.arange(n)
    cand = np.where(cand == points[:, None], -1, cand)
    order = np.sort(cand, 1)
    # a candidate listed twice counts once
    cand = np.where(np.concatenate([np.zeros((n, 1), bool), order[:, 1:] == order[:, :-1]], 1), -1, order)
    vec = x[np.maximum(cand, 0)]
    dist = 2 - 2 * np.einsum("bnd,bd->bn", vec, x[points])
    dist = np.where(cand >= 0, dist, np.inf)
    alive = np.isfinite(dist)
    out = np.full((n, degree), -1, np.int64)
    for j in range(degree):
        d = np.where(alive, dist, np.inf)
        pick = d.argmin(1)
        ok = np.isfinite(d[rows, pick])
        if not ok.any():
            break
        out[ok, j] = cand[rows, pick][ok]
        between = 2 - 2 * np.einsum("bnd,bd->bn", vec, vec[rows, pick])
        # squared distances, so alpha counts squared
        alive &= ~((alpha * alpha * between <= dist) & ok[:, None])
        alive[rows, pick] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """(neighbours of every unit vector in x, -1 where fewer; the point where searches start)."""
    n = len(x)
    near = np.full((n, degree), -1, np.int64)
    entry = int((x @ x.mean(0)).argmax()) if n else 0
    order = np.random.default_rng(11).permutation(n)
    order = np.concatenate([[entry], order[order != entry]]) if n else order
    at, size = 1, 1
    while at < n:
        batch = order[at : at + size]
        at, size = at + size, min(2 * size, 400, max(1, at // 2) if at > 64 else 2 * size)
        found, _ = _search(x, near, entry, x[batch], beam)
        near[batch] = _prune(x, batch, found, degree, alpha)
        src = np.repeat(batch, degree)
        dst = near[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        target, start, count = np.unique(dst, return_index=True, return_counts=True)
        used = (near[target] >= 0).sum(1)
        for t, s, c, u in zip(target[used + count <= degree], start[used + count <= degree], count[used + count <= degree], used[used + count <= degree]):
            near[t, u : u + c] = src[s : s + c]
        full = np.flatnonzero(used + count > degree)
        full = full[np.argsort(count[full], kind="stable")]
        for i in range(0, len(full), 400):
            own = full[i : i + 400]
            width = int(count[own].max())
            fresh = np.full((len(own), width), -1, np.int64)
            for row, o in enumerate(own):
                fresh[row, : count[o]] = src[start[o] : start[o] + count[o]]
            near[target[own]] = _prune(x, target[own], np.concatenate([near[target[own]], fresh], 1), degree, alpha)
    return near, entry


def _vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(ids, vectors as bytes of doubles, lengths) of the rows that take part."""
    lists = batch.column(1)
    off = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.values.slice(int(off[0]), int(off[-1] - off[0]))
    off = off - off[0]
    values = pc.fill_null(flat, float("nan")).to_numpy(zero_copy_only=False)
    good = lists.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
    good &= tx.segments(np.logical_and, np.isfinite(values), off, False) & tx.segments(np.logical_or, values != 0, off, False)
    rows = np.flatnonzero(good)
    size = np.diff(off)[rows]
    data = np.ascontiguousarray(values[tx.ragged(off[rows], size)], np.float64)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64) * 8
    vec = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return batch.column(0).take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64), vec.cast(pa.binary()), size.astype(np.int32)


def _points(vectors: DataFrame, k: int) -> DataFrame:
    """(vec: doubles as bytes, dim, ids: its least ids, at most k + 1) of every distinct vector that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vec, dim = _vectors(batch)
            coded = vec.dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((ids, code))
            code, own = code[order], ids[order]
            first = np.ones(len(code), bool)
            first[1:] = (code[1:] != code[:-1]) | (own[1:] != own[:-1])
            code, own, order = code[first], own[first], order[first]
            start = np.searchsorted(code, np.arange(len(coded.dictionary)))
            least = np.arange(len(code)) - start[code] <= k
            count = np.bincount(code[least], minlength=len(start))
            lists = tx.list_array(own[least], np.concatenate([[0], np.cumsum(count)]))
            yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(dim[order[start]]), lists], ["vec", "dim", "ids"])

    rows = vectors.select(vectors["vec_id"].cast("long"), vectors["embedding"].cast("array<double>"))
    part = rows.mapInArrow(run, "vec binary, dim int, ids array<long>")
    return part.groupBy("vec").agg(F.first("dim").alias("dim"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))


def _asked(queries: DataFrame) -> DataFrame:
    """(query_id, vec, dim) of every row that takes part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vec, dim = _vectors(batch)
            yield pa.RecordBatch.from_arrays([pa.array(ids), vec, pa.array(dim)], ["query_id", "vec", "dim"])

    return queries.select(queries["vec_id"].cast("long"), queries["embedding"].cast("array<double>")).mapInArrow(run, "query_id long, vec binary, dim int")


def _scaled(raw: np.ndarray) -> np.ndarray:
    """The vectors times powers of two that bring their largest component near one: no cosine changes, no square overflows."""
    _, e = np.frexp(np.abs(raw).max(1))
    return np.ldexp(raw, -e[:, None])


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = _scaled(raw)
    return (raw / np.sqrt((raw * raw).sum(1, keepdims=True))).astype(np.float32)


def _nodes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points in the order of nodes, offsets of the nodes in them, first point of each): vectors of one direction are one node."""
    names, node = np.unique(np.ascontiguousarray(unit).view(np.dtype((np.void, unit.shape[1] * 4))).ravel(), return_inverse=True)
    order = np.argsort(node, kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=len(names)))])
    return order, ends, order[ends[:-1]]


def build_index(vectors: DataFrame, k: int, shard_points: int = SHARD_POINTS) -> DataFrame:
    """A row for each shard: dim, shard, shards, and its graph (vectors by node, nodes, ids, neighbours, entry) as bytes."""
    points = cut(_points(vectors, k))
    sizes = points.groupBy("dim").agg(F.ceil(F.count("*") / shard_points).cast("int").alias("shards"))
    dealt = points.join(sizes, "dim").withColumn("shard", F.pmod(F.xxhash64("vec"), F.col("shards")).cast("int"))
    total = sizes.agg(F.sum("shards")).first()[0] or 1
    dealt = dealt.repartition(int(2 * total), "dim", "shard").sortWithinPartitions("dim", "shard", "vec")

    @tx.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tx.groups(batches, ["dim", "shard"]):
            dim = table["dim"][0].as_py()
            raw = np.frombuffer(b"".join(table["vec"].to_pylist()), np.float64).reshape(-1, dim)
            unit = _unit(raw)
            order, ends, first = _nodes(unit)
            near, entry = build(unit[first])
            ids = table["ids"].to_pylist()
            ids = [ids[i] for i in order]
            cols = {
                "dim": pa.array([dim], pa.int32()), "shard": pa.array([table["shard"][0].as_py()], pa.int32()), "shards": pa.array([table["shards"][0].as_py()], pa.int32()), "entry": pa.array([entry], pa.int32()),
                "vectors": pa.array([raw[order].tobytes()], pa.binary()), "nodes": pa.array([ends.astype(np.int32).tobytes()], pa.binary()), "near": pa.array([near.astype(np.int32).tobytes()], pa.binary()),
                "ids": pa.array([np.array([i for own in ids for i in own], np.int64).tobytes()], pa.binary()), "n_ids": pa.array([np.array([len(own) for own in ids], np.int32).tobytes()], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(cols)

    return cut(dealt.mapInArrow(run, f"dim int, shard int, shards int, entry int, {', '.join(c + ' binary' for c in _GRAPH)}"))


_GRAPH = ("vectors", "nodes", "near", "ids", "n_ids")


class Shard:
    """One shard's graph, and the exact scores of what a search in it meets."""

    def __init__(self, dim: int, entry: int, vectors: bytes, nodes: bytes, near: bytes, ids: bytes, n_ids: bytes):
        self.raw = _scaled(np.frombuffer(vectors, np.float64).reshape(-1, dim))
        self.norm = np.sqrt((self.raw * self.raw).sum(1))
        self.ends = np.frombuffer(nodes, np.int32).astype(np.int64)
        self.x = (self.raw[self.ends[:-1]] / self.norm[self.ends[:-1], None]).astype(np.float32)
        self.near = np.frombuffer(near, np.int32).reshape(len(self.x), -1)
        self.ids = np.frombuffer(ids, np.int64)
        self.id_ends = np.concatenate([[0], np.cumsum(np.frombuffer(n_ids, np.int32))])
        self.entry = entry

    def best(self, v: np.ndarray, own_id: int, k: int, nodes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k nearest among some nodes' vectors (all, if None), ties to the smaller id."""
        if nodes is None:
            points = np.arange(len(self.raw))
        else:
            points = tx.ragged(self.ends[nodes], self.ends[nodes + 1] - self.ends[nodes])
        score = (self.raw[points] * v).sum(1) / (self.norm[points] * np.sqrt((v * v).sum()))
        count = self.id_ends[points + 1] - self.id_ends[points]
        ids = self.ids[tx.ragged(self.id_ends[points], count)]
        score = np.repeat(score, count)
        other = ids != own_id
        ids, score = ids[other], score[other]
        order = np.lexsort((ids, -score))[:k]
        return ids[order], score[order]

    def nearest(self, q: np.ndarray, own_ids: np.ndarray, k: int, beam: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, scores) of every query.  Where the beam is full of what is as near as the k-th, so that it may hide others
        as near, the shard is scanned."""
        q = _scaled(q)
        for a in range(0, len(q), 256):
            found, dist = _search(self.x, self.near, self.entry, _unit(q[a : a + 256]), beam)
            for row, (nodes, d) in enumerate(zip(found, dist)):
                v, own_id = q[a + row], own_ids[a + row]
                some = nodes[nodes >= 0]
                near = np.sort(d)
                tied = len(some) == beam < len(self.x) and near[-1] <= near[min(k, beam - 1)] + 1e-5
                yield own_id, *self.best(v, own_id, k, None if tied else some)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, beam: int = SEARCH_BEAM, shard_points: int = SHARD_POINTS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries(vec_id, embedding) the k rows of vectors found nearest,
    but for rows with the query's own id."""
    index = build_index(vectors, k, shard_points)
    asked = cut(_asked(queries).distinct())
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    shards = index.select("dim", "shards").distinct()
    asked = asked.join(shards, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = graphs.withColumn("query_id", F.lit(None).cast("long")).withColumn("vec", F.lit(None).cast("binary")).unionByName(asked.drop("shards"), allowMissingColumns=True)
    both = both.repartition("dim", "shard", "block").sortWithinPartitions("dim", "shard", "block", F.col("query_id").asc_nulls_first())

    @tx.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, dim = None, 0
        for batch in batches:  # a graph stands before its queries, which stream past it
            starts = np.flatnonzero(~batch.column(8).is_valid().to_numpy(zero_copy_only=False))
            for a, b in zip([0, *starts.tolist()], [*starts.tolist(), batch.num_rows]):
                if a in starts:
                    dim = batch.column(0)[a].as_py()
                    shard = Shard(dim, batch.column(2)[a].as_py(), *(batch.column(i)[a].as_py() for i in range(3, 8)))
                    a += 1
                if a >= b:
                    continue
                part = batch.slice(a, b - a)
                q = np.frombuffer(b"".join(part.column(9).to_pylist()), np.float64).reshape(-1, dim)
                out = list(shard.nearest(q, part.column(8).to_numpy(), k, beam))
                count = [len(i) for _, i, _ in out]
                cols = [np.repeat([o[0] for o in out], count), np.concatenate([o[1] for o in out]), np.concatenate([o[2] for o in out])]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = both.select("dim", "block", "entry", *_GRAPH, "query_id", "vec").mapInArrow(run, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
