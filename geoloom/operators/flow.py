"""Drainage, paths and cellular automata on rasters.

Directions and accumulations work on edges (cell, downstream cell) of a table; upstream sums double the reach every round (pointer jumping), so
the rounds grow with the logarithm of the longest path.  Cost paths are solved in tiles that exchange their edges.  Tables are cut
from their lineage by checkpoints between rounds.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import operator
from ..session import cut
from .grouped import runs
from .raster import AROUND, neighbours

#: Side of a square tile of cost_distance.
_SIDE = 512

#: Direction codes: east 0, then clockwise (as seen with rows downwards) to north-east 7.
DIRECTIONS = {"e": 0, "se": 1, "s": 2, "sw": 3, "w": 4, "nw": 5, "n": 6, "ne": 7}
PIT = 255


@operator("flow")
def d8_direction(cells: DataFrame, size: float = 1.0, filled: bool = False) -> DataFrame:
    """The direction of the steepest fall (diagonals by their length), 255 for pits and flats; ties to the first code.  filled: pits are first
    raised to just above their lowest neighbour."""
    around = neighbours(cells)
    if filled:
        low = F.array_min(F.array_compact(F.array(*[F.col(n) for n in AROUND])))
        cells = around.select("r", "c", F.when((F.col("z") < low) & (F.col("present") == 8), low + 0.001).otherwise(F.col("z")).alias("z"))
        around = neighbours(cells)
    falls = [F.struct(((F.col("z") - F.col(n)) / (size * (2**0.5 if len(n) == 2 else 1.0))).alias("fall"), F.lit(-code).alias("code")) for n, code in sorted(DIRECTIONS.items(), key=lambda d: d[1])]
    best = F.array_max(F.filter(F.array(*falls), lambda s: s["fall"] > 0))
    return around.where("z is not null").select("r", "c", "z", F.coalesce(-best["code"], F.lit(PIT)).alias("dir"))


def downstream(directions: DataFrame) -> DataFrame:
    """Edges (r, c, dr, dc) to the cell each cell drains to, inside the raster."""
    row = F.create_map(*[F.lit(x) for n, code in DIRECTIONS.items() for x in (code, AROUND[n][0])])
    col = F.create_map(*[F.lit(x) for n, code in DIRECTIONS.items() for x in (code, AROUND[n][1])])
    out = directions.where(F.col("dir") != PIT).select("r", "c", (F.col("r") + F.element_at(row, F.col("dir"))).alias("dr"), (F.col("c") + F.element_at(col, F.col("dir"))).alias("dc"))
    return out.join(directions.select(F.col("r").alias("dr"), F.col("c").alias("dc")), ["dr", "dc"], "left_semi").select("r", "c", "dr", "dc")


@operator("flow")
def flow_accumulation(directions: DataFrame, include_self: bool = False, rounds: int = 64) -> DataFrame:
    """How many cells drain through each cell.  Every cell sends its weight along jumps of 1, 2, 4, ... cells: after round k a cell has
    gathered what lies up to 2^k cells upstream."""
    edges = cut(downstream(directions))
    gathered = cut(directions.select("r", "c", F.lit(1).cast("long").alias("n")))
    jump = edges
    for _ in range(rounds):
        if jump.isEmpty():
            break
        sent = gathered.join(jump, ["r", "c"]).groupBy(F.col("dr").alias("r"), F.col("dc").alias("c")).agg(F.sum("n").alias("more"))
        gathered = cut(gathered.join(sent, ["r", "c"], "left").select("r", "c", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
        far = jump.select(F.col("r").alias("dr"), F.col("c").alias("dc"), F.col("dr").alias("fr"), F.col("dc").alias("fc"))
        jump = cut(jump.join(far, ["dr", "dc"]).select("r", "c", F.col("fr").alias("dr"), F.col("fc").alias("dc")))
    return gathered.select("r", "c", (F.col("n") - (0 if include_self else 1)).alias("acc"))


@operator("flow")
def streams(accumulation: DataFrame, threshold: int) -> DataFrame:
    return accumulation.where(F.col("acc") >= threshold).select("r", "c", "acc")


@operator("flow")
def strahler(directions: DataFrame, stream_cells: DataFrame, rounds: int = 10_000) -> DataFrame:
    """Stream orders: 1 at the heads; where tributaries meet, the greatest order, plus 1 if it comes twice.  A round settles the cells all of
    whose tributaries are settled."""
    own = stream_cells.select("r", "c")
    edges = downstream(directions).join(own, ["r", "c"], "left_semi").join(own.select(F.col("r").alias("dr"), F.col("c").alias("dc")), ["dr", "dc"], "left_semi")
    edges = cut(edges)
    inflows = edges.groupBy(F.col("dr").alias("r"), F.col("dc").alias("c")).agg(F.count("*").alias("inflows"))
    state = cut(own.join(inflows, ["r", "c"], "left").select("r", "c", F.coalesce("inflows", F.lit(0)).alias("inflows"), F.when(F.col("inflows").isNull(), 1).alias("order")))
    for _ in range(rounds):
        done = state.where("order is not null")
        met = done.join(edges, ["r", "c"]).groupBy(F.col("dr").alias("r"), F.col("dc").alias("c")).agg(F.count("*").alias("came"), F.max("order").alias("top"), F.collect_list("order").alias("orders"))
        # at most eight tributaries a cell
        twice = F.size(F.filter("orders", lambda o: o == F.col("top"))) > 1
        new = met.select("r", "c", "came", (F.col("top") + F.when(twice, 1).otherwise(0)).alias("new"))
        after = cut(state.join(new, ["r", "c"], "left").select("r", "c", "inflows", F.coalesce("order", F.when(F.col("came") == F.col("inflows"), F.col("new"))).alias("order")))
        if after.where("order is null").count() == state.where("order is null").count():
            state = after
            break
        state = after
    return state.select("r", "c", "order")


@operator("flow")
def watershed(directions: DataFrame, row: int, col: int) -> DataFrame:
    """The cells that drain through a pour point, itself included: every cell's outlet by pointer jumping, with the pour point as an end."""
    edges = downstream(directions).where(~((F.col("r") == row) & (F.col("c") == col)))
    ends = cut(directions.select("r", "c").join(edges, ["r", "c"], "left").select("r", "c", F.coalesce("dr", "r").alias("er"), F.coalesce("dc", "c").alias("ec")))
    while True:
        far = ends.select(F.col("r").alias("er"), F.col("c").alias("ec"), F.col("er").alias("fr"), F.col("ec").alias("fc"))
        moved = cut(ends.join(far, ["er", "ec"]).select("r", "c", F.col("fr").alias("er"), F.col("fc").alias("ec")))
        if moved.join(ends, ["r", "c", "er", "ec"], "left_anti").isEmpty():
            return moved.where((F.col("er") == row) & (F.col("ec") == col)).select("r", "c")
        ends = moved


def _tile_shape(rows: int, cols: int) -> tuple[int, int]:
    """Height and width of the tiles of cost_distance: squares, or as wide (high) as a raster that is narrower, and longer for it."""
    if cols <= _SIDE:
        return min(rows, max(_SIDE * _SIDE // cols, 1)), cols
    return (rows, min(cols, _SIDE * _SIDE // rows)) if rows <= _SIDE else (_SIDE, _SIDE)


def _pack_tiles(high: int, wide: int, r0: int, c0: int):
    """Rows (tr, tc, r, c, z), sorted by tile, as one array of z a tile, with a margin of one cell; NaN where there is no cell."""

    def run(batches):
        for part in runs(batches, ["tr", "tc"]):
            tr, tc = part["tr"][0].as_py(), part["tc"][0].as_py()
            z = np.full((high + 2, wide + 2), np.nan)
            at = part["r"].to_numpy() - (r0 + tr * high - 1), part["c"].to_numpy() - (c0 + tc * wide - 1)
            np.fmin.at(z, at, part["z"].to_numpy())
            yield pa.RecordBatch.from_pydict({"tr": [tr], "tc": [tc], "z": [z.tobytes()]})

    return run


def _tile_costs(z: np.ndarray, seeds: list[tuple[int, float]], size: float, most: float) -> np.ndarray:
    """Least costs inside a tile (with its margin) from seeds (place, cost), by Dijkstra's method; the margin is reached, not left."""
    wide = z.shape[1]
    inner = np.zeros(z.shape, bool)
    inner[1:-1, 1:-1] = True
    inner, z = inner.ravel().tolist(), z.ravel().tolist()
    d = [float("inf")] * len(z)
    moves = [(a * wide + b, size * (2**0.5 if a and b else 1.0)) for a, b in AROUND.values()]
    heap = []
    for at, cost in seeds:
        if z[at] == z[at] and cost < d[at]:
            d[at] = cost
            heap.append((cost, at))
    heapify(heap)
    while heap:
        d0, at = heappop(heap)
        if d0 > d[at]:
            continue
        z0 = z[at]
        for move, length in moves:
            to = at + move
            o = d0 + length * (1.0 + 5.0 * (z0 + z[to]) / 200.0)
            if o < d[to] and o <= most:  # never for NaN, where there is no cell
                d[to] = o
                if inner[to]:
                    heappush(heap, (o, to))
    return np.array(d).reshape(-1, wide)


def _relax_tiles(high: int, wide: int, r0: int, c0: int, size: float, most: float, whole: bool):
    """Tiles with their seeds, as the cells reached: all inside (whole), or those at the edge (own) and in the margin, with the tile that owns them."""

    def run(batches):
        for batch in batches:
            for tr, tc, z, seeds in zip(*[batch.column(k).to_pylist() for k in ("tr", "tc", "z", "seeds")]):
                r, c = r0 + tr * high - 1, c0 + tc * wide - 1
                z = np.frombuffer(z).reshape(high + 2, wide + 2)
                d = _tile_costs(z, [((s["r"] - r) * (wide + 2) + s["c"] - c, s["d"]) for s in seeds], size, most)
                take = np.isfinite(d)
                inside = np.zeros(d.shape, bool)
                inside[1:-1, 1:-1] = True
                if whole:
                    take &= inside
                else:
                    take[2:-2, 2:-2] = False
                i, j = np.nonzero(take)
                out = {"r": i + r, "c": j + c, "d": d[i, j]}
                if not whole:
                    out = {"tr": (out["r"] - r0) // high, "tc": (out["c"] - c0) // wide, **out, "own": inside[i, j]}
                yield pa.RecordBatch.from_pydict(out)

    return run


@operator("flow")
def cost_distance(cells: DataFrame, row: int, col: int, size: float = 1.0, most: float = float("inf"), rounds: int = 100_000) -> DataFrame:
    """The least cost from a cell to every cell it reaches: steps cost their length times 1 + 5 (a + b) / 200 with the costs (z) at both
    ends; null and NaN are no cells, and of cells given twice the cheaper counts.  A round solves the tiles that got a cheaper way in over their edge and
    passes on what their own edges offer, until none does, so rounds grow with the tiles a path crosses; only cells at edges are written between rounds."""
    costs = cells.where("z is not null and not isnan(z)").select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("z").cast("double").alias("z"))
    r0, r1, c0, c1 = costs.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    if r0 is None:
        return costs.select("r", "c", F.col("z").alias("d"))
    high, wide = _tile_shape(r1 - r0 + 1, c1 - c0 + 1)
    place = (high, wide, r0, c0)
    owners = lambda v, start, step: F.explode(F.array_distinct(F.array(*[F.floor((F.col(v) - start + k) / F.lit(step)) for k in (-1, 0, 1)])))
    dealt = costs.withColumn("tr", owners("r", r0, high)).withColumn("tc", owners("c", c0, wide)).repartition("tr", "tc").sortWithinPartitions("tr", "tc")
    tiles = cut(dealt.select("tr", "tc", "r", "c", "z").mapInArrow(_pack_tiles(*place), "tr long, tc long, z binary"))

    def solved(known: DataFrame, whole: bool, schema: str) -> DataFrame:
        seeds = known.groupBy("tr", "tc").agg(F.collect_list(F.struct("r", "c", "d")).alias("seeds"))  # the edge of a tile at most
        return tiles.join(seeds, ["tr", "tc"]).mapInArrow(_relax_tiles(*place, size, most, whole), schema)

    cell = ["tr", "tc", "r", "c"]
    known = costs.sparkSession.range(1).select(*[F.lit(v).cast("long").alias(n) for n, v in zip(cell, ((row - r0) // high, (col - c0) // wide, row, col))], F.lit(0.0).alias("d"), F.lit(True).alias("new"))
    for _ in range(rounds):
        active = known.join(known.where("new").select("tr", "tc").distinct(), ["tr", "tc"], "left_semi")
        met = solved(active, False, "tr long, tc long, r long, c long, d double, own boolean")
        both = known.select(*cell, "d", F.lit(True).alias("own")).unionByName(met).groupBy(*cell).agg(F.min(F.when(F.col("own"), F.col("d"))).alias("had"), F.min(F.when(~F.col("own"), F.col("d"))).alias("o"))
        known = cut(both.select(*cell, F.least("had", "o").alias("d"), (F.col("o").isNotNull() & (F.col("had").isNull() | (F.col("o") < F.col("had")))).alias("new")))
        if known.where("new").isEmpty():
            break
    else:
        raise RuntimeError(f"costs have not settled in {rounds} rounds")
    return solved(known, True, "r long, c long, d double")


@operator("flow")
def inundation_level(cells: DataFrame, volume: float, cell_area: float) -> DataFrame:
    """The level up to which a volume of water fills the raster (10 above its highest cell at most), its cells and the volume held.
    It is the least of (volume + sum of the k lowest cells) / k over all k, from sums over ranges of heights that are sorted apart."""
    heights = cells.where("z is not null").groupBy(F.col("z").alias("v")).agg(F.count("*").alias("times"))
    dealt = cut(heights.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part").agg(F.sum("times").alias("n"), F.sum(F.col("v") * F.col("times")).alias("s"))  # a row for each range
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s0"))
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    k, s = F.col("n0") + F.sum("times").over(inside), F.col("s0") + F.sum(F.col("v") * F.col("times")).over(inside)
    levels = dealt.join(F.broadcast(parts), "part").select("v", ((F.lit(volume / cell_area) + s) / k).alias("level"))
    level = levels.agg(F.least(F.min("level"), F.max("v") + 10.0)).first()[0]
    held = F.sum(F.greatest(F.lit(0.0), F.lit(level) - F.col("z"))) * cell_area
    return cells.agg(F.lit(level).alias("level"), F.sum(F.when(F.col("z") < level, 1).otherwise(0)).alias("cells"), held.alias("volume"))


@operator("flow")
def automaton_step(cells: DataFrame, transitions: DataFrame, seed: int, weight: float = 0.5) -> DataFrame:
    """One step of land-use change of cells (r, c, cls): each class's chance is its transition probability (from_class, to_class, p) mixed with
    its share among the eight neighbours; a hash of cell and seed draws."""
    around = F.explode(F.array(*[F.struct((F.col("r") + a).alias("r"), (F.col("c") + b).alias("c")) for a, b in AROUND.values()]))
    votes = cells.select(around.alias("n"), F.col("cls").alias("k")).groupBy("n.r", "n.c", "k").agg(F.count("*").alias("votes"))
    total = votes.groupBy("r", "c").agg(F.sum("votes").alias("total"))
    chance = cells.join(transitions, cells["cls"] == transitions["from_class"]).select("r", "c", "cls", F.col("to_class").alias("k"), "p")
    chance = chance.join(votes, ["r", "c", "k"], "left").join(total, ["r", "c"], "left")
    mixed = (1.0 - weight) * F.col("p") + weight * F.coalesce(F.col("votes") / F.col("total"), F.lit(0.0))
    per_cell = chance.groupBy("r", "c", "cls").agg(F.array_sort(F.collect_list(F.struct("k", mixed.alias("m")))).alias("ks"))
    u = F.pmod(F.xxhash64(F.lit(seed), "r", "c"), F.lit(1 << 30)) / float(1 << 30)
    whole = F.aggregate("ks", F.lit(0.0), lambda s, x: s + x["m"])
    pick = F.aggregate(
        "ks",
        F.struct((u * whole).alias("left"), F.lit(None).cast("int").alias("k")),
        lambda s, x: F.struct((s["left"] - x["m"]).alias("left"), F.when(s["k"].isNull() & (s["left"] < x["m"]), x["k"].cast("int")).otherwise(s["k"]).alias("k")),
        lambda s: s["k"],
    )
    return per_cell.select("r", "c", F.coalesce(pick, "cls").alias("cls"))


@operator("flow")
def land_use_simulation(cells: DataFrame, transitions: DataFrame, steps: int, seed: int = 42, weight: float = 0.5) -> DataFrame:
    for k in range(steps):
        cells = cut(automaton_step(cells, transitions, seed + k, weight))
    return cells
