"""Rasters in long form: (r, c, value), null where there is no data.

Neighbourhoods come from tiles with a margin: a cell is sent to its tile, and once more to each tile it borders, so a
3 x 3 stencil moves (1 + 2 / TILE)^2 rows a cell in one shuffle; in a tile the neighbours are array look-ups.  What is computed from
them stays a column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import cos, pi, radians, sin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import clamp
from ..registry import operator
from .grouped import runs

TILE = 256
#: Neighbours in reading order.
AROUND = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}


def neighbours(cells: DataFrame, value: str = "z", tile: int = TILE) -> DataFrame:
    """r, c, z and the eight values around (nw, n, ne, w, e, sw, s, se), null beyond the raster or without data, with
    `present`: how many of the eight cells exist."""
    rows = cells.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col(value).cast("double").alias("z"))
    span = lambda v: F.array_distinct(F.array(F.floor((v - 1) / tile), F.floor(v / tile), F.floor((v + 1) / tile)))
    dealt = rows.withColumn("tr", F.explode(span(F.col("r")))).withColumn("tc", F.explode(span(F.col("c"))))
    dealt = dealt.repartition("tr", "tc").sortWithinPartitions("tr", "tc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["tr", "tc"]):
            tr, tc = t["tr"][0].as_py(), t["tc"][0].as_py()
            i = t["r"].to_numpy() - tr * tile + 1
            j = t["c"].to_numpy() - tc * tile + 1
            z = t["z"].to_numpy(zero_copy_only=False).astype(float)
            grid = np.full((tile + 2, tile + 2), np.nan)
            there = np.zeros(grid.shape, bool)
            grid[i, j], there[i, j] = z, True
            own = (i > 0) & (i <= tile) & (j > 0) & (j <= tile)
            i, j = i[own], j[own]
            cols = {"r": pa.array(i + tr * tile - 1), "c": pa.array(j + tc * tile - 1), "z": _nulls(grid[i, j])}
            for name, (dr, dc) in AROUND.items():
                cols[name] = _nulls(grid[i + dr, j + dc])
            cols["present"] = pa.array(sum(there[i + dr, j + dc].astype(np.int32) for dr, dc in AROUND.values()))
            yield pa.RecordBatch.from_pydict(cols)

    return dealt.mapInArrow(run, "r long, c long, z double, " + ", ".join(f"{n} double" for n in AROUND) + ", present int")


def _nulls(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=np.isnan(values))


def _gradient(size: float) -> tuple[Column, Column]:
    """Horn's east and south differences; null unless all eight neighbours have data."""
    col = F.col
    dx = ((col("se") + 2.0 * col("e") + col("ne")) - (col("nw") + 2.0 * col("w") + col("sw"))) / (8.0 * size)
    dy = ((col("sw") + 2.0 * col("s") + col("se")) - (col("nw") + 2.0 * col("n") + col("ne"))) / (8.0 * size)
    return dx, dy


def slope(size: float) -> tuple[Column, Column]:
    """Degrees and percent."""
    dx, dy = _gradient(size)
    rise = F.sqrt(dx * dx + dy * dy)
    return F.degrees(F.atan(rise)), rise * 100.0


def aspect(size: float) -> Column:
    """Degrees clockwise from north, 0 to 360; -1 where flat."""
    dx, dy = _gradient(size)
    a = 90.0 - F.degrees(F.atan2(-dy, dx))
    turned = F.when(a < 0, a + 360.0).when(a >= 360.0, a - 360.0).otherwise(a)
    return F.when((F.abs(dx) < 1e-10) & (F.abs(dy) < 1e-10), -1.0).otherwise(turned)


def hillshade(size: float, azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    """0 to 255."""
    dx, dy = _gradient(size)
    steep = F.atan(F.sqrt(dx * dx + dy * dy))
    facing = pi / 2 - F.atan2(-dy, dx)
    zenith = radians(90 - altitude)
    light = cos(zenith) * F.cos(steep) + sin(zenith) * F.sin(steep) * F.cos(radians(azimuth) - facing)
    return F.greatest(F.lit(0.0), 255.0 * light)


def curvature(size: float) -> tuple[Column, Column, Column]:
    """Profile, plan and their sum; null unless the cell and all neighbours have data, 0 where flat."""
    col = F.col
    p = ((col("ne") - col("nw")) + 2.0 * (col("e") - col("w")) + (col("se") - col("sw"))) / (8.0 * size)
    q = ((col("nw") - col("sw")) + 2.0 * (col("n") - col("s")) + (col("ne") - col("se"))) / (8.0 * size)
    xx = (col("e") - 2.0 * col("z") + col("w")) / (size * size)
    yy = (col("n") - 2.0 * col("z") + col("s")) / (size * size)
    xy = (col("se") - col("sw") - col("ne") + col("nw")) / (4.0 * size * size)
    g = p * p + q * q
    flat = g < 1e-12
    safe = F.when(flat, 1.0).otherwise(g)
    profile = F.when(flat, 0.0).otherwise(-(p * p * xx + 2.0 * p * q * xy + q * q * yy) / (F.sqrt(safe) * F.pow(1.0 + safe, F.lit(1.5))))
    plan = F.when(flat, 0.0).otherwise(-(q * q * xx - 2.0 * p * q * xy + p * p * yy) / F.pow(safe, F.lit(1.5)))
    known = F.when(col("z").isNotNull() & _full(), F.lit(1.0)) * 1.0
    return profile * known, plan * known, (profile + plan) * known


def _full() -> Column:
    out = F.lit(True)
    for n in AROUND:
        out = out & F.col(n).isNotNull()
    return out


def _valid() -> Column:
    return F.array_compact(F.array(*[F.col(n) for n in AROUND]))


def ruggedness() -> Column:
    """sqrt of the sum of squared differences to the neighbours with data."""
    return F.when(F.col("z").isNotNull() & (F.size(_valid()) > 0) & (F.col("present") == 8), F.sqrt(F.aggregate(_valid(), F.lit(0.0), lambda a, v: a + (F.col("z") - v) * (F.col("z") - v))))


def position() -> Column:
    """The cell less the mean of the neighbours with data."""
    return F.when(F.col("z").isNotNull() & (F.size(_valid()) > 0) & (F.col("present") == 8), F.col("z") - F.aggregate(_valid(), F.lit(0.0), lambda a, v: a + v) / F.size(_valid()))


@operator("raster")
def terrain(cells: DataFrame, size: float = 30.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Slope, aspect, hillshade, ruggedness, position and curvatures of a height raster."""
    around = neighbours(cells)
    deg, pct = slope(size)
    prof, plan, both = curvature(size)
    full = F.when(_full(), F.lit(1.0))
    return around.select("r", "c", (deg * full).alias("slope_deg"), (pct * full).alias("slope_pct"), (aspect(size) * full).alias("aspect_deg"), (hillshade(size, azimuth, altitude) * full).alias("hillshade"), ruggedness().alias("tri"), position().alias("tpi"), prof.alias("profile"), plan.alias("plan"), both.alias("curvature"))


# --- algebra of bands


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where that has no value."""
    return F.when(F.abs(a + b) > 1e-10, (a - b) / (a + b))


def normalize(cells: DataFrame, sentinel: float) -> DataFrame:
    """Both encodings of no data, NaN and the sentinel, as null."""
    return cells.withColumn("z", F.when(~(F.isnan("z") | (F.abs(F.col("z") - sentinel) < 1e-10)), F.col("z")))


@operator("raster")
def band_algebra(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sum, difference, product and quotient of two bands, cell by cell; null if either is, or on division by 0."""
    x, y = F.col("x"), F.col("y")
    both = a.select("r", "c", F.col("z").alias("x")).join(b.select("r", "c", F.col("z").alias("y")), ["r", "c"])
    return both.select("r", "c", (x + y).alias("added"), (x - y).alias("less"), (x * y).alias("product"), F.when(F.abs(y) > 1e-10, x / y).alias("quotient"))


@operator("raster")
def mosaic_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """The first band's value where it has one, else the second's."""
    both = a.select("r", "c", "z", F.lit(0).alias("o")).unionByName(b.select("r", "c", "z", F.lit(1).alias("o")))
    return both.groupBy("r", "c").agg(F.min_by("z", F.when(F.col("z").isNotNull(), F.col("o"))).alias("z"))


@operator("raster")
def mosaic_feather(a: DataFrame, b: DataFrame, first_col: int, width: int) -> DataFrame:
    """Where both have data, the second fades in over `width` columns from first_col."""
    both = a.select("r", "c", F.col("z").alias("x")).join(b.select("r", "c", F.col("z").alias("y")), ["r", "c"], "full")
    w = clamp((F.col("c") - first_col) / float(width), 0.0, 1.0)
    blend = F.col("x") * (1.0 - w) + F.col("y") * w
    return both.select("r", "c", F.coalesce(blend, "x", "y").alias("z"))


@operator("raster")
def resample(cells: DataFrame, rows: int, cols: int, new_rows: int, new_cols: int, method: str = "nearest") -> DataFrame:
    """A raster of rows x cols on a grid of new_rows x new_cols over the same area, by nearest, bilinear or cubic
    (Catmull-Rom) weights.  Every source cell spreads its weights to the target cells it takes part in, so that the work is one
    aggregation; a target cell is null where a cell it needs has no data."""
    fy, fx = rows / new_rows, cols / new_cols
    target = lambda n, f, v: F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((v - 2.5) / f - 0.5).cast("long")), F.least(F.lit(n - 1).cast("long"), F.ceil((v + 3.5) / f).cast("long")))
    if method == "nearest":
        near = cells.withColumn("nr", F.explode(target(new_rows, fy, F.col("r")))).withColumn("nc", F.explode(target(new_cols, fx, F.col("c"))))
        pick = lambda n, f, limit: F.least(F.lit(limit - 1), F.floor((n + 0.5) * f))
        near = near.where((pick(F.col("nr"), fy, rows) == F.col("r")) & (pick(F.col("nc"), fx, cols) == F.col("c")))
        return near.select(F.col("nr").alias("r"), F.col("nc").alias("c"), "z")
    taps = [0, 1] if method == "bilinear" else [-1, 0, 1, 2]

    def weight(t: Column) -> Column:
        a = F.abs(t)
        if method == "bilinear":
            return F.greatest(F.lit(0.0), 1.0 - a)
        return F.when(a <= 1, (1.5 * a - 2.5) * a * a + 1.0).when(a < 2, ((-0.5 * a + 2.5) * a - 4.0) * a + 2.0).otherwise(0.0)

    def spread(df: DataFrame, v: str, new: str, n: int, f: float, limit: int) -> DataFrame:
        """Each cell with the target lines it counts in, and its weight there; taps beyond the edge count for the edge."""
        df = df.withColumn(new, F.explode(target(n, f, F.col(v))))
        at = clamp((F.col(new) + 0.5) * f - 0.5, 0.0, limit - 1.0)
        base = F.floor(at)
        w = F.lit(0.0)
        used = F.lit(False)
        for tap in taps:
            here = clamp(base + tap, 0.0, limit - 1.0) == F.col(v)
            w = w + F.when(here, weight(at - (base + tap))).otherwise(0.0)
            used = used | here
        return df.withColumn(f"w_{new}", w).where(used)

    out = spread(spread(cells, "r", "nr", new_rows, fy, rows), "c", "nc", new_cols, fx, cols)
    out = out.withColumn("w", F.col("w_nr") * F.col("w_nc")).where(F.abs("w") > 1e-12)
    total = out.groupBy("nr", "nc").agg(F.sum(F.col("w") * F.col("z")).alias("s"), F.sum(F.when(F.col("z").isNull(), 1).otherwise(0)).alias("missing"))
    return total.select(F.col("nr").alias("r"), F.col("nc").alias("c"), F.when(F.col("missing") == 0, F.col("s")).alias("z"))


@operator("raster")
def threshold(cells: DataFrame, low: float, high: float) -> DataFrame:
    """1 from low to high, else 0; null without data."""
    return cells.select("r", "c", F.when(F.col("z").isNotNull(), F.col("z").between(low, high).cast("int")).alias("z"))


@operator("raster")
def chunks(cells: DataFrame, size: int = 256) -> DataFrame:
    """Square blocks: their place and how many cells and values they hold."""
    return cells.groupBy(F.floor(F.col("r") / size).alias("block_r"), F.floor(F.col("c") / size).alias("block_c")).agg(F.count("*").alias("cells"), F.count("z").alias("valid"))


@operator("raster")
def zonal_mask(cells: DataFrame, zones: int) -> DataFrame:
    """count, min, max, mean, population standard deviation and sum of z for every zone 1..zones; zone 0 is background, and
    zones without data keep a row of nulls."""
    stats = cells.where("zone > 0 and z is not null").groupBy("zone").agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"), F.avg("z").alias("mean"), F.stddev_pop("z").alias("std"), F.sum("z").alias("total"))
    every = cells.sparkSession.range(1, zones + 1).select(F.col("id").cast("int").alias("zone"))
    return every.join(stats, "zone", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@operator("raster")
def zonal_box(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """Statistics of the cells whose centre (x, y) lies in each closed box (box_id, x0, y0, x1, y1); zeros where none does,
    and the shares of the zone's cells at or above 0.5 and at or below 0.2."""
    from .joins import cell_join

    test = (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    met = cell_join(cells.where("z is not null"), boxes, "x", "y", ("x0", "y0", "x1", "y1"), test, 10.0)
    share = lambda cond: F.avg(F.when(cond, 1.0).otherwise(0.0))
    stats = met.groupBy("box_id").agg(F.count("*").alias("n"), F.avg("z").alias("mean"), F.min("z").alias("low"), F.max("z").alias("high"), F.sum("z").alias("total"), share(F.col("z") >= 0.5).alias("healthy"), share(F.col("z") <= 0.2).alias("degraded"))
    return boxes.select("box_id").join(stats, "box_id", "left").na.fill(0)


@operator("raster")
def coherence(cells: DataFrame, cols: int, half: int = 2) -> DataFrame:
    """r, c, coherence of two images (master, slave) over windows of 2 half + 1 cells in line order; null where a window is dark.
    Each cell is dealt to the windows it lies in, so there is one aggregation and no long window."""
    place = F.col("r").cast("long") * cols + F.col("c")
    offsets = F.explode(F.sequence(F.lit(-half), F.lit(half)))
    dealt = cells.select(place.alias("at"), "r", "c", "master", "slave", offsets.alias("o")).withColumn("to", F.col("at") + F.col("o"))
    m, s = F.col("master"), F.col("slave")
    own = F.col("o") == 0
    sums = dealt.groupBy("to").agg(F.max(F.when(own, F.col("r"))).alias("r"), F.max(F.when(own, F.col("c"))).alias("c"), F.sum(m * s).alias("ms"), F.sum(m * m).alias("mm"), F.sum(s * s).alias("ss"))
    energy = F.sqrt(F.col("mm") * F.col("ss"))
    return sums.where("r is not null").select("r", "c", F.when(energy > 0, F.col("ms") / energy).alias("coherence"))
