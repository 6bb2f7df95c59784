"""Spatial, interval and nearest-neighbour joins, planned as equi-joins on grid cells with an exact residual.

No side is broadcast by hint: Spark broadcasts a side only below its own size threshold, and adaptive execution
splits skewed cells.  A zone costs a row per cell it meets, so cells should be about as large as zones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import crs, geometry
from ..registry import operator
from ..session import cut

_CELLS = ["__cx", "__cy"]
#: Of count_within_radius: bands of latitude in a radius, bands in a block, distances measured at a time.
_BANDS, _DEPTH, _TESTS = 32, 4, 1 << 19


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size)).cast("long")


def _cover(df: DataFrame, box: tuple[Column, Column, Column, Column], size: float) -> DataFrame:
    """A row for each cell a box meets."""
    x0, y0, x1, y1 = box
    return df.withColumn("__cx", F.explode(F.sequence(_cell(x0, size), _cell(x1, size)))).withColumn("__cy", F.explode(F.sequence(_cell(y0, size), _cell(y1, size))))


def cell_join(points: DataFrame, zones: DataFrame, x: str, y: str, box: tuple[str, str, str, str], test: Column, size: float, how: str = "inner") -> DataFrame:
    """Points with the zones whose cells hold them and that pass the test."""
    p = points.withColumn("__cx", _cell(F.col(x), size)).withColumn("__cy", _cell(F.col(y), size))
    z = _cover(zones, tuple(F.col(b) for b in box), size).withColumnsRenamed({c: c + "z" for c in _CELLS})
    on = (F.col("__cx") == F.col("__cxz")) & (F.col("__cy") == F.col("__cyz")) & test
    return p.join(z, on, how).drop(*_CELLS, *(c + "z" for c in _CELLS))


def first_match(points: DataFrame, zones: DataFrame, x: str, y: str, box: tuple[str, str, str, str], test: Column, order: str, size: float) -> DataFrame:
    """Every point once, with the first zone (by `order`) that holds it, or nulls."""
    keep = points.columns
    tagged = points.withColumn("__row", F.monotonically_increasing_id())
    found = cell_join(tagged, zones, x, y, box, test, size, "left")
    zone = F.when(F.col(order).isNotNull(), F.struct(F.col(order).alias("__order"), *[F.col(c) for c in zones.columns]))
    best = found.groupBy("__row", *keep).agg(F.min(zone).alias("__zone"))
    return best.select(*keep, *[F.col(f"__zone.{c}").alias(c) for c in zones.columns])


@operator("join")
def zone_join(points: DataFrame, zones: DataFrame, cell: float = 36.0) -> DataFrame:
    """Points (lon, lat) with the first zone (zone_id order) whose half-open box x0, y0, x1, y1 holds them."""
    test = (F.col("lon") >= F.col("x0")) & (F.col("lon") < F.col("x1")) & (F.col("lat") >= F.col("y0")) & (F.col("lat") < F.col("y1"))
    return first_match(points, zones, "lon", "lat", ("x0", "y0", "x1", "y1"), test, "zone_id", cell)


@operator("join")
def pip_join(points: DataFrame, polygons: DataFrame, cell: float = 8.0) -> DataFrame:
    """Points (lon, lat) with the first polygon (poly_id order) whose ring strictly holds them."""
    b = geometry.box(F.col("ring"))
    boxed = polygons.withColumns({"__x0": b["x0"], "__y0": b["y0"], "__x1": b["x1"], "__y1": b["y1"]})
    test = geometry.in_box(F.col("lon"), F.col("lat"), tuple(F.col(c) for c in ("__x0", "__y0", "__x1", "__y1"))) & geometry.in_ring(F.col("lon"), F.col("lat"), F.col("ring"))
    return first_match(points, boxed, "lon", "lat", ("__x0", "__y0", "__x1", "__y1"), test, "poly_id", cell).drop("__x0", "__y0", "__x1", "__y1", "ring")


@operator("join")
def box_pairs(left: DataFrame, right: DataFrame, cell: float = 10.0) -> DataFrame:
    """Pairs of boxes (x0, y0, x1, y1; ids a and b) that meet, edges included.  A pair is reported in the one cell
    that holds the lower left corner of its overlap."""
    a = _cover(left.withColumnsRenamed({c: f"a_{c}" for c in ("x0", "y0", "x1", "y1")}), tuple(F.col(f"a_{c}") for c in ("x0", "y0", "x1", "y1")), cell)
    b = _cover(right.withColumnsRenamed({c: f"b_{c}" for c in ("x0", "y0", "x1", "y1")}), tuple(F.col(f"b_{c}") for c in ("x0", "y0", "x1", "y1")), cell)
    met = a.join(b, _CELLS).where(geometry.boxes_meet(tuple(F.col(f"a_{c}") for c in ("x0", "y0", "x1", "y1")), tuple(F.col(f"b_{c}") for c in ("x0", "y0", "x1", "y1"))))
    home = (F.col("__cx") == _cell(F.greatest("a_x0", "b_x0"), cell)) & (F.col("__cy") == _cell(F.greatest("a_y0", "b_y0"), cell))
    return met.where(home).drop(*_CELLS)


@operator("join")
def within_radius(origins: DataFrame, places: DataFrame, km: float) -> DataFrame:
    """Pairs of origins (o_id, o_lon, o_lat) and places (p_id, p_lon, p_lat) at most km apart on the sphere.  Cells are bands of
    latitude; in a band the longitude range follows from the latitude, and crosses the date line."""
    deg = km / 111.19492664455873  # a degree of the meridian on a sphere of 6371 km
    band = lambda y: F.floor(y / F.lit(deg)).cast("long")
    near = places.withColumn("__b", band(F.col("p_lat")))
    wide = origins.withColumn("__b", F.explode(F.sequence(band(F.col("o_lat") - deg), band(F.col("o_lat") + deg))))
    pole = F.abs(F.col("o_lat")) + deg >= 89.9
    reach = F.when(pole, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(km / 6371.0)) / F.cos(F.radians("o_lat"))))) + 1e-9)
    wide = wide.withColumn("__reach", reach)
    # longitude cells of fixed width, wrapped; wide reaches near the poles take more cells
    step = max(deg, 0.5)
    n = int(360.0 / step) + 1
    wrapped = F.array_distinct(F.flatten(F.transform(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0)), lambda shift: F.transform(F.sequence(F.floor((F.col("o_lon") + shift - F.col("__reach") + 180.0) / step).cast("long"), F.floor((F.col("o_lon") + shift + F.col("__reach") + 180.0) / step).cast("long")), lambda v: v))))
    wide = wide.withColumn("__c", F.explode(F.filter(wrapped, lambda v: (v >= 0) & (v <= n))))
    near = near.withColumn("__c", F.floor((F.col("p_lon") + 180.0) / step).cast("long"))
    met = wide.join(near, ["__b", "__c"]).withColumn("km", crs.haversine_km(F.col("o_lon"), F.col("o_lat"), F.col("p_lon"), F.col("p_lat")))
    return met.where(F.col("km") <= km).drop("__b", "__c", "__reach")


def _ring_counts(at: np.ndarray, lam: np.ndarray, phi: np.ndarray, weight: np.ndarray, low: float, high: float, km: float) -> np.ndarray:
    """The weight of places (lam, phi; degrees) in a band of latitude, low to high, that lies within km of each origin (at: lon, lat).

    In a band the circle is at least so wide and at most so wide in longitude.  What lies inside the lesser width is counted by sums
    over the sorted longitudes; only what lies between the two is measured."""
    n = len(lam)
    turn = np.mod(lam, 360.0)
    order = np.argsort(turn, kind="stable")
    ring = np.concatenate([turn[order] - 360.0, turn[order], turn[order] + 360.0])  # any n in a row are each place once
    sums = np.concatenate([[0], np.cumsum(np.tile(weight[order], 3))])
    hav = lambda v: np.sin(v / 2.0) ** 2
    o, a, b = np.radians(at[:, 1]), np.radians(max(low, -90.0)), np.radians(min(high, 90.0))
    nearest, farthest = np.maximum(np.maximum(a - o, o - b), 0.0), np.maximum(np.abs(a - o), np.abs(b - o))
    thin, thick = max(min(np.cos(a), np.cos(b)), 0.0), 1.0 if a <= 0.0 <= b else max(np.cos(a), np.cos(b))

    def width(rest, cosine, slack):  # degrees of longitude to either side; negative: none
        with np.errstate(all="ignore"):
            share = rest / (np.maximum(np.cos(o), 0.0) * cosine)
        share = np.where(np.isnan(share), np.inf, share)
        share = share + slack * (1e-9 * np.minimum(np.abs(share), 2.0) + 1e-12)
        return np.where(share < 0, -1.0, np.degrees(2.0 * np.arcsin(np.sqrt(np.clip(share, 0.0, 1.0)))))

    reach = hav(min(km / 6371.0, np.pi))
    most, least = width(reach - hav(nearest), thin, 1), width(reach - hav(farthest), thick, -1)
    here = np.mod(at[:, 0], 360.0)
    most_from = np.searchsorted(ring, here - np.maximum(most, 0.0), "left")
    most_to = np.where(most >= 179.999, most_from + n, np.searchsorted(ring, here + np.maximum(most, 0.0), "right"))
    most_to = np.where(most < 0, most_from, np.minimum(most_to, most_from + n))
    least_from = np.clip(np.searchsorted(ring, here - np.maximum(least, 0.0), "left"), most_from, most_to)
    least_to = np.clip(np.searchsorted(ring, here + np.maximum(least, 0.0), "right"), least_from, most_to)
    least_to = np.where(least < 0, least_from, least_to)
    found = sums[least_to] - sums[least_from]
    # the places between the widths, some at a time
    starts, sizes = np.r_[most_from, least_to], np.r_[least_from - most_from, most_to - least_to]
    who = np.tile(np.arange(len(at)), 2)
    keep = sizes > 0
    starts, sizes, who = starts[keep], sizes[keep], who[keep]
    ends = np.cumsum(sizes)
    done = 0
    while done < len(sizes):
        upto = max(int(np.searchsorted(ends, (ends[done - 1] if done else 0) + _TESTS, "right")), done + 1)
        s, k = sizes[done:upto], np.repeat(who[done:upto], sizes[done:upto])
        place = order[(np.repeat(starts[done:upto] - (np.cumsum(s) - s), s) + np.arange(s.sum())) % n]
        y, x = phi[place], lam[place]
        h = np.sin(np.radians(y - at[k, 1]) / 2.0) ** 2 + np.cos(o[k]) * np.cos(np.radians(y)) * np.sin(np.radians(x - at[k, 0]) / 2.0) ** 2
        met = 2.0 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1.0, h))) <= km
        found = found + np.bincount(k[met], weight[place[met]], len(at)).astype(np.int64)
        done = upto
    return found


@operator("join")
def count_within_radius(origins: DataFrame, places: DataFrame, km: float, by: str) -> DataFrame:
    """For each origin (o_id, o_lon, o_lat) how many places (p_lon, p_lat) of each value of a column lie at most km apart on the sphere: o_id, the
    column, n; latitudes are between -90 and 90.  No pair is made: origins and places of one spot are taken together, and blocks of latitude count in
    bands, as _ring_counts says, so the work is that of the circles' edges."""
    fine = max(km / 111.19492664455873 / _BANDS, 1e-6)
    block = fine * _DEPTH
    at = lambda y: F.floor((y + 90.0) / F.lit(block)).cast("long")
    real = lambda x, y: F.abs(F.col(x)).between(0.0, 1e300) & F.col(y).between(-90.0, 90.0)
    spots = places.where(real("p_lon", "p_lat")).groupBy(F.col("p_lon").alias("x"), F.col("p_lat").alias("y"), F.col(by).alias("by")).agg(F.count("*").alias("n")).withColumn("b", at(F.col("y")))
    centres = origins.where(real("o_lon", "o_lat")).select(F.col("o_lon").alias("x"), F.col("o_lat").alias("y")).distinct()
    deg = km / 111.19492664455873 + 1e-9
    asked = centres.withColumn("b", F.explode(F.sequence(at(F.col("y") - deg), at(F.col("y") + deg))))

    def run(asked: pa.Table, spots: pa.Table) -> pa.Table:
        o = np.column_stack([asked["x"].to_numpy(), asked["y"].to_numpy()])
        x, y, n = spots["x"].to_numpy(), spots["y"].to_numpy(), spots["n"].to_numpy()
        kinds = spots["by"].combine_chunks().dictionary_encode(null_encoding="encode")
        kind = kinds.indices.to_numpy()
        out = {"x": [], "y": [], "by": [], "n": []}
        band = np.floor((y + 90.0) / fine)
        order = np.lexsort((band, kind))
        cuts = np.flatnonzero(np.r_[True, (np.diff(kind[order]) != 0) | (np.diff(band[order]) != 0)]) if len(order) else []
        totals: dict[int, np.ndarray] = {}
        for p, q in zip(cuts, [*cuts[1:], len(order)]):
            rows = order[p:q]
            near = np.flatnonzero((o[:, 1] >= y[rows].min() - deg) & (o[:, 1] <= y[rows].max() + deg))
            if not len(near):
                continue
            total = totals.setdefault(int(kind[rows[0]]), np.zeros(len(o), np.int64))
            total[near] += _ring_counts(o[near], x[rows], y[rows], n[rows], y[rows].min(), y[rows].max(), km)
        for k, total in totals.items():
            some = np.flatnonzero(total)
            out["x"].append(o[some, 0]), out["y"].append(o[some, 1]), out["by"].append(np.full(len(some), k)), out["n"].append(total[some])
        if not out["n"]:
            return pa.table({"x": pa.array([], pa.float64()), "y": pa.array([], pa.float64()), "by": pa.array([], kinds.dictionary.type), "n": pa.array([], pa.int64())})
        whole = {k: np.concatenate(v) for k, v in out.items()}
        return pa.table(whole | {"by": kinds.dictionary.take(pa.array(whole["by"]))})

    schema = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("by", places.schema[by].dataType), T.StructField("n", T.LongType())])
    counts = asked.groupBy("b").cogroup(spots.groupBy("b")).applyInArrow(run, schema).groupBy("x", "y", "by").agg(F.sum("n").alias("n"))
    named = origins.select("o_id", F.col("o_lon").alias("x"), F.col("o_lat").alias("y")).join(counts, ["x", "y"])
    return named.groupBy("o_id", F.col("by").alias(by)).agg(F.sum("n").alias("n"))


@operator("join")
def knn(queries: DataFrame, points: DataFrame, k: int = 3, cell: float = 0.0) -> DataFrame:
    """q_id with the k nearest points (p_id; all, if fewer) by plane distance in any unit, ties to the smaller p_id, and the rank.

    Rounds: candidates from the 3 x 3 cells around a query; a query is settled when its k-th candidate is nearer than the
    next cells can be; the others go on with cells four times as wide, until a cell is as wide as all that lies between
    queries and points, so that the block holds every point.  The first cells (unless given) hold about 2 k points each, by the
    points' extent.  What a round leaves is written, so no round is computed again."""
    ends = lambda df, x, y: df.agg(F.min(x), F.max(x), F.min(y), F.max(y), F.count("*")).first()
    p, q = ends(points, "p_x", "p_y"), ends(queries, "q_x", "q_y")
    if not p[4] or not q[4] or p[0] is None or q[0] is None:
        return queries.crossJoin(points.limit(0)).select("q_id", F.lit(0).alias("rank"), "p_id", F.lit(0.0).alias("d"))
    span = max(max(p[1], q[1]) - min(p[0], q[0]), max(p[3], q[3]) - min(p[2], q[2]), 1e-300)
    size = float(cell) or max(span * (2.0 * k / p[4]) ** 0.5, span * 2.0**-40)
    size = span if p[4] <= k + 1 else min(size, span)
    left, done = queries, None
    while True:
        last = size >= span
        near = points.withColumn("__cx", _cell(F.col("p_x"), size)).withColumn("__cy", _cell(F.col("p_y"), size))
        around = lambda v: F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: _cell(F.col(v), size) + d))  # noqa: B023, E731
        asked = left.withColumn("__cx", around("q_x")).withColumn("__cy", around("q_y"))
        dx, dy = F.col("q_x") - F.col("p_x"), F.col("q_y") - F.col("p_y")
        met = asked.join(near, _CELLS).where("q_id <> p_id").withColumn("d", F.sqrt(dx * dx + dy * dy))
        ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("d", "p_id"))).where(F.col("rank") <= k)
        # how far the searched block reaches around the query
        gap = lambda v: F.least(v - _cell(v, size) * size + size, (_cell(v, size) + 2) * size - v)  # noqa: B023, E731
        ranked = cut(ranked.select("q_id", "rank", "p_id", "d", ((F.col("rank") == k) & (F.col("d") < F.least(gap(F.col("q_x")), gap(F.col("q_y"))))).alias("__far")))
        settled = ranked.where("__far").select("q_id")
        rows = (ranked if last else ranked.join(settled, "q_id", "left_semi")).drop("__far")
        done = rows if done is None else done.unionByName(rows)
        if last:
            return done
        left = cut(left.join(settled, "q_id", "left_anti"))
        if left.isEmpty():
            return done
        size = min(size * 4, span)


@operator("join")
def valid_factor_join(features: DataFrame, factors: DataFrame, year: int) -> DataFrame:
    """Features (cls, sub) with their factor of a year: `cls:sub` before `cls`, the first of several (by ord) wins;
    features without factor have a null factor_value."""
    valid = factors.where((F.col("valid_from_year") <= year) & (F.col("valid_to_year").isNull() | (F.col("valid_to_year") >= year)))
    best = valid.groupBy("category").agg(F.min_by("factor_value", "ord").alias("factor_value"))
    key = F.lower(F.col("cls"))
    fine = best.select(F.col("category").alias("__k1"), F.col("factor_value").alias("__f1"))
    coarse = best.select(F.col("category").alias("__k2"), F.col("factor_value").alias("__f2"))
    out = features.join(fine, F.concat_ws(":", key, F.lower(F.col("sub"))) == F.col("__k1"), "left").join(coarse, key == F.col("__k2"), "left")
    return out.withColumn("factor_value", F.coalesce("__f1", "__f2")).drop("__k1", "__f1", "__k2", "__f2")


@operator("join")
def overlapping_validity(new: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of new (category, from_year, to_year) that no known row of the category overlaps, ends included; a null
    end is open."""
    k = known.select(F.col("category").alias("__c"), F.col("from_year").alias("__a"), F.coalesce("to_year", F.lit(9999)).alias("__b"))
    meets = (F.col("category") == F.col("__c")) & (F.col("from_year") <= F.col("__b")) & (F.col("__a") <= F.coalesce("to_year", F.lit(9999)))
    return new.join(k, meets, "left_anti")


@operator("join")
def tiered_lookup(keys: DataFrame, overrides: DataFrame, regional: DataFrame, defaults: DataFrame) -> DataFrame:
    """keys (category, region) with the value and tier of the first table that has one: overrides and regional by both
    columns, defaults by category."""
    o = overrides.select("category", "region", F.col("value").alias("__o"))
    g = regional.select("category", "region", F.col("value").alias("__g"))
    n = defaults.select("category", F.col("value").alias("__n"))
    out = keys.join(o, ["category", "region"], "left").join(g, ["category", "region"], "left").join(n, "category", "left")
    tier = F.when(F.col("__o").isNotNull(), "override").when(F.col("__g").isNotNull(), "regional").when(F.col("__n").isNotNull(), "default")
    return out.withColumn("value", F.coalesce("__o", "__g", "__n")).withColumn("tier", tier).drop("__o", "__g", "__n")


def pairs_by(left: DataFrame, right: DataFrame, keys: list[str], test: Callable[[], Column]) -> DataFrame:
    """An equi-join with a residual predicate."""
    return left.join(right, keys).where(test())
