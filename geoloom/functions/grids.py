"""Discrete global grids: geohash, hexagons and map tiles, as column expressions."""

from __future__ import annotations

from math import pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
# fixed values: axial neighbour offsets of a hexagon
HEX_STEPS = [(1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)]
TILE_SOURCES = {
    "osm": "https://tile.openstreetmap.org/{z}/{x}/{y}.png",
    "opentopo": "https://tile.opentopomap.org/{z}/{x}/{y}.png",
}


# --- geohash


def geohash_bits(precision: int) -> tuple[int, int]:
    """Bits of longitude and latitude."""
    return (5 * precision + 1) // 2, 5 * precision // 2


def _cell(x: Column, low: float, width: float, bits: int) -> Column:
    n = 1 << bits
    return F.greatest(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), F.floor((x - low) / width * n).cast("long")))


def geohash_cell(lon: Column, lat: Column, precision: int) -> tuple[Column, Column]:
    """Integer column and row of the cell a point lies in."""
    bx, by = geohash_bits(precision)
    return _cell(lon, -180.0, 360.0, bx), _cell(lat, -90.0, 180.0, by)


def geohash_of_cell(ix: Column, iy: Column, precision: int) -> Column:
    """The text of a cell: its bits, longitude first, in groups of five."""
    bx, by = geohash_bits(precision)
    chars = []
    for k in range(precision):
        value = F.lit(0).cast("long")
        for j in range(5):
            i = 5 * k + j
            source, shift = (ix, bx - 1 - i // 2) if i % 2 == 0 else (iy, by - 1 - i // 2)
            value = value * 2 + F.shiftright(source, shift).bitwiseAND(F.lit(1).cast("long"))
        chars.append(F.substring(F.lit(BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*chars)


def geohash(lon: Column, lat: Column, precision: int) -> Column:
    return geohash_of_cell(*geohash_cell(lon, lat, precision), precision)


def geohash_decode(code: Column) -> Column:
    """A struct (x0, y0, x1, y1): the cell of a geohash of any precision; null if a character is none of base 32."""
    start = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(1.0).alias("nx"), F.lit(1.0).alias("ny"), F.lit(True).alias("even"), F.lit(True).alias("ok"))

    # each character's five bits alternate between the axes, beginning where the last one ended
    chars = F.filter(F.split(F.lower(code), ""), lambda x: x != "")

    def add(s: Column, ch: Column) -> Column:
        v = (F.position(ch, F.lit(BASE32)) - 1).cast("long")
        b = [F.shiftright(v, 4 - i).bitwiseAND(F.lit(1).cast("long")) for i in range(5)]
        three = lambda p: (b[p] * 4 + b[p + 2] * 2 + b[p + 4])
        two = b[1] * 2 + b[3]
        even = s["even"]
        x = F.when(even, s["x"] * 8 + three(0)).otherwise(s["x"] * 4 + two)
        y = F.when(even, s["y"] * 4 + two).otherwise(s["y"] * 8 + three(0))
        return F.struct(x.alias("x"), y.alias("y"), (s["nx"] * F.when(even, 8.0).otherwise(4.0)).alias("nx"), (s["ny"] * F.when(even, 4.0).otherwise(8.0)).alias("ny"), (~even).alias("even"), (s["ok"] & (v >= 0)).alias("ok"))

    def box(s: Column) -> Column:
        w, h = 360.0 / s["nx"], 180.0 / s["ny"]
        return F.when(s["ok"], F.struct((s["x"] * w - 180.0).alias("x0"), (s["y"] * h - 90.0).alias("y0"), ((s["x"] + 1) * w - 180.0).alias("x1"), ((s["y"] + 1) * h - 90.0).alias("y1")))

    return F.aggregate(chars, start, add, box)


def geohash_neighbours(lon: Column, lat: Column, precision: int) -> Column:
    """An array of the geohashes around a point's cell; longitude wraps, rows beyond the poles are left out."""
    bx, by = geohash_bits(precision)
    ix, iy = geohash_cell(lon, lat, precision)
    out = [F.when((iy + dy).between(0, (1 << by) - 1), geohash_of_cell(F.pmod(ix + dx, F.lit(1 << bx).cast("long")), iy + dy, precision)) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy) != (0, 0)]
    return F.array_compact(F.array(*out))


def geohash_cover(x0: Column, y0: Column, x1: Column, y1: Column, precision: int) -> Column:
    """An array of the geohashes that meet a box: every cell of the grid between its corners."""
    ax, ay = geohash_cell(x0, y0, precision)
    bx, by = geohash_cell(x1, y1, precision)
    cells = F.flatten(F.transform(F.sequence(ax, bx), lambda x: F.transform(F.sequence(ay, by), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    return F.transform(cells, lambda s: geohash_of_cell(s["x"], s["y"], precision))


# --- hexagons: axial coordinates on the plane of degrees scaled to the unit square


def hex_count(resolution: int) -> int:
    """Cells of the world at a resolution: 2 + 120 * 7^r."""
    if not 0 <= resolution <= 15:
        raise ValueError("resolutions are 0 to 15")
    return 2 + 120 * 7**resolution


def hex_size(resolution: int) -> float:
    """Centre to corner on the unit square."""
    return 1 / (1.5 * sqrt(hex_count(resolution)))


def _round_away(x: Column) -> Column:
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def hex_cell(lon: Column, lat: Column, resolution: int) -> tuple[Column, Column]:
    """Axial i, j of the cell a point lies in."""
    u, v = (lon + 180.0) / 360.0, (lat + 90.0) / 180.0
    s = hex_size(resolution)
    q, r = (u * (sqrt(3) / 3) - v / 3.0) / s, v * (2.0 / 3.0) / s
    t = -q - r
    qi, ri, ti = _round_away(q), _round_away(r), _round_away(t)
    dq, dr, dt = F.abs(qi - q), F.abs(ri - r), F.abs(ti - t)
    i = F.when((dq > dr) & (dq > dt), -ri - ti).otherwise(qi)
    j = F.when(~((dq > dr) & (dq > dt)) & (dr > dt), -qi - ti).otherwise(ri)
    return i.cast("long"), j.cast("long")


def hex_centre(i: Column, j: Column, resolution: int) -> tuple[Column, Column]:
    """lon, lat of a cell's centre."""
    s = hex_size(resolution)
    u, v = s * (sqrt(3) * i + sqrt(3) / 2 * j), s * 1.5 * j
    return u * 360.0 - 180.0, v * 180.0 - 90.0


def hex_boundary(i: Column, j: Column, resolution: int) -> Column:
    """The six corners (lon, lat) in order, within the world, the first again at the end."""
    from math import cos, radians, sin

    s = hex_size(resolution)
    u, v = s * (sqrt(3) * i + sqrt(3) / 2 * j), s * 1.5 * j
    corner = lambda k: F.struct(
        F.greatest(F.lit(-180.0), F.least(F.lit(180.0), (u + s * cos(radians(60 * k - 30))) * 360.0 - 180.0)).alias("x"),
        F.greatest(F.lit(-90.0), F.least(F.lit(90.0), (v + s * sin(radians(60 * k - 30))) * 180.0 - 90.0)).alias("y"),
    )
    return F.array(*[corner(k % 6) for k in range(7)])


def hex_neighbours(i: Column, j: Column) -> Column:
    return F.array(*[F.struct((i + a).alias("i"), (j + b).alias("j")) for a, b in HEX_STEPS])


def hex_disk(i: Column, j: Column, steps: int) -> Column:
    """All cells within so many steps, the centre included."""
    offsets = [(a, b) for a in range(-steps, steps + 1) for b in range(-steps, steps + 1) if abs(a + b) <= steps]
    return F.array(*[F.struct((i + a).alias("i"), (j + b).alias("j")) for a, b in offsets])


def hex_distance(i1: Column, j1: Column, i2: Column, j2: Column) -> Column:
    a, b = i1 - i2, j1 - j2
    return F.greatest(F.abs(a), F.abs(b), F.abs(a + b))


def _base36(x: Column) -> Column:
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lower(F.conv(F.abs(x).cast("string"), 10, 36)))


def hex_text(i: Column, j: Column, resolution: int) -> Column:
    return F.concat_ws("_", F.lit(f"h3_{resolution}"), _base36(i), _base36(j))


def hex_parse(text: Column) -> Column:
    """A struct (resolution, i, j); null for anything else."""
    part = lambda n: F.regexp_extract(text, r"^h3_(\d{1,2})_(-?[0-9a-z]+)_(-?[0-9a-z]+)$", n)
    number = lambda p: F.when(p.startswith("-"), -1).otherwise(1) * F.conv(F.ltrim(p, F.lit("-")), 36, 10).cast("long")
    return F.when(part(2) != "", F.struct(part(1).cast("int").alias("resolution"), number(part(2)).alias("i"), number(part(3)).alias("j")))


def hex_cover(x0: Column, y0: Column, x1: Column, y1: Column, resolution: int) -> Column:
    """The cells whose centres lie in a box (closed), row by row."""
    s = hex_size(resolution)
    v0, v1 = (y0 + 90.0) / 180.0, (y1 + 90.0) / 180.0
    rows = F.sequence(F.ceil(v0 / (1.5 * s)).cast("long"), F.floor(v1 / (1.5 * s)).cast("long"))

    def row(j: Column) -> Column:
        shift = j * 0.5
        a = F.ceil((x0 + 180.0) / 360.0 / (s * sqrt(3)) - shift).cast("long")
        b = F.floor((x1 + 180.0) / 360.0 / (s * sqrt(3)) - shift).cast("long")
        return F.when(a <= b, F.transform(F.sequence(a, F.greatest(a, b)), lambda i: F.struct(i.alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint>>"))

    none = F.array().cast("array<struct<i:bigint,j:bigint>>")
    return F.when(F.ceil(v0 / (1.5 * s)) <= F.floor(v1 / (1.5 * s)), F.flatten(F.transform(rows, row))).otherwise(none)


# --- map tiles


def tile_xy(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    n = 1 << zoom
    x = F.floor((lon + 180.0) / 360.0 * n)
    phi = F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat)))
    y = F.floor((1.0 - F.asinh(F.tan(phi)) / pi) / 2.0 * n)
    inside = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), v)).cast("long")
    return inside(x), inside(y)


def tile_corner(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """lon, lat of a tile's north-west corner."""
    n = float(1 << zoom)
    return x / n * 360.0 - 180.0, F.degrees(F.atan(F.sinh(pi * (1.0 - 2.0 * y / n))))


def tile_bounds(x: Column, y: Column, zoom: int) -> tuple[Column, Column, Column, Column]:
    """west, south, east, north."""
    w, n = tile_corner(x, y, zoom)
    e, s = tile_corner(x + 1, y + 1, zoom)
    return w, s, e, n


def tile_url(source: str, x: Column, y: Column, zoom: int) -> Column:
    before, rest = TILE_SOURCES[source].replace("{z}", str(zoom)).split("{x}")
    middle, after = rest.split("{y}")
    return F.concat(F.lit(before), x.cast("string"), F.lit(middle), y.cast("string"), F.lit(after))
