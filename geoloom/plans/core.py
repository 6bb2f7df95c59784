"""Projections, grids, geometry, joins, sources and carbon accounting as queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import crs, geometry, grids
from ..functions.base import c, rounded
from ..operators import carbon, joins, polygons
from ..sources import readers, sinks
from . import fixtures as fx
from .catalog import query, r

R = "6378137.0"


# --- projections


@query("crs_mercator", f"SELECT id, {r(f'RADIANS(lon) * {R}', 3)} AS x, {r(f'LN(TAN(PI() / 4 + RADIANS(lat) / 2)) * {R}', 3)} AS y FROM g_points", ("g_points",))
def crs_mercator(spark, d):
    x, y = crs.to_mercator(F.col("lon"), F.col("lat"))
    return fx.points(spark, d).select("id", rounded(x, 3).alias("x"), rounded(y, 3).alias("y"))


@query("crs_mercator_inverse", f"SELECT id, {r('lon', 7)} AS lon, {r('lat', 7)} AS lat FROM g_points", ("g_points",))
def crs_mercator_inverse(spark, d):
    lon, lat = crs.from_mercator(*crs.to_mercator(F.col("lon"), F.col("lat")))
    return fx.points(spark, d).select("id", rounded(lon, 7).alias("lon"), rounded(lat, 7).alias("lat"))


@query("crs_equal_area", f"SELECT id, {r(f'RADIANS(lon) * {R} * COS(RADIANS(30))', 3)} AS x, {r(f'SIN(RADIANS(lat)) * {R} / COS(RADIANS(30))', 3)} AS y FROM g_points", ("g_points",))
def crs_equal_area(spark, d):
    x, y = crs.to_equal_area(F.col("lon"), F.col("lat"))
    return fx.points(spark, d).select("id", rounded(x, 3).alias("x"), rounded(y, 3).alias("y"))


GCJ = """shifted AS (SELECT id, lon, lat, lon - 105 AS u, lat - 35 AS v, 1 - 0.006693421622965943 * POW(SIN(RADIANS(lat)), 2) AS m FROM g_points),
waves AS (SELECT *, (20 * SIN(6 * u * PI()) + 20 * SIN(2 * u * PI())) * 2 / 3 AS w FROM shifted),
polys AS (SELECT *, -100 + 2 * u + 3 * v + 0.2 * v * v + 0.1 * u * v + 0.2 * SQRT(ABS(u)) + w + (20 * SIN(v * PI()) + 40 * SIN(v / 3 * PI())) * 2 / 3 + (160 * SIN(v / 12 * PI()) + 320 * SIN(v * PI() / 30)) * 2 / 3 AS north,
 300 + u + 2 * v + 0.1 * u * u + 0.1 * u * v + 0.1 * SQRT(ABS(u)) + w + (20 * SIN(u * PI()) + 40 * SIN(u / 3 * PI())) * 2 / 3 + (150 * SIN(u / 12 * PI()) + 300 * SIN(u / 30 * PI())) * 2 / 3 AS east FROM waves),
gcj AS (SELECT id, lon, lat, CASE WHEN lon BETWEEN 72.004 AND 137.8347 AND lat BETWEEN 0.8293 AND 55.8271 THEN lon + east * 180 / (6378245.0 / SQRT(m) * COS(RADIANS(lat)) * PI()) ELSE lon END AS glon,
 CASE WHEN lon BETWEEN 72.004 AND 137.8347 AND lat BETWEEN 0.8293 AND 55.8271 THEN lat + north * 180 / (6378245.0 * (1 - 0.006693421622965943) / (m * SQRT(m)) * PI()) ELSE lat END AS glat FROM polys)"""


@query("crs_gcj02", f"SELECT id, {r('glon', 8)} AS lon, {r('glat', 8)} AS lat FROM gcj", ("g_points",), GCJ)
def crs_gcj02(spark, d):
    lon, lat = crs.to_gcj02(F.col("lon"), F.col("lat"))
    return fx.points(spark, d).select("id", rounded(lon, 8).alias("lon"), rounded(lat, 8).alias("lat"))


@query("crs_gcj02_inverse", f"SELECT id, {r('lon')} AS lon, {r('lat')} AS lat FROM g_points WHERE lon BETWEEN 75 AND 135 AND lat BETWEEN 5 AND 50", ("g_points",))
def crs_gcj02_inverse(spark, d):
    p = fx.points(spark, d).where("lon between 75 and 135 and lat between 5 and 50")
    back = crs.from_gcj02(*crs.to_gcj02(F.col("lon"), F.col("lat")))
    return p.select("id", rounded(back["lon"]).alias("lon"), rounded(back["lat"]).alias("lat"))


BD = "bd AS (SELECT id, lon, lat, SQRT(lon * lon + lat * lat) + 0.00002 * SIN(lat * PI() * 3000 / 180) AS z, ATAN2(lat, lon) + 0.000003 * COS(lon * PI() * 3000 / 180) AS t FROM g_points)"


@query("crs_bd09", f"SELECT id, {r('z * COS(t) + 0.0065', 8)} AS lon, {r('z * SIN(t) + 0.006', 8)} AS lat FROM bd", ("g_points",), BD)
def crs_bd09(spark, d):
    lon, lat = crs.gcj02_to_bd09(F.col("lon"), F.col("lat"))
    return fx.points(spark, d).select("id", rounded(lon, 8).alias("lon"), rounded(lat, 8).alias("lat"))


@query("crs_bd09_inverse", f"SELECT id, {r('SQRT(x * x + y * y) * COS(ATAN2(y, x)) + 0 * x', 2)} AS lon, {r('lat + 0', 2)} AS lat FROM (SELECT id, lon AS x, lat AS y, lat FROM g_points)", ("g_points",))
def crs_bd09_inverse(spark, d):
    lon, lat = crs.bd09_to_gcj02(*crs.gcj02_to_bd09(F.col("lon"), F.col("lat")))
    return fx.points(spark, d).select("id", rounded(lon, 2).alias("lon"), rounded(lat, 2).alias("lat"))


@query("haversine_pairs", f"SELECT a.id AS a_id, b.id AS b_id, {r('2 * 6371 * ASIN(SQRT(LEAST(1, POW(SIN(RADIANS(b.lat - a.lat) / 2), 2) + COS(RADIANS(a.lat)) * COS(RADIANS(b.lat)) * POW(SIN(RADIANS(b.lon - a.lon) / 2), 2))))')} AS km FROM g_points a JOIN g_points b ON b.id = a.id + 1", ("g_points",))
def haversine_pairs(spark, d):
    a = fx.points(spark, d).select(F.col("id").alias("a_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    b = fx.points(spark, d).select(F.col("id").alias("b_id"), "lon", "lat", (F.col("id") - 1).alias("a_id"))
    return a.join(b, "a_id").select("a_id", "b_id", rounded(crs.haversine_km(F.col("x"), F.col("y"), F.col("lon"), F.col("lat"))).alias("km"))


@query("great_circle_azimuth", f"SELECT a_id, {r('CASE WHEN z < 0 THEN z + 360 ELSE z END')} AS bearing FROM (SELECT a.id AS a_id, DEGREES(ATAN2(SIN(RADIANS(b.lon - a.lon)) * COS(RADIANS(b.lat)), COS(RADIANS(a.lat)) * SIN(RADIANS(b.lat)) - SIN(RADIANS(a.lat)) * COS(RADIANS(b.lat)) * COS(RADIANS(b.lon - a.lon)))) AS z FROM g_points a JOIN g_points b ON b.id = a.id + 1)", ("g_points",))
def great_circle_azimuth(spark, d):
    a = fx.points(spark, d).select(F.col("id").alias("a_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    b = fx.points(spark, d).select((F.col("id") - 1).alias("a_id"), "lon", "lat")
    return a.join(b, "a_id").select("a_id", rounded(crs.azimuth(F.col("x"), F.col("y"), F.col("lon"), F.col("lat"))).alias("bearing"))


FL = "(1 / 298.257223563)"
SIN_S = "SQRT(POW(COS(u2) * SIN(lam), 2) + POW(COS(u1) * SIN(u2) - SIN(u1) * COS(u2) * COS(lam), 2))"
COS_S = "(SIN(u1) * SIN(u2) + COS(u1) * COS(u2) * COS(lam))"
VIN = f"""pr AS (SELECT a.id AS a_id, RADIANS(b.lon - a.lon) AS l, ATAN((1 - {FL}) * TAN(RADIANS(a.lat))) AS u1, ATAN((1 - {FL}) * TAN(RADIANS(b.lat))) AS u2 FROM g_points a JOIN g_points b ON b.id = a.id + 1),
it(i, a_id, l, u1, u2, lam, moved) AS (SELECT 0, a_id, l, u1, u2, l, 1e9 FROM pr UNION ALL SELECT i + 1, a_id, l, u1, u2, CASE WHEN moved < 1e-12 THEN lam ELSE nl END, CASE WHEN moved < 1e-12 THEN moved ELSE ABS(nl - lam) END FROM (
 SELECT *, l + (1 - k) * {FL} * sa * (sg + k * ss * (cm + k * cs * (2 * cm * cm - 1))) AS nl FROM (SELECT *, {FL} / 16 * c2 * (4 + {FL} * (4 - 3 * c2)) AS k, CASE WHEN c2 = 0 THEN 0 ELSE cs - 2 * SIN(u1) * SIN(u2) / c2 END AS cm FROM (SELECT *, 1 - sa * sa AS c2, ATAN2(ss, cs) AS sg FROM (
 SELECT *, CASE WHEN ss = 0 THEN 0 ELSE COS(u1) * COS(u2) * SIN(lam) / ss END AS sa FROM (SELECT *, {SIN_S} AS ss, {COS_S} AS cs FROM it WHERE i < 60))))))"""
# the length from the angles of the last round, with the series in u^2
VLEN = f"""SELECT a_id, CASE WHEN moved < 1e-9 THEN {r('b * ca * (sg - cb * ss * (cm + cb / 4 * (cs * (2 * cm * cm - 1) - cb / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3))))', 1)} END AS metres FROM (
 SELECT *, 1 + q / 16384 * (4096 + q * (-768 + q * (320 - 175 * q))) AS ca, q / 1024 * (256 + q * (-128 + q * (74 - 47 * q))) AS cb FROM (SELECT *, c2 * (6378137.0 * 6378137.0 - b * b) / (b * b) AS q, CASE WHEN c2 = 0 THEN 0 ELSE cs - 2 * SIN(u1) * SIN(u2) / c2 END AS cm FROM (
 SELECT *, 6378137.0 * (1 - {FL}) AS b, 1 - POW(CASE WHEN ss = 0 THEN 0 ELSE COS(u1) * COS(u2) * SIN(lam) / ss END, 2) AS c2, ATAN2(ss, cs) AS sg FROM (SELECT *, {SIN_S} AS ss, {COS_S} AS cs FROM it WHERE i = 60))))"""


@query("vincenty_inverse", VLEN, ("g_points",), VIN)
def vincenty_inverse(spark, d):
    a = fx.points(spark, d).select(F.col("id").alias("a_id"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    b = fx.points(spark, d).select((F.col("id") - 1).alias("a_id"), "lon", "lat")
    return a.join(b, "a_id").select("a_id", rounded(crs.vincenty_m(F.col("x"), F.col("y"), F.col("lon"), F.col("lat")), 1).alias("metres"))


@query("vincenty_round_trip", f"SELECT id, {r('100000.0', 3)} AS metres FROM g_points WHERE ABS(lat) < 80", ("g_points",))
def vincenty_round_trip(spark, d):
    p = fx.points(spark, d).where("abs(lat) < 80")
    end = crs.vincenty_direct(F.col("lon"), F.col("lat"), F.col("id") % 360 * 1.0, F.lit(100000.0))
    p = p.withColumn("e", end)
    return p.select("id", rounded(crs.vincenty_m(F.col("lon"), F.col("lat"), F.col("e.lon"), F.col("e.lat")), 3).alias("metres"))


@query("gauss_round_trip", f"SELECT id, CAST(FLOOR(lon / 6) + 1 AS INTEGER) AS zone, {r('lon', 7)} AS lon, {r('lat', 7)} AS lat FROM g_points WHERE lon >= 0", ("g_points",))
def gauss_round_trip(spark, d):
    p = fx.points(spark, d).where("lon >= 0").withColumn("zone", crs.gauss_zone(F.col("lon")))
    m = crs.gauss_meridian(F.col("zone"))
    lon, lat = crs.tm_inverse(*crs.tm_forward(F.col("lon"), F.col("lat"), m, ellipsoid="cgcs2000"), m, ellipsoid="cgcs2000")
    return p.select("id", "zone", rounded(lon, 7).alias("lon"), rounded(lat, 7).alias("lat"))


# the meridian arc and the first terms in longitude, of the classic series: agrees to the metre near the meridian
UTM = """u AS (SELECT id, lon, lat, CAST(FLOOR((lon + 180) / 6) % 60 + 1 AS INTEGER) AS zone, RADIANS(lat) AS p FROM g_points WHERE ABS(lat) < 80),
m AS (SELECT *, RADIANS(lon - (zone * 6 - 183)) * COS(p) AS a, POW(TAN(p), 2) AS t, 0.00673949674228 * POW(COS(p), 2) AS k, 6378137.0 / SQRT(1 - 0.00669437999014 * POW(SIN(p), 2)) AS n,
 6378137.0 * ((1 - 0.00669437999014 / 4 - 3 * POW(0.00669437999014, 2) / 64 - 5 * POW(0.00669437999014, 3) / 256) * p - (3 * 0.00669437999014 / 8 + 3 * POW(0.00669437999014, 2) / 32 + 45 * POW(0.00669437999014, 3) / 1024) * SIN(2 * p) + (15 * POW(0.00669437999014, 2) / 256 + 45 * POW(0.00669437999014, 3) / 1024) * SIN(4 * p) - 35 * POW(0.00669437999014, 3) / 3072 * SIN(6 * p)) AS arc FROM u)"""


@query("utm_forward", "SELECT id, zone, CAST(FLOOR(500000 + 0.9996 * n * (a + (1 - t + k) * POW(a, 3) / 6 + (5 - 18 * t + t * t + 72 * k - 58 * 0.00673949674228) * POW(a, 5) / 120) + 0.5) AS BIGINT) // 10 AS east, CAST(FLOOR(CASE WHEN lat < 0 THEN 10000000 ELSE 0 END + 0.9996 * (arc + n * TAN(p) * (a * a / 2 + (5 - t + 9 * k + 4 * k * k) * POW(a, 4) / 24 + (61 - 58 * t + t * t + 600 * k - 330 * 0.00673949674228) * POW(a, 6) / 720)) + 0.5) AS BIGINT) // 10 AS north FROM m", ("g_points",), UTM)
def utm_forward(spark, d):
    e, n, zone, _ = crs.to_utm(F.col("lon"), F.col("lat"))
    ten = lambda v: F.floor(F.floor(v + 0.5) / 10).cast("long")
    return fx.points(spark, d).where("abs(lat) < 80").select("id", zone.alias("zone"), ten(e).alias("east"), ten(n).alias("north"))


@query("dms", f"SELECT id, CAST(SIGN(lon) * FLOOR(ABS(lon)) AS INTEGER) AS deg, CAST(FLOOR((ABS(lon) - FLOOR(ABS(lon))) * 60) AS INTEGER) AS minute, {r('((ABS(lon) - FLOOR(ABS(lon))) * 60 - FLOOR((ABS(lon) - FLOOR(ABS(lon))) * 60)) * 60')} AS second FROM g_points", ("g_points",))
def dms(spark, d):
    a, b, s = crs.to_dms(F.col("lon"))
    return fx.points(spark, d).select("id", a.alias("deg"), b.alias("minute"), rounded(s).alias("second"))


@query("geocentric_helmert", f"SELECT id, {r('12.5 + 1.000003 * (x - RADIANS(0.9 / 3600) * y + RADIANS(0.7 / 3600) * z)', 3)} AS x, {r('-8.25 + 1.000003 * (RADIANS(0.9 / 3600) * x + y - RADIANS(0.5 / 3600) * z)', 3)} AS y, {r('31.0 + 1.000003 * (-RADIANS(0.7 / 3600) * x + RADIANS(0.5 / 3600) * y + z)', 3)} AS z FROM (SELECT id, (n + 50) * COS(RADIANS(lat)) * COS(RADIANS(lon)) AS x, (n + 50) * COS(RADIANS(lat)) * SIN(RADIANS(lon)) AS y, (n * (1 - e2) + 50) * SIN(RADIANS(lat)) AS z FROM (SELECT *, 6378137.0 / SQRT(1 - e2 * POW(SIN(RADIANS(lat)), 2)) AS n FROM (SELECT *, (2 - 1 / 298.257223563) / 298.257223563 AS e2 FROM g_points)))", ("g_points",))
def geocentric_helmert(spark, d):
    x, y, z = crs.helmert(*crs.geocentric(F.col("lon"), F.col("lat"), F.lit(50.0)), (12.5, -8.25, 31.0), (0.5, 0.7, 0.9), 3.0)
    return fx.points(spark, d).select("id", rounded(x, 3).alias("x"), rounded(y, 3).alias("y"), rounded(z, 3).alias("z"))


F1, F2 = "(1 / 298.3)", "(1 / 298.257223563)"
ECC = f"({F1} * (2 - {F1}))"
MOLO = f"""mo AS (SELECT id, lon, lat, SIN(RADIANS(lat)) AS s, COS(RADIANS(lat)) AS k, SIN(RADIANS(lon)) AS sl, COS(RADIANS(lon)) AS cl, 6378245.0 / SQRT(1 - {ECC} * POW(SIN(RADIANS(lat)), 2)) AS n,
 6378245.0 * (1 - {ECC}) / POW(1 - {ECC} * POW(SIN(RADIANS(lat)), 2), 1.5) AS m FROM g_points)"""
D_LAT = f"(-15.8 * s * cl + 154.4 * s * sl - 82.3 * k - 108.0 * n * {ECC} * s * k / 6378245.0 + ({F2} - {F1}) * (m / (1 - {F1}) + n * (1 - {F1})) * s * k) / (m + 100)"


@query("molodensky_shift", f"SELECT id, {r('lon + DEGREES((-15.8 * sl - 154.4 * cl) / ((n + 100) * k))', 8)} AS lon, {r(f'lat + DEGREES({D_LAT})', 8)} AS lat, {r(f'100 + 15.8 * k * cl - 154.4 * k * sl - 82.3 * s + 108.0 * 6378245.0 / n + ({F2} - {F1}) * (1 - {F1}) * n * s * s', 4)} AS h FROM mo", ("g_points",), MOLO)
def molodensky_shift(spark, d):
    lon, lat, h = crs.molodensky(F.col("lon"), F.col("lat"), F.lit(100.0), (15.8, -154.4, -82.3), "beijing54", "wgs84")
    return fx.points(spark, d).select("id", rounded(lon, 8).alias("lon"), rounded(lat, 8).alias("lat"), rounded(h, 4).alias("h"))


@query("geoid_height", f"SELECT id, {r('v00 * (1 - x) * (1 - y) + v10 * x * (1 - y) + v01 * (1 - x) * y + v11 * x * y')} AS n FROM (SELECT id, (lon + 180) / 10 - FLOOR((lon + 180) / 10) AS x, (lat + 90) / 10 - FLOOR((lat + 90) / 10) AS y, FLOOR((lon + 180) / 10) * 0.5 + FLOOR((lat + 90) / 10) * 0.25 AS v00, FLOOR((lon + 180) / 10 + 1) * 0.5 + FLOOR((lat + 90) / 10) * 0.25 AS v10, FLOOR((lon + 180) / 10) * 0.5 + FLOOR((lat + 90) / 10 + 1) * 0.25 AS v01, FLOOR((lon + 180) / 10 + 1) * 0.5 + FLOOR((lat + 90) / 10 + 1) * 0.25 AS v11 FROM g_points)", ("g_points",))
def geoid_height(spark, d):
    """Bilinear in a 10-degree grid of undulations, joined by cell corners."""
    grid = spark.range(38 * 20).select((F.col("id") % 38).alias("i"), F.floor(F.col("id") / 38).alias("j")).withColumn("v", F.col("i") * 0.5 + F.col("j") * 0.25)
    p = fx.points(spark, d).withColumn("u", (F.col("lon") + 180) / 10).withColumn("w", (F.col("lat") + 90) / 10).withColumn("i", F.floor("u")).withColumn("j", F.floor("w"))
    corner = lambda n, a, b: grid.select((F.col("i") - a).alias("i"), (F.col("j") - b).alias("j"), F.col("v").alias(n))
    for n, a, b in (("v00", 0, 0), ("v10", 1, 0), ("v01", 0, 1), ("v11", 1, 1)):
        p = p.join(corner(n, a, b), ["i", "j"], "left")
    return p.select("id", rounded(crs.bilinear(F.col("u") - F.col("i"), F.col("w") - F.col("j"), F.col("v00"), F.col("v10"), F.col("v01"), F.col("v11"))).alias("n"))


# --- grids

BITS = "bits AS (SELECT id, lon, lat, CAST(FLOOR((lon + 180) / 360 * 4096 * 2) AS BIGINT) AS ix, CAST(FLOOR((lat + 90) / 180 * 4096) AS BIGINT) AS iy FROM g_points)"
GEOHASH5 = " || ".join("SUBSTR('0123456789bcdefghjkmnpqrstuvwxyz', CAST(1 + " + " + ".join(f"{16 >> j} * ((({'ix' if (5 * k + j) % 2 == 0 else 'iy'}) >> {(12 - (5 * k + j) // 2) if (5 * k + j) % 2 == 0 else (11 - (5 * k + j) // 2)}) & 1)" for j in range(5)) + " AS INTEGER), 1)" for k in range(5))


@query("geohash_encode", f"SELECT id, {GEOHASH5} AS code FROM bits", ("g_points",), BITS)
def geohash_encode(spark, d):
    return fx.points(spark, d).select("id", grids.geohash(F.col("lon"), F.col("lat"), 5).alias("code"))


@query("geohash_decode", f"SELECT id, {r('ix * 360.0 / 8192 - 180')} AS x0, {r('iy * 180.0 / 4096 - 90')} AS y0, {r('(ix + 1) * 360.0 / 8192 - 180')} AS x1, {r('(iy + 1) * 180.0 / 4096 - 90')} AS y1 FROM bits", ("g_points",), BITS)
def geohash_decode(spark, d):
    p = fx.points(spark, d).withColumn("b", grids.geohash_decode(grids.geohash(F.col("lon"), F.col("lat"), 5)))
    return p.select("id", *[rounded(F.col(f"b.{k}")).alias(k) for k in ("x0", "y0", "x1", "y1")])


@query("geohash_neighbors", "SELECT id, COUNT(*) AS n FROM (SELECT id, iy + dy AS y FROM bits, (VALUES (-1), (0), (1)) AS a(dx), (VALUES (-1), (0), (1)) AS b(dy) WHERE NOT (dx = 0 AND dy = 0)) WHERE y BETWEEN 0 AND 4095 GROUP BY id", ("g_points",), BITS)
def geohash_neighbors(spark, d):
    return fx.points(spark, d).select("id", F.size(F.array_distinct(grids.geohash_neighbours(F.col("lon"), F.col("lat"), 5))).cast("long").alias("n"))


@query("geohash_cover", "SELECT zone_id, CAST((LEAST(31, FLOOR((x1 + 180) / 360 * 32)) - FLOOR((x0 + 180) / 360 * 32) + 1) * (LEAST(31, FLOOR((y1 + 90) / 180 * 32)) - FLOOR((y0 + 90) / 180 * 32) + 1) AS BIGINT) AS cells FROM g_zones", ("g_zones",))
def geohash_cover(spark, d):
    return fx.zones(spark, d).select("zone_id", F.size(F.array_distinct(grids.geohash_cover(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 2))).cast("long").alias("cells"))


S5 = "(1 / (1.5 * SQRT(2016842.0)))"
HEX = f"""axial AS (SELECT id, (SQRT(3.0) / 3 * (lon + 180) / 360 - (lat + 90) / 180 / 3) / {S5} AS q, (2.0 / 3 * (lat + 90) / 180) / {S5} AS s FROM g_points),
cube AS (SELECT id, q, s, -q - s AS t, SIGN(q) * FLOOR(ABS(q) + 0.5) AS qi, SIGN(s) * FLOOR(ABS(s) + 0.5) AS si, SIGN(-q - s) * FLOOR(ABS(-q - s) + 0.5) AS ti FROM axial),
hex AS (SELECT id, CAST(CASE WHEN ABS(qi - q) > ABS(si - s) AND ABS(qi - q) > ABS(ti - t) THEN -si - ti ELSE qi END AS BIGINT) AS i, CAST(CASE WHEN ABS(qi - q) > ABS(si - s) AND ABS(qi - q) > ABS(ti - t) THEN si WHEN ABS(si - s) > ABS(ti - t) THEN -qi - ti ELSE si END AS BIGINT) AS j FROM cube)"""


@query("hex_cell", "SELECT id, i, j FROM hex", ("g_points",), HEX)
def hex_cell(spark, d):
    i, j = grids.hex_cell(F.col("lon"), F.col("lat"), 5)
    return fx.points(spark, d).select("id", i.alias("i"), j.alias("j"))


@query("hex_centre", f"SELECT id, {r(f'{S5} * (SQRT(3.0) * i + SQRT(3.0) / 2 * j) * 360 - 180')} AS lon, {r(f'{S5} * 1.5 * j * 180 - 90')} AS lat FROM hex", ("g_points",), HEX)
def hex_centre(spark, d):
    i, j = grids.hex_cell(F.col("lon"), F.col("lat"), 5)
    lon, lat = grids.hex_centre(F.col("i"), F.col("j"), 5)
    return fx.points(spark, d).select("id", i.alias("i"), j.alias("j")).select("id", rounded(lon).alias("lon"), rounded(lat).alias("lat"))


@query("hex_neighbors", "SELECT id, i + a AS i, j + b AS j FROM hex, (VALUES (1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)) AS s(a, b)", ("g_points",), HEX)
def hex_neighbors(spark, d):
    i, j = grids.hex_cell(F.col("lon"), F.col("lat"), 5)
    return fx.points(spark, d).select("id", i.alias("i"), j.alias("j")).select("id", F.explode(grids.hex_neighbours(F.col("i"), F.col("j"))).alias("n")).select("id", "n.i", "n.j")


@query("hex_disk", "SELECT id, COUNT(*) AS cells, CAST(SUM(i + a) AS BIGINT) AS si, CAST(SUM(j + b) AS BIGINT) AS sj FROM hex, (SELECT x.v AS a, y.v AS b FROM (VALUES (-2), (-1), (0), (1), (2)) AS x(v), (VALUES (-2), (-1), (0), (1), (2)) AS y(v) WHERE ABS(x.v + y.v) <= 2) GROUP BY id", ("g_points",), HEX)
def hex_disk(spark, d):
    i, j = grids.hex_cell(F.col("lon"), F.col("lat"), 5)
    p = fx.points(spark, d).select("id", i.alias("i"), j.alias("j")).select("id", F.explode(grids.hex_disk(F.col("i"), F.col("j"), 2)).alias("n"))
    return p.groupBy("id").agg(F.count("*").alias("cells"), F.sum("n.i").alias("si"), F.sum("n.j").alias("sj"))


@query("hex_text", "SELECT id, i, j FROM hex", ("g_points",), HEX)
def hex_text(spark, d):
    i, j = grids.hex_cell(F.col("lon"), F.col("lat"), 5)
    p = fx.points(spark, d).select("id", i.alias("i"), j.alias("j")).select("id", grids.hex_parse(grids.hex_text(F.col("i"), F.col("j"), 5)).alias("h"))
    return p.select("id", "h.i", "h.j")


@query("hex_boundary", f"SELECT id, {r(f'GREATEST(-180, LEAST(180, ({S5} * (SQRT(3.0) * i + SQRT(3.0) / 2 * j) + {S5} * COS(RADIANS(-30))) * 360 - 180))')} AS x, {r(f'GREATEST(-90, LEAST(90, ({S5} * 1.5 * j + {S5} * SIN(RADIANS(-30))) * 180 - 90))')} AS y FROM hex", ("g_points",), HEX)
def hex_boundary(spark, d):
    i, j = grids.hex_cell(F.col("lon"), F.col("lat"), 5)
    p = fx.points(spark, d).select("id", i.alias("i"), j.alias("j")).select("id", F.element_at(grids.hex_boundary(F.col("i"), F.col("j"), 5), 1).alias("p"))
    return p.select("id", rounded(F.col("p.x")).alias("x"), rounded(F.col("p.y")).alias("y"))


@query("hex_cover", "SELECT zone_id, COUNT(*) AS cells FROM (SELECT zone_id, x0, x1, s, j, UNNEST(GENERATE_SERIES(CAST(CEIL((x0 + 180) / 360 / (s * SQRT(3.0)) - j * 0.5) AS BIGINT), CAST(FLOOR((x1 + 180) / 360 / (s * SQRT(3.0)) - j * 0.5) AS BIGINT))) AS i FROM (SELECT zone_id, x0, x1, s, UNNEST(GENERATE_SERIES(CAST(CEIL((y0 + 90) / 180 / (1.5 * s)) AS BIGINT), CAST(FLOOR((y1 + 90) / 180 / (1.5 * s)) AS BIGINT))) AS j FROM (SELECT *, 1 / (1.5 * SQRT(5882.0)) AS s FROM g_zones))) GROUP BY zone_id", ("g_zones",))
def hex_cover(spark, d):
    return fx.zones(spark, d).select("zone_id", F.size(grids.hex_cover(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 2)).cast("long").alias("cells"))


TILE = "CAST(FLOOR((lon + 180) / 360 * 256) AS BIGINT) AS x, CAST(FLOOR((1 - LN(TAN(RADIANS(lat)) + 1 / COS(RADIANS(lat))) / PI()) / 2 * 256) AS BIGINT) AS y"


@query("tile_xy", f"SELECT id, {TILE} FROM g_points", ("g_points",))
def tile_xy(spark, d):
    x, y = grids.tile_xy(F.col("lon"), F.col("lat"), 8)
    return fx.points(spark, d).select("id", x.alias("x"), y.alias("y"))


@query("tile_bounds", f"SELECT id, {r('x / 256.0 * 360 - 180')} AS west, {r('DEGREES(ATAN((EXP(PI() * (1 - 2 * (y + 1) / 256.0)) - EXP(-PI() * (1 - 2 * (y + 1) / 256.0))) / 2))')} AS south, {r('(x + 1) / 256.0 * 360 - 180')} AS east, {r('DEGREES(ATAN((EXP(PI() * (1 - 2 * y / 256.0)) - EXP(-PI() * (1 - 2 * y / 256.0))) / 2))')} AS north FROM (SELECT id, {TILE} FROM g_points)", ("g_points",))
def tile_bounds(spark, d):
    x, y = grids.tile_xy(F.col("lon"), F.col("lat"), 8)
    b = grids.tile_bounds(F.col("x"), F.col("y"), 8)
    return fx.points(spark, d).select("id", x.alias("x"), y.alias("y")).select("id", *[rounded(v).alias(n) for v, n in zip(b, ("west", "south", "east", "north"))])


@query("tile_url", f"SELECT id, 'https://tile.openstreetmap.org/8/' || x || '/' || y || '.png' AS url FROM (SELECT id, {TILE} FROM g_points)", ("g_points",))
def tile_url(spark, d):
    x, y = grids.tile_xy(F.col("lon"), F.col("lat"), 8)
    return fx.points(spark, d).select("id", grids.tile_url("osm", x, y, 8).alias("url"))


@query("point_tiles", f"SELECT x, y, COUNT(*) AS n FROM (SELECT CAST(FLOOR((lon + 180) / 360 * 16) AS BIGINT) AS x, CAST(FLOOR((1 - LN(TAN(RADIANS(lat)) + 1 / COS(RADIANS(lat))) / PI()) / 2 * 16) AS BIGINT) AS y FROM g_points) GROUP BY x, y", ("g_points",))
def point_tiles(spark, d):
    return sinks.point_tiles(fx.points(spark, d), 4).where("length(data) > 0").select("x", "y", "n")


# --- geometry

RING = "edges AS (SELECT a.poly_id, a.x AS ax, a.y AS ay, b.x AS qx, b.y AS qy, a.k FROM g_poly_vertices a JOIN g_poly_vertices b ON a.poly_id = b.poly_id AND b.k = (a.k + 1) % 6)"


@query("polygon_area", f"SELECT e.poly_id, {r('ABS(SUM(ax * qy - qx * ay)) / 2')} AS deg2, {r('ABS(SUM(ax * qy - qx * ay)) / 2 * 111320.0 * 111320.0 * COS(RADIANS((SUM(ay) + MAX(CASE WHEN k = 0 THEN ay END)) / 7))', 0)} AS m2, {r('ABS(SUM(ax * qy - qx * ay)) / 2 * 111320.0 * 111320.0 * COS(RADIANS(SUM((ay + qy) * (ax * qy - qx * ay)) / (3 * SUM(ax * qy - qx * ay))))', 0)} AS carbon_m2 FROM edges e GROUP BY e.poly_id", ("g_poly_vertices",), RING)
def polygon_area(spark, d):
    ring = F.col("ring")
    return fx.polygons(spark, d).select("poly_id", rounded(geometry.area_deg2(ring)).alias("deg2"), rounded(geometry.area_m2(ring), 0).alias("m2"), rounded(geometry.carbon_area_m2(ring), 0).alias("carbon_m2"))


@query("polygon_centroid", f"SELECT poly_id, {r('SUM((ax + qx) * (ax * qy - qx * ay)) / (3 * SUM(ax * qy - qx * ay))')} AS x, {r('SUM((ay + qy) * (ax * qy - qx * ay)) / (3 * SUM(ax * qy - qx * ay))')} AS y FROM edges GROUP BY poly_id", ("g_poly_vertices",), RING)
def polygon_centroid(spark, d):
    p = geometry.centroid(F.col("ring"))
    return fx.polygons(spark, d).select("poly_id", rounded(p["x"]).alias("x"), rounded(p["y"]).alias("y"))


@query("box_buffer", f"SELECT poly_id, {r('MIN(x) - 0.5')} AS x0, {r('MIN(y) - 0.5')} AS y0, {r('MAX(x) + 0.5')} AS x1, {r('MAX(y) + 0.5')} AS y1 FROM g_poly_vertices GROUP BY poly_id", ("g_poly_vertices",))
def box_buffer(spark, d):
    b = geometry.box(geometry.box_buffer(F.col("ring"), F.lit(0.5)))
    return fx.polygons(spark, d).select("poly_id", *[rounded(b[k]).alias(k) for k in ("x0", "y0", "x1", "y1")])


@query("point_buffer", f"SELECT id, {r(f'32 / 2.0 * SIN(2 * PI() / 32) * 0.25')} AS area FROM g_points", ("g_points",))
def point_buffer(spark, d):
    return fx.points(spark, d).select("id", rounded(geometry.area_deg2(geometry.point_buffer(F.col("lon"), F.col("lat"), F.lit(0.5)))).alias("area"))


# the hull of a convex ring's octagons is its Minkowski sum with one: area, octagon, and each edge times the octagon's reach along its normal
REACH = "LIST_MAX(LIST_TRANSFORM(RANGE(0, 8), lambda k: 0.5 * COS(ATAN2(ax - qx, qy - ay) - k * PI() / 4)))"


@query("buffer_hull", f"SELECT poly_id, {r(f'SUM(ax * qy - qx * ay) / 2 + 4 * 0.25 * SIN(PI() / 4) + SUM(SQRT(POW(qx - ax, 2) + POW(qy - ay, 2)) * {REACH})', 4)} AS area FROM edges GROUP BY poly_id", ("g_poly_vertices",), RING)
def buffer_hull(spark, d):
    return polygons.buffer_hull(fx.polygons(spark, d), 0.5).select("poly_id", rounded(geometry.area_deg2(F.col("ring")), 4).alias("area"))


@query("geometry_problems", "SELECT poly_id, 0 AS n FROM g_poly_vertices GROUP BY poly_id", ("g_poly_vertices",))
def geometry_problems(spark, d):
    return fx.polygons(spark, d).select("poly_id", F.size(geometry.problems(F.col("ring"))).alias("n"))


@query("self_intersection", "SELECT poly_id, 1 AS crossings FROM g_poly_vertices GROUP BY poly_id", ("g_poly_vertices",))
def self_intersection(spark, d):
    """A bow tie of four corners of each hexagon crosses itself once."""
    p = lambda k: F.element_at("ring", k)
    bow = F.array(p(1), p(3), p(2), p(4), p(1))
    return fx.polygons(spark, d).select("poly_id", geometry.self_crossings(bow).alias("crossings"))


@query("polygon_vertices", f"SELECT poly_id, k, {r('x')} AS x, {r('y')} AS y FROM g_poly_vertices", ("g_poly_vertices",))
def polygon_vertices(spark, d):
    return sinks.vertices(fx.polygons(spark, d)).where("k < 6").select("poly_id", "k", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


@query("simplify_distance")
def simplify_distance(spark, d):
    return polygons.simplify(fx.polygons(spark, d), 1.5).select("poly_id", F.size("ring").alias("points"))


@query("simplify_area")
def simplify_area(spark, d):
    return polygons.simplify(fx.polygons(spark, d), 4.0, "area").select("poly_id", F.size("ring").alias("points"))


def _shifted_pairs(spark, d):
    a = fx.polygons(spark, d).select(F.col("poly_id").alias("a_id"), F.col("ring").alias("a_ring"))
    return a.withColumn("b_ring", F.transform("a_ring", lambda p: F.struct((p["x"] + 1.0).alias("x"), (p["y"] + 0.5).alias("y"))))


@query("overlay_areas", f"SELECT poly_id AS a_id, {r('s')} AS total FROM (SELECT poly_id, 2 * ABS(SUM(ax * qy - qx * ay)) / 2 AS s FROM edges GROUP BY poly_id)", ("g_poly_vertices",), RING)
def overlay_areas(spark, d):
    """|A u B| + |A n B| = |A| + |B|, with B a shifted copy of A."""
    p = _shifted_pairs(spark, d)
    u = polygons.overlay(p, "union").select("a_id", F.col("area").alias("u"))
    i = polygons.overlay(p, "intersection").select("a_id", F.col("area").alias("i"))
    return u.join(i, "a_id").select("a_id", rounded(F.col("u") + F.col("i")).alias("total"))


@query("overlay_difference", f"SELECT poly_id AS a_id, {r('0.0')} AS rest FROM g_poly_vertices GROUP BY poly_id", ("g_poly_vertices",))
def overlay_difference(spark, d):
    """|A xor B| = |A - B| + |B - A|, and |A - B| = |A| - |A n B|."""
    p = _shifted_pairs(spark, d)
    x = polygons.overlay(p, "symmetric").select("a_id", F.col("area").alias("x"))
    m = polygons.overlay(p, "difference").select("a_id", "a_ring", F.col("area").alias("m"))
    i = polygons.overlay(p, "intersection").select("a_id", F.col("area").alias("i"))
    out = x.join(m, "a_id").join(i, "a_id")
    return out.select("a_id", rounded(F.abs(F.col("x") - 2 * F.col("m")) + F.abs(geometry.area_deg2(F.col("a_ring")) - F.col("i") - F.col("m")), 6).alias("rest"))


@query("clip_to_zones", f"SELECT poly_id, {r('SUM(ABS(a))', 5)} AS area FROM (SELECT poly_id, SUM(ax * qy - qx * ay) / 2 AS a FROM edges GROUP BY poly_id) GROUP BY poly_id", ("g_poly_vertices",), RING)
def clip_to_zones(spark, d):
    """Polygons cut by the zones they meet; the zones tile the world, so the parts add up to the polygon."""
    b = geometry.box(F.col("ring"))
    p = fx.polygons(spark, d).select("poly_id", F.col("ring").alias("a_ring"), *[b[k].alias(k) for k in ("x0", "y0", "x1", "y1")])
    met = joins.box_pairs(p, fx.zones(spark, d).select("zone_id", "x0", "y0", "x1", "y1"), 36.0)
    pairs = met.select("poly_id", "a_ring", geometry.box_ring(F.col("b_x0"), F.col("b_y0"), F.col("b_x1"), F.col("b_y1")).alias("b_ring"))
    return polygons.overlay(pairs).groupBy("poly_id").agg(F.sum("area").alias("a")).select("poly_id", rounded(F.col("a"), 5).alias("area"))


@query("zone_gaps")
def zone_gaps(spark, d):
    """What the hull of three neighbouring hexagons holds beside them."""
    return polygons.gaps(fx.polygons(spark, d).select(F.floor(F.col("poly_id") / 3).alias("gid"), "ring")).select("gid", rounded(F.col("area"), 4).alias("area"))


# --- joins

ZJ = "zj AS (SELECT p.*, z.zone_id, z.zone_name FROM g_points p LEFT JOIN g_zones z ON p.lon >= z.x0 AND p.lon < z.x1 AND p.lat >= z.y0 AND p.lat < z.y1)"


@query("zone_join", "SELECT id, zone_id, zone_name FROM zj", ("g_points", "g_zones"), ZJ)
def zone_join(spark, d):
    return joins.zone_join(fx.points(spark, d), fx.zones(spark, d)).select("id", "zone_id", "zone_name")


@query("pip_join", "SELECT p.id, MIN(i.poly_id) AS poly_id FROM g_points p LEFT JOIN (SELECT q.id, e.poly_id FROM g_points q JOIN edges e ON q.lon BETWEEN e.ax - 7 AND e.ax + 7 AND q.lat BETWEEN e.ay - 7 AND e.ay + 7 WHERE (qx - ax) * (q.lat - ay) - (qy - ay) * (q.lon - ax) > 0 GROUP BY q.id, e.poly_id HAVING COUNT(*) = 6) i ON p.id = i.id GROUP BY p.id", ("g_points", "g_poly_vertices"), RING)
def pip_join(spark, d):
    return joins.pip_join(fx.points(spark, d), fx.polygons(spark, d)).select("id", "poly_id")


@query("box_pairs", "WITH b AS (SELECT poly_id, MIN(x) AS x0, MIN(y) AS y0, MAX(x) AS x1, MAX(y) AS y1 FROM g_poly_vertices GROUP BY poly_id) SELECT l.poly_id AS a, m.poly_id AS b FROM b l JOIN b m ON l.x0 <= m.x1 AND m.x0 <= l.x1 AND l.y0 <= m.y1 AND m.y0 <= l.y1 WHERE l.poly_id < m.poly_id".replace("WITH b AS (", "SELECT * FROM (WITH b AS (") + ")", ("g_poly_vertices",))
def box_pairs(spark, d):
    b = geometry.box(F.col("ring"))
    p = fx.polygons(spark, d)
    side = lambda n: p.select(F.col("poly_id").alias(n), *[b[k].alias(k) for k in ("x0", "y0", "x1", "y1")])
    return joins.box_pairs(side("a"), side("b")).where("a < b").select("a", "b")


@query("points_in_boxes", "SELECT z.zone_id, COUNT(*) AS n FROM g_points p JOIN g_zones z ON p.lon BETWEEN z.x0 AND z.x1 AND p.lat BETWEEN z.y0 AND z.y1 GROUP BY z.zone_id", ("g_points", "g_zones"))
def points_in_boxes(spark, d):
    test = geometry.in_box(F.col("lon"), F.col("lat"), tuple(F.col(k) for k in ("x0", "y0", "x1", "y1")))
    return joins.cell_join(fx.points(spark, d), fx.zones(spark, d), "lon", "lat", ("x0", "y0", "x1", "y1"), test, 36.0).groupBy("zone_id").agg(F.count("*").alias("n"))


@query("knn3", f"SELECT q_id, rank, p_id, {r('d')} AS d FROM (SELECT q.poly_id AS q_id, p.id AS p_id, SQRT(POW(q.x - p.lon, 2) + POW(q.y - p.lat, 2)) AS d, CAST(ROW_NUMBER() OVER (PARTITION BY q.poly_id ORDER BY SQRT((q.x - p.lon) * (q.x - p.lon) + (q.y - p.lat) * (q.y - p.lat)), p.id) AS INTEGER) AS rank FROM g_poly_vertices q JOIN g_points p ON q.poly_id <> p.id WHERE q.k = 0) WHERE rank <= 3", ("g_points", "g_poly_vertices"))
def knn3(spark, d):
    q = fx.polygons(spark, d).select(F.col("poly_id").alias("q_id"), F.element_at("ring", 1).alias("p")).select("q_id", F.col("p.x").alias("q_x"), F.col("p.y").alias("q_y"))
    p = fx.points(spark, d).select(F.col("id").alias("p_id"), F.col("lon").alias("p_x"), F.col("lat").alias("p_y"))
    return joins.knn(q, p, 3).select("q_id", "rank", "p_id", rounded(F.col("d")).alias("d"))


@query("within_radius", f"SELECT q.poly_id AS o_id, p.cls, COUNT(*) AS n FROM g_poly_vertices q JOIN g_points p ON 2 * 6371 * ASIN(SQRT(LEAST(1, POW(SIN(RADIANS(p.lat - q.y) / 2), 2) + COS(RADIANS(q.y)) * COS(RADIANS(p.lat)) * POW(SIN(RADIANS(p.lon - q.x) / 2), 2)))) <= 1500 WHERE q.k = 0 GROUP BY 1, 2", ("g_points", "g_poly_vertices"))
def within_radius(spark, d):
    o = fx.polygons(spark, d).select(F.col("poly_id").alias("o_id"), F.element_at("ring", 1).alias("p")).select("o_id", F.col("p.x").alias("o_lon"), F.col("p.y").alias("o_lat"))
    p = fx.points(spark, d).select(F.col("id").alias("p_id"), F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat"), "cls")
    return joins.count_within_radius(o, p, 1500.0, "cls")


FACT = "fact AS (SELECT category, factor_value FROM g_factors WHERE valid_from_year <= 2020 AND (valid_to_year IS NULL OR valid_to_year >= 2020))"


def _factors(spark, d):
    return fx.factors(spark, d).withColumn("ord", F.monotonically_increasing_id())


@query("factor_valid_join", "SELECT id, cls, factor_value FROM g_points LEFT JOIN fact ON cls = category", ("g_points", "g_factors"), FACT)
def factor_valid_join(spark, d):
    p = fx.points(spark, d).withColumn("sub", F.lit("any"))
    return joins.valid_factor_join(p, _factors(spark, d), 2020).select("id", "cls", "factor_value")


@query("unmatched_features", "SELECT cls, COUNT(*) AS n FROM g_points WHERE cls NOT IN (SELECT category FROM fact) GROUP BY cls", ("g_points", "g_factors"), FACT)
def unmatched_features(spark, d):
    known = fx.factors(spark, d).where("valid_from_year <= 2020 and (valid_to_year is null or valid_to_year >= 2020)").select(F.col("category").alias("cls"))
    return fx.points(spark, d).join(known, "cls", "left_anti").groupBy("cls").agg(F.count("*").alias("n"))


@query("validity_overlap", "SELECT n_name AS category, from_year FROM (SELECT n_nationkey, n_name, CASE n_nationkey % 5 WHEN 0 THEN 'forest' WHEN 1 THEN 'wetland' ELSE 'tundra' END AS category, 2005 + n_nationkey AS from_year FROM nation) c WHERE NOT EXISTS (SELECT 1 FROM g_factors f WHERE f.category = c.category AND c.from_year <= COALESCE(f.valid_to_year, 9999) AND f.valid_from_year <= c.from_year + 3)", ("g_factors",))
def validity_overlap(spark, d):
    n = fx.table(spark, d, "nation")
    kind = F.when(F.col("n_nationkey") % 5 == 0, "forest").when(F.col("n_nationkey") % 5 == 1, "wetland").otherwise("tundra")
    new = n.select(F.col("n_name").alias("name"), kind.alias("category"), (F.col("n_nationkey") + 2005).alias("from_year"), (F.col("n_nationkey") + 2008).alias("to_year"))
    known = fx.factors(spark, d).select("category", F.col("valid_from_year").alias("from_year"), F.col("valid_to_year").alias("to_year"))
    return joins.overlapping_validity(new, known).select(F.col("name").alias("category"), "from_year")


@query("tiered_lookup", "SELECT k.cls AS category, k.region, COALESCE(o.v, g.v, f.factor_value) AS value, CASE WHEN o.v IS NOT NULL THEN 'override' WHEN g.v IS NOT NULL THEN 'regional' WHEN f.factor_value IS NOT NULL THEN 'default' END AS tier FROM (SELECT DISTINCT cls, CAST(id % 3 AS INTEGER) AS region FROM g_points) k LEFT JOIN (VALUES ('forest', 0, -9.0::DOUBLE)) AS o(c, r, v) ON o.c = k.cls AND o.r = k.region LEFT JOIN (VALUES ('forest', 0, -8.0::DOUBLE), ('wetland', 1, -7.0::DOUBLE)) AS g(c, r, v) ON g.c = k.cls AND g.r = k.region LEFT JOIN fact f ON f.category = k.cls", ("g_points", "g_factors"), FACT)
def tiered_lookup(spark, d):
    keys = fx.points(spark, d).select(F.col("cls").alias("category"), (F.col("id") % 3).cast("int").alias("region")).distinct()
    over = spark.createDataFrame([("forest", 0, -9.0)], "category string, region int, value double")
    regional = spark.createDataFrame([("forest", 0, -8.0), ("wetland", 1, -7.0)], "category string, region int, value double")
    default = fx.factors(spark, d).where("valid_from_year <= 2020 and (valid_to_year is null or valid_to_year >= 2020)").select("category", F.col("factor_value").alias("value"))
    return joins.tiered_lookup(keys, over, regional, default).select("category", "region", "value", "tier")


# --- carbon


@query("carbon_by_zone", f"SELECT zone_id, zone_name, cls, COUNT(*) AS n, {r('SUM(ABS(w) * factor_value)', 4)} AS emission FROM zj JOIN fact ON cls = category GROUP BY zone_id, zone_name, cls", ("g_points", "g_zones", "g_factors"), f"{ZJ}, {FACT}")
def carbon_by_zone(spark, d):
    """Points to zones, classes to the year's factors, emissions by zone and class: the flagship."""
    p = joins.zone_join(fx.points(spark, d), fx.zones(spark, d)).withColumn("sub", F.lit(None).cast("string"))
    known = joins.valid_factor_join(p, _factors(spark, d), 2020).where("factor_value is not null")
    out = known.groupBy("zone_id", "zone_name", "cls").agg(F.count("*").alias("n"), F.sum(F.abs("w") * F.col("factor_value")).alias("e"))
    return out.select("zone_id", "zone_name", "cls", "n", rounded(F.col("e"), 4).alias("emission"))


CLASSES = "classes AS (SELECT cls, COUNT(*) AS features, factor_value, SIGN(SUM(ABS(w))) * FLOOR(ABS(SUM(ABS(w))) * 100 + 0.5) / 100 AS area_ha, SIGN(SUM(ABS(w)) * factor_value) * FLOOR(ABS(SUM(ABS(w)) * factor_value) * 100 + 0.5) / 100 AS emission FROM g_points JOIN fact ON cls = category WHERE ABS(w) > 0 GROUP BY cls, factor_value)"


def _classes(spark, d):
    p = fx.points(spark, d).withColumn("sub", F.lit(None).cast("string")).withColumn("area_ha", F.abs("w"))
    return carbon.class_emissions(joins.valid_factor_join(p, _factors(spark, d), 2020))


@query("carbon_classes", f"SELECT cls, features, factor_value, {r('area_ha', 2)} AS area_ha, {r('emission', 1)} AS emission, CAST(ROW_NUMBER() OVER (ORDER BY ABS(emission) DESC, cls) AS INTEGER) AS place FROM classes", ("g_points", "g_factors"), f"{FACT}, {CLASSES}")
def carbon_classes(spark, d):
    return _classes(spark, d).select("cls", "features", "factor_value", rounded(F.col("area_ha"), 2).alias("area_ha"), rounded(F.col("emission"), 1).alias("emission"), "place")


@query("carbon_totals", f"SELECT {r('SUM(area_ha)', 2)} AS area_ha, {r('SUM(emission)', 1)} AS emission, CAST(SUM(features) AS BIGINT) AS features FROM classes", ("g_points", "g_factors"), f"{FACT}, {CLASSES}")
def carbon_totals(spark, d):
    t = carbon.report_totals(_classes(spark, d))
    return t.select(rounded(F.col("area_ha"), 2).alias("area_ha"), rounded(F.col("emission"), 1).alias("emission"), "features")


@query("top_classes", f"SELECT cls, {r('emission', 1)} AS emission FROM classes ORDER BY ABS(emission) DESC, cls LIMIT 2", ("g_points", "g_factors"), f"{FACT}, {CLASSES}")
def top_classes(spark, d):
    return _classes(spark, d).where("place <= 2").select("cls", rounded(F.col("emission"), 1).alias("emission"))


FUEL = "fuel AS (SELECT * FROM (VALUES ('RawCoal', 20.908, 26.37, 0.94), ('NaturalGas', 389.31, 15.32, 0.99), ('Diesel', 42.652, 20.20, 0.98)) AS t(f, ncv, cc, ox))"
USE = "CAST(a.quantity AS DOUBLE) * f.ncv::DOUBLE * f.cc::DOUBLE * f.ox::DOUBLE / 1000 * 44 / 12"


@query("activity_emissions", f"SELECT a.fuel_type, {r('SUM(a.quantity)', 2)} AS quantity, COUNT(*) AS n, {r('SUM(a.quantity) * MAX(f.ncv)::DOUBLE * MAX(f.cc)::DOUBLE * MAX(f.ox)::DOUBLE / 1000 * 44 / 12', 2)} AS tco2 FROM g_activities a JOIN fuel f ON f.f = a.fuel_type GROUP BY a.fuel_type", ("g_activities",), FUEL)
def activity_emissions(spark, d):
    out = carbon.activity_emissions(fx.activities(spark, d))
    return out.select("fuel_type", rounded(F.col("quantity"), 2).alias("quantity"), "n", rounded(F.col("tco2"), 2).alias("tco2"))


@query("scope_totals", f"SELECT COALESCE(a.scope, 'scope1') AS scope, COUNT(*) AS n, {r(f'SUM({USE})', 2)} AS tco2e FROM g_activities a JOIN fuel f ON f.f = a.fuel_type GROUP BY 1", ("g_activities",), FUEL)
def scope_totals(spark, d):
    a = fx.activities(spark, d).withColumn("tco2e", carbon.fuel_co2(F.col("fuel_type"), F.col("quantity")))
    return carbon.scope_totals(a).select("scope", "n", rounded(F.col("tco2e"), 2).alias("tco2e"))


@query("gas_breakdown", f"SELECT cls, {r('SUM(a * 1.5)', 3)} AS co2, {r('SUM(a * 0.02 * 27)', 3)} AS ch4, {r('SUM(a * 0.001 * 273)', 3)} AS n2o, {r('SUM(a * 0.0001 * 24300)', 3)} AS other FROM (SELECT cls, FLOOR(ABS(w)) AS a FROM g_points) GROUP BY cls", ("g_points",))
def gas_breakdown(spark, d):
    gases = F.array(*[F.struct(F.lit(g).alias("gas"), F.lit(f).alias("f")) for g, f in (("CO2", 1.5), ("CH4", 0.02), ("N2O", 0.001), ("SF6", 0.0001))])
    rows = fx.points(spark, d).select("cls", F.floor(F.abs("w")).cast("double").alias("a"), F.explode(gases).alias("g")).select("cls", "g.gas", (F.col("a") * F.col("g.f") * carbon.warming(F.col("g.gas"))).alias("tco2e"))
    out = carbon.gas_breakdown(rows)
    return out.select("cls", *[rounded(F.col(k), 3).alias(k) for k in ("co2", "ch4", "n2o", "other")])


@query("pool_dynamics", f"SELECT id, {r('ABS(w) * EXP(-0.1 * 5) + 2.0 * (1 - EXP(-0.1 * 5)) / 0.1')} AS dead, {r('120 - (120 - ABS(w) / 100) * EXP(-0.05 * 10)')} AS soil, {r('ABS(w) / 10 * 0.5 * 1.4 * 1.25 * 0.47 * (44.0::DOUBLE / 12.0::DOUBLE)')} AS biomass FROM g_points", ("g_points",))
def pool_dynamics(spark, d):
    w = F.abs("w")
    return fx.points(spark, d).select("id", rounded(carbon.pool_after(w, c(2.0), c(0.1), c(5.0))).alias("dead"), rounded(carbon.soil_transition(w / 100.0, c(120.0), c(10.0))).alias("soil"), rounded(carbon.biomass_stock(w / 10.0, 0.5, 1.4, 0.25)).alias("biomass"))


@query("zone_budget", f"SELECT z.zone_id, z.zone_name, {r('COALESCE(SUM(a * factor_value), 0)', 3)} AS net, {r('COALESCE(SUM(CASE WHEN factor_value > 0 THEN a * factor_value END), 0)', 3)} AS sources, {r('COALESCE(SUM(CASE WHEN factor_value < 0 THEN a * factor_value END), 0)', 3)} AS sinks, CAST(COALESCE(SUM(CASE WHEN q.id IS NOT NULL AND factor_value IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS skipped FROM g_zones z LEFT JOIN (SELECT zone_id, id, FLOOR(ABS(w)) AS a, factor_value FROM zj LEFT JOIN fact ON cls = category) q ON q.zone_id = z.zone_id GROUP BY z.zone_id, z.zone_name", ("g_points", "g_zones", "g_factors"), f"{ZJ}, {FACT}")
def zone_budget(spark, d):
    cover = joins.zone_join(fx.points(spark, d), fx.zones(spark, d)).select("zone_id", F.col("cls").alias("category"), F.floor(F.abs("w")).cast("double").alias("area_ha"))
    out = carbon.land_budget(fx.zones(spark, d), cover, fx.factors(spark, d), 2020)
    return out.select("zone_id", "zone_name", *[rounded(F.col(k), 3).alias(k) for k in ("net", "sources", "sinks")], "skipped")


# --- sources


@query("quality_rules", "SELECT reason, COUNT(*) AS n FROM (SELECT CASE WHEN sensor_type = 'temperature' AND (value < -50 OR value > 60) THEN 'temperature out of range' WHEN sensor_type = 'humidity' AND (value < 0 OR value > 100) THEN 'humidity out of range' WHEN sensor_type = 'pm25' AND (value < 0 OR value >= 1000) THEN 'pm25 out of range' ELSE 'ok' END AS reason FROM g_readings) GROUP BY reason", ("g_readings",))
def quality_rules(spark, d):
    return readers.checked_readings(fx.readings(spark, d)).groupBy(F.coalesce("reject_reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("nmea_scan", f"SELECT id, {r('lat', 5)} AS lat, {r('lon', 5)} AS lon FROM g_points", ("g_points",))
def nmea_scan(spark, d):
    """Points written as GGA sentences and read back."""
    part = lambda v, width, a, b: F.concat(F.lpad(F.floor(F.abs(v)).cast("string"), width, "0"), F.lpad(F.format_string("%.7f", (F.abs(v) - F.floor(F.abs(v))) * 60.0), 10, "0"), F.lit(","), F.when(v < 0, b).otherwise(a))
    line = F.concat(F.lit("$GPGGA,"), F.col("id").cast("string"), F.lit(","), part(F.col("lat"), 2, "N", "S"), F.lit(","), part(F.col("lon"), 3, "E", "W"), F.lit(",1,08,0.9,545.4,M,46.9,M,,*47"))
    got = readers.nmea(fx.points(spark, d).select(line.alias("value")))
    return got.select(F.col("time").cast("long").alias("id"), rounded(F.col("lat"), 5).alias("lat"), rounded(F.col("lon"), 5).alias("lon"))


@query("wkt_scan", f"SELECT id, {r('lon', 4)} AS x, {r('lat', 4)} AS y FROM g_points", ("g_points",))
def wkt_scan(spark, d):
    p = fx.points(spark, d).select("id", readers.wkt_point(F.format_string("POINT(%.6f %.6f)", "lon", "lat")).alias("p"))
    return p.select("id", rounded(F.col("p.x"), 4).alias("x"), rounded(F.col("p.y"), 4).alias("y"))


@query("wkb_round_trip", f"SELECT id, {r('lon')} AS x, {r('lat')} AS y FROM g_points", ("g_points",))
def wkb_round_trip(spark, d):
    p = readers.wkb_points(fx.points(spark, d).select("id", F.col("lon").alias("x"), F.col("lat").alias("y")))
    return readers.wkb_boxes(p.select("id", "wkb")).select("id", rounded(F.col("x")).alias("x"), rounded(F.col("y")).alias("y"))


@query("property_filter", "SELECT id FROM g_points WHERE cls = 'forest'", ("g_points",))
def property_filter(spark, d):
    p = fx.points(spark, d).select("id", F.create_map(F.lit("class"), F.col("cls")).alias("properties"))
    return readers.property_filter(p, "class", "forest").select("id")


@query("box_query", "SELECT id, lon, lat FROM g_points WHERE lon BETWEEN 0 AND 60 AND lat BETWEEN -30 AND 30", ("g_points",))
def box_query(spark, d):
    return readers.box_query(fx.points(spark, d), 0.0, -30.0, 60.0, 30.0).select("id", "lon", "lat")


@query("feature_page", "SELECT id, w FROM g_points WHERE lon BETWEEN -90 AND 90 AND lat BETWEEN -45 AND 45 ORDER BY w DESC, id LIMIT 20 OFFSET 10", ("g_points",))
def feature_page(spark, d):
    return readers.page(fx.points(spark, d), ["-w", "+id"], 20, 10, (-90.0, -45.0, 90.0, 45.0), ["id", "w"])


@query("guarded_sql", "SELECT cls, COUNT(*) AS n FROM g_points GROUP BY cls", ("g_points",))
def guarded_sql(spark, d):
    fx.points(spark, d).createOrReplaceTempView("g_points")
    return spark.sql(readers.check_select("SELECT cls, COUNT(*) AS n FROM g_points GROUP BY cls"))


@query("reproject_rings", f"SELECT poly_id, {r(f'MIN(RADIANS(x) * {R})', 3)} AS x0, {r(f'MAX(LN(TAN(PI() / 4 + RADIANS(y) / 2)) * {R})', 3)} AS y1 FROM g_poly_vertices GROUP BY poly_id", ("g_poly_vertices",))
def reproject_rings(spark, d):
    moved = F.transform("ring", lambda p: F.struct(*[v.alias(n) for v, n in zip(crs.transform(p["x"], p["y"], 4326, 3857), ("x", "y"))]))
    b = geometry.box(moved)
    return fx.polygons(spark, d).select("poly_id", rounded(b["x0"], 3).alias("x0"), rounded(b["y1"], 3).alias("y1"))


