"""Raster, statistics and series operators as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.base import rounded
from ..operators import flow, raster, series, stats
from . import fixtures as fx
from .catalog import query, r

AROUND = "around AS (SELECT a.r, a.c, a.z, " + ", ".join(f"{n}.z AS {n}" for n in raster.AROUND) + ", " + " + ".join(f"CASE WHEN {n}.r IS NULL THEN 0 ELSE 1 END" for n in raster.AROUND) + " AS present FROM g_raster a " + " ".join(f"LEFT JOIN g_raster {n} ON {n}.r = a.r + ({dr}) AND {n}.c = a.c + ({dc})" for n, (dr, dc) in raster.AROUND.items()) + ")"
GRAD = f"{AROUND}, grad AS (SELECT *, ((se + 2 * e + ne) - (nw + 2 * w + sw)) / 240.0 AS dx, ((sw + 2 * s + se) - (nw + 2 * n + ne)) / 240.0 AS dy FROM around)"


def _terrain(spark, d):
    return raster.terrain(fx.raster(spark, d))


@query("slope_horn", f"SELECT r, c, {r('DEGREES(ATAN(SQRT(dx * dx + dy * dy)))')} AS deg, {r('SQRT(dx * dx + dy * dy) * 100')} AS pct FROM grad WHERE dx IS NOT NULL AND dy IS NOT NULL", ("g_raster",), GRAD)
def slope_horn(spark, d):
    return _terrain(spark, d).where("slope_deg is not null").select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), rounded(F.col("slope_deg")).alias("deg"), rounded(F.col("slope_pct")).alias("pct"))


@query("aspect", f"SELECT r, c, {r('CASE WHEN ABS(dx) < 1e-10 AND ABS(dy) < 1e-10 THEN -1 WHEN a < 0 THEN a + 360 WHEN a >= 360 THEN a - 360 ELSE a END')} AS deg FROM (SELECT *, 90 - DEGREES(ATAN2(-dy, dx)) AS a FROM grad) WHERE dx IS NOT NULL AND dy IS NOT NULL", ("g_raster",), GRAD)
def aspect(spark, d):
    return _terrain(spark, d).where("aspect_deg is not null").select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), rounded(F.col("aspect_deg")).alias("deg"))


@query("hillshade", f"SELECT r, c, {r('GREATEST(0, 255 * (COS(RADIANS(45)) * COS(st) + SIN(RADIANS(45)) * SIN(st) * COS(RADIANS(315) - (PI() / 2 - ATAN2(-dy, dx)))))', 5)} AS shade FROM (SELECT *, ATAN(SQRT(dx * dx + dy * dy)) AS st FROM grad) WHERE dx IS NOT NULL AND dy IS NOT NULL", ("g_raster",), GRAD)
def hillshade(spark, d):
    return _terrain(spark, d).where("hillshade is not null").select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), rounded(F.col("hillshade"), 5).alias("shade"))


SQ = " + ".join(f"COALESCE(POW(z - {n}, 2), 0)" for n in raster.AROUND)


@query("tri", f"SELECT r, c, {r(f'SQRT({SQ})')} AS tri FROM around WHERE present = 8", ("g_raster",), AROUND)
def tri(spark, d):
    return _terrain(spark, d).where("tri is not null").select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), rounded(F.col("tri")).alias("tri"))


@query("tpi", f"SELECT r, c, {r('z - (' + ' + '.join(raster.AROUND) + ') / 8')} AS tpi FROM around WHERE present = 8", ("g_raster",), AROUND)
def tpi(spark, d):
    return _terrain(spark, d).where("tpi is not null").select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), rounded(F.col("tpi")).alias("tpi"))


CURV = f"{AROUND}, curv AS (SELECT r, c, ((ne - nw) + 2 * (e - w) + (se - sw)) / 240.0 AS p, ((nw - sw) + 2 * (n - s) + (ne - se)) / 240.0 AS q, (e - 2 * z + w) / 900.0 AS xx, (n - 2 * z + s) / 900.0 AS yy, (se - sw - ne + nw) / 3600.0 AS xy FROM around WHERE present = 8)"


@query("curvature", f"SELECT r, c, {r('CASE WHEN g < 1e-12 THEN 0 ELSE -(p * p * xx + 2 * p * q * xy + q * q * yy) / (SQRT(g) * POW(1 + g, 1.5)) END')} AS profile, {r('CASE WHEN g < 1e-12 THEN 0 ELSE -(q * q * xx - 2 * p * q * xy + p * p * yy) / POW(g, 1.5) END')} AS plan FROM (SELECT *, p * p + q * q AS g FROM curv)", ("g_raster",), CURV)
def curvature(spark, d):
    return _terrain(spark, d).where("curvature is not null").select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), rounded(F.col("profile")).alias("profile"), rounded(F.col("plan")).alias("plan"))


@query("ndvi_summary", f"SELECT COUNT(v) AS n, {r('AVG(v)')} AS mean, {r('AVG(CASE WHEN v >= 0.5 THEN 1.0 ELSE 0.0 END)')} AS healthy, {r('AVG(CASE WHEN v <= 0.2 THEN 1.0 ELSE 0.0 END)')} AS degraded FROM (SELECT (nir - red) / (nir + red) AS v FROM g_raster WHERE ABS(nir + red) > 1e-10)", ("g_raster",))
def ndvi_summary(spark, d):
    v = fx.raster(spark, d).select(raster.normalized_difference(F.col("nir"), F.col("red")).alias("v")).where("v is not null")
    share = lambda t: rounded(F.avg(F.when(t, 1.0).otherwise(0.0)))
    return v.agg(F.count("v").alias("n"), rounded(F.avg("v")).alias("mean"), share(F.col("v") >= 0.5).alias("healthy"), share(F.col("v") <= 0.2).alias("degraded"))


@query("band_algebra", f"SELECT r, c, {r('red + nir')} AS added, {r('red - nir')} AS less, {r('red * nir')} AS product, {r('CASE WHEN ABS(nir) > 1e-10 THEN red / nir END')} AS quotient FROM g_raster", ("g_raster",))
def band_algebra(spark, d):
    g = fx.raster(spark, d)
    out = raster.band_algebra(g.select("r", "c", F.col("red").alias("z")), g.select("r", "c", F.col("nir").alias("z")))
    return out.select("r", "c", *[rounded(F.col(k)).alias(k) for k in ("added", "less", "product", "quotient")])


@query("ndwi", f"SELECT r, c, {r('CASE WHEN ABS(red + nir) > 1e-10 THEN (red - nir) / (red + nir) END')} AS v FROM g_raster", ("g_raster",))
def ndwi(spark, d):
    return fx.raster(spark, d).select("r", "c", rounded(raster.normalized_difference(F.col("red"), F.col("nir"))).alias("v"))


@query("band_threshold", "SELECT r, c, CASE WHEN red IS NULL THEN NULL WHEN red BETWEEN 0.3 AND 0.6 THEN 1 ELSE 0 END AS z FROM g_raster", ("g_raster",))
def band_threshold(spark, d):
    return raster.threshold(fx.raster(spark, d).select("r", "c", F.col("red").alias("z")), 0.3, 0.6)


@query("raster_chunks", "SELECT CAST(FLOOR(r / 16) AS BIGINT) AS block_r, CAST(FLOOR(c / 16) AS BIGINT) AS block_c, COUNT(*) AS cells, COUNT(red) AS valid FROM g_raster GROUP BY 1, 2", ("g_raster",))
def raster_chunks(spark, d):
    return raster.chunks(fx.raster(spark, d).select("r", "c", F.col("red").alias("z")), 16)


@query("zonal_mask", f"SELECT z.zone, COALESCE(n, 0) AS n, {r('low')} AS low, {r('high')} AS high, {r('mean')} AS mean, {r('std')} AS std, {r('total', 4)} AS total FROM (VALUES (1), (2), (3), (4), (5), (6)) AS z(zone) LEFT JOIN (SELECT zone, COUNT(*) AS n, MIN(red) AS low, MAX(red) AS high, AVG(red) AS mean, STDDEV_POP(red) AS std, SUM(red) AS total FROM g_raster WHERE zone > 0 AND red IS NOT NULL GROUP BY zone) s ON s.zone = z.zone", ("g_raster",))
def zonal_mask(spark, d):
    out = raster.zonal_mask(fx.raster(spark, d).select("r", "c", "zone", F.col("red").alias("z")), 6)
    return out.select("zone", "n", *[rounded(F.col(k)).alias(k) for k in ("low", "high", "mean", "std")], rounded(F.col("total"), 4).alias("total"))


@query("zonal_box", f"SELECT b.box_id, COUNT(red) AS n, {r('COALESCE(AVG(red), 0)')} AS mean, {r('COALESCE(MIN(red), 0)')} AS low, {r('COALESCE(MAX(red), 0)')} AS high, {r('COALESCE(AVG(CASE WHEN red >= 0.5 THEN 1.0 WHEN red IS NOT NULL THEN 0.0 END), 0)')} AS healthy FROM (VALUES (1, 0, 0, 10, 10), (2, 5, 5, 25, 12), (3, 500, 500, 600, 600)) AS b(box_id, x0, y0, x1, y1) LEFT JOIN g_raster ON c + 0.5 BETWEEN x0 AND x1 AND r + 0.5 BETWEEN y0 AND y1 AND red IS NOT NULL GROUP BY b.box_id", ("g_raster",))
def zonal_box(spark, d):
    cells = fx.raster(spark, d).select((F.col("c") + 0.5).alias("x"), (F.col("r") + 0.5).alias("y"), F.col("red").alias("z"))
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 10.0), (2, 5.0, 5.0, 25.0, 12.0), (3, 500.0, 500.0, 600.0, 600.0)], "box_id int, x0 double, y0 double, x1 double, y1 double")
    return raster.zonal_box(cells, boxes).select("box_id", "n", *[rounded(F.col(k)).alias(k) for k in ("mean", "low", "high", "healthy")])


@query("band_stats", f"SELECT {r('MIN(red)')} AS low, {r('MAX(red)')} AS high, {r('AVG(red)')} AS mean, {r('COALESCE(STDDEV_SAMP(red), 0)')} AS std FROM g_raster", ("g_raster",))
def band_stats(spark, d):
    return fx.raster(spark, d).agg(rounded(F.min("red")).alias("low"), rounded(F.max("red")).alias("high"), rounded(F.avg("red")).alias("mean"), rounded(F.coalesce(F.stddev_samp("red"), F.lit(0.0))).alias("std"))


@query("mosaic_first", "SELECT r, c, COALESCE(red, nir) AS z FROM g_raster", ("g_raster",))
def mosaic_first(spark, d):
    g = fx.raster(spark, d)
    return raster.mosaic_first(g.select("r", "c", F.col("red").alias("z")), g.select("r", "c", F.col("nir").alias("z")))


@query("mosaic_feather", f"SELECT r, c, {r('COALESCE(red * (1 - w) + nir * w, red, nir)')} AS z FROM (SELECT *, GREATEST(0.0, LEAST(1.0, (c - 10) / 20.0)) AS w FROM g_raster)", ("g_raster",))
def mosaic_feather(spark, d):
    g = fx.raster(spark, d)
    out = raster.mosaic_feather(g.select("r", "c", F.col("red").alias("z")), g.select("r", "c", F.col("nir").alias("z")), 10, 20)
    return out.select("r", "c", rounded(F.col("z")).alias("z"))


def _resampled(spark, d, method, shift=0.0):
    """The raster on cells half as high and twice as wide."""
    cells = fx.raster(spark, d).select("r", "c", "z")
    rows = (cells.agg(F.max("r")).first()[0] or 0) + 1
    out = raster.resample(cells, rows, 40, 2 * rows, 20, method)
    return out.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), rounded(F.col("z") + shift).alias("z"))


NR = "h AS (SELECT MAX(r) AS top FROM g_raster), g10 AS (SELECT y.v AS r, x.v AS c FROM (SELECT UNNEST(GENERATE_SERIES(0, (SELECT 2 * top + 1 FROM h))) AS v) y, (SELECT UNNEST(GENERATE_SERIES(0, 19)) AS v) x)"


@query("resample_nearest", f"SELECT CAST(t.r AS BIGINT) AS r, CAST(t.c AS BIGINT) AS c, {r('s.z')} AS z FROM g10 t JOIN g_raster s ON s.r = FLOOR((t.r + 0.5) * 0.5) AND s.c = FLOOR((t.c + 0.5) * 2.0)", ("g_raster",), NR)
def resample_nearest(spark, d):
    return _resampled(spark, d, "nearest")


BI = f"{NR}, spot AS (SELECT r, c, GREATEST(0.0, LEAST((SELECT top FROM h)::DOUBLE, (r + 0.5) * 0.5 - 0.5)) AS y, GREATEST(0.0, LEAST(39.0, (c + 0.5) * 2.0 - 0.5)) AS x FROM g10)"


@query("resample_bilinear", f"SELECT CAST(t.r AS BIGINT) AS r, CAST(t.c AS BIGINT) AS c, {r('(a.z * (1 - (x - FLOOR(x))) + b.z * (x - FLOOR(x))) * (1 - (y - FLOOR(y))) + (e.z * (1 - (x - FLOOR(x))) + f.z * (x - FLOOR(x))) * (y - FLOOR(y))')} AS z FROM spot t, h JOIN g_raster a ON a.r = FLOOR(y) AND a.c = FLOOR(x) JOIN g_raster b ON b.r = FLOOR(y) AND b.c = LEAST(39, FLOOR(x) + 1) JOIN g_raster e ON e.r = LEAST(top, FLOOR(y) + 1) AND e.c = FLOOR(x) JOIN g_raster f ON f.r = LEAST(top, FLOOR(y) + 1) AND f.c = LEAST(39, FLOOR(x) + 1)", ("g_raster",), BI)
def resample_bilinear(spark, d):
    return _resampled(spark, d, "bilinear")


CUBIC = "CASE WHEN ABS({0}) <= 1 THEN 1.5 * POW(ABS({0}), 3) - 2.5 * POW(ABS({0}), 2) + 1 WHEN ABS({0}) < 2 THEN -0.5 * POW(ABS({0}), 3) + 2.5 * POW(ABS({0}), 2) - 4 * ABS({0}) + 2 ELSE 0 END".format


@query(
    "resample_cubic",
    f"""SELECT CAST(t.r AS BIGINT) AS r, CAST(t.c AS BIGINT) AS c, {r(f"SUM(s.z * ({CUBIC('(y - FLOOR(y) - i.v)')}) * ({CUBIC('(x - FLOOR(x) - j.v)')})) + 1e-9")} AS z FROM spot t, h, (SELECT UNNEST(GENERATE_SERIES(-1, 2)) AS v) i, (SELECT UNNEST(GENERATE_SERIES(-1, 2)) AS v) j, g_raster s
 WHERE s.r = GREATEST(0, LEAST(top, FLOOR(y) + i.v)) AND s.c = GREATEST(0, LEAST(39, FLOOR(x) + j.v)) GROUP BY t.r, t.c""",
    ("g_raster",),
    BI,
)
def resample_cubic(spark, d):
    return _resampled(spark, d, "cubic", 1e-9)  # sums that end in a 5 are rounded up, whatever the order of summing


@query("null_sentinels", "SELECT COUNT(*) AS cells, COUNT(red) AS valid FROM g_raster", ("g_raster",))
def null_sentinels(spark, d):
    raw = fx.raster(spark, d).select("r", "c", F.when(F.col("red").isNull() & (F.col("c") % 2 == 0), F.lit(float("nan"))).otherwise(F.coalesce("red", F.lit(-9999.0))).alias("z"))
    return raster.normalize(raw, -9999.0).agg(F.count("*").alias("cells"), F.count("z").alias("valid"))


# --- statistics

EDGE = "edge AS (SELECT a.r * 40 + a.c AS i, b.r * 40 + b.c AS j FROM g_raster a JOIN g_raster b ON ABS(a.r - b.r) <= 1 AND ABS(a.c - b.c) <= 1 AND NOT (a.r = b.r AND a.c = b.c))"


def _values(spark, d):
    return fx.raster(spark, d).select((F.col("r") * 40 + F.col("c")).alias("i"), F.col("z").alias("v"))


def _edges(spark, d, with_self=False):
    e = stats.grid_weights(fx.raster(spark, d), stats.QUEEN, with_self)
    return e.select((F.col("r") * 40 + F.col("c")).alias("i"), (F.col("nr") * 40 + F.col("nc")).alias("j"), "w")


@query("morans_i", f"SELECT n, {r('n / s0 * num / sse')} AS i, {r('-1.0 / (n - 1)')} AS expected, {r('(n * n * 2 * s0 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - 1.0 / ((n - 1) * (n - 1))', 9)} AS variance FROM (SELECT COUNT(*) AS n, SUM((z - m) * (z - m)) AS sse FROM g_raster, (SELECT AVG(z) AS m FROM g_raster)), (SELECT CAST(COUNT(*) AS DOUBLE) AS s0, SUM((x.z - m) * (y.z - m)) AS num FROM edge, g_raster x, g_raster y, (SELECT AVG(z) AS m FROM g_raster) WHERE x.r * 40 + x.c = i AND y.r * 40 + y.c = j), (SELECT SUM(4.0 * k * k) AS s2 FROM (SELECT COUNT(*) AS k FROM edge GROUP BY i))", ("g_raster",), EDGE)
def morans_i(spark, d):
    return stats.morans_i(_values(spark, d), _edges(spark, d)).select("n", rounded(F.col("i")).alias("i"), rounded(F.col("expected")).alias("expected"), rounded(F.col("variance"), 9).alias("variance"))


@query("getis_ord", f"SELECT CAST(i AS INTEGER) AS i, {r('(SUM(y.z) - m * COUNT(*)) / (sd * SQRT((n * COUNT(*) - COUNT(*) * COUNT(*)) / (n - 1.0)))', 5)} AS z FROM (SELECT * FROM edge UNION ALL SELECT r * 40 + c, r * 40 + c FROM g_raster) e, g_raster y, (SELECT AVG(z) AS m, STDDEV_POP(z) AS sd, COUNT(*) AS n FROM g_raster) WHERE y.r * 40 + y.c = j GROUP BY i, m, sd, n", ("g_raster",), EDGE)
def getis_ord(spark, d):
    return stats.getis_ord(_values(spark, d), _edges(spark, d, True)).select("i", rounded(F.col("z"), 5).alias("z"))


@query("ols", f"SELECT COUNT(*)::DOUBLE AS n, {r('REGR_SLOPE(w, lat)')} AS slope, {r('REGR_INTERCEPT(w, lat)', 4)} AS intercept, {r('REGR_R2(w, lat)')} AS r2 FROM g_points", ("g_points",))
def ols(spark, d):
    out = stats.ols(fx.points(spark, d).select(F.col("lat").alias("x"), F.col("w").alias("y")))
    return out.select("n", rounded(F.col("slope")).alias("slope"), rounded(F.col("intercept"), 4).alias("intercept"), rounded(F.col("r2")).alias("r2"))


@query("quantile_breaks", "SELECT i, w AS value FROM (SELECT w, ROW_NUMBER() OVER (ORDER BY w) - 1 AS k, COUNT(*) OVER () AS n FROM g_points), (VALUES (1), (2), (3), (4)) AS q(i) WHERE k = LEAST(n - 1, FLOOR(i * n / 5.0 + 0.5))", ("g_points",))
def quantile_breaks(spark, d):
    return stats.quantile_breaks(fx.points(spark, d).select(F.col("w").alias("v")), 5)


@query("equal_interval", f"SELECT i, {r('a + i * (b - a) / 5')} AS value FROM (SELECT MIN(w) AS a, MAX(w) AS b FROM g_points), (VALUES (1), (2), (3), (4)) AS q(i)", ("g_points",))
def equal_interval(spark, d):
    return stats.equal_interval_breaks(fx.points(spark, d).select(F.col("w").alias("v")), 5).select("i", rounded(F.col("value")).alias("value"))


SSE = "({b}.q - {a}.q - POW({b}.s - {a}.s, 2) / ({b}.n - {a}.n))"
# the least deviations of 1 to 4 classes up to each value, one layer after the other
JENKS = f"""pre AS (SELECT z, ROW_NUMBER() OVER (ORDER BY z) AS j, SUM(n) OVER w AS n, SUM(n * z) OVER w AS s, SUM(n * z * z) OVER w AS q FROM (SELECT z, COUNT(*)::DOUBLE AS n FROM g_raster GROUP BY z) WINDOW w AS (ORDER BY z)),
b1 AS (SELECT *, q - s * s / n AS b FROM pre),
b2 AS (SELECT p.z, p.j, p.n, p.s, p.q, MIN(a.b + {SSE.format(a='a', b='p')}) AS b, ARG_MIN(a.j, a.b + {SSE.format(a='a', b='p')}) AS i FROM b1 a JOIN pre p ON a.j < p.j GROUP BY ALL),
b3 AS (SELECT p.z, p.j, p.n, p.s, p.q, MIN(a.b + {SSE.format(a='a', b='p')}) AS b, ARG_MIN(a.j, a.b + {SSE.format(a='a', b='p')}) AS i FROM b2 a JOIN pre p ON a.j < p.j GROUP BY ALL),
b4 AS (SELECT p.j, MIN(a.b + {SSE.format(a='a', b='p')}) AS b, ARG_MIN(a.j, a.b + {SSE.format(a='a', b='p')}) AS i FROM b3 a JOIN (SELECT * FROM pre ORDER BY j DESC LIMIT 1) p ON a.j < p.j GROUP BY ALL),
spot AS (SELECT b2.i AS e1, b3.i AS e2, b4.i AS e3, b4.b / (SELECT q - s * s / n FROM pre ORDER BY j DESC LIMIT 1) AS rest FROM b4 JOIN b3 ON b3.j = b4.i JOIN b2 ON b2.j = b3.i)"""


@query("jenks", f"SELECT k.i::INTEGER AS i, {r('z')} AS value, {r('1 - rest')} AS gvf FROM spot, (VALUES (1), (2), (3)) AS k(i) JOIN pre ON pre.j = CASE k.i WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END", ("g_raster",), JENKS)
def jenks(spark, d):
    return stats.jenks_breaks(fx.raster(spark, d).select(F.col("z").alias("v")), 4).select("i", rounded(F.col("value")).alias("value"), rounded(F.col("gvf")).alias("gvf"))


@query("kmeans")
def kmeans(spark, d):
    rows = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("features"))
    return stats.kmeans(rows, 5, 20).groupBy("cluster").agg(F.count("*").alias("n"))


GRID = "grid AS (SELECT y.v AS r, x.v AS c FROM (SELECT UNNEST(GENERATE_SERIES(0, 17)) AS v) y, (SELECT UNNEST(GENERATE_SERIES(0, 35)) AS v) x)"


@query("kernel_density", f"SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, {r('SUM(EXP(-0.5 * d2 / 64) / (2 * PI() * 64))', 8)} AS density FROM (SELECT r, c, POW(-180 + (c + 0.5) * 10 - lon, 2) + POW(-90 + (r + 0.5) * 10 - lat, 2) AS d2 FROM grid, g_points) WHERE d2 <= 576 GROUP BY r, c", ("g_points",), GRID)
def kernel_density(spark, d):
    p = fx.points(spark, d).select(F.col("lon").alias("x"), F.col("lat").alias("y"))
    return stats.kernel_density(p, 36, 18, [-180.0, -90.0, 180.0, 90.0], 8.0).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), rounded(F.col("density"), 8).alias("density"))


@query("line_density", f"SELECT {r('SUM(len)', 4)} AS total FROM (SELECT SQRT(POW(ax - qx, 2) + POW(ay - qy, 2)) AS len FROM (SELECT a.x AS ax, a.y AS ay, b.x AS qx, b.y AS qy FROM g_poly_vertices a JOIN g_poly_vertices b ON a.poly_id = b.poly_id AND b.k = a.k + 1))", ("g_poly_vertices",))
def line_density(spark, d):
    """All cells together hold the whole length of the lines."""
    e = fx.polygons(spark, d).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.struct(F.element_at("ring", k).alias("a"), F.element_at("ring", k + 1).alias("b")))).alias("e"))
    lines = e.select(F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"), F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2"))
    return stats.line_density(lines, 37, 19, [-185.0, -95.0, 185.0, 95.0]).agg(rounded(F.sum(F.col("density") * 100.0), 4).alias("total"))


@query("idw_grid", f"SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, {r('SUM(w / d2) / SUM(1 / d2)', 4)} AS z, COUNT(*) AS n FROM (SELECT r, c, w, POW(-180 + (c + 0.5) * 10 - lon, 2) + POW(90 - (r + 0.5) * 10 - lat, 2) AS d2 FROM grid, g_points) WHERE d2 <= 144 AND d2 >= 1e-24 GROUP BY r, c", ("g_points",), GRID)
def idw_grid(spark, d):
    p = fx.points(spark, d).select(F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("w").alias("z"))
    return stats.idw_grid(p, 36, 18, [-180.0, -90.0, 180.0, 90.0], 2.0, 12.0).select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), rounded(F.col("z"), 4).alias("z"), "n")


@query("semivariogram", f"SELECT CAST(FLOOR(d / 3) AS INTEGER) AS bin, COUNT(*) AS pairs, {r('AVG(d)')} AS distance, {r('AVG(g) / 2', 1)} AS gamma FROM (SELECT SQRT((a.lon - b.lon) * (a.lon - b.lon) + (a.lat - b.lat) * (a.lat - b.lat)) AS d, POW(a.w - b.w, 2) AS g FROM g_points a JOIN g_points b ON a.id < b.id) WHERE d < 15 GROUP BY 1", ("g_points",))
def semivariogram(spark, d):
    p = fx.points(spark, d).select("id", F.col("lon").alias("x"), F.col("lat").alias("y"), F.col("w").alias("z"))
    return stats.semivariogram(p, 3.0, 5).select("bin", "pairs", rounded(F.col("distance")).alias("distance"), rounded(F.col("gamma"), 1).alias("gamma"))


@query("kriging")
def kriging(spark, d):
    q = fx.polygons(spark, d).select(F.col("poly_id").alias("q_id"), F.element_at("ring", 1).alias("p")).select("q_id", F.col("p.x").alias("q_x"), F.col("p.y").alias("q_y"))
    p = fx.points(spark, d).select(F.col("id").alias("p_id"), F.col("lon").alias("p_x"), F.col("lat").alias("p_y"), F.col("w").alias("z"))
    return stats.kriging(q, p, "spherical", 0.1, 1.0, 20.0, 8).select("q_id", rounded(F.col("z"), 3).alias("z"), rounded(F.col("variance"), 5).alias("variance"))


@query("transition_matrix", f"SELECT f.v AS from_class, t.v AS to_class, {r('CASE WHEN k IS NULL THEN CASE WHEN f.v = t.v THEN 1.0 ELSE 0.0 END ELSE COALESCE(n, 0) / k END')} AS p FROM (SELECT UNNEST(GENERATE_SERIES(0, 6))::INTEGER AS v) f CROSS JOIN (SELECT UNNEST(GENERATE_SERIES(0, 6))::INTEGER AS v) t LEFT JOIN (SELECT lc0, lc1, COUNT(*)::DOUBLE AS n FROM g_raster GROUP BY 1, 2) x ON x.lc0 = f.v AND x.lc1 = t.v LEFT JOIN (SELECT lc0, COUNT(*)::DOUBLE AS k FROM g_raster GROUP BY 1) y ON y.lc0 = f.v", ("g_raster",))
def transition_matrix(spark, d):
    out = stats.transition_matrix(fx.raster(spark, d).select(F.col("lc0").alias("a"), F.col("lc1").alias("b")), 7)
    return out.select("from_class", "to_class", rounded(F.col("p")).alias("p"))


@query("information_value", f"SELECT lc0 AS class, COUNT(*)::DOUBLE AS cells, {r('CASE WHEN SUM(ev) > 0 THEN GREATEST(-5.0, LN((SUM(ev) / COUNT(*)) / (MAX(te) / MAX(tc)))) ELSE -5 END')} AS value FROM (SELECT lc0, CASE WHEN z > 40 THEN 1.0 ELSE 0.0 END AS ev FROM g_raster), (SELECT SUM(CASE WHEN z > 40 THEN 1.0 ELSE 0.0 END) AS te, COUNT(*)::DOUBLE AS tc FROM g_raster) GROUP BY lc0", ("g_raster",))
def information_value(spark, d):
    cells = fx.raster(spark, d).select(F.lit("lc").alias("factor"), F.col("lc0").alias("class"), F.when(F.col("z") > 40, 1).otherwise(0).alias("event"))
    return stats.information_value(cells).select("class", "cells", rounded(F.col("value")).alias("value"))


@query("monte_carlo")
def monte_carlo(spark, d):
    items = fx.points(spark, d).groupBy(F.col("cls").alias("item")).agg(F.sum(F.abs("w")).alias("activity")).withColumn("factor", F.lit(1.5))
    return stats.monte_carlo(items, 500)


# --- series

PAIRS = "pairs AS (SELECT a.sid, a.t AS ta, b.t AS tb, a.v AS va, b.v AS vb, a.k AS ka, b.k AS kb FROM numbered a JOIN numbered b ON a.sid = b.sid AND a.k < b.k)"
NUM = "numbered AS (SELECT sid, t, v, ROW_NUMBER() OVER (PARTITION BY sid ORDER BY t) - 1 AS k, COUNT(*) OVER (PARTITION BY sid) AS n FROM g_series)"


@query("mann_kendall", f"SELECT sid, CAST(MAX(n) AS BIGINT) AS n, CAST(SUM(SIGN(vb - va)) AS BIGINT) AS s, {r('SUM(SIGN(vb - va)) / (MAX(n) * (MAX(n) - 1) / 2.0)')} AS tau FROM (SELECT p.*, m.n FROM pairs p JOIN (SELECT DISTINCT sid, n FROM numbered) m ON p.sid = m.sid) GROUP BY sid", ("g_series",), f"{NUM}, {PAIRS}")
def mann_kendall(spark, d):
    return series.trend(fx.series(spark, d)).select("sid", "n", "s", rounded(F.col("tau")).alias("tau"))


@query("sen_slope", f"SELECT sid, {r('s', 4)} AS sen_slope FROM (SELECT sid, (vb - va) / (kb - ka) AS s, ROW_NUMBER() OVER (PARTITION BY sid ORDER BY (vb - va) / (kb - ka)) - 1 AS i, COUNT(*) OVER (PARTITION BY sid) AS m FROM pairs) WHERE i = FLOOR(m / 2)", ("g_series",), f"{NUM}, {PAIRS}")
def sen_slope(spark, d):
    return series.trend(fx.series(spark, d)).select("sid", rounded(F.col("sen_slope"), 4).alias("sen_slope"))


@query("linear_trend", f"SELECT sid, {r('REGR_SLOPE(v, k)', 3)} AS slope, {r('REGR_INTERCEPT(v, k)', 2)} AS intercept, {r('REGR_R2(v, k)')} AS r2 FROM numbered GROUP BY sid", ("g_series",), NUM)
def linear_trend(spark, d):
    return series.trend(fx.series(spark, d)).select("sid", rounded(F.col("slope"), 3).alias("slope"), rounded(F.col("intercept"), 2).alias("intercept"), rounded(F.col("r2")).alias("r2"))


@query("pettitt", f"SELECT sid, spot AS break_at, u, {r('LEAST(1.0, 2 * EXP(-6 * u * u / (POW(n, 3) + POW(n, 2))))')} AS p FROM (SELECT sid, spot, u, n, ROW_NUMBER() OVER (PARTITION BY sid ORDER BY u DESC, spot) AS place FROM (SELECT x.sid, x.k AS spot, MAX(x.n) AS n, ABS(SUM(SIGN(p.vb - p.va))) AS u FROM numbered x JOIN pairs p ON p.sid = x.sid AND p.ka < x.k AND p.kb >= x.k WHERE x.k > 0 GROUP BY x.sid, x.k)) WHERE place = 1", ("g_series",), f"{NUM}, {PAIRS}")
def pettitt(spark, d):
    return series.change_point(fx.series(spark, d)).select("sid", "break_at", "u", rounded(F.col("p")).alias("p"))


@query("seasonal_mann_kendall", "SELECT sid, CAST(SUM(SIGN(vb - va)) AS BIGINT) AS s FROM pairs WHERE ka % 12 = kb % 12 GROUP BY sid", ("g_series",), f"{NUM}, {PAIRS}")
def seasonal_mann_kendall(spark, d):
    return series.seasonal_trend(fx.series(spark, d), 12).select("sid", "s")


@query("series_breaks")
def series_breaks(spark, d):
    return series.breaks(fx.series(spark, d), 12, 3)


DEC = f"{NUM}, tr AS (SELECT *, AVG(v) OVER (PARTITION BY sid ORDER BY t ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS trend FROM numbered), se AS (SELECT *, AVG(v - trend) OVER (PARTITION BY sid, k % 12) AS raw FROM tr), ce AS (SELECT *, raw - AVG(raw) OVER (PARTITION BY sid) AS seasonal FROM se)"


@query("decompose", f"SELECT sid, t, {r('trend', 2)} AS trend, {r('seasonal', 2)} AS seasonal, {r('v - trend - seasonal', 2)} AS rest FROM ce", ("g_series",), DEC)
def decompose(spark, d):
    out = series.decompose(fx.series(spark, d), 12)
    return out.select("sid", "t", *[rounded(F.col(k), 2).alias(k) for k in ("trend", "seasonal", "rest")])


@query("rolling_sum", "SELECT sid, t, CASE WHEN k >= 2 THEN SUM(v) OVER (PARTITION BY sid ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS rolled FROM numbered", ("g_series",), NUM)
def rolling_sum(spark, d):
    return series.rolling(fx.series(spark, d), 3).select("sid", "t", "rolled")


ANOM = f"{NUM}, an AS (SELECT sid, t, k, (v - AVG(v) OVER (PARTITION BY sid)) / STDDEV_POP(v) OVER (PARTITION BY sid) AS a FROM numbered), ro AS (SELECT sid, t, AVG(a) OVER (PARTITION BY sid ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m FROM an), kd AS (SELECT *, CASE WHEN m >= 0.2 THEN 1 WHEN m <= -0.2 THEN -1 ELSE 0 END AS kind FROM ro), isl AS (SELECT *, SUM(CASE WHEN kind = prev THEN 0 ELSE 1 END) OVER (PARTITION BY sid ORDER BY t) AS g FROM (SELECT *, LAG(kind) OVER (PARTITION BY sid ORDER BY t) AS prev FROM kd))"


def _anomalies(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("sid")
    return fx.series(spark, d).select("sid", "t", ((F.col("v") - F.avg("v").over(w)) / F.stddev_pop("v").over(w)).alias("v"))


@query("oscillation_phases", f"SELECT sid, t, {r('m')} AS rolled, CASE WHEN kind <> 0 AND ROW_NUMBER() OVER (PARTITION BY sid, g ORDER BY t) >= 3 THEN CASE kind WHEN 1 THEN 'warm' ELSE 'cold' END ELSE 'neutral' END AS phase FROM isl", ("g_series",), ANOM)
def oscillation_phases(spark, d):
    return series.phases(_anomalies(spark, d), 0.2, -0.2, 3).select("sid", "t", rounded(F.col("rolled")).alias("rolled"), "phase")


@query("spi")
def spi(spark, d):
    return series.spi(fx.series(spark, d), 3).select("sid", "t", rounded(F.col("spi")).alias("spi"))


@query("spei")
def spei(spark, d):
    return series.spei(_anomalies(spark, d), 3).select("sid", "t", rounded(F.col("spei")).alias("spei"))


@query("drought_recursion", f"SELECT sid, t, {r('x', 5)} AS x FROM rec", ("g_series",), ANOM + ", rec AS (SELECT sid, t, k, a AS x FROM an WHERE k = 0 UNION ALL SELECT an.sid, an.t, an.k, an.a + 0.8 * rec.x FROM rec JOIN an ON an.sid = rec.sid AND an.k = rec.k + 1)")
def drought_recursion(spark, d):
    return series.autoregression(_anomalies(spark, d), 0.8).select("sid", "t", rounded(F.col("x"), 5).alias("x"))


C0, C1, C2 = series.muskingum_weights(12.0, 0.2, 6.0)


@query("muskingum", f"SELECT sid, t, {r('o', 2)} AS outflow FROM rec", ("g_series",), f"{NUM}, rec AS (SELECT sid, t, k, v, v AS o FROM numbered WHERE k = 0 UNION ALL SELECT n.sid, n.t, n.k, n.v, GREATEST(0.0, {C0!r}::DOUBLE * n.v + {C1!r}::DOUBLE * rec.v + {C2!r}::DOUBLE * rec.o) FROM rec JOIN numbered n ON n.sid = rec.sid AND n.k = rec.k + 1)")
def muskingum(spark, d):
    return series.muskingum(fx.series(spark, d)).select("sid", "t", rounded(F.col("outflow"), 2).alias("outflow"))


@query("linear_reservoir", f"SELECT sid, t, {r('o', 2)} AS outflow FROM rec", ("g_series",), f"{NUM}, rec AS (SELECT sid, t, k, 0.2::DOUBLE * v AS o FROM numbered WHERE k = 0 UNION ALL SELECT n.sid, n.t, n.k, 0.2::DOUBLE * n.v + 0.8::DOUBLE * rec.o FROM rec JOIN numbered n ON n.sid = rec.sid AND n.k = rec.k + 1)")
def linear_reservoir(spark, d):
    return series.linear_reservoir(fx.series(spark, d), 4.0, 8.0 / 9.0).select("sid", "t", rounded(F.col("outflow"), 2).alias("outflow"))


@query("hydrograph", f"SELECT sid, step, {r('SUM(v * u)', 2)} AS flow FROM (SELECT n.sid, CAST(n.k + o.k AS INTEGER) AS step, n.v, o.u FROM numbered n, (VALUES (0, 0.2::DOUBLE), (1, 0.5::DOUBLE), (2, 0.3::DOUBLE)) AS o(k, u)) GROUP BY sid, step", ("g_series",), NUM)
def hydrograph(spark, d):
    return series.convolve(fx.series(spark, d), [0.2, 0.5, 0.3]).select("sid", F.col("step").cast("int").alias("step"), rounded(F.col("flow"), 2).alias("flow"))


SNOW = f"{NUM}, days AS (SELECT sid, k, t, CAST(((t * 7) % 21) - 10 AS DOUBLE) AS temp, CAST((t * 13) % 9 AS DOUBLE) AS precip FROM numbered)"


@query("snowpack", f"SELECT sid, t, {r('melt')} AS melt, {r('swe')} AS swe FROM rec", ("g_series",), SNOW + ", rec AS (SELECT sid, k, t, LEAST(GREATEST(0.0, 3 * temp), CASE WHEN temp >= 1 THEN 0.0 ELSE precip END) AS melt, CASE WHEN temp >= 1 THEN 0.0 ELSE precip END + CASE WHEN temp < 0 THEN LEAST(-0.05 * temp, CASE WHEN temp >= 1 THEN 0.0 ELSE precip END * 0.05) ELSE 0.0 END - LEAST(GREATEST(0.0, 3 * temp), CASE WHEN temp >= 1 THEN 0.0 ELSE precip END) AS swe FROM days WHERE k = 0 UNION ALL SELECT d.sid, d.k, d.t, LEAST(GREATEST(0.0, 3 * temp), p.swe + CASE WHEN temp >= 1 THEN 0.0 ELSE precip END), p.swe + CASE WHEN temp >= 1 THEN 0.0 ELSE precip END + CASE WHEN temp < 0 THEN LEAST(-0.05 * temp, (p.swe + CASE WHEN temp >= 1 THEN 0.0 ELSE precip END) * 0.05) ELSE 0.0 END - LEAST(GREATEST(0.0, 3 * temp), p.swe + CASE WHEN temp >= 1 THEN 0.0 ELSE precip END) FROM rec p JOIN days d ON d.sid = p.sid AND d.k = p.k + 1)")
def snowpack(spark, d):
    days = fx.series(spark, d).select("sid", "t", ((F.col("t") * 7) % 21 - 10).cast("double").alias("temp"), ((F.col("t") * 13) % 9).cast("double").alias("precip"))
    return series.snowpack(days).select("sid", "t", rounded(F.col("melt")).alias("melt"), rounded(F.col("swe")).alias("swe"))


STACK = "stack AS (SELECT r, c, y AS year, CASE WHEN p THEN red ELSE nir END * y AS z FROM g_raster, (VALUES (1, TRUE), (2, FALSE), (3, TRUE), (4, FALSE), (5, TRUE)) AS v(y, p))"


def _stack(spark, d):
    g = fx.raster(spark, d)
    return g.select("r", "c", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("year"), "red", "nir").select("r", "c", "year", (F.when(F.col("year") % 2 == 1, F.col("red")).otherwise(F.col("nir")) * F.col("year")).alias("z"))


@query("pixel_slope", f"SELECT r, c, {r('CASE WHEN COUNT(z) = 5 THEN REGR_SLOPE(z, year) END')} AS slope FROM stack GROUP BY r, c", ("g_raster",), STACK)
def pixel_slope(spark, d):
    return series.pixel_slope(_stack(spark, d)).select("r", "c", rounded(F.col("slope")).alias("slope"))


@query("pixel_trend", f"SELECT r, c, {r('CASE WHEN COUNT(*) = COUNT(s) THEN SUM(s) / 10.0 END')} AS tau FROM (SELECT a.r, a.c, SIGN(b.z - a.z) AS s FROM stack a JOIN stack b ON a.r = b.r AND a.c = b.c AND a.year < b.year) GROUP BY r, c", ("g_raster",), STACK)
def pixel_trend(spark, d):
    return series.pixel_trend(_stack(spark, d)).select("r", "c", rounded(F.col("tau")).alias("tau"))


@query("change_detection", f"SELECT r, c, {r('nir * 2 - red')} AS change, CAST(CASE WHEN ABS(nir * 2 - red) > 0.4 THEN SIGN(nir * 2 - red) WHEN nir * 2 - red IS NOT NULL THEN 0 END AS INTEGER) AS kind FROM g_raster", ("g_raster",))
def change_detection(spark, d):
    return series.change_detection(_stack(spark, d), 1, 2, 0.4).select("r", "c", rounded(F.col("change")).alias("change"), "kind")


@query("yearly_stats", f"SELECT year, {r('AVG(z)')} AS mean, COUNT(z) AS valid FROM stack GROUP BY year", ("g_raster",), STACK)
def yearly_stats(spark, d):
    return series.yearly_stats(_stack(spark, d)).select("year", rounded(F.col("mean")).alias("mean"), "valid")


# --- drainage

FALL = "CASE WHEN z - {n} > 0 THEN (z - {n}) / {d} END"
D8 = f"{AROUND}, falls AS (SELECT r, c, z, " + ", ".join(f"{FALL.format(n=n, d='SQRT(2.0)' if len(n) == 2 else '1.0')} AS f{code}" for n, code in flow.DIRECTIONS.items()) + " FROM around), d8 AS (SELECT r, c, z, CASE " + " ".join(f"WHEN f{k} = m THEN {k}" for k in range(8)) + " ELSE 255 END AS dir FROM (SELECT *, GREATEST(" + ", ".join(f"COALESCE(f{k}, -1)" for k in range(8)) + ") AS m FROM falls))"
DOWN = f"{D8}, down AS (SELECT d.r, d.c, d.r + o.a AS dr, d.c + o.b AS dc FROM d8 d JOIN (VALUES " + ", ".join(f"({code}, {raster.AROUND[n][0]}, {raster.AROUND[n][1]})" for n, code in flow.DIRECTIONS.items()) + ") AS o(k, a, b) ON o.k = d.dir)"


@query("d8_direction", "SELECT r, c, dir FROM d8", ("g_raster",), D8)
def d8_direction(spark, d):
    return flow.d8_direction(fx.raster(spark, d)).select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "dir")


@query("flow_accumulation", "SELECT g.r, g.c, COALESCE(n, 0) AS acc FROM g_raster g LEFT JOIN (SELECT er, ec, COUNT(*) AS n FROM walk GROUP BY er, ec) w ON w.er = g.r AND w.ec = g.c", ("g_raster",), DOWN + ", walk AS (SELECT r AS sr, c AS sc, dr AS er, dc AS ec FROM down UNION ALL SELECT w.sr, w.sc, d.dr, d.dc FROM walk w JOIN down d ON d.r = w.er AND d.c = w.ec)")
def flow_accumulation(spark, d):
    return flow.flow_accumulation(flow.d8_direction(fx.raster(spark, d))).select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "acc")


# every round gives each stream cell the order its tributaries have come to; heads have 1 from the start
STREAM = f"""{DOWN}, walk AS (SELECT r AS sr, c AS sc, dr AS er, dc AS ec FROM down UNION ALL SELECT w.sr, w.sc, d.dr, d.dc FROM walk w JOIN down d ON d.r = w.er AND d.c = w.ec),
sc AS (SELECT er AS r, ec AS c FROM walk GROUP BY er, ec HAVING COUNT(*) >= 2), se AS (SELECT d.r, d.c, d.dr, d.dc, COUNT(*) OVER (PARTITION BY d.dr, d.dc) AS inflows FROM down d JOIN sc a ON a.r = d.r AND a.c = d.c JOIN sc b ON b.r = d.dr AND b.c = d.dc),
feeds AS (SELECT r, c, dr, dc, inflows FROM se UNION ALL SELECT r, c, r, c, 0 FROM sc ANTI JOIN (SELECT dr AS r, dc AS c FROM se) USING (r, c)), hops AS (SELECT 2 * COUNT(*) + 60 AS most FROM (SELECT DISTINCT r FROM g_raster)),
strahler(i, r, c, o) AS (SELECT 0, r, c, CASE WHEN inflows = 0 THEN 1 END FROM (SELECT DISTINCT dr AS r, dc AS c, inflows FROM feeds) UNION ALL SELECT i + 1, dr, dc, CASE WHEN inflows = 0 THEN 1 WHEN COUNT(o) = inflows THEN MAX(o) + CASE WHEN LIST_SORT(LIST(o), 'DESC')[2] = MAX(o) THEN 1 ELSE 0 END END
 FROM strahler JOIN feeds ON feeds.r = strahler.r AND feeds.c = strahler.c WHERE i < (SELECT most FROM hops) GROUP BY i, dr, dc, inflows)"""


@query("stream_order", 'SELECT o AS "order", COUNT(*) AS cells FROM strahler WHERE i = (SELECT MAX(i) FROM strahler) GROUP BY o', ("g_raster",), STREAM)
def stream_order(spark, d):
    dirs = flow.d8_direction(fx.raster(spark, d)).cache()
    return flow.strahler(dirs, flow.streams(flow.flow_accumulation(dirs), 2)).groupBy("order").agg(F.count("*").alias("cells"))


@query("watershed", "SELECT COUNT(*) AS cells FROM (SELECT 4 AS r, 7 AS c UNION SELECT sr, sc FROM walk WHERE er = 4 AND ec = 7)", ("g_raster",), DOWN + ", walk AS (SELECT r AS sr, c AS sc, dr AS er, dc AS ec FROM down UNION ALL SELECT w.sr, w.sc, d.dr, d.dc FROM walk w JOIN down d ON d.r = w.er AND d.c = w.ec)")
def watershed(spark, d):
    return flow.watershed(flow.d8_direction(fx.raster(spark, d)), 4, 7).agg(F.count("*").alias("cells"))


FILLED = f"{AROUND}, filled AS (SELECT r, c, CASE WHEN present = 8 AND z < LEAST({', '.join(raster.AROUND)}) THEN LEAST({', '.join(raster.AROUND)}) + 0.001 ELSE z END AS z FROM around), "
FILLED += D8.replace("around", "around2").replace("g_raster", "filled")


@query("pit_filling", "SELECT dir, COUNT(*) AS cells FROM d8 GROUP BY dir", ("g_raster",), FILLED)
def pit_filling(spark, d):
    return flow.d8_direction(fx.raster(spark, d), filled=True).groupBy("dir").agg(F.count("*").alias("cells"))


SHIFTS = ", ".join(f"({a}, {b})" for a, b in raster.AROUND.values())
COST = f"""steps AS (SELECT a.r, a.c, b.r AS nr, b.c AS nc, SQRT(s.dr * s.dr + s.dc * s.dc) * (1 + 5 * (a.z + b.z) / 200) AS cost FROM g_raster a, (VALUES {SHIFTS}) AS s(dr, dc) JOIN g_raster b ON b.r = a.r + s.dr AND b.c = a.c + s.dc UNION ALL SELECT r, c, r, c, 0 FROM g_raster),
hops AS (SELECT COUNT(*) AS most FROM (SELECT DISTINCT r FROM g_raster)),
go(i, r, c, d) AS (SELECT 0, 0, 0, 0.0::DOUBLE UNION ALL SELECT i + 1, nr, nc, MIN(d + cost) FROM go JOIN steps ON steps.r = go.r AND steps.c = go.c WHERE i < (SELECT 2 * most + 60 FROM hops) GROUP BY i, nr, nc)"""


@query("cost_distance", f"SELECT r::BIGINT AS r, c::BIGINT AS c, {r('d')} AS d FROM go WHERE i = (SELECT MAX(i) FROM go)", ("g_raster",), COST)
def cost_distance(spark, d):
    return flow.cost_distance(fx.raster(spark, d), 0, 0).select("r", "c", rounded(F.col("d")).alias("d"))


@query(
    "inundation_level",
    f"""SELECT {r("level", 4)} AS level, (SELECT COUNT(*) FROM g_raster WHERE z < level) AS cells FROM (SELECT LEAST(MIN((5000.0 + s) / k), MAX(z) + 10) AS level FROM (SELECT z, SUM(z) OVER w AS s, COUNT(*) OVER w AS k FROM g_raster WINDOW w AS (ORDER BY z)))""",
    ("g_raster",),
)
def inundation_level(spark, d):
    return flow.inundation_level(fx.raster(spark, d), 5000.0, 1.0).select(rounded(F.col("level"), 4).alias("level"), "cells")


@query("land_use_simulation")
def land_use_simulation(spark, d):
    g = fx.raster(spark, d)
    t = stats.transition_matrix(g.select(F.col("lc0").alias("a"), F.col("lc1").alias("b")), 6)
    return flow.land_use_simulation(g.select("r", "c", F.col("lc1").alias("cls")), t, 2).groupBy("cls").agg(F.count("*").alias("cells"))
