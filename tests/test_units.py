"""Operators against plain Python, known values and round trips."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.functions import base, crs, geometry, grids
from geoloom.operators import flow, joins, polygons, raster, series, stats
from geoloom.registry import Registry, registry
from geoloom.sources import readers, sinks
from geoloom.streaming import readings


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def test_registry():
    own = Registry()

    @own.register("g")
    def double(df, times: int = 2):
        """Doc."""
        return df

    assert own.names("g") == ["double"] and own.groups() == {"g": ["double"]}
    assert json.loads(own.schemas())[0]["parameters"]["properties"]["times"]["default"] == 2
    with pytest.raises(ValueError):
        own.register("g", "double")(lambda df: df)
    with pytest.raises(TypeError):
        own.dispatch("double", None, other=1)
    with pytest.raises(KeyError):
        own.get("none")
    assert len(registry.names()) > 50


def test_registry_dispatch(spark):
    cells = spark.createDataFrame([(0, 0, 0.2), (0, 1, 0.5), (0, 2, None)], "r int, c int, z double")
    got = registry.dispatch("threshold", cells, low=0.3, high=0.6)
    assert sorted((r.c, r.z) for r in got.collect() if r.z is not None) == [(0, 0), (1, 1)]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_known_values(spark):
    lit = F.lit
    assert one(spark, grids.geohash(lit(-5.6), lit(42.6), 5)) == "ezs42"
    assert one(spark, grids.geohash_decode(lit("a"))) is None
    x, y = crs.to_mercator(lit(180.0), lit(0.0))
    assert one(spark, x) == pytest.approx(20037508.342789244)
    assert one(spark, y) == pytest.approx(0, abs=1e-6)
    # Flinders Peak to Buninyong, the worked example of the geodesic formulas
    a = (144.42486788888888, -37.95103341666667)
    b = (143.92649552777777, -37.65282113888889)
    assert one(spark, crs.vincenty_m(lit(a[0]), lit(a[1]), lit(b[0]), lit(b[1]))) == pytest.approx(54972.271, abs=0.05)
    assert one(spark, base.round_half_away(lit(1.005))) == 1.0
    assert one(spark, base.normal_cdf(lit(1.96))) == pytest.approx(0.9750021, abs=2e-7)
    assert one(spark, grids.hex_parse(lit("junk"))) is None
    assert grids.hex_count(3) == 41162


def test_points_and_rings(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4)]
    df = spark.createDataFrame([(ring(square),)], "ring array<struct<x:double,y:double>>")
    for p, inside in (((1, 1), True), ((4, 2), False), ((0, 0), False), ((5, 1), False)):
        assert df.select(geometry.in_ring(F.lit(float(p[0])), F.lit(float(p[1])), F.col("ring")).alias("v")).first()["v"] is inside
    hole = spark.createDataFrame([([ring(square), ring([(1, 1), (2, 1), (2, 2), (1, 2)])],)], "rings array<array<struct<x:double,y:double>>>")
    for p, inside in (((1.5, 1.5), False), ((1.0, 1.5), False), ((3.0, 3.0), True)):
        assert hole.select(geometry.in_polygon(F.lit(p[0]), F.lit(p[1]), F.col("rings")).alias("v")).first()["v"] is inside
    bad = spark.createDataFrame([([{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}],)], "ring array<struct<x:double,y:double>>")
    assert "fewer than 4 points" in bad.select(geometry.problems(F.col("ring")).alias("v")).first()["v"]


def test_polygon_algebra():
    rng = random.Random(1)
    star = [(np.cos(a) * (2 if k % 2 else 1), np.sin(a) * (2 if k % 2 else 1)) for k, a in enumerate(np.linspace(0, 2 * np.pi, 12, endpoint=False))]
    t = polygons.triangles(star)
    assert sum(abs(polygons.area(x)) for x in t) == pytest.approx(abs(polygons.area(star)))
    total = lambda ps: sum(abs(polygons.area(p)) for p in ps)
    for _ in range(20):
        moved = [(x + rng.uniform(-2, 2), y + rng.uniform(-2, 2)) for x, y in star]
        dx, dy = rng.uniform(-2, 2), rng.uniform(-2, 2)
        moved = [(x + dx, y + dy) for x, y in star]
        a, b = polygons.triangles(star), polygons.triangles(moved)
        i, u, x = total(polygons.intersection(a, b)), total(polygons.union(a, b)), total(polygons.symmetric(a, b))
        assert u + i == pytest.approx(total(a) + total(b))
        assert x == pytest.approx(u - i)
    assert polygons.hull([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2)]) == [(0, 0), (2, 0), (2, 2), (0, 2)]
    line = [(0.0, 0.0), (1.0, 0.1), (2.0, -0.1), (3.0, 5.0), (4.0, 6.0), (5.0, 7.0)]
    assert polygons.simplify_distance(line, 0.5) == [(0.0, 0.0), (2.0, -0.1), (3.0, 5.0), (5.0, 7.0)]
    assert polygons.simplify_area(line, 0.2)[0] == line[0]


def test_knn_against_brute_force(spark):
    rng = random.Random(3)
    ps = [(i, rng.uniform(-50, 50) ** 3 / 2500, rng.uniform(-50, 50)) for i in range(200)]
    df = spark.createDataFrame(ps, "id long, x double, y double")
    got = {}
    for r in joins.knn(df.selectExpr("id q_id", "x q_x", "y q_y"), df.selectExpr("id p_id", "x p_x", "y p_y"), 4, 1.0).orderBy("q_id", "rank").collect():
        got.setdefault(r.q_id, []).append(r.p_id)
    for i, x, y in ps:
        best = sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in ps if j != i)[:4]
        assert got[i] == [j for _, j in best]


def test_neighbours_across_tiles(spark):
    cells = spark.createDataFrame([(r, c, float(r * 10 + c)) for r in range(7) for c in range(9)], "r int, c int, z double")
    got = {(x.r, x.c): x for x in raster.neighbours(cells, tile=3).collect()}
    assert len(got) == 63
    for (r, c), x in got.items():
        assert x.ne == (float((r - 1) * 10 + c + 1) if r > 0 and c < 8 else None)
        assert x.present == sum(0 <= r + a < 7 and 0 <= c + b < 9 for a, b in raster.AROUND.values())


def test_resample_identity(spark):
    cells = spark.createDataFrame([(r, c, float(r * r + c)) for r in range(5) for c in range(6)], "r int, c int, z double")
    for how in ("nearest", "bilinear", "cubic"):
        got = {(x.r, x.c): x.z for x in raster.resample(cells, 5, 6, 5, 6, how).collect()}
        assert got == pytest.approx({(r, c): float(r * r + c) for r in range(5) for c in range(6)})


def test_series_kernels():
    rng = np.random.default_rng(0)
    for n in (3, 40, 1500):
        v = np.round(rng.normal(0, 1, n), 1)
        s = int(sum(np.sign(v[j + 1 :] - v[j]).sum() for j in range(n)))
        assert series.kendall(v)[2] == s
    v = np.r_[np.zeros(10), np.ones(10)]
    assert series.pettitt(v)[0] == 10
    assert series.sen(np.arange(5.0)) == 1.0
    assert series.gamma_cdf(1.0, 1.0) == pytest.approx(1 - np.exp(-1))
    assert series.gamma_cdf(2.5, 20.0) == pytest.approx(1.0, abs=1e-6)


def test_flow(spark):
    slope = spark.createDataFrame([(r, c, float(10 - r - c)) for r in range(4) for c in range(4)], "r int, c int, z double")
    dirs = flow.d8_direction(slope)
    acc = {(x.r, x.c): x.acc for x in flow.flow_accumulation(dirs, include_self=True).collect()}
    assert acc[3, 3] == 16 and acc[0, 0] == 1
    assert flow.watershed(dirs, 3, 3).count() == 16
    flat = spark.createDataFrame([(r, c, 0.0) for r in range(3) for c in range(3)], "r int, c int, z double")
    got = {(x.r, x.c): x.d for x in flow.cost_distance(flat, 0, 0).collect()}
    assert got[2, 2] == pytest.approx(2 * 2**0.5) and got[0, 2] == 2.0


def test_cost_distance_query_against_dijkstra(spark, sf_dir):
    import heapq

    from geoloom.plans import fixtures, rasters  # noqa: F401  (it registers the query)
    from geoloom.plans.catalog import QUERIES

    z = {(x.r, x.c): x.z for x in fixtures.raster(spark, sf_dir).select("r", "c", "z").collect() if x.z is not None}
    best, heap = {}, [(0.0, 0, 0)]
    while heap:
        d, i, j = heapq.heappop(heap)
        if (i, j) in best:
            continue
        best[i, j] = d
        for a, b in ((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b):
            if (i + a, j + b) in z and (i + a, j + b) not in best:
                heapq.heappush(heap, (d + (2**0.5 if a and b else 1.0) * (1 + 5 * (z[i, j] + z[i + a, j + b]) / 200), i + a, j + b))
    got = {(x.r, x.c): x.d for x in QUERIES["cost_distance"](spark, sf_dir).collect()}
    assert len(got) == len(z) == len(best)
    assert got == pytest.approx(best, abs=2e-6)


def least_costs(z, start):
    """Dijkstra's method over a dict of cells."""
    import heapq

    best, heap = {}, [(0.0, *start)] if start in z else []
    while heap:
        d, i, j = heapq.heappop(heap)
        if (i, j) in best:
            continue
        best[i, j] = d
        for a, b in ((a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b):
            if (i + a, j + b) in z and (i + a, j + b) not in best:
                heapq.heappush(heap, (d + (2**0.5 if a and b else 1.0) * (1 + 5 * (z[i, j] + z[i + a, j + b]) / 200), i + a, j + b))
    return best


def test_cost_distance_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(flow, "_SIDE", 7)
    rng = random.Random(5)
    z = {(r, c): float(rng.choice([0, 1, 500])) for r in range(-4, 14) for c in range(-3, 16) if rng.random() > 0.25}
    z |= {(-4, -3): 1.0, (40, 40): 1.0}  # a cell that no path reaches
    rows = [(r, c, v) for (r, c), v in z.items()] + [(60, 1, None), (61, 1, float("nan"))]
    cells = spark.createDataFrame(rows, "r int, c int, z double")
    want = least_costs(z, (-4, -3))
    got = {(x.r, x.c): x.d for x in flow.cost_distance(cells, -4, -3).collect()}
    assert len(want) > 150 and got == pytest.approx(want, abs=1e-9)
    near = {(x.r, x.c) for x in flow.cost_distance(cells, -4, -3, most=9.0).collect()}
    assert near == {k for k, v in want.items() if v <= 9.0}
    assert flow.cost_distance(cells, 39, 39).collect() == []
    with pytest.raises(RuntimeError):
        flow.cost_distance(cells, -4, -3, rounds=1)


def test_cost_distance_of_a_long_raster_in_time(spark):
    import time

    # 128 s when a round moved one cell on
    z = {(k // 40, k % 40): float(k * 31 % 97) for k in range(20_000)}
    start = time.time()
    got = {(x.r, x.c): x.d for x in flow.cost_distance(spark.createDataFrame([(*k, v) for k, v in z.items()], "r int, c int, z double"), 0, 0).collect()}
    assert time.time() - start < 40 and got == pytest.approx(least_costs(z, (0, 0)), abs=1e-9)


def against_sql(spark, folder, name, **tables):
    """The rows of a query and of its SQL on small tables."""
    import duckdb

    from geoloom.plans import core  # noqa: F401  (it registers the queries)
    from geoloom.plans.catalog import ORACLES, QUERIES

    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).collect()), key=repr), sorted(con.sql(ORACLES[name]).fetchall(), key=repr)


CUSTOMER = "c_custkey long, c_acctbal double, c_mktsegment string"


def test_counts_within_radius(spark):
    rng = random.Random(11)
    spots = [(rng.uniform(-180, 180), rng.uniform(-90, 90), rng.choice(["a", "b", None])) for _ in range(700)]
    spots += [(180.0, 10.0, "a"), (-180.0, 10.0, "a"), (541.0, 10.0, "b"), (0.0, 90.0, "a"), (7.0, -90.0, "b"), (5.0, 5.0, "a"), (5.0, 5.0, "a")]
    centres = [(k, x, y) for k, (x, y) in enumerate([(179.9, 10.0), (-179.9, 10.0), (0.0, 90.0), (3.0, -90.0), (5.0, 5.0), (5.0, 5.0), (0.0, 85.0), (100.0, -88.0), (40.0, 0.0)])]
    p = spark.createDataFrame([*spots, (None, 1.0, "a"), (float("nan"), 1.0, "a")], "p_lon double, p_lat double, cls string")
    o = spark.createDataFrame([*centres, (99, None, 0.0)], "o_id long, o_lon double, o_lat double")

    def apart(x, y, u, v):
        h = np.sin(np.radians(v - y) / 2) ** 2 + np.cos(np.radians(y)) * np.cos(np.radians(v)) * np.sin(np.radians(u - x) / 2) ** 2
        return 2 * 6371 * np.arcsin(np.sqrt(min(1.0, h)))

    for km in (1500.0, 25_000.0, 1.0):
        want = {}
        for k, x, y in centres:
            for u, v, kind in spots:
                if apart(x, y, u, v) <= km:
                    want[k, kind] = want.get((k, kind), 0) + 1
        got = joins.count_within_radius(o, p, km, "cls").collect()
        assert {(g.o_id, g.cls): g.n for g in got} == want and len(got) == len(want)


def test_within_radius_query_makes_no_pairs(spark, tmp_path):
    import time

    # 3,000 circles over 60,000 points hold over two million pairs
    spark.range(60_000).selectExpr("id AS c_custkey", "0D AS c_acctbal", "'BUILDING' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(3_000).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    from geoloom.plans import core  # noqa: F401  (it registers the query)
    from geoloom.plans.catalog import QUERIES

    frame = QUERIES["within_radius"](spark, str(tmp_path))
    start = time.time()
    total = frame.agg(F.sum("n")).first()[0]
    assert total > 2_000_000 and time.time() - start < 30
    plan = frame._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" in plan and "ASIN" not in plan.upper()


def test_series_without_breaks(spark):
    flat, step = [("a", k, 1.0) for k in range(40)], [("b", k, float(k >= 20)) for k in range(40)]
    assert series.breaks(spark.createDataFrame(flat, "sid string, t int, v double")).collect() == []
    got = series.breaks(spark.createDataFrame([*flat, *step], "sid string, t int, v double")).collect()
    assert {x.sid for x in got} == {"b"}


@pytest.mark.parametrize("name", ["vincenty_inverse", "vincenty_round_trip"])
def test_geodesics_of_many_points_in_time(spark, tmp_path, name):
    import time

    # the points stand in one file, as a table of this size does; folds over rounds took 88 s and 229 s for 90,000 points
    rows = [(k, 0.0, "BUILDING") for k in range(60_000)]
    start = time.time()
    got, want = against_sql(spark, tmp_path, name, customer=(rows, CUSTOMER))
    assert got == want and time.time() - start < 30


def test_geodesics_of_odd_rows(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0), (0.0, 0.0, None, 1.0), (0.0, 0.0, 179.9, 0.1), (float("nan"), 0.0, 1.0, 1.0), (0.0, 90.0, 0.0, -90.0)], "a double, b double, c double, d double")
    got = [x.m for x in df.coalesce(1).select(crs.vincenty_m(*map(F.col, "abcd")).alias("m")).collect()]
    assert got[0] == 0.0 and got[1] is got[2] is got[3] is None and got[4] == pytest.approx(20003931.4586, abs=1e-3)
    end = df.coalesce(1).select(crs.vincenty_direct(F.col("a"), F.col("b"), F.col("c"), F.lit(1000.0)).alias("e")).select("e.*").collect()
    assert end[0].lon == 0.0 and end[0].lat == pytest.approx(0.009043, abs=1e-6) and end[1].lat is None and end[3].lon is None


def test_utm_at_the_edge_of_ten_metres(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "utm_forward", customer=([(k, 0.0, "BUILDING") for k in (26_681, 77_681, 30_000)], CUSTOMER))
    assert got == want and (26_681, 5, 55_175, 217_665) in got


def test_point_within_rounding_of_an_edge(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "pip_join", customer=([(51_985, 0.0, "BUILDING")], CUSTOMER), supplier=([(3896,), (3975,)], "s_suppkey long"))
    assert got == want == [(51_985, 3896)]


def test_empty_inputs(spark):
    cells = spark.createDataFrame([], "r int, c int, z double, zone int")
    assert raster.neighbours(cells).count() == 0
    assert raster.zonal_mask(cells, 2).count() == 2
    assert flow.d8_direction(cells).count() == 0
    empty = spark.createDataFrame([], "sid string, t int, v double")
    assert series.trend(empty).count() == 0 and series.muskingum(empty).count() == 0
    assert stats.quantile_breaks(spark.createDataFrame([], "v double")).count() == 0


def test_geojson_and_csv(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "id": "a", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 1], [0, 0]]]}, "properties": {"class": "Forest"}}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [5, -1]}, "properties": None}]}
    (tmp_path / "f.json").write_text(json.dumps(doc))
    (tmp_path / "g.json").write_text(json.dumps({"type": "Point", "coordinates": [1.5, 2.5]}))
    f = readers.geojson(spark, str(tmp_path / "f.json"))
    assert f.count() == 2
    box = readers.feature_box(f).first()
    assert (box.x0, box.y0, box.x1, box.y1) == (0.0, -1.0, 5.0, 1.0)
    assert readers.property_filter(f, "class", "Forest").count() == 1
    assert readers.geojson(spark, str(tmp_path / "g.json")).first().kind == "Point"
    (tmp_path / "p.csv").write_text("Name,LNG,Latitude\nx,10.5,-3\ny,bad,4\n")
    rows = readers.points_csv(spark, str(tmp_path / "p.csv")).orderBy("lat").collect()
    assert rows[0].lon == 10.5 and rows[0].properties["Name"] == "x" and rows[1].lon is None
    with pytest.raises(ValueError):
        readers.points_of(spark.createDataFrame([(1,)], "a int"))


def test_factor_table(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Source,category,factor_value,gas_ch4_factor,valid_from_year\n, Forest ,-5.0,0.1,\nX,Wetland,bad,,2010\n")
    rows = {r.category: r for r in readers.factors_csv(spark, str(tmp_path / "f.csv")).collect()}
    assert rows["forest"].source == "IPCC_2019" and rows["forest"].valid_from_year == 2000 and rows["forest"].gases[0].gas == "ch4"
    assert rows["wetland"].factor_value is None and rows["wetland"].valid_from_year == 2010


def test_select_guard():
    assert readers.check_select(" SELECT updated_at FROM t ")
    for bad in ("DROP TABLE t", "SELECT 1; SELECT 2", "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x", "select \\ from t"):
        with pytest.raises(ValueError):
            readers.check_select(bad)
    with pytest.raises(ValueError):
        readers.check_select("SELECT updated_at FROM t", strict=True)
    assert readers.check_select("SELECT 'drop' FROM t")


def test_bytes_round_trips():
    band = np.array([[1.5, 2.0], [-9999.0, 4.0], [0.0, 7.25]])
    back = sinks.read_geotiff(sinks.geotiff(band))
    assert np.isnan(back[1, 0]) and back[2, 1] == 7.25
    tiles = [(1, 0, 1, b"b"), (0, 0, 0, b"a"), (1, 1, 0, b"")]
    pack = sinks.Archive(sinks.archive(tiles))
    assert pack.tiles() == [(0, 0, 0), (1, 0, 1), (1, 1, 0)] and pack.tile(1, 0, 1) == b"b"
    data = sinks.tile_bytes("l", [(1, "polygon", [[(0, 0), (10, 0), (10, 10), (0, 0)]], {"k": "v", "n": 3, "f": 1.5, "b": True})])
    assert data[0] == 0x1A and b"l" in data
    assert sinks.xlsx(["a"], [(1,), ("x<y",), (None,)])[:2] == b"PK"
    assert "LWPOLYLINE" in sinks.dxf([("a", [(0.0, 0.0), (1.0, 1.0)])])
    assert sinks.fill("{{ a }}-{{b}}", {"a": 1, "b": "x"}) == "1-x"
    assert sinks.modflow_discretisation(2, 3, 4, 10.0, 10.0, 100.0, 0.0, 1).count("CONSTANT") == 5
    assert len(sinks.world_file(0, 10, 1, 1).splitlines()) == 6


def test_streams_agree_with_batches(spark, sf_dir):
    from geoloom.plans import fixtures, streams

    batch = readings.minute_means(fixtures.readings(spark, sf_dir)).count()
    streamed = streams.stream_minutes(spark, sf_dir).first()
    assert 0 < streamed["minutes"] <= batch
    good, bad = readings.split(fixtures.readings(spark, sf_dir))
    assert good.count() + bad.count() == fixtures.readings(spark, sf_dir).count()


def test_nmea(spark):
    lines = ["$GPGGA,123519,4807.038,N,01131.000,E,1,08,,545.4,M,46.9,M,,*47", "$GPRMC,123519,A,4807.038,S,01131.000,W,022.4,084.4,230394,003.1,W*6A", "garbage", "$GPGGA,1,2", "$GPGSV,3,1,11"]
    got = {r.kind: r for r in readers.nmea(spark.createDataFrame([(x,) for x in lines], "value string")).collect()}
    assert got["GGA"].lat == pytest.approx(48.1173) and got["GGA"].hdop == 99.9 and got["GGA"].satellites == 8
    assert got["RMC"].lat == pytest.approx(-48.1173) and got["RMC"].lon == pytest.approx(-11.516667, abs=1e-6) and got["RMC"].valid
    assert len(got) == 2


@pytest.mark.parametrize("scale", [1.0, 100_000.0, 1e-6])
def test_knn_in_any_unit(spark, scale):
    """Clustered, sparse and few points, in any unit, against brute force; ties to the smaller id."""
    from geoloom.operators.joins import knn

    rng = np.random.default_rng(4)
    near = rng.integers(0, 9, (60, 2)).astype(float)  # many ties
    far = rng.uniform(-5000, 5000, (40, 2))
    xy = np.concatenate([near, far]) * scale
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "p_id long, p_x double, p_y double")
    asked = points.selectExpr("p_id as q_id", "p_x as q_x", "p_y as q_y").where("q_id % 3 = 0")
    got = {}
    for r in knn(asked, points, 4).orderBy("q_id", "rank").collect():
        got.setdefault(r.q_id, []).append(r.p_id)
    for i in range(0, 100, 3):
        order = sorted((float(np.sqrt(((xy[i] - xy[j]) ** 2).sum())), j) for j in range(100) if j != i)
        assert got[i] == [j for _, j in order[:4]], i
    few = points.where("p_id >= 92")
    assert knn(few.selectExpr("p_id as q_id", "p_x as q_x", "p_y as q_y"), few, 20).count() == 8 * 7
    assert knn(asked, points.where("false"), 3).count() == 0 and knn(asked.where("false"), points, 3).count() == 0


def test_jenks_is_exact(spark):
    """Against all placements of two and three breaks, and against the plain dynamic programme on many distinct values."""
    from itertools import combinations

    from geoloom.operators.stats import jenks_breaks

    def cost(parts):
        return sum(((p - p.mean()) ** 2).sum() for p in parts if len(p))

    rng = np.random.default_rng(5)
    for n, k in ((14, 3), (12, 4)):
        v = np.sort(np.round(rng.lognormal(0, 2, n), 3))
        got = [r.value for r in jenks_breaks(spark.createDataFrame([(float(x),) for x in v], "v double"), k).orderBy("i").collect()]
        best = min(cost(np.split(v, c)) for c in combinations(range(1, n), k - 1))
        assert abs(cost(np.split(v, np.searchsorted(v, got, "right"))) - best) < 1e-9
    v = np.append(rng.normal(size=6000), 1e6)  # more than 4096 distinct values, and an outlier
    got = [r.value for r in jenks_breaks(spark.createDataFrame([(float(x),) for x in v], "v double"), 4).orderBy("i").collect()]
    assert len(got) == 3
    assert jenks_breaks(spark.createDataFrame([], "v double"), 3).count() == 0


def test_quantile_breaks_over_many_ranges(spark):
    from geoloom.operators.stats import quantile_breaks

    rng = np.random.default_rng(6)
    v = np.sort(rng.integers(0, 500, 3000).astype(float))
    df = spark.createDataFrame([(float(x),) for x in rng.permutation(v)], "v double")
    got = [r.value for r in quantile_breaks(df, 7).orderBy("i").collect()]
    assert got == [v[min(int(i * 3000 / 7 + 0.5), 2999)] for i in range(1, 7)]


def test_sen_and_pettitt_without_all_pairs():
    from geoloom.operators import series

    rng = np.random.default_rng(7)
    for v in (rng.normal(size=200), rng.integers(0, 4, 150).astype(float), np.zeros(50), np.arange(60.0), rng.lognormal(0, 3, 180)):
        slopes = np.sort(np.concatenate([(v[k:] - v[:-k]) / k for k in range(1, len(v))]))
        assert series.sen(v, most=100) == series.sen(v) == slopes[len(slopes) // 2]
        u = np.abs(np.cumsum([np.sign(v - x).sum() for x in v])[:-1])
        at, top, _ = series.pettitt(v)
        assert top == u.max() and (at == int(u.argmax()) + 1 or top == 0)


def test_folds_over_several_runs(spark):
    from geoloom.operators.series import autoregression

    rows = [("a", i, float(i % 7)) for i in range(900)] + [("b", 0, 2.0)]
    got = {(r.sid, r.t): r.x for r in autoregression(spark.createDataFrame(rows, "sid string, t int, v double"), 0.5).collect()}
    x = 0.0
    for i in range(900):
        x = i % 7 + 0.5 * x
        assert abs(got["a", i] - x) < 1e-9
    assert got["b", 0] == 2.0


def test_tables_and_stores(spark, tmp_path):
    from geoloom.sources import tables

    rows = spark.createDataFrame([(1, 10.0, 20.0, "{}"), (2, -30.0, 5.0, "{}")], "id long, lon double, lat double, props string")
    name = f"places_{random.randrange(10**9)}"
    try:
        assert tables.ingest(rows, name) == 2 and tables.count_rows(spark, name) == 2 and name in tables.list_tables(spark)
        with pytest.raises(ValueError):
            tables.ingest(rows.withColumn("lat", F.lit(95.0)), name)
        assert tables.count_rows(spark, name) == 2
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    tables.put_objects(rows.select(F.col("props").alias("value")).coalesce(1), str(tmp_path / "store"))
    listed = tables.list_objects(spark, str(tmp_path / "store"), "*.txt").collect()
    assert len(listed) == 1 and listed[0].length == 6
    assert bytes(tables.get_objects(spark, str(tmp_path / "store"), "*.txt").first().content) == b"{}\n{}\n"


def test_jdbc_round_trip(spark, tmp_path):
    from geoloom.sources import tables

    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    try:
        spark.sparkContext._jvm.java.lang.Class.forName(driver)
    except Exception:
        pytest.skip("no JDBC driver here")
    df = spark.range(100).selectExpr("cast(id as int) as id", "cast(id * 2 as double) as v")
    tables.jdbc_push(df, url, "nums", driver=driver, rows_a_batch=30)
    assert tables.jdbc_pull(spark, url, "nums", driver=driver).where("id >= 90").count() == 10
    got = tables.jdbc_pull(spark, url, "nums", ("ID", 0, 100, 4), driver=driver)
    assert got.rdd.getNumPartitions() == 4 and got.agg(F.sum("v")).first()[0] == 9900.0


def test_geoparquet_files(spark, tmp_path):
    import io

    import pyarrow.parquet as pq

    from geoloom.sources import tables

    rng = np.random.default_rng(1)
    data = [(i, float(x), float(y), json.dumps({"n": i})) for i, (x, y) in enumerate(rng.uniform(-80, 80, (500, 2)))]
    points = spark.createDataFrame(data, "id long, lon double, lat double, props string")
    seen = []
    for r in tables.geoparquet_files(points, 3, 50).collect():
        file = pq.ParquetFile(io.BytesIO(bytes(r.file)))
        geo = json.loads(file.metadata.metadata[b"geo"])
        table = file.read().to_pylist()
        place = [np.frombuffer(t["geometry"][5:], "<f8") for t in table]
        own = geo["columns"]["geometry"]
        assert geo["version"] == "1.1.0" and own["encoding"] == "WKB" and own["geometry_types"] == ["Point"]
        assert own["bbox"] == [min(p[0] for p in place), min(p[1] for p in place), max(p[0] for p in place), max(p[1] for p in place)]
        assert file.metadata.num_row_groups > 1
        seen += [(t["id"], float(p[0]), float(p[1]), t["props"]) for t, p in zip(table, place)]
    assert sorted(seen) == sorted(data)
    path = str(tmp_path / "points")
    tables.with_covering(points).repartitionByRange(8, "lon").write.parquet(path)
    found = tables.box_scan(spark, path, (-10.0, -20.0, 15.0, 30.0))
    assert {r.id for r in found.collect()} == {i for i, x, y, _ in data if -10 <= x <= 15 and -20 <= y <= 30}
    assert "PushedFilters: [" in (plan := found._jdf.queryExecution().toString()) and "LessThanOrEqual(xmin" in plan
    groups = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0), (20.0, 0.0, 30.0, 1.0), (None, 0.0, 1.0, 1.0)], "a double, b double, c double, d double")
    verdict = tables.group_verdict((F.col("a"), F.col("b")), (F.col("c"), F.col("d")), (-10.0, -20.0, 15.0, 30.0))
    assert [r[0] for r in groups.select(verdict).collect()] == ["intersects", "disjoint", "unknown"]
