"""Geospatial inputs derived from the tables, as DataFrames and as the SQL of the same views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SQL: dict[str, str] = {}

SQL["g_points"] = """SELECT c_custkey AS id, CAST(c_custkey * 7919 % 36000 AS DOUBLE) / 100 - 180 AS lon, CAST(c_custkey * 104729 % 17000 AS DOUBLE) / 100 - 85 AS lat, c_acctbal AS w,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'built_up' WHEN 'AUTOMOBILE' THEN 'cropland' WHEN 'MACHINERY' THEN 'grassland' WHEN 'HOUSEHOLD' THEN 'wetland' ELSE 'forest' END AS cls FROM customer"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """id, lon, lat, w, cls: a point for each customer."""
    k = F.col("c_custkey")
    cls = F.when(F.col("c_mktsegment") == "BUILDING", "built_up").when(F.col("c_mktsegment") == "AUTOMOBILE", "cropland").when(F.col("c_mktsegment") == "MACHINERY", "grassland").when(F.col("c_mktsegment") == "HOUSEHOLD", "wetland").otherwise("forest")
    return table(spark, d, "customer").select(k.alias("id"), ((k * 7919 % 36000).cast("double") / 100 - 180).alias("lon"), ((k * 104729 % 17000).cast("double") / 100 - 85).alias("lat"), F.col("c_acctbal").alias("w"), cls.alias("cls"))


SQL["g_zones"] = """SELECT n_nationkey AS zone_id, n_name AS zone_name, CAST(-180 + 72 * (n_nationkey % 5) AS DOUBLE) AS x0, CAST(-90 + 36 * FLOOR(n_nationkey / 5) AS DOUBLE) AS y0,
 CAST(-108 + 72 * (n_nationkey % 5) AS DOUBLE) AS x1, CAST(-54 + 36 * FLOOR(n_nationkey / 5) AS DOUBLE) AS y1 FROM nation"""


def zones(spark: SparkSession, d: str) -> DataFrame:
    """zone_id, zone_name, x0, y0, x1, y1: half-open boxes that tile the world."""
    k = F.col("n_nationkey")
    x0, y0 = (72 * (k % 5) - 180).cast("double"), (36 * F.floor(k / 5) - 90).cast("double")
    return table(spark, d, "nation").select(k.alias("zone_id"), F.col("n_name").alias("zone_name"), x0.alias("x0"), y0.alias("y0"), (x0 + 72).alias("x1"), (y0 + 36).alias("y1"))


FACTORS = [("forest", -5.0, 2000, None), ("grassland", -1.2, 2000, None), ("wetland", -8.5, 2000, 2015), ("wetland", -7.5, 2016, None), ("cropland", 0.5, 2000, None)]
SQL["g_factors"] = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', CAST({b} AS DOUBLE), {c}, {'CAST(NULL AS INTEGER)' if e is None else e})" for a, b, c, e in FACTORS) + ") AS t(category, factor_value, valid_from_year, valid_to_year)"


def factors(spark: SparkSession, d: str = "") -> DataFrame:
    """category, factor_value, valid_from_year, valid_to_year; built_up has none on purpose."""
    return spark.createDataFrame(FACTORS, "category string, factor_value double, valid_from_year int, valid_to_year int")


HEXAGON = [(3, 0), (1, 3), (-2, 2), (-3, -1), (-1, -3), (2, -2)]
SQL["g_poly_vertices"] = "SELECT s_suppkey AS poly_id, k, CAST(s_suppkey * 7919 % 3400 AS DOUBLE) / 10 - 170 + dx AS x, CAST(s_suppkey * 104729 % 1600 AS DOUBLE) / 10 - 80 + dy AS y FROM supplier, (VALUES " + ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(HEXAGON)) + ") AS o(k, dx, dy)"


def polygons(spark: SparkSession, d: str) -> DataFrame:
    """poly_id, ring: a convex hexagon for each supplier, counter-clockwise, closed."""
    k = F.col("s_suppkey")
    cx, cy = (k * 7919 % 3400).cast("double") / 10 - 170, (k * 104729 % 1600).cast("double") / 10 - 80
    ring = F.array(*[F.struct((cx + x).alias("x"), (cy + y).alias("y")) for x, y in [*HEXAGON, HEXAGON[0]]])
    return table(spark, d, "supplier").select(k.alias("poly_id"), ring.alias("ring"))


SQL["g_raster"] = """SELECT CAST(FLOOR(p_partkey / 40) AS INTEGER) AS r, CAST(p_partkey % 40 AS INTEGER) AS c, CAST(p_size AS DOUBLE) + CAST((p_partkey * 31) % 97 AS DOUBLE) / 10 AS z,
 CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_partkey * 37 % 1000 AS DOUBLE) / 1000 END AS red, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE CAST(p_partkey * 91 % 1000 AS DOUBLE) / 1000 END AS nir,
 CAST(p_size % 6 AS INTEGER) AS lc0, CAST(p_partkey % 6 AS INTEGER) AS lc1, CAST(p_partkey % 5 AS INTEGER) AS zone FROM part"""


def raster(spark: SparkSession, d: str) -> DataFrame:
    """r, c, z, red, nir, lc0, lc1, zone: 40 columns wide, a cell for each part; null where there is no data."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        F.floor(k / 40).cast("int").alias("r"), (k % 40).cast("int").alias("c"), (F.col("p_size").cast("double") + ((k * 31) % 97).cast("double") / 10).alias("z"),
        F.when(k % 17 != 0, (k * 37 % 1000).cast("double") / 1000).alias("red"), F.when(k % 19 != 0, (k * 91 % 1000).cast("double") / 1000).alias("nir"),
        (F.col("p_size") % 6).cast("int").alias("lc0"), (k % 6).cast("int").alias("lc1"), (k % 5).cast("int").alias("zone"),
    )


SQL["g_series"] = "SELECT o_orderpriority AS sid, CAST(EXTRACT(YEAR FROM o_orderdate) * 12 + EXTRACT(MONTH FROM o_orderdate) AS INTEGER) AS t, SUM(CAST(FLOOR(o_totalprice) AS DOUBLE)) AS v FROM orders GROUP BY 1, 2"


def series(spark: SparkSession, d: str) -> DataFrame:
    """sid, t, v: monthly sums by priority (whole numbers, so any order of summing gives the same)."""
    t = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("int")
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("sid"), t.alias("t")).agg(F.sum(F.floor("o_totalprice").cast("double")).alias("v"))


SQL["g_readings"] = """SELECT event_id, ts, user_id AS device_id, CASE event_id % 3 WHEN 0 THEN 'temperature' WHEN 1 THEN 'humidity' ELSE 'pm25' END AS sensor_type, value,
 CAST(user_id * 7919 % 36000 AS DOUBLE) / 100 - 180 AS lon, CAST(user_id * 104729 % 17000 AS DOUBLE) / 100 - 85 AS lat FROM events"""


def reading_columns(events: DataFrame) -> DataFrame:
    """The same for a batch or a stream of events."""
    u = F.col("user_id")
    kind = F.when(F.col("event_id") % 3 == 0, "temperature").when(F.col("event_id") % 3 == 1, "humidity").otherwise("pm25")
    return events.select("event_id", "ts", u.alias("device_id"), kind.alias("sensor_type"), "value", ((u * 7919 % 36000).cast("double") / 100 - 180).alias("lon"), ((u * 104729 % 17000).cast("double") / 100 - 85).alias("lat"))


def readings(spark: SparkSession, d: str) -> DataFrame:
    """event_id, ts, device_id, sensor_type, value, lon, lat: a sensor reading for each event."""
    return reading_columns(table(spark, d, "events"))


SQL["g_activities"] = """SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'RawCoal' WHEN 'N' THEN 'NaturalGas' ELSE 'Diesel' END AS fuel_type, l_quantity AS quantity,
 CASE l_linestatus WHEN 'O' THEN 'scope1' WHEN 'F' THEN 'scope2' END AS scope FROM lineitem"""


def activities(spark: SparkSession, d: str) -> DataFrame:
    """l_orderkey, l_linenumber, fuel_type, quantity, scope: a fuel use for each line item."""
    fuel = F.when(F.col("l_returnflag") == "A", "RawCoal").when(F.col("l_returnflag") == "N", "NaturalGas").otherwise("Diesel")
    scope = F.when(F.col("l_linestatus") == "O", "scope1").when(F.col("l_linestatus") == "F", "scope2")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fuel.alias("fuel_type"), F.col("l_quantity").alias("quantity"), scope.alias("scope"))


SQL["g_quakes"] = """SELECT l_orderkey AS eid, 3 + CAST(l_partkey * 13 % 40 AS DOUBLE) / 10 AS mag, CAST(l_orderkey * 7919 % 36000 AS DOUBLE) / 100 - 180 AS lon, CAST(l_orderkey * 104729 % 17000 AS DOUBLE) / 100 - 85 AS lat,
 l_partkey AS pk FROM lineitem WHERE l_linenumber = 1"""


def quakes(spark: SparkSession, d: str) -> DataFrame:
    """eid, mag, lon, lat, pk: an earthquake for each first line item."""
    k = F.col("l_orderkey")
    return table(spark, d, "lineitem").where("l_linenumber = 1").select(k.alias("eid"), (3 + (F.col("l_partkey") * 13 % 40).cast("double") / 10).alias("mag"), ((k * 7919 % 36000).cast("double") / 100 - 180).alias("lon"), ((k * 104729 % 17000).cast("double") / 100 - 85).alias("lat"), F.col("l_partkey").alias("pk"))
