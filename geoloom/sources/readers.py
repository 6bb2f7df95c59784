"""Scans: features, points, sensor lines, factor tables, texts of geometry."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import operator


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """id, kind, coordinates (JSON text), properties of the features of GeoJSON documents: collections, single features and bare geometries."""
    shape = "type string, id string, properties map<string,string>, geometry struct<type:string,coordinates:string>, coordinates string, features array<struct<type:string,id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    docs = spark.read.schema(shape).option("multiLine", True).json(path)
    geometry = "struct<type:string,coordinates:string>"
    one = F.struct(F.col("type"), F.col("id"), F.col("properties"), F.coalesce("geometry", F.struct(F.col("type"), F.col("coordinates")).cast(geometry)).alias("geometry"))
    items = F.when(F.col("features").isNotNull(), F.col("features")).otherwise(F.array(one))
    rows = docs.select(F.explode(items).alias("f"))
    return rows.select(F.col("f.id").alias("id"), F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.coalesce("f.properties", F.create_map().cast("map<string,string>")).alias("properties"))


def rings_of(kind: Column, coordinates: Column) -> Column:
    """Rings (array<array<struct<x,y>>>) of Polygon coordinates, of all parts of a MultiPolygon, null for others."""
    pairs = F.from_json(coordinates, "array<array<array<double>>>")
    many = F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>"))
    rings = F.when(kind == "Polygon", pairs).when(kind == "MultiPolygon", many)
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))


def point_of(kind: Column, coordinates: Column) -> Column:
    p = F.from_json(coordinates, "array<double>")
    return F.when(kind == "Point", F.struct(p[0].alias("x"), p[1].alias("y")))


@operator("source")
def feature_box(features: DataFrame) -> DataFrame:
    """The box of Points, Polygons (outer ring) and MultiPolygons (all rings) of features (kind, coordinates): one row."""
    rings = rings_of(F.col("kind"), F.col("coordinates"))
    shown = F.when(F.col("kind") == "Polygon", F.slice(rings, 1, 1)).otherwise(rings)
    point = point_of(F.col("kind"), F.col("coordinates"))
    points = F.when(point.isNotNull(), F.array(point)).otherwise(F.flatten(shown))
    p = features.select(F.explode(points).alias("p"))
    return p.agg(F.min("p.x").alias("x0"), F.min("p.y").alias("y0"), F.max("p.x").alias("x1"), F.max("p.y").alias("y1"))


def points_csv(spark: SparkSession, path: str) -> DataFrame:
    """lon, lat and the other columns as properties of a CSV with headers in any case (lat, latitude, y; lon, longitude, lng, x)."""
    return points_of(spark.read.option("header", True).csv(path))


def points_of(rows: DataFrame) -> DataFrame:
    by = {c.strip().lower(): c for c in rows.columns}
    lat = next((by[k] for k in ("lat", "latitude", "y") if k in by), None)
    lon = next((by[k] for k in ("lon", "longitude", "lng", "x") if k in by), None)
    if lat is None or lon is None:
        raise ValueError("no columns of latitude and longitude")
    rest = [c for c in rows.columns if c not in (lat, lon)]
    props = F.create_map(*[x for c in rest for x in (F.lit(c), F.col(f"`{c}`"))]) if rest else F.create_map().cast("map<string,string>")
    number = lambda c: F.expr(f"try_cast(trim(`{c}`) as double)")
    return rows.select(number(lon).alias("lon"), number(lat).alias("lat"), props.alias("properties"))


# --- sensor lines


def _degrees(value: Column, hemisphere: Column, digits: int) -> Column:
    raw = F.regexp_extract(value, rf"^(\d{{{digits}}})(\d{{2}}\.?\d*)$", 1)
    minutes = F.regexp_extract(value, rf"^(\d{{{digits}}})(\d{{2}}\.?\d*)$", 2)
    size = F.when(raw != "", raw.cast("double") + minutes.cast("double") / 60.0)
    return F.when(hemisphere.isin("S", "W"), -size).otherwise(size)


@operator("source")
def nmea(lines: DataFrame) -> DataFrame:
    """Fixes of GGA (14 fields or more) and RMC (12 or more) sentences in a column `value`: kind, time, lat, lon, quality, satellites, hdop
    (99.9 if missing), altitude, knots, course, valid.  Other lines give no row; a checksum is cut off."""
    body = F.split(F.substring_index(F.trim("value"), "*", 1), ",")
    rows = lines.where(F.trim("value").startswith("$")).select(body.alias("f"))
    kind = F.substring(F.col("f")[0], 4, 3)
    rows = rows.withColumn("kind", kind).where("(kind = 'GGA' and size(f) >= 14) or (kind = 'RMC' and size(f) >= 12)")
    f = lambda i: F.try_element_at(F.col("f"), F.lit(i + 1))
    num = lambda i: F.when(f(i) != "", F.expr(f"try_cast(f[{i}] as double)"))
    gga = F.col("kind") == "GGA"
    return rows.select(
        "kind", f(1).alias("time"),
        F.when(gga, _degrees(f(2), f(3), 2)).otherwise(_degrees(f(3), f(4), 2)).alias("lat"), F.when(gga, _degrees(f(4), f(5), 3)).otherwise(_degrees(f(5), f(6), 3)).alias("lon"),
        F.when(gga, F.coalesce(num(6), F.lit(0.0)).cast("int")).alias("quality"), F.when(gga, F.coalesce(num(7), F.lit(0.0)).cast("int")).alias("satellites"), F.when(gga, F.coalesce(num(8), F.lit(99.9))).alias("hdop"), F.when(gga, num(9)).alias("altitude"),
        F.when(~gga, num(7)).alias("knots"), F.when(~gga, num(8)).alias("course"), F.when(gga, F.coalesce(num(6), F.lit(0.0)) > 0).otherwise(f(2) == "A").alias("valid"),
    )


#: Ranges a reading must lie in; the last has an open end.
RANGES = {"temperature": (-50.0, 60.0, True), "humidity": (0.0, 100.0, True), "pm25": (0.0, 1000.0, False)}


def reading_fault(sensor: Column, value: Column) -> Column:
    """Why a reading is rejected, or null."""
    out = F.when(value.isNull() | F.isnan(value), "no value")
    for name, (low, high, closed) in RANGES.items():
        outside = (value < low) | ((value > high) if closed else (value >= high))
        out = out.when((sensor == name) & outside, f"{name} out of range")
    return out


def place_fault(lon: Column, lat: Column) -> Column:
    return F.when(lon.isNull() | lat.isNull() | F.isnan(lon) | F.isnan(lat), "no place").when(~lon.between(-180, 180), "longitude out of range").when(~lat.between(-90, 90), "latitude out of range")


def fix_fault(hdop: Column, satellites: Column) -> Column:
    return F.when(hdop > 5.0, "hdop above 5").when(satellites < 4, "fewer than 4 satellites")


def missing_fields(props: Column, names: list[str]) -> Column:
    """The names that a map has no value for."""
    return F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.coalesce(F.try_element_at(props, n), F.lit("")) == "")


@operator("source")
def checked_readings(readings: DataFrame) -> DataFrame:
    """Readings (sensor_type, value, lon, lat) with reject_reason, null for good ones."""
    return readings.withColumn("reject_reason", F.coalesce(place_fault(F.col("lon"), F.col("lat")), reading_fault(F.col("sensor_type"), F.col("value"))))


@operator("source")
def scraped_sites(rows: DataFrame) -> DataFrame:
    """Sites (name, lat, lng as text or numbers) with lon, lat and reject_reason."""
    lat, lon = F.expr("try_cast(lat as double)"), F.expr("try_cast(lng as double)")
    return rows.select("name", lon.alias("lon"), lat.alias("lat"), F.coalesce(F.when(F.coalesce("name", F.lit("")) == "", "no name"), place_fault(lon, lat)).alias("reject_reason"))


# --- geometry as text and bytes


def wkt_point(text: Column) -> Column:
    """A struct (x, y) of POINT(x y); null for anything else."""
    number = r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"
    part = lambda i: F.regexp_extract(text, rf"^POINT\({number}\s+{number}\)$", i)
    return F.when(part(1) != "", F.struct(part(1).cast("double").alias("x"), part(2).cast("double").alias("y")))


@operator("source")
def wkb_points(points: DataFrame) -> DataFrame:
    """Points (x, y) with wkb, 21 bytes little-endian."""
    from pyspark.sql import types as T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [None if x is None or y is None else struct.pack("<BIdd", 1, 1, x, y) for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.binary())], [*b.schema.names, "wkb"])

    return points.mapInArrow(run, T.StructType([*points.schema.fields, T.StructField("wkb", T.BinaryType())]))


@operator("source")
def wkb_boxes(rows: DataFrame) -> DataFrame:
    """Rows (wkb) with x, y of Points in either byte order; null for other geometries."""
    from pyspark.sql import types as T

    def one(w: bytes | None) -> tuple[float, float] | None:
        if w is None or len(w) < 21:
            return None
        order = "<" if w[0] == 1 else ">"
        kind, x, y = struct.unpack(order + "Idd", w[1:21])
        return (x, y) if kind == 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(w) for w in b.column("wkb").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g and g[0] for g in got], pa.float64()), pa.array([g and g[1] for g in got], pa.float64())], [*b.schema.names, "x", "y"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


# --- factor tables

GASES = ["co2", "ch4", "n2o", "hfcs", "pfcs", "sf6", "nf3"]


def factors_csv(spark: SparkSession, path: str) -> DataFrame:
    return factors_of(spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path))


def factors_of(rows: DataFrame) -> DataFrame:
    """category, subcategory, factor_value, unit, source (IPCC_2019), valid_from_year (2000), valid_to_year, region, scope, uncertainty_pct and the gases
    given, whatever the order of the columns."""
    have = {c.strip().lower(): c for c in rows.columns}
    text = lambda n: F.trim(F.col(f"`{have[n]}`")) if n in have else F.lit(None).cast("string")
    word = lambda n: F.when(text(n) != "", text(n))
    number = lambda n: word(n).try_cast("double") if n in have else F.lit(None).cast("double")
    gases = F.array_compact(F.array(*[F.when(number(f"gas_{g}_factor").isNotNull(), F.struct(F.lit(g).alias("gas"), number(f"gas_{g}_factor").alias("factor"))) for g in GASES]))
    return rows.select(
        F.lower(word("category")).alias("category"), F.lower(word("subcategory")).alias("subcategory"), number("factor_value").alias("factor_value"), word("unit").alias("unit"), F.coalesce(word("source"), F.lit("IPCC_2019")).alias("source"),
        F.coalesce(number("valid_from_year").cast("int"), F.lit(2000)).alias("valid_from_year"), number("valid_to_year").cast("int").alias("valid_to_year"), word("region").alias("region"), word("scope").alias("scope"), number("uncertainty_pct").alias("uncertainty_pct"), gases.alias("gases"),
    ).where("category is not null")


# --- guarded SQL

_WORDS = re.compile(r"\b(insert|update|delete|drop|create|alter|truncate|merge|grant|revoke|call|exec|execute|attach|copy|refresh|set|load|export|import|vacuum|analyze)\b", re.I)


def check_select(sql: str, strict: bool = False) -> str:
    """The statement, if it only reads: SELECT or WITH, one statement, no word that changes anything (strict: not even inside another word)."""
    text = sql.strip()
    bare = re.sub(r"'(?:[^']|'')*'|`[^`]*`|\"[^\"]*\"", "''", text)
    if not re.match(r"(select|with)\b", text, re.I):
        raise ValueError("only SELECT and WITH")
    if ";" in bare or "\\" in bare:
        raise ValueError("one statement, without ; or \\")
    bad = re.search(_WORDS.pattern.replace(r"\b", ""), text, re.I) if strict else _WORDS.search(bare)
    if bad:
        raise ValueError(f"{bad.group(0)} is not allowed")
    return text


def query_json(spark: SparkSession, sql: str) -> DataFrame:
    """Rows of a checked statement as JSON texts."""
    df = spark.sql(check_select(sql))
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def box_query(rows: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Rows (lon, lat) in a closed box; the ranges reach the file scan."""
    return rows.where(F.col("lon").between(x0, x1) & F.col("lat").between(y0, y1))


def page(rows: DataFrame, sort: list[str], count: int = 100, start: int = 0, box: tuple[float, float, float, float] | None = None, names: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """A page of features: filtered, sorted ("+name" or "-name"), from `start`, at most 10,000."""
    if box:
        rows = box_query(rows, *box)
    if where is not None:
        rows = rows.where(where)
    keys = [F.col(s.lstrip("+-")).desc() if s.startswith("-") else F.col(s.lstrip("+-")).asc() for s in sort]
    out = rows.orderBy(*keys).offset(start).limit(min(count, 10_000))
    return out.select(*names) if names else out


def property_filter(features: DataFrame, key: str, value: str) -> DataFrame:
    """Features whose property, as text, is the value; a missing one drops the feature."""
    return features.where(F.try_element_at(F.col("properties"), F.lit(key)) == value)
