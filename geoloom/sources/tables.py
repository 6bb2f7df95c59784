"""Tables: checked ingestion, lists and counts, other databases through JDBC, object stores, and GeoParquet files."""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import place_fault

# --- ingestion


def checked_places(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features to store, those rejected with reject_reason) of features (id, lon, lat, props): places must lie in the world."""
    checked = features.withColumn("reject_reason", place_fault(F.col("lon"), F.col("lat")))
    return checked.where("reject_reason is null").drop("reject_reason"), checked.where("reject_reason is not null")


def ingest(features: DataFrame, table: str, mode: str = "append") -> int:
    """Store features (id, lon, lat, props) as a table, if all lie in the world; else nothing is stored and ValueError names a fault.
    How many were stored."""
    good, bad = checked_places(features)
    fault = bad.select("reject_reason").first()
    if fault is not None:
        raise ValueError(f"not stored: {fault[0]}")
    good.write.mode(mode).saveAsTable(table)
    return good.count()


def list_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Names of stored tables and views, in order."""
    return sorted(t.name for t in spark.catalog.listTables(database))


def count_rows(spark: SparkSession, table: str) -> int:
    return spark.table(table).count()


# --- other databases


def jdbc_pull(spark: SparkSession, url: str, table: str, split: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A table, or a query in brackets with a name, of another database.  Filters and columns are pushed to it.  split: a number column,
    its bounds and how many connections read between them."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if split:
        column, low, high, parts = split
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def jdbc_push(df: DataFrame, url: str, table: str, mode: str = "append", rows_a_batch: int = 5000, **options: str) -> None:
    """Write rows to a table of another database, in batches, one connection a partition."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", rows_a_batch).options(**options).mode(mode).save()


# --- object stores


def list_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and time of the files under a path of any store that Spark reads; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime")


def get_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and content of the files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content")


def put_objects(rows: DataFrame, path: str) -> None:
    """Store texts (value) under a path, a file for each partition."""
    rows.select("value").write.mode("overwrite").text(path)


# --- GeoParquet


def crs_json(epsg: int) -> dict:
    """The reference system in a file's metadata, by its code."""
    if epsg == 4326:
        return {"type": "GeographicCRS", "name": "WGS 84", "id": {"authority": "EPSG", "code": 4326}}
    return {"type": "ProjectedCRS", "name": f"EPSG:{epsg}", "id": {"authority": "EPSG", "code": epsg}}


def geo_metadata(box: tuple[float, float, float, float] | None, kinds: list[str], epsg: int = 4326, column: str = "geometry") -> str:
    """The `geo` entry of a GeoParquet 1.1 file with WKB geometries."""
    own = {"encoding": "WKB", "geometry_types": sorted(kinds), "crs": crs_json(epsg)}
    if box:
        own["bbox"] = list(box)
    own["covering"] = {"bbox": {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}}
    return json.dumps({"version": "1.1.0", "primary_column": column, "columns": {column: own}}, sort_keys=True)


def geoparquet_files(points: DataFrame, parts: int = 1, rows_a_group: int = 10_000, epsg: int = 4326) -> DataFrame:
    """part, file: points (id, lon, lat, props: JSON) as complete GeoParquet files, one for each of `parts` ranges of longitude.  Rows are
    sorted by place, so that a box meets few row groups."""
    schema = pa.schema([("id", pa.int64()), ("props", pa.string()), ("geometry", pa.binary()), ("bbox", pa.struct([(k, pa.float64()) for k in ("xmin", "ymin", "xmax", "ymax")]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, writer, part, box = io.BytesIO(), None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(4)[0].as_py()
            lon, lat = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            wkb = [struct.pack("<BIdd", 1, 1, x, y) for x, y in zip(lon, lat)]
            boxes = [{"xmin": x, "ymin": y, "xmax": x, "ymax": y} for x, y in zip(lon, lat)]
            mine = (min(lon), min(lat), max(lon), max(lat))
            box = mine if box is None else (min(box[0], mine[0]), min(box[1], mine[1]), max(box[2], mine[2]), max(box[3], mine[3]))
            writer = writer or pq.ParquetWriter(out, schema, compression="zstd")
            writer.write_table(pa.Table.from_arrays([batch.column(0), batch.column(3), pa.array(wkb, pa.binary()), pa.array(boxes, schema.field("bbox").type)], schema=schema), rows_a_group)
        if writer is not None:
            writer.add_key_value_metadata({"geo": geo_metadata(box, ["Point"], epsg)})
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": pa.array([out.getvalue()], pa.binary())})

    rows = points.select(F.col("id").cast("long"), F.col("lon").cast("double"), F.col("lat").cast("double"), F.col("props").cast("string")).where("lon is not null and lat is not null")
    dealt = rows.repartitionByRange(parts, "lon").withColumn("part", F.spark_partition_id()).sortWithinPartitions(F.floor(F.col("lon")), "lat", "lon")
    return dealt.mapInArrow(run, "part int, file binary")


def with_covering(points: DataFrame) -> DataFrame:
    """points (lon, lat) with the covering columns by which row groups are pruned."""
    return points.withColumns({"xmin": F.col("lon"), "ymin": F.col("lat"), "xmax": F.col("lon"), "ymax": F.col("lat")})


def box_scan(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows of files with covering columns that meet a box.  The test is on plain columns, so the reader prunes row groups by it."""
    x0, y0, x1, y1 = box
    return spark.read.parquet(path).where((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))


def group_verdict(least: tuple[Column, Column], greatest: tuple[Column, Column], box: tuple[float, float, float, float]) -> Column:
    """What a row group's least and greatest coordinates tell of a box: intersects, disjoint, or unknown without statistics."""
    x0, y0, x1, y1 = box
    apart = (least[0] > x1) | (greatest[0] < x0) | (least[1] > y1) | (greatest[1] < y0)
    missing = least[0].isNull() | least[1].isNull() | greatest[0].isNull() | greatest[1].isNull()
    return F.when(missing, "unknown").when(apart, "disjoint").otherwise("intersects")
