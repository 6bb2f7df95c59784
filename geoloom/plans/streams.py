"""Streaming operators as queries: each runs its stream over the events to the end and returns what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.base import rounded
from ..session import shared_dir
from ..streaming import readings
from . import fixtures as fx
from .catalog import query, r


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files; a table of one file is read through a folder pattern."""
    schema = fx.table(spark, d, "events").schema
    return fx.reading_columns(spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]"))


def _run(df: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    out, at = _folder(spark, name), _folder(spark, name + "-state")
    df.writeStream.outputMode(mode).option("checkpointLocation", at).format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


MINUTE = f"SELECT DATE_TRUNC('minute', ts) AS minute, device_id, COUNT(*) AS n, {r('AVG(value)')} AS mean_value FROM g_readings GROUP BY 1, 2"


@query("minute_means", MINUTE, ("g_readings",))
def minute_means(spark, d):
    out = readings.minute_means(fx.readings(spark, d))
    return out.select(F.col("minute").cast("timestamp_ntz").alias("minute"), "device_id", "n", rounded(F.col("mean_value")).alias("mean_value"))


@query("stream_quality", "SELECT COUNT(*) AS n, SUM(CASE WHEN sensor_type = 'temperature' THEN 1 ELSE 0 END)::BIGINT AS temperatures FROM g_readings WHERE NOT (sensor_type = 'temperature' AND (value < -50 OR value > 60)) AND NOT (sensor_type = 'humidity' AND (value < 0 OR value > 100)) AND NOT (sensor_type = 'pm25' AND (value < 0 OR value >= 1000))", ("g_readings",))
def stream_quality(spark, d):
    good, _ = readings.split(_events(spark, d))
    return _run(good, spark, "quality").agg(F.count("*").alias("n"), F.sum(F.when(F.col("sensor_type") == "temperature", 1).otherwise(0)).alias("temperatures"))


CLOSED = "SELECT COUNT(*) AS minutes, SUM(n)::BIGINT AS readings FROM (SELECT DATE_TRUNC('minute', ts) AS m, device_id, COUNT(*) AS n FROM g_readings GROUP BY 1, 2) WHERE m + INTERVAL 1 MINUTE <= (SELECT MAX(ts) - INTERVAL 1 HOUR FROM g_readings)"


@query("stream_minutes", CLOSED, ("g_readings",))
def stream_minutes(spark, d):
    """Closed minutes only: those the watermark has passed."""
    return _run(readings.minute_means(_events(spark, d)), spark, "minutes").agg(F.count("*").alias("minutes"), F.sum("n").alias("readings"))


@query("stream_state", "SELECT device_id, COUNT(*) AS n FROM g_readings GROUP BY device_id", ("g_readings",))
def stream_state(spark, d):
    """The last state of each device, written by micro-batches; the sink keeps the newest of each."""
    out = _folder(spark, "state")
    at = _folder(spark, "state-at")

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    readings.write_batches(readings.device_state(_events(spark, d).select("device_id", "ts", "value")), sink, at, mode="update").awaitTermination()
    return spark.read.parquet(out).groupBy("device_id").agg(F.max("n").alias("n"))


@query("latest_state", "SELECT user_id AS task_id, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id")
def latest_state(spark, d):
    e = fx.table(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("updated"), F.col("event_type").alias("state"))
    return readings.latest_state(e).select("task_id", "state")


@query("json_messages", f"SELECT COUNT(*) AS n, {r('SUM(value)', 2)} AS total FROM g_readings", ("g_readings",))
def json_messages(spark, d):
    """Readings written as JSON messages and read back."""
    lines = fx.readings(spark, d).select(F.to_json(F.struct(F.col("device_id").cast("string").alias("device_id"), "sensor_type", "value", F.col("lon").alias("lng"), "lat")).alias("value"))
    return readings.json_messages(lines).agg(F.count("*").alias("n"), rounded(F.sum("value"), 2).alias("total"))


@query("csv_replay", "SELECT device_id::VARCHAR AS device_id, COUNT(*) AS n FROM g_readings GROUP BY device_id", ("g_readings",))
def csv_replay(spark, d):
    lines = fx.readings(spark, d).select(F.concat_ws(",", F.col("device_id").cast("string"), "sensor_type", F.col("value").cast("string"), F.col("lon").cast("string"), F.col("lat").cast("string")).alias("value"))
    return readings.csv_messages(lines).groupBy("device_id").agg(F.count("*").alias("n"))


@query("bulk_unpack", "SELECT COUNT(*) AS n, CAST(SUM(event_id) AS BIGINT) AS ids FROM events")
def bulk_unpack(spark, d):
    e = fx.table(spark, d, "events").withColumn("b", F.floor(F.col("event_id") / 500))
    packed = e.groupBy("b").agg(F.collect_list("event_id").alias("times"), F.collect_list("user_id").alias("devices"), F.collect_list("value").alias("values"))
    return readings.unpacked(packed).agg(F.count("*").alias("n"), F.sum("ts").alias("ids"))


