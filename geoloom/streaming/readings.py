"""Sensor streams: ingestion, quality split, minute aggregates with a watermark, state by device.

Event time is the reading's own `ts`.  The same functions take a batch, so a backfill and the stream agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.readers import checked_readings

MESSAGE = "device_id string, sensor_type string, value double, lng double, lat double"
#: How late a reading may come.
LATENESS = "1 hour"


def json_messages(lines: DataFrame) -> DataFrame:
    """Readings of JSON texts (value); without a device or sensor they are named unknown."""
    m = F.from_json("value", MESSAGE)
    return lines.select(m.alias("m")).where("m is not null").select(F.coalesce("m.device_id", F.lit("unknown")).alias("device_id"), F.coalesce("m.sensor_type", F.lit("unknown")).alias("sensor_type"), F.col("m.value").alias("value"), F.col("m.lng").alias("lon"), F.col("m.lat").alias("lat"))


def csv_messages(lines: DataFrame) -> DataFrame:
    """Readings of lines device,sensor,value,lng,lat (value); a header and lines without a number give none."""
    f = F.split("value", ",")
    num = lambda i: F.expr(f"try_cast(trim(get(split(value, ','), {i})) as double)")
    return lines.select(F.trim(F.get(f, F.lit(0))).alias("device_id"), F.trim(F.get(f, F.lit(1))).alias("sensor_type"), num(2).alias("value"), num(3).alias("lon"), num(4).alias("lat")).where("value is not null")


def read_stream(spark: SparkSession, path: str, schema: str, form: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(form).load(path)


def split(readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with reject_reason)."""
    checked = checked_readings(readings)
    return checked.where("reject_reason is null").drop("reject_reason"), checked.where("reject_reason is not null")


def minute_means(readings: DataFrame, lateness: str | None = LATENESS) -> DataFrame:
    """minute, device_id, n, mean value and mean place of each device and minute; in a stream, once the watermark has passed the minute."""
    rows = readings.withColumn("ts", F.col("ts").cast("timestamp"))
    if lateness and readings.isStreaming:
        rows = rows.withWatermark("ts", lateness)
    out = rows.groupBy(F.window("ts", "1 minute").alias("w"), "device_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    return out.select(F.col("w.start").alias("minute"), "device_id", "n", "mean_value", "lon", "lat")


def unpacked(batches: DataFrame) -> DataFrame:
    """Rows of arrays of equal length (times, devices, values), as a bulk insert brings them."""
    return batches.select(F.explode(F.arrays_zip("times", "devices", "values")).alias("x")).select(F.col("x.times").alias("ts"), F.col("x.devices").alias("device_id"), F.col("x.values").alias("value"))


def latest_state(tasks: DataFrame) -> DataFrame:
    """The last state of each task (task_id, updated, state)."""
    return tasks.groupBy("task_id").agg(F.max_by("state", "updated").alias("state"), F.max("updated").alias("updated"))


def device_state(readings: DataFrame, keep: float = 0.9) -> DataFrame:
    """A smoothed value and count for each device, kept between batches: device_id, n, smooth."""

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, smooth = state.get if state.exists else (0, 0.0)
        for f in frames:
            for v in f.sort_values("ts")["value"]:
                smooth = float(v) if n == 0 else keep * smooth + (1 - keep) * float(v)
                n += 1
        state.update((n, smooth))
        yield pd.DataFrame({"device_id": [key[0]], "n": [n], "smooth": [smooth]})

    return readings.groupBy("device_id").applyInPandasWithState(step, "device_id long, n long, smooth double", "n long, smooth double", "update", GroupStateTimeout.NoTimeout)


def write_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, mode: str = "append"):
    """Run a sink for each micro-batch; without `every`, take what there is and end."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
