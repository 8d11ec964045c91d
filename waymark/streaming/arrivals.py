"""Structured Streaming extensions: windowed counts and a running speed per sequence.

The batch engine has no streams; these take image arrivals or events as they come.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The table ``name`` of ``folder`` as a stream of its files, with ``ts`` as an instant."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum of ``value`` per key and tumbling window; later rows than ``late`` are dropped by the watermark."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), key, "n", "total")


def running_speed(frames: DataFrame) -> DataFrame:
    """Latest speed of each sequence from a stream of ``sequence_id, captured_at, lat, lon``.

    The state of a sequence is its last frame; frames older than that are ignored.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import numpy as np

        last = state.get if state.exists else None
        speed = None
        rows = pd.concat(list(batches)).sort_values("captured_at", kind="stable")
        for at, lat, lon in zip(rows["captured_at"], rows["lat"], rows["lon"]):
            if last is not None and at > last[0]:
                h = np.sin(np.radians(lat - last[1]) / 2) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(last[1])) * np.sin(np.radians(lon - last[2]) / 2) ** 2
                speed = 2 * 6_371_000.0 * np.arcsin(min(1.0, np.sqrt(h))) / ((at - last[0]) / 1000.0)
            if last is None or at > last[0]:
                last = (int(at), float(lat), float(lon))
        state.update(last)
        if speed is not None:
            yield pd.DataFrame({"sequence_id": [key[0]], "captured_at": [last[0]], "speed_ms": [float(speed)]})

    clean = frames.where("sequence_id is not null and captured_at is not null and lat is not null and lon is not null")
    return clean.groupBy("sequence_id").applyInPandasWithState(
        step, "sequence_id string, captured_at long, speed_ms double", "captured_at long, lat double, lon double", "update", GroupStateTimeout.NoTimeout
    )


def run_available(stream: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Process what is there and return the result table written under ``path``.

    In complete mode each batch replaces the table, otherwise batches are appended.
    """
    spark = stream.sparkSession
    out = f"{path}/table"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return spark.read.parquet(out)
