"""Progress logs as streams. The pipelines do not need this; it watches them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "ts timestamp, event string, duration_s double, done long, total long, error string"


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The events of all logs in a folder, as they are appended by whole files."""
    return spark.readStream.schema(EVENT).json(folder)


def rates(stream: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Events and errors of each name and minute; state older than ``late`` goes."""
    timed = stream.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event").agg(F.count("*").alias("n"), F.count("error").alias("errors"))
