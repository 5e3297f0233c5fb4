"""Streams of link records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls


def read_links(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of link records from JSON lines that arrive in a folder."""
    return spark.readStream.schema(schema).json(path)


def unseen(links: DataFrame, time: str | None = None, horizon: str = "1 hour") -> DataFrame:
    """Links whose frontier key has not been seen; with ``time``, not within the horizon.

    With an event time, state older than the watermark is dropped, so it stays bounded.
    """
    keyed = links.withColumn("key", urls.frontier_key(F.col("url")))
    if time is None:
        return keyed.dropDuplicates(["key"])
    return keyed.withWatermark(time, horizon).dropDuplicatesWithinWatermark(["key"])


def domain_counts(links: DataFrame, time: str, window: str = "1 minute", lateness: str = "5 minutes") -> DataFrame:
    """Links by host and window of event time."""
    own = links.withColumn("domain", urls.host_of(F.col("url"))).withWatermark(time, lateness)
    return own.groupBy(F.window(time, window), "domain").agg(F.count("*").alias("n"))
