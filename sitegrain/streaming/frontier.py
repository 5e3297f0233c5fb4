"""A crawl frontier as a stream: what has been seen is state by key, and timers forget it.

Each frontier key has one value of state. A link whose key has none is let through and sets
it; of several in one batch the first in breadth-first order is. With ``revisit``, a timer of
event time clears the state, so that the address may be crawled anew. State lives in the
query's checkpoint, so a restarted stream goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import urls

FOUND = "key string, url string, source_url string, depth int, seq bigint"
STATE = "depth int, seq bigint, links bigint"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Seen(StatefulProcessor):
    """Lets through the first link of each key; ``revisit_ms`` later in event time its key is forgotten."""

    def __init__(self, revisit_ms: int | None):
        self.revisit_ms = revisit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", STATE)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        self.seen.update((0, -1, 0))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first, links, latest = None, 0, 0
        for row in rows:
            links += 1
            if self.revisit_ms is not None:
                latest = max(latest, row.at_ms)
            if first is None or (row.depth, row.seq) < (first.depth, first.seq):
                first = row
        if self.seen.exists():
            depth, seq, before = self.seen.get()
            self.seen.update((depth, seq, before + links))
            return
        self.seen.update((first.depth, first.seq, links))
        if self.revisit_ms is not None:
            self.handle.registerTimer(max(latest + self.revisit_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield Row(key=key[0], url=first.url, source_url=first.source_url, depth=first.depth, seq=first.seq)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def fresh_links(links: DataFrame, visited: DataFrame | None = None, time: str | None = None, lateness: str = "1 hour", revisit_ms: int | None = None) -> DataFrame:
    """A stream of links (url, source_url, depth, seq) reduced to those whose key is new: key, url, source_url, depth, seq.

    ``visited`` (column key) is what has been crawled before the stream began; it is read at
    the first start alone. With ``time`` and ``revisit_ms``, a key is new again that long
    after the latest link that came with its first. Links without a URL are left out.
    """
    keyed = links.where("url is not null").withColumn("key", urls.frontier_key(F.col("url")))
    keyed = keyed.withColumns({"depth": F.coalesce(F.col("depth").cast("int"), F.lit(0)), "seq": F.col("seq").cast("bigint")})
    columns = ["key", "url", "source_url", "depth", "seq"]
    if revisit_ms is not None:
        if time is None:
            raise ValueError("revisit_ms needs a column of event time")
        keyed = keyed.withWatermark(time, lateness).withColumn("at_ms", F.unix_millis(time))
        columns += ["at_ms", time]
    known = None if visited is None else visited.select("key").where("key is not null").distinct().groupBy("key")
    return keyed.select(*columns).groupBy("key").transformWithState(Seen(revisit_ms), FOUND, "append", "None" if revisit_ms is None else "EventTime", known)


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start in here keep state in RocksDB, which timers need; the session's own setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def take_in(found: DataFrame, path: str, checkpoint: str, timeout: int | None = None) -> None:
    """Run a stream of :func:`fresh_links` over all that has arrived, append it to Parquet files, and stop."""
    with state_on_disk(found.sparkSession):
        query = found.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(timeout)
    if query.isActive:
        query.stop()
        raise TimeoutError(f"the stream did not end within {timeout} s")
