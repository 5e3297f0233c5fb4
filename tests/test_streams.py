"""The frontier as a stream: restarts, what was crawled before, timers; against the batch rule."""

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from sitegrain.functions import urls
from sitegrain.operators import relation
from sitegrain.streaming import frontier

SCHEMA = "url string, source_url string, depth int, seq long, at timestamp"
BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)


def arrive(folder, name, rows):
    lines = [json.dumps({"url": u, "source_url": "s", "depth": d, "seq": q, "at": (BEGIN + timedelta(minutes=m)).isoformat()}) for u, d, q, m in rows]
    (folder / f".{name}").write_text("\n".join(lines))
    (folder / f".{name}").rename(folder / name)  # whole at once


def test_restarts_and_visited(spark, tmp_path):
    """Three arrivals with a restart before each: the result is that of one batch over all."""
    folder = tmp_path / "in"
    folder.mkdir()
    visited = spark.createDataFrame([("https://h.org/old",), (None,), ("https://h.org/old",)], "key string")
    arrivals = [
        [("https://h.org/a", 2, 5, 0), ("https://h.org/a/", 1, 9, 0), ("https://h.org/old", 0, 1, 0), (None, 0, 2, 0), ("https://H.org/b#x", 1, 3, 0), ("https://h.org/b", 1, 4, 0)],
        [("https://h.org/a", 0, 20, 1), ("https://h.org/c", 3, 21, 1)],
        [("https://h.org/c", 0, 30, 2), ("https://h.org/d", 0, 31, 2), ("https://h.org/old#y", 0, 32, 2)],
    ]
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    counts = []
    for k, rows in enumerate(arrivals):
        arrive(folder, f"{k}.json", rows)
        stream = spark.readStream.schema(SCHEMA).json(str(folder))
        frontier.take_in(frontier.fresh_links(stream, visited), str(tmp_path / "out"), str(tmp_path / "state"), 300)
        counts.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert counts == [2, 3, 4] and spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    got = {r.key: (r.depth, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"https://h.org/a": (1, 9), "https://h.org/b": (1, 3), "https://h.org/c": (3, 21), "https://h.org/d": (0, 31)}
    rows = spark.createDataFrame([r for part in arrivals for r in part], "url string, depth int, seq long, at int").where("url is not null")
    keyed = rows.withColumn("key", urls.frontier_key(F.col("url"))).join(visited.where("key is not null").distinct(), "key", "left_anti")
    assert {r.key for r in relation.first_seen(keyed, "key").collect()} == set(got)


def test_timers_forget(spark, tmp_path):
    """A key is new again once its time has passed by the watermark, also over a restart."""
    folder = tmp_path / "in"
    folder.mkdir()
    seen = []
    for k, rows in enumerate([[("https://h.org/a", 0, 1, 0), ("https://h.org/b", 0, 2, 50)], [("https://h.org/a", 0, 3, 55)], [("https://h.org/z", 0, 4, 300)], [("https://h.org/a", 0, 5, 301), ("https://h.org/b", 0, 6, 302)], [("https://h.org/b", 0, 7, 303)]]):
        arrive(folder, f"{k}.json", rows)
        stream = spark.readStream.schema(SCHEMA).json(str(folder))
        fresh = frontier.fresh_links(stream, None, "at", "10 minutes", revisit_ms=60 * 60_000)
        frontier.take_in(fresh, str(tmp_path / "out"), str(tmp_path / "state"), 300)
        seen.append(sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert seen == [[1, 2], [1, 2], [1, 2, 4], [1, 2, 4, 5, 6], [1, 2, 4, 5, 6]]
