"""Fetching as a Spark data source: partitions by host, batches of requests as offsets.

Requests are files in a shared folder, one a lane and batch: a lane has whole hosts, or with
``lanes`` above 1 a fixed share of each, in the order of host and key. A task reads one lane and
asks for one address after the other, with a pause between those of one host; so no host sees
more tasks than it has lanes. Answers come from the network, or from an archive that was
written with the same lanes, which a task reads beside its requests, in one pass and with one
record of each in memory.

As a stream, the offset is the number of batches: a query that is started anew reads those that
its checkpoint does not have yet.
"""

from __future__ import annotations

import gzip
import io
import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import urls
from ..operators.frontier import status_of

FORMAT = "sitegrain_fetch"
ANSWERS = "url string, final_url string, status_code int, content_type string, html string, error string, redirect_chain array<string>"
_COLUMNS = [c.split()[0] for c in ANSWERS.split(", ")]
_WRITTEN = "file string, n bigint"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def _lane(host: Column, key: Column, parts: int, lanes: int) -> Column:
    """The file of a key: by its host, and by one of the host's lanes."""
    return F.pmod(F.xxhash64(host, F.pmod(F.xxhash64(key), F.lit(lanes))), F.lit(parts)).cast("int")


def _write_lanes(rows: DataFrame, folder: str, parts: int, ending: str, pack: Callable[[bytes], bytes]) -> None:
    """``rows`` (lane, line), sorted within each lane, as one file a lane; a file gets its name when it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        lane, sink, place, n = None, None, "", 0

        def finish() -> pa.RecordBatch:
            sink.close()
            store.move(place, f"{root}/lane-{lane:05d}{ending}")
            return pa.record_batch([pa.array([f"lane-{lane:05d}{ending}"]), pa.array([n], pa.int64())], names=["file", "n"])

        for batch in batches:
            for own, line in zip(batch.column("lane").to_pylist(), batch.column("line").to_pylist()):
                if own != lane:
                    if sink is not None:
                        yield finish()
                    lane, n, place = own, 0, f"{root}/.{uuid.uuid4().hex}"
                    store.create_dir(root, recursive=True)
                    sink = store.open_output_stream(place)
                sink.write(pack(line.encode() + b"\n"))
                n += 1
        if sink is not None:
            yield finish()

    rows.select("lane", "line").mapInArrow(run, _WRITTEN).write.format("noop").mode("overwrite").save()


def write_requests(wanted: DataFrame, folder: str, parts: int = 64, lanes: int = 1) -> int:
    """Write the distinct URLs of ``wanted`` (url) as the next batch of requests in ``folder``; its number, from 0.

    A URL without a host or a null one is left out. All batches of a folder have the same
    ``parts`` and ``lanes``.
    """
    layout = {"parts": parts, "lanes": lanes}
    store, root = _open(folder)
    if (before := _layout(store, root)) not in (None, layout):
        raise ValueError(f"{folder} was begun with {before}")
    number = len(_batches(store, root))
    keyed = wanted.select("url").where("url is not null").distinct().withColumns({"host": urls.host_of(F.col("url")), "key": urls.frontier_key(F.col("url"))}).where("host <> ''")
    placed = keyed.withColumn("lane", _lane(F.col("host"), F.col("key"), parts, lanes)).repartition(parts, "lane").sortWithinPartitions("lane", "host", "key", "url")
    _write_lanes(placed.withColumn("line", F.to_json(F.struct("url", "host", "key"))), f"{folder.rstrip('/')}/batch-{number:06d}", parts, ".json", lambda line: line)
    store.create_dir(f"{root}/batch-{number:06d}", recursive=True)
    for name, text in (("_layout", json.dumps(layout)), (f"batch-{number:06d}/_DONE", "")):
        with store.open_output_stream(f"{root}/{name}") as out:
            out.write(text.encode())
    return number


def write_archive(answers: DataFrame, folder: str, parts: int = 64, lanes: int = 1) -> None:
    """Write fetch results (columns of ``ANSWERS``) as an archive; of several with one key, the first URL's is found."""
    keyed = answers.withColumns({"host": urls.host_of(F.col("url")), "key": urls.frontier_key(F.col("url"))}).where("host <> ''")
    placed = keyed.withColumn("lane", _lane(F.col("host"), F.col("key"), parts, lanes)).repartition(parts, "lane").sortWithinPartitions("lane", "host", "key", "url")
    _write_lanes(placed.withColumn("line", F.to_json(F.struct("host", "key", *_COLUMNS))), folder, parts, ".json.gz", gzip.compress)
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/_layout") as out:
        out.write(json.dumps({"parts": parts, "lanes": lanes}).encode())


def _layout(store: fs.FileSystem, root: str) -> dict | None:
    if store.get_file_info(f"{root}/_layout").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{root}/_layout") as source:
        return json.loads(source.read())


def _batches(store: fs.FileSystem, root: str) -> list[str]:
    """Finished batches of requests, in order; the first that is not finished ends them."""
    names = sorted(i.path for i in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if i.base_name.startswith("batch-"))
    out = []
    for name in names:
        if store.get_file_info(f"{name}/_DONE").type == fs.FileType.NotFound:
            break
        out.append(name)
    return out


def _lines(store: fs.FileSystem, path: str) -> Iterator[dict]:
    """Records of a file, one at a time; none where there is no file."""
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return
    with store.open_input_file(path) as raw:
        source = gzip.open(raw) if path.endswith(".gz") else io.BufferedReader(raw)
        for line in source:
            yield json.loads(line)


def over_http(timeout: float = 30.0, agent: str = "sitegrain") -> Callable[[str], dict]:
    """A function that fetches a URL over the network: its answer, or an error raised. Other status codes are answers."""
    import socket
    import urllib.error
    import urllib.request

    class Redirects(urllib.request.HTTPRedirectHandler):
        def __init__(self) -> None:
            self.chain: list[str] = []

        def redirect_request(self, req, fp, code, msg, headers, newurl):
            self.chain.append(req.full_url)
            return super().redirect_request(req, fp, code, msg, headers, newurl)

    def fetch(url: str) -> dict:
        followed = Redirects()
        request = urllib.request.Request(url, headers={"User-Agent": agent})
        try:
            answer = urllib.request.build_opener(followed).open(request, timeout=timeout)
        except urllib.error.HTTPError as error:
            answer = error
        except urllib.error.URLError as error:
            if isinstance(error.reason, (TimeoutError, socket.timeout)):
                raise TimeoutError(str(error.reason)) from error
            raise ConnectionError(str(error.reason)) from error
        with answer:
            body = answer.read()
            charset = answer.headers.get_content_charset() or "utf-8"
            try:
                text = body.decode(charset, "replace")
            except LookupError:
                text = body.decode("utf-8", "replace")
            return {"final_url": answer.geturl(), "status_code": answer.status, "content_type": answer.headers.get("Content-Type"), "html": text, "redirect_chain": followed.chain}

    return fetch


class _Archive:
    """Answers of one lane of an archive, met in the order of requests."""

    def __init__(self, folder: str, lane: str):
        store, root = _open(folder)
        self.lines = _lines(store, f"{root}/{lane}.json.gz")
        self.held: dict | None = next(self.lines, None)

    def find(self, request: dict) -> dict:
        """The answer to a request; 404 where there is none. Requests of one key may repeat it."""
        wanted = request["host"], request["key"]
        while self.held is not None and (self.held["host"], self.held["key"]) < wanted:
            self.held = next(self.lines, None)
        if self.held is not None and (self.held["host"], self.held["key"]) == wanted:
            return {c: self.held.get(c) for c in _COLUMNS}
        return {"status_code": 404, "content_type": "text/html"}


@dataclass
class Lane(InputPartition):
    """A file of requests."""

    path: str
    name: str

    def __post_init__(self) -> None:
        super().__init__(self.path)


class _Fetching:
    """What reader and stream share: options, and the fetching of a lane."""

    def __init__(self, options: dict):
        self.folder, self.archive = options["path"], options.get("archive")
        self.pause, self.retries, self.backoff, self.timeout = (float(options.get(k, v)) for k, v in (("pause", 0.1), ("retries", 2), ("backoff", 2.0), ("timeout", 30.0)))
        if self.archive is not None:
            mine, other = (_layout(*_open(f)) for f in (self.folder, self.archive))
            if mine is not None and mine != other:
                raise ValueError(f"requests have the layout {mine}, the archive {other}")

    def batches(self) -> list[str]:
        return _batches(*_open(self.folder))

    def lanes(self, batches: list[str]) -> list[Lane]:
        store = _open(self.folder)[0]
        files = (i for batch in batches for i in store.get_file_info(fs.FileSelector(batch)))
        return [Lane(i.path, i.base_name.removesuffix(".json")) for i in sorted(files, key=lambda i: i.path) if i.base_name.startswith("lane-")]

    def read(self, partition: Lane) -> Iterator[tuple]:
        archive = None if self.archive is None else _Archive(self.archive, partition.name)
        online = None if archive is not None else over_http(self.timeout)
        host, asked = None, False
        for request in _lines(_open(self.folder)[0], partition.path):
            if archive is not None:
                row = archive.find(request)
            else:
                row = self._tried(online, request["url"], asked and request["host"] == host)
            host, asked = request["host"], True
            row = {c: None for c in _COLUMNS} | row | {"url": request["url"]}
            row["final_url"] = row["final_url"] or request["url"]
            yield tuple(row[c] for c in _COLUMNS)

    def _tried(self, fetch: Callable[[str], dict], url: str, again: bool) -> dict:
        """An answer, with errors and answers of 500 and more tried again; a host is left alone between two requests."""
        row: dict = {}
        for attempt in range(int(self.retries) + 1):
            if attempt:
                time.sleep(self.backoff**attempt)
            elif again:
                time.sleep(self.pause)
            try:
                row = fetch(url)
            except TimeoutError:
                row = {"error": "timeout"}
            except Exception as error:  # noqa: BLE001
                row = {"error": str(error) or type(error).__name__}
            if row.get("error") is None and row["status_code"] < 500:
                break
        return row


class _Reader(_Fetching, DataSourceReader):
    def partitions(self) -> list[Lane]:
        return self.lanes(self.batches())


class _Stream(_Fetching, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"batches": 0}

    def latestOffset(self) -> dict:
        return {"batches": len(self.batches())}

    def partitions(self, start: dict, end: dict) -> list[Lane]:
        return self.lanes(self.batches()[start["batches"] : end["batches"]])

    def commit(self, end: dict) -> None:
        pass


class FetchSource(DataSource):
    """Options: path (folder of requests), archive (folder of answers; without it the network), pause, retries, backoff, timeout."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ANSWERS

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> _Stream:
        return _Stream(dict(self.options))


def _judged(answers: DataFrame) -> DataFrame:
    """Answers with crawl_status; what is no page keeps no text."""
    redirected = F.size(F.coalesce("redirect_chain", F.expr("cast(array() as array<string>)"))) > 0
    status = status_of(F.col("status_code"), F.col("content_type"), redirected, F.col("error"))
    return answers.withColumn("crawl_status", status).withColumn("html", F.when(F.col("crawl_status").isin("success", "redirect"), F.col("html")))


def _options(archive: str | None, how: dict) -> dict[str, str]:
    return {k: str(v) for k, v in ({"archive": archive} | how).items() if v is not None}


def fetched(spark: SparkSession, folder: str, archive: str | None = None, **how: float) -> DataFrame:
    """Answers to all requests in ``folder``, with crawl_status; ``how``: pause, retries, backoff, timeout."""
    spark.dataSource.register(FetchSource)
    return _judged(spark.read.format(FORMAT).options(**_options(archive, how)).load(folder))


def fetched_stream(spark: SparkSession, folder: str, archive: str | None = None, **how: float) -> DataFrame:
    """Answers to requests as batches arrive in ``folder``."""
    spark.dataSource.register(FetchSource)
    return _judged(spark.readStream.format(FORMAT).options(**_options(archive, how)).load(folder))
