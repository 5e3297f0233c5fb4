"""Fetching as a data source: archives, a server on this machine, restarts of a stream."""

import threading
import time
from collections import defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from sitegrain.sources import web


@pytest.fixture(scope="module")
def server():
    asked, busy = defaultdict(list), defaultdict(int)

    class Site(BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def do_GET(self):
            host = self.headers["Host"]
            asked[self.path].append(time.time())
            busy[host] += self.path != "/slow"  # which is given up on before it is answered
            busy["most", host] = max(busy["most", host], busy[host])
            try:
                self.answer()
            finally:
                busy[host] -= self.path != "/slow"

        def answer(self):
            name = self.path.strip("/").split("?")[0]
            if name == "slow":
                time.sleep(9)
            if name == "moved":
                self.send_response(301)
                self.send_header("Location", "/page1")
                self.end_headers()
                return
            if name == "cut":
                self.connection.close()
                return
            status = {"gone": 404, "down": 503, "late": 503 if len(asked[self.path]) < 3 else 200}.get(name, 200)
            body = "é".encode("latin-1") if name == "latin" else f"<title>{name}</title>".encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/pdf" if name == "pdf" else "text/html; charset=latin-1" if name == "latin" else "text/html; charset=no-such" if name == "odd" else "text/html")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    running = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_port}", asked, busy
    running.shutdown()


def test_over_the_network(spark, tmp_path, server):
    base, asked, busy = server
    names = ["page1", "page2", "gone", "down", "late", "moved", "pdf", "latin", "odd", "slow", "cut"]
    wanted = spark.createDataFrame([(f"{base}/{n}",) for n in names] + [(f"{base}/page1",), (None,), ("",), ("http://127.0.0.1:9/refused",)], "url string").repartition(5)
    web.write_requests(wanted, str(tmp_path / "requests"), parts=8)
    rows = web.fetched(spark, str(tmp_path / "requests"), pause=0.05, backoff=0.1, timeout=3.0).collect()
    got = {r.url.rpartition("/")[2]: r for r in rows}
    assert len(rows) == len(got) == 12
    assert {n: (r.crawl_status, r.status_code) for n, r in got.items()} == {
        "page1": ("success", 200), "page2": ("success", 200), "gone": ("http_error", 404), "down": ("http_error", 503), "late": ("success", 200), "moved": ("redirect", 200),
        "pdf": ("skipped_content_type", 200), "latin": ("success", 200), "odd": ("success", 200), "slow": ("timeout", None), "cut": ("error", None), "refused": ("error", None),
    }
    assert got["latin"].html == "é" and got["page2"].html == "<title>page2</title>" and got["pdf"].html is None and got["gone"].html is None
    assert got["moved"].final_url == f"{base}/page1" and got["moved"].redirect_chain == [f"{base}/moved"] and got["page1"].final_url == f"{base}/page1"
    assert {n: len(asked[f"/{n}"]) for n in ("gone", "down", "late", "slow", "page2")} == {"gone": 1, "down": 3, "late": 3, "slow": 3, "page2": 1}
    assert max(n for k, n in busy.items() if isinstance(k, tuple)) == 1  # one at a time


def archive_of(spark, folder, lanes=1):
    pages = [(f"https://{h}.org/{i}", None, 200 if i % 5 else 500, "text/html" if i % 7 else "image/png", f"page {h} {i}", None, ["x"] if i % 11 == 0 else None) for h in ("a", "b", "hot") for i in range(60 if h == "hot" else 10)]
    pages += [("https://a.org/1#again", None, 200, "text/html", "later", None, None), ("nohost", None, 200, "text/html", "x", None, None)]
    web.write_archive(spark.createDataFrame(pages, web.ANSWERS).repartition(3), folder, parts=6, lanes=lanes)
    return {u: (s, c, h) for u, _, s, c, h, _, _ in pages}


@pytest.mark.parametrize("lanes", [1, 4])
def test_from_an_archive(spark, tmp_path, lanes):
    held = archive_of(spark, str(tmp_path / "archive"), lanes)
    wanted = [*(u for u in held if u.startswith("http")), "https://a.org/none", "https://nowhere.net/x", "https://A.org/2", "https://a.org/3#frag", "https://hot.org/59/"]
    web.write_requests(spark.createDataFrame([(u,) for u in wanted], "url string"), str(tmp_path / "requests"), parts=6, lanes=lanes)
    found = web.fetched(spark, str(tmp_path / "requests"), str(tmp_path / "archive"))
    rows = {r.url: r for r in found.collect()}
    assert set(rows) == set(wanted) and found.rdd.getNumPartitions() <= 6
    for url, row in rows.items():
        own = {"https://A.org/2": "https://a.org/2", "https://a.org/3#frag": "https://a.org/3", "https://hot.org/59/": "https://hot.org/59", "https://a.org/1#again": "https://a.org/1"}.get(url, url)
        if own in held:
            status, kind, text = held[own]
            fine = status == 200 and kind == "text/html"
            assert (row.status_code, row.html) == (status, text if fine else None), url
            assert row.crawl_status == ("http_error" if status == 500 else "skipped_content_type" if not fine else "redirect" if row.redirect_chain else "success")
        else:
            assert (row.status_code, row.crawl_status, row.html) == (404, "http_error", None)
    if lanes == 4:
        lane = found.withColumn("lane", F.spark_partition_id()).where("url like 'https://hot.org/%'")
        assert lane.select("lane").distinct().count() > 1
    with pytest.raises(Exception, match="layout"):
        web.write_requests(spark.createDataFrame([("https://a.org/1",)], "url string"), str(tmp_path / "other"), parts=5)
        web.fetched(spark, str(tmp_path / "other"), str(tmp_path / "archive")).collect()
    with pytest.raises(ValueError, match="begun"):
        web.write_requests(spark.createDataFrame([("https://a.org/1",)], "url string"), str(tmp_path / "requests"), parts=7)


def test_a_stream_reads_nothing_twice(spark, tmp_path):
    """Batches that arrive between starts are each read once; one that is not whole waits."""
    archive_of(spark, str(tmp_path / "archive"))
    counts = []
    for k, urls in enumerate([["https://a.org/1", "https://b.org/2"], ["https://hot.org/1"], [], ["https://a.org/1", "https://a.org/4", "https://b.org/9"]]):
        if urls:
            assert web.write_requests(spark.createDataFrame([(u,) for u in urls], "url string"), str(tmp_path / "requests"), parts=6) == min(k, 2)
        if k == 2:
            (tmp_path / "requests" / "batch-000002").mkdir()
        stream = web.fetched_stream(spark, str(tmp_path / "requests"), str(tmp_path / "archive"))
        query = stream.select("url", "crawl_status").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(300)
        counts.append(spark.read.parquet(str(tmp_path / "out")).count())
    assert counts == [2, 3, 3, 6]
