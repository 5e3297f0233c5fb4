"""Where pages come from: a table of fetched pages, or a function that fetches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..operators.frontier import status_of

FETCHED = "url string, final_url string, status_code int, content_type string, html string, error string, redirect_chain array<string>"


def exists(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Those of ``candidates`` (url) whose frontier key a page of ``known`` (url) has."""
    keys = known.select(urls.frontier_key(F.col("url")).alias("_key")).distinct()
    return candidates.withColumn("_key", urls.frontier_key(F.col("url"))).join(keys, "_key", "left_semi").drop("_key")


def from_table(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """Fetch results for ``wanted`` (url) out of ``pages`` (page_id, url, html); offline."""
    key = urls.frontier_key(F.col("url"))
    keyed = pages.select(key.alias("_key"), F.col("page_id"), F.col("url").alias("final_url"), "html")
    first = keyed.groupBy("_key").agg(F.min("page_id").alias("page_id"))
    found = wanted.withColumn("_key", key).join(keyed.join(first, ["_key", "page_id"]), "_key", "left").drop("_key", "page_id")
    hit = F.col("final_url").isNotNull()
    found = found.withColumns({"status_code": F.when(hit, 200).otherwise(404), "content_type": F.when(hit, "text/html"), "error": F.lit(None).cast("string")})
    return found.withColumn("crawl_status", crawl_status())


def site_files(sites: DataFrame, known: DataFrame) -> DataFrame:
    """``sites`` (root_url) with has_robots_txt, has_objects_inv, has_sitemap and has_search_index.

    A file is there if ``known`` (url) has it: the first three at the host's root, the last one
    below the root URL.
    """
    base = F.concat(F.lower(urls.part(F.col("root_url"), 1)), F.lit("://"), urls.part(F.col("root_url"), 3), F.lit("/"))
    below = F.concat(F.regexp_replace("root_url", "/+$", ""), F.lit("/"))
    files = {"has_robots_txt": F.concat(base, F.lit("robots.txt")), "has_objects_inv": F.concat(base, F.lit("objects.inv")), "has_sitemap": F.concat(base, F.lit("sitemap.xml")), "has_search_index": F.concat(below, F.lit("search/search_index.json"))}
    listed = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), url.alias("url")) for name, url in files.items())))
    asked = sites.select("root_url").distinct().select("root_url", listed.alias("f")).select("root_url", "f.name", "f.url")
    found = exists(asked, known).groupBy("root_url").agg(F.collect_set("name").alias("_found"))  # four names at most
    return sites.join(found, "root_url", "left").select(*sites.columns, *(F.coalesce(F.array_contains("_found", name), F.lit(False)).alias(name) for name in files))


def crawl_status() -> Column:
    return status_of(F.col("status_code"), F.col("content_type"), F.lit(False), F.col("error"))


def from_function(wanted: DataFrame, fetch: Callable[[str], dict], retries: int = 2, backoff: float = 2.0, pause: float = 0.1) -> DataFrame:
    """Fetch results by ``fetch(url)``, run on executors one URL after another in a partition.

    ``fetch`` returns the columns of ``FETCHED``, or raises TimeoutError or another error.
    Errors and answers of 500 and more are tried again after backoff ** attempt seconds.
    """
    columns = [c.split()[0] for c in FETCHED.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        for frame in frames:
            rows = []
            for url in frame["url"]:
                for attempt in range(retries + 1):
                    time.sleep(pause if not attempt else backoff**attempt)
                    try:
                        row = {c: None for c in columns} | fetch(url) | {"url": url}
                    except TimeoutError:
                        row = {c: None for c in columns} | {"url": url, "error": "timeout"}
                    except Exception as e:  # noqa: BLE001
                        row = {c: None for c in columns} | {"url": url, "error": str(e)}
                    if row["error"] is None and (row["status_code"] or 0) < 500:
                        break
                row["final_url"] = row["final_url"] or url
                rows.append(row)
            yield pd.DataFrame(rows, columns=columns)

    found = wanted.select("url").mapInPandas(run, FETCHED)
    redirected = F.size(F.coalesce("redirect_chain", F.expr("cast(array() as array<string>)"))) > 0
    return found.withColumn("crawl_status", status_of(F.col("status_code"), F.col("content_type"), redirected, F.col("error")))


UNLOCKED = "url string, html string, requests int, successful int, failed int, credits int"


def through_service(wanted: DataFrame, post: Callable[[str], tuple[int, str]], retries: int = 2, per_minute: int = 300, unit: float = 1.0) -> DataFrame:
    """Pages by way of a paid service: url, html (null where it failed) and counts of each URL.

    ``post(url)`` returns status and body, or raises TimeoutError, ConnectionError or another
    error. A full answer costs a credit. 429 is tried again after 5 * 2 ** attempt units (of a
    second), 502 to 504 after 2 ** attempt, a lost connection after 2, a timeout at once; all
    else fails. Tasks share the rate among them, as far as they run at one time.
    """
    tasks = wanted.sparkSession.sparkContext.defaultParallelism
    columns = [c.split()[0] for c in UNLOCKED.split(", ")]

    def one(url: str, sleep: Callable[[float], None]) -> tuple:
        for attempt in range(retries + 1):
            try:
                status, body = post(url)
            except TimeoutError:
                continue
            except ConnectionError:
                if attempt < retries:
                    sleep(2 * unit)
                continue
            except Exception:  # noqa: BLE001
                return url, None, attempt + 1, 0, 1, 0
            if status == 200:
                return url, body, attempt + 1, 1, 0, 1
            if status == 429:
                sleep(5 * 2**attempt * unit)
            elif status in (502, 503, 504):
                sleep(2**attempt * unit)
            else:
                return url, None, attempt + 1, 0, 1, 0
        return url, None, retries + 1, 0, 1, 0

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        first = True
        for frame in frames:
            rows = []
            for url in frame["url"]:
                if not first:
                    time.sleep(60.0 * tasks / per_minute * unit)
                first = False
                rows.append(one(url, time.sleep))
            yield pd.DataFrame(rows, columns=columns)

    return wanted.select("url").mapInPandas(run, UNLOCKED)


def service_counts(fetched: DataFrame) -> DataFrame:
    """One row: total_requests, successful_requests, failed_requests and credits_used of :func:`through_service`."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return fetched.agg(total("requests").alias("total_requests"), total("successful").alias("successful_requests"), total("failed").alias("failed_requests"), total("credits").alias("credits_used"))


def rehomed(fetched: DataFrame, root: str) -> DataFrame:
    """Fetch results with ``inside``: whether the final URL is still within the crawl's domain."""
    return fetched.withColumn("inside", urls.is_internal(F.col("final_url"), root))
