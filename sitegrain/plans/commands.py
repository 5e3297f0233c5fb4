"""The three steps from file to file: crawl, classify, extract. Files are folders of sections; see :mod:`documents`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, urls
from ..operators import frontier
from ..schema import CLASSIFICATION
from ..sources import documents, fetch, scraper
from . import classify, extract


def site_signals(pages: DataFrame, seed_url: str) -> dict[str, str]:
    """Signals of a site as text: marks of its seed page, files that ``pages`` has, and the best guess."""
    first = pages.where(urls.frontier_key(F.col("url")) == urls.frontier_key(F.lit(seed_url))).orderBy("page_id").limit(1)
    rows = fetch.site_files(first.select(F.lit(seed_url).alias("root_url"), html.signals(F.col("html")).alias("s")), pages)
    guess = html.best_guess(F.col("s"), F.col("has_objects_inv"), F.col("has_search_index"))
    row = rows.select(*(c for c in rows.columns if c not in ("root_url", "s")), "s.*", guess["tool"].alias("detected_tool"), guess["confidence"].alias("detected_confidence")).first()
    told = row.asDict() if row else {}
    return {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in told.items() if v not in (None, "")}


def crawl_to_file(pages: DataFrame, seed_url: str, path: str, crawl_id: str = "crawl", **limits) -> None:
    """Crawl ``pages`` (page_id, url, html) from a seed and write a crawl document; see :func:`frontier.crawl_pages`."""
    inside, outside = frontier.crawl_pages(pages, seed_url, **limits)
    root = pages.sparkSession.range(1).select(urls.bare_host(F.lit(seed_url))).first()[0]
    order = F.struct("depth", "seq")
    documents.write_sections(documents.crawl_sections(crawl_id, root, [seed_url], site_signals(pages, seed_url), inside.withColumn("seq", order).withColumn("http_status", F.lit(200)), outside), path)


def classify_file(spark: SparkSession, path: str, out: str, **how) -> None:
    """Classify a crawl document and write a classification document; see :func:`classify.classify`."""
    crawl_id, root_domain, made = classify.classify_file(spark, path, **how)
    documents.write_sections(made.sections(crawl_id, root_domain), out)


def extract_file(spark: SparkSession, path: str, pages: DataFrame, out: str, extractor: Callable[[DataFrame, int], DataFrame] | None = None, limit: int = 0, attempts: int = 2, accept: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Extract records for a classification document's URLs and write a result document; see :func:`extract.extract`."""
    domain = documents.read_head(spark, path, CLASSIFICATION, "templates").first().root_domain
    found = extract.extract(documents.read_template_urls(spark, path), extractor or scraper.SelectorExtractor(pages), attempts, limit, accept)
    documents.write_sections(extract.result_sections(domain, *found), out)
