"""Breadth-first search over pages, a level at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html, urls
from ..tables import materialize
from .relation import capped_external


def status_of(status: Column, content_type: Column, redirected: Column, error: Column) -> Column:
    """What came of a fetch, from its status, content type, history and error."""
    kind = F.trim(F.lower(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    page = kind.startswith("text/html") | kind.startswith("application/xhtml+xml")
    fine = status.between(200, 299)
    return (
        F.when(error == "timeout", "timeout")
        .when(error.isNotNull(), "error")
        .when(fine & ~page, "skipped_content_type")
        .when(fine & redirected, "redirect")
        .when(fine, "success")
        .otherwise("http_error")
    )


def enqueue(pages: DataFrame, root: str) -> DataFrame:
    """Links of ``pages`` that a crawl would record: page_id, pos, href, text, key, internal."""
    found = html.links(pages).where(~urls.should_skip(F.col("href")))
    return found.select("page_id", "source_url", "pos", "href", "text", urls.frontier_key(F.col("href")).alias("key"), urls.is_internal(F.col("href"), root).alias("internal"))


def crawl(seeds: DataFrame, edges: DataFrame, max_depth: int = 3, max_nodes: int | None = None) -> DataFrame:
    """Nodes reached from ``seeds`` (node, seq) over ``edges`` (src, dst, pos), level by level.

    Returns node, depth, parent and seq. A node belongs to its first level; there, to the
    parent that comes first, then to the link that does. ``seq`` orders a level: it is the
    discovering parent's order and link. ``max_nodes`` bounds how many are taken in all, in
    order. Levels are joined by their nodes and checked against all found before; each is
    kept as a table.
    """
    level = materialize(seeds.groupBy("node").agg(F.min("seq").alias("seq")).select("node", F.lit(0).alias("depth"), F.lit(None).cast(seeds.schema["node"].dataType).alias("parent"), F.col("seq").cast("long")))
    found, taken = level, level.count()
    for depth in range(1, max_depth + 1):
        new = level.join(edges, level["node"] == edges["src"]).select(F.col("dst").alias("node"), F.col("node").alias("parent"), F.col("seq").alias("_at"), F.col("pos").cast("long").alias("_pos"))
        first = new.groupBy("node").agg(F.min(F.struct("_at", "_pos", "parent")).alias("_f"))
        fresh = first.join(found.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), F.col("_f.parent").alias("parent"), F.col("_f._at").alias("_at"), F.col("_f._pos").alias("_pos"))
        level = materialize(ordered(fresh))
        n = level.count()
        if max_nodes is not None and taken + n > max_nodes:
            level, n = materialize(level.orderBy("seq").limit(max_nodes - taken)), max_nodes - taken
        if not n:
            break
        found, taken = found.unionByName(level), taken + n
    return found


def ordered(fresh: DataFrame, salts: int = 256) -> DataFrame:
    """``seq`` for a level: rows by the order of their parent and link, counted from 0.

    Rows are ranked within ranges of the parent's order, and ranges get offsets from their
    sizes, so that no window holds a whole level.
    """
    bounds = fresh.agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    bucket = F.floor((F.col("_at") - F.col("_lo")) * salts / (F.col("_hi") - F.col("_lo") + 1)).cast("int")
    placed = fresh.crossJoin(F.broadcast(bounds)).withColumn("_b", bucket)  # with one row
    sizes = placed.groupBy("_b").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).select("_b", "_before")  # a row for each range
    ranked = placed.withColumn("_k", F.row_number().over(Window.partitionBy("_b").orderBy("_at", "_pos", "node")) - 1)
    return ranked.join(F.broadcast(before), "_b").select("node", "depth", "parent", (F.col("_k") + F.col("_before")).cast("long").alias("seq"))


def crawl_pages(pages: DataFrame, seed_url: str, max_depth: int = 3, max_internal: int = 10_000, per_domain: int = 50, max_external: int = 500) -> tuple[DataFrame, DataFrame]:
    """Crawl a table of fetched pages (page_id, url, html) as if it were the network.

    Returns the internal URLs (url, source_url, depth, seq) that were fetched, and the
    external links in order, capped for each domain and in all. A URL is found by its
    frontier key; of pages with one key the first counts.
    """
    root = pages.sparkSession.range(1).select(urls.bare_host(F.lit(seed_url))).first()[0]
    keyed = pages.withColumn("key", urls.frontier_key(F.col("url")))
    first = keyed.groupBy("key").agg(F.min("page_id").alias("page_id"))
    keyed = keyed.join(first, ["key", "page_id"])
    links = materialize(enqueue(keyed, root).join(keyed.select("page_id", F.col("key").alias("src")), "page_id"))
    inside = links.where("internal").select("src", F.col("key").alias("dst"), "pos").join(keyed.select(F.col("key").alias("dst")), "dst", "left_semi")
    seeds = keyed.where(F.col("key") == urls.frontier_key(F.lit(seed_url))).select(F.col("key").alias("node"), F.lit(0).cast("long").alias("seq"))
    nodes = crawl(seeds, inside, max_depth, max_internal)
    at = keyed.select(F.col("key").alias("node"), "url")
    internal = nodes.join(at, "node").join(at.select(F.col("node").alias("parent"), F.col("url").alias("source_url")), "parent", "left")
    outside = links.where("not internal").join(nodes.select(F.col("node").alias("src"), "depth", F.col("seq").alias("_at")), "src")
    outside = outside.select(F.struct("depth", "_at", "pos").alias("seq"), F.col("href").alias("url"), "source_url", (F.col("depth") + 1).alias("depth"), F.col("text").alias("link_text"))
    return internal.select("url", F.coalesce("source_url", "url").alias("source_url"), "depth", "seq"), capped_external(outside, per_domain, max_external)


def next_urls(waiting: DataFrame, done: DataFrame | None = None, most: int = 1) -> DataFrame:
    """The first ``most`` rows of ``waiting`` (key, depth, seq) in breadth-first order that are not in ``done`` (key)."""
    left = waiting if done is None else waiting.join(done.select("key").distinct(), "key", "left_anti")
    return left.orderBy("depth", "seq").limit(most)


def crawl_stats(internal: DataFrame, external: DataFrame) -> DataFrame:
    """One row: URLs inside and outside, distinct external domains, greatest depth."""
    inner = internal.agg(F.count("*").alias("internal_discovered"), F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth_reached"))
    outer = external.agg(F.count("*").alias("external_discovered"), F.count_distinct(F.lower(urls.part(F.col("url"), 3))).alias("external_domains"))
    return inner.crossJoin(outer)  # one row each
