"""The wide URL relation: link records parsed, filtered, deduplicated and given versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import segments, urls


def parsed(links: DataFrame) -> DataFrame:
    """Link records (seq, url, source_url, depth, link_text) as the wide relation.

    Adds key, domain, scheme, path, fragment and is_asset. ``seq`` is the order of arrival,
    on which every tie is decided.
    """
    u = F.col("url")
    return links.withColumns({"key": urls.parsed_key(u), "domain": urls.host_of(u), "scheme": urls.scheme_of(u), "path": urls.path_of(u), "fragment": urls.fragment_of(u), "is_asset": urls.is_asset(u)})


def deduplicated(rows: DataFrame, key: str = "key") -> DataFrame:
    """One row for each key: the least depth, then the longest link text, then the first.

    The winner takes the place (``seq``) at which its key was first seen. It is an aggregate,
    so copies of a key are combined before they are shuffled.
    """
    columns = [c for c in rows.columns if c not in (key, "seq")]
    order = F.struct(F.col("depth"), -F.length(F.coalesce("link_text", F.lit(""))), F.col("seq"))
    best = rows.groupBy(key).agg(F.min("seq").alias("seq"), F.min_by(F.struct(*columns), order).alias("_best"))
    return best.select("seq", key, *(F.col(f"_best.{c}").alias(c) for c in columns))


def first_seen(rows: DataFrame, key: str) -> DataFrame:
    """The first row (by ``seq``) of each key."""
    columns = [c for c in rows.columns if c not in (key, "seq")]
    best = rows.groupBy(key).agg(F.min_by(F.struct("seq", *columns), "seq").alias("_best"))
    return best.select(F.col("_best.seq").alias("seq"), key, *(F.col(f"_best.{c}").alias(c) for c in columns))


def canonicalised(rows: DataFrame) -> DataFrame:
    """Rows under their canonical URL (column canonical_url), deduplicated anew, with its path."""
    rows = rows.withColumn("canonical_url", urls.canonical(F.col("key")))
    rows = rows.withColumn("path", urls.path_of(F.col("canonical_url")))
    return deduplicated(rows.drop("key"), "canonical_url")


def with_versions(rows: DataFrame) -> DataFrame:
    """Adds version and version_free_path."""
    found = urls.version_of(F.col("path"))
    return rows.withColumns({"version": found["version"], "version_free_path": found["version_free_path"]})


def ingested(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages and assets of link records; both deduplicated by their parsed form."""
    rows = parsed(links)
    return deduplicated(rows.where(~F.col("is_asset"))), deduplicated(rows.where("is_asset"))


def structural_path() -> Column:
    return F.coalesce("version_free_path", "path")


def segment_table(rows: DataFrame, path: str | Column = "path") -> DataFrame:
    """One row for each path segment: seq, pos from 0, raw and lexical_type."""
    own = urls.segments(F.col(path) if isinstance(path, str) else path)
    return rows.select("seq", F.posexplode(own).alias("pos", "raw")).withColumn("lexical_type", segments.classify(F.col("raw")))


def capped_external(rows: DataFrame, per_domain: int = 50, total: int = 500) -> DataFrame:
    """External links in order of arrival: the first of each domain, then the first overall.

    The first rows of a domain are found per salt before they meet, so that a domain with
    most of the links is no single task's work.
    """
    salt = F.pmod(F.xxhash64("seq"), F.lit(64))
    rows = rows.withColumns({"_domain": F.lower(urls.part(F.col("url"), 3)), "_salt": salt})
    part = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_domain", "_salt").orderBy("seq"))).where(F.col("_n") <= per_domain)
    kept = part.withColumn("_n", F.row_number().over(Window.partitionBy("_domain").orderBy("seq"))).where(F.col("_n") <= per_domain)
    return kept.orderBy("seq").limit(total).drop("_domain", "_salt", "_n")
