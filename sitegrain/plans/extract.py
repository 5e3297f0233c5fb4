"""The extraction of records: a template's URLs, validated, and healed where they fail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import validation
from ..sources import documents
from ..tables import materialize


def extract(urls: DataFrame, extractor: Callable[[DataFrame, int], DataFrame], attempts: int = 2, limit: int = 0, accept: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Extract records for ``urls`` (template_id, seq, url): records, failed URLs and counts.

    ``limit`` bounds the URLs of each template (0: all). An extractor may have a method
    ``create(urls)`` that returns those of the templates that it could make a scraper for;
    the others are passed over. See :func:`validation.heal_rounds`.
    """
    own = validation.limit_per_template(urls, limit)
    if hasattr(extractor, "create"):
        own = materialize(extractor.create(own), "created")
    done, failed = validation.heal_rounds(own, extractor, attempts, accept, materialize)
    return done, failed, validation.run_counts(own, done, failed)


def results_by_template(done: DataFrame, failed: DataFrame) -> DataFrame:
    """A row for each template that was taken up: template_id and its records as a JSON array, in order.

    A record has url, status and data. Many URLs are better written from the rows of ``done``.
    """
    head = F.to_json(F.struct("url", F.lit("extracted").alias("status")))
    entry = F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"data":'), F.col("data"), F.lit("}"))
    listed = done.select("template_id", "seq", entry.alias("e")).groupBy("template_id").agg(F.array_sort(F.collect_list(F.struct("seq", "e"))).alias("_r"))
    found = listed.select("template_id", F.concat(F.lit("["), F.array_join("_r.e", ","), F.lit("]")).alias("results"))
    none = failed.select("template_id").distinct().join(found, "template_id", "left_anti")
    return found.unionByName(none.withColumn("results", F.lit("[]")))


def result_document(domain: str, done: DataFrame, failed: DataFrame, counts: DataFrame) -> DataFrame:
    """One row, the document as JSON text (column json): domain, total_processed, total_healed, failed,
    results (template_id: its records) and failed_urls (url, template_id), as the format asks."""
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("template_id").alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    each = results_by_template(done, failed).select("template_id", F.concat(quoted, F.lit(":"), "results").alias("e"))
    results = each.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("template_id", "e"))), lambda x: x["e"]), ",").alias("_results"))
    lost = failed.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("template_id", "seq", "url"))), lambda x: F.struct(x["url"].alias("url"), x["template_id"].alias("template_id")))).alias("_lost"))
    head = F.to_json(F.struct(F.lit(domain).alias("domain"), F.col("processed").alias("total_processed"), F.col("healed").alias("total_healed"), "failed"))
    one = counts.crossJoin(results).crossJoin(lost)  # one row each
    return one.select(F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"results":{'), "_results", F.lit('},"failed_urls":'), "_lost", F.lit("}")).alias("json"))


def result_sections(domain: str, done: DataFrame, failed: DataFrame, counts: DataFrame) -> documents.Sections:
    """The result document as sections; see :func:`result_document` for its form."""
    spark = done.sparkSession
    told = F.to_json(F.struct(F.lit(domain).alias("domain"), F.col("processed").alias("total_processed"), F.col("healed").alias("total_healed"), "failed"))
    head = counts.select(F.lit(0).alias("key"), F.concat(F.substr(told, F.lit(1), F.length(told) - 1), F.lit(',"results":{')).alias("line"))
    names = done.select("template_id").union(failed.select("template_id")).distinct().withColumn("order", F.lit(0))
    about = F.to_json(F.struct("url", F.lit("extracted").alias("status")))
    entry = F.concat(F.substr(about, F.lit(1), F.length(about) - 1), F.lit(',"data":'), F.col("data"), F.lit("}"))
    results = documents.grouped_elements(done, names, "template_id", "order", F.struct("seq", "url"), entry)
    lost = documents.elements(failed, F.struct("template_id", "seq", "url"), F.to_json(F.struct("url", "template_id")))
    return [("head", head), ("results", results), ("then", documents.fixed(spark, '},"failed_urls":[')), ("failed_urls", lost), ("end", documents.fixed(spark, "]}"))]
