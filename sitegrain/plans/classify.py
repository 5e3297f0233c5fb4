"""The classification of a crawl: from link records to templates, coverage and domains."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators import coverage, generator, grouping, relation, templates
from ..sources import documents
from ..tables import materialize

TARGET_COVERAGE = 85.0


@dataclass
class Classification:
    """What a classification found, as tables; ``document`` makes its one-row form."""

    pages: DataFrame
    assets: DataFrame
    templates: DataFrame
    matches: DataFrame
    uncovered: DataFrame
    report: DataFrame
    domains: DataFrame
    generator: tuple[str | None, float]

    def document(self, crawl_id: str, root_domain: str, most_uncovered: int = 50) -> DataFrame:
        """One row in the form of a classification document, for one site's worth of URLs."""
        ranked = F.struct((-F.col("member_count")).alias("m"), "rank", F.struct(*(c for c in self.templates.columns if c != "rank")).alias("t"))
        listed = self.templates.agg(F.transform(F.array_sort(F.collect_list(ranked)), lambda x: x["t"]).alias("templates"))
        left = self.uncovered.orderBy("seq").limit(most_uncovered).agg(F.array_sort(F.collect_list(F.struct("seq", F.struct("url", "reason", "recommendation").alias("u")))).alias("_u"))
        outside = self.domains.agg(F.array_sort(F.collect_list(F.struct("first_seq", F.struct("domain", "url_count", "classification", "observed_paths", F.lit("").alias("note")).alias("d")))).alias("_d"))
        mapped = coverage.template_map(self.matches, self.templates).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("rank", "template_id", "urls"))), lambda x: F.struct(x["template_id"], x["urls"]))).alias("template_map"))
        one = self.report.select(F.struct(*self.report.columns).alias("summary"))
        for part in (listed, left, outside, mapped):
            one = one.crossJoin(part)  # one row each
        name, confidence = self.generator
        return one.select(
            F.lit(crawl_id).alias("crawl_id"), F.lit(root_domain).alias("root_domain"), F.lit(name).cast("string").alias("generator_detected"), F.lit(confidence).alias("generator_confidence"),
            "summary", "templates", F.col("_u.u").alias("uncovered_urls"), F.col("_d.d").alias("external_domains"), "template_map",
        )


    def sections(self, crawl_id: str, root_domain: str, most_uncovered: int = 50) -> documents.Sections:
        """The classification document of one site as sections; no list of it passes through one task."""
        spark = self.templates.sparkSession
        name, confidence = self.generator
        quote = lambda x: json.dumps(x, ensure_ascii=False)
        head = ",".join(f'"{k}":{quote(v)}' for k, v in (("crawl_id", crawl_id), ("root_domain", root_domain), ("generator_detected", name), ("generator_confidence", confidence)))
        first = self.report.select(F.lit(0).alias("key"), F.concat(F.lit("{" + head + ',"summary":'), F.to_json(F.struct(*self.report.columns)), F.lit(',"templates":[')).alias("line"))
        listed = documents.elements(self.templates, F.struct((-F.col("member_count")).alias("m"), "rank"), F.to_json(F.struct(*(c for c in self.templates.columns if c != "rank"))))
        left = documents.elements(self.uncovered.orderBy("seq").limit(most_uncovered), F.col("seq"), F.to_json(F.struct("url", "reason", "recommendation")))
        outside = documents.elements(self.domains, F.struct("first_seq", "domain"), F.to_json(F.struct("domain", "url_count", "classification", "observed_paths", F.lit("").alias("note"))))
        mapped = documents.grouped_elements(self.matches, self.templates, "template_id", "rank", F.struct("seq", "canonical_url"), documents.quoted(F.col("canonical_url")))
        line = lambda text: documents.fixed(spark, text)
        return [
            ("head", first), ("templates", listed), ("then", line('],"uncovered_urls":[')), ("uncovered_urls", left), ("then", line('],"external_domains":[')),
            ("external_domains", outside), ("then", line('],"template_map":{')), ("template_map", mapped), ("end", line("}}")),
        ]

    def summary(self, crawl_id: str, root_domain: str) -> DataFrame:
        """A short report of one site; see :func:`documents.summary_lines`."""
        return documents.summary_lines(crawl_id, root_domain, self.generator, self.report, self.templates, self.uncovered, self.domains)


def classify(internal: DataFrame, external: DataFrame, signals: dict[str, object] | None = None, strict_literals: bool = False, use_versions: bool = True) -> Classification:
    """Classify link records (seq, url, source_url, depth, link_text) of one site.

    Records are parsed, parted from assets, deduplicated by their parsed and then by their
    canonical form; structural groups become templates, and every page is matched with the
    most specific one that fits. A coverage under ``TARGET_COVERAGE`` is logged.
    """
    spark = internal.sparkSession
    pages, assets = relation.ingested(internal)
    pages = materialize(relation.with_versions(relation.canonicalised(pages)))
    outside = materialize(relation.canonicalised(relation.ingested(external)[0]))
    path = F.coalesce("version_free_path", "path") if use_versions else F.col("path")
    rows = pages if use_versions else pages.withColumn("version_free_path", F.col("path"))
    groups = materialize(grouping.discover(rows, path))
    ranked = templates.as_table(spark, templates.finalise(templates.derive(rows, groups, path), strict=strict_literals))
    found = materialize(coverage.matches(rows, ranked, path))
    report = coverage.report(rows, found, ranked)
    share = report.first()
    if share.total_internal_urls and share.coverage_percent < TARGET_COVERAGE:
        logging.getLogger(__name__).warning("coverage is %.2f %%, under %.0f %%", share.coverage_percent, TARGET_COVERAGE)
    return Classification(rows, assets, ranked, found, coverage.uncovered(rows, found), report, coverage.external_domains(outside), generator.detect(pages, signals))


def classify_sites(links: DataFrame, strict_literals: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classify the link records of many sites at once: templates, matches and a report for each site.

    ``links`` are internal link records of any number of sites; a site is a URL's host without
    port and ``www.``. Each is classified as :func:`classify` would do it alone, but all of
    them in the same jobs: prefixes and groups begin with their site, templates are merged
    site by site in tasks, and a URL meets its own site's templates. Templates and matches
    (seq, canonical_url, template_id) have a column ``site``; the report has total_internal_urls,
    covered_urls, template_count and coverage_percent of each.
    """
    pages = materialize(relation.with_versions(relation.canonicalised(relation.ingested(links)[0])).withColumn("site", urls.bare_host(F.col("canonical_url"))))
    groups = materialize(grouping.discover(pages, site=F.col("site")), "groups")
    derived = templates.derive(pages, groups).withColumn("site", F.regexp_extract("group_prefix", "^([^\n]*)\n", 1))
    ranked = materialize(templates.finalise_sites(derived, strict_literals), "templates")
    found = materialize(coverage.matches(pages, ranked).join(pages.select("seq", "site"), "seq"), "matches")
    totals = pages.groupBy("site").agg(F.count("*").alias("total_internal_urls"))
    covered = found.groupBy("site").agg(F.count("*").alias("covered_urls"))
    made = ranked.groupBy("site").agg(F.count("*").alias("template_count"))
    none = F.lit(0).cast("bigint")
    counts = totals.join(covered, "site", "left").join(made, "site", "left").withColumns({c: F.coalesce(c, none) for c in ("covered_urls", "template_count")})
    return ranked, found, counts.withColumn("coverage_percent", F.round(F.col("covered_urls") / F.col("total_internal_urls") * 100, 2))


def classify_file(spark: SparkSession, path: str, **how) -> tuple[str, str, Classification]:
    """Read a crawl document, in sections or in one file, and classify it: crawl_id, root_domain and what was found."""
    head = documents.read_crawl_head(spark, path).select("crawl_id", "root_domain", "signals").first()
    return head.crawl_id, head.root_domain, classify(documents.read_links(spark, path, "internal_urls"), documents.read_links(spark, path, "external_urls"), head.signals, **how)


def classify_document(spark: SparkSession, path: str, **how) -> DataFrame:
    """Read a crawl document and classify it; a row in the form of a classification document."""
    crawl_id, root_domain, made = classify_file(spark, path, **how)
    return made.document(crawl_id, root_domain)


def links_of_pages(pages: DataFrame) -> DataFrame:
    """Link records for a table of pages: each page's own URL, in the order of page_id."""
    return pages.select(F.col("page_id").alias("seq"), "url", F.col("url").alias("source_url"), F.lit(0).alias("depth"), F.lit("").alias("link_text"))


def split_links(links: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Link records inside and outside of a domain."""
    inside = urls.is_internal(F.col("url"), root)
    return links.where(inside), links.where(~inside)
