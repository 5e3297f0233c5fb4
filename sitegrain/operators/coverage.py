"""Which template each URL matches, what is left over, and the domains outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import segments, urls
from ..functions.values import DOC_HOST_ENDINGS, DOC_HOST_SIGNALS, DOC_PATH_SIGNALS, DOMAIN_KINDS
from . import heavy, matching

#: Templates are compiled into one tree up to so many; a site has dozens.
MOST_TEMPLATES = 20_000


def matches(rows: DataFrame, templates: DataFrame, path: Column | None = None) -> DataFrame:
    """seq, canonical_url and template_id of each URL's first template in the order of ``rank``.

    All segments must fit one by one; a template without segments takes the root alone. With a
    column ``site`` in both, a URL meets the templates of its own site. Templates are counted:
    up to ``MOST_TEMPLATES`` are one tree that every URL walks, more are joined.
    """
    path = F.coalesce("version_free_path", "path") if path is None else path
    sites = "site" in templates.columns
    own = rows.select("seq", "canonical_url", (F.concat(F.array("site"), urls.segments(path)) if sites else urls.segments(path)).alias("_s"))
    if templates.count() > MOST_TEMPLATES:
        return joined(own, templates.withColumn("pattern", F.concat(F.lit("/"), "site", "pattern")) if sites else templates)
    found = own.select("seq", "canonical_url", matching.first_template(rows.sparkSession, templates, F.col("_s")).alias("template_id"))
    return found.where("template_id is not null")


def joined(own: DataFrame, templates: DataFrame) -> DataFrame:
    """Matches of ``own`` (seq, canonical_url, _s) with any number of templates, by joins.

    A template is found by an equality: on the number of segments (with a wildcard, of those
    before it), and on its first literal segment and that one's place, if it has any. So a URL
    gives a row for each of its segments and for each length of a wildcard's beginning, and
    meets only templates that could fit.
    """
    parts = templates.select("template_id", "rank", urls.segments(F.col("pattern")).alias("_t"))
    wild = F.array_position("_t", "...")
    parts = parts.withColumn("_wild", wild > 0).withColumn("_t", F.when(wild > 0, F.slice("_t", F.lit(1), (wild - 1).cast("int"))).otherwise(F.col("_t")))
    first = F.array_position(F.transform("_t", lambda x: ~x.rlike("^<.*>$")), F.lit(True)).cast("int")
    parts = parts.withColumns({"_n": F.size("_t"), "_at": first, "_word": F.when(first > 0, F.lower(F.element_at("_t", F.greatest(first, F.lit(1))))).otherwise("")})
    lengths = [r._n for r in parts.where("_wild").select("_n").distinct().collect()]  # as many as a pattern has segments
    none = F.array(F.struct(F.lit(0).alias("_at"), F.lit("").alias("_word")))
    words = F.transform("_s", lambda x, i: F.struct((i + 1).alias("_at"), F.lower(x).alias("_word")))
    reach = lambda wild, n: F.struct(F.lit(wild).alias("_wild"), n.alias("_n"))
    ends = F.array(reach(False, F.size("_s")), *(F.when(F.size("_s") >= n, reach(True, F.lit(n))) for n in lengths))
    asked = own.select("*", F.explode(F.filter(ends, lambda x: x.isNotNull())).alias("_e")).select("*", F.explode(F.concat(none, words)).alias("_w"))
    asked = asked.select("seq", "canonical_url", "_s", "_e._wild", "_e._n", "_w._at", "_w._word").where("_at <= _n")
    fit = F.forall(F.arrays_zip("_s", "_t"), lambda x: x["_t"].isNull() | F.coalesce(segments.fits(x["_s"], x["_t"]), F.lit(False)))
    found = asked.join(parts, ["_wild", "_n", "_at", "_word"]).where(fit)
    return found.groupBy("seq", "canonical_url").agg(F.min_by("template_id", "rank").alias("template_id"))


def uncovered(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows without a template: seq, url, reason and recommendation."""
    path = F.coalesce("version_free_path", "path")
    left = rows.join(found.select("seq"), "seq", "left_anti")
    reason = F.concat(F.lit("no_template_match (path="), F.substring(path, 1, 80), F.lit(")"))
    return left.select("seq", F.col("canonical_url").alias("url"), reason.alias("reason"), F.lit("self_heal").alias("recommendation"))


def report(rows: DataFrame, found: DataFrame, templates: DataFrame) -> DataFrame:
    """One row: totals, covered and uncovered URLs, share in percent, templates and URLs per template."""
    total = rows.agg(F.count("*").alias("total_internal_urls"))
    counts = total.crossJoin(found.agg(F.count("*").alias("covered_urls"))).crossJoin(templates.agg(F.count("*").cast("int").alias("template_count")))  # one row each
    covered, n = F.col("covered_urls"), F.col("total_internal_urls")
    share = F.when(n > 0, F.round(covered / n * 100, 2)).otherwise(0.0)
    each = F.when(F.col("template_count") > 0, F.round(covered / F.col("template_count"), 1)).otherwise(0.0)
    return counts.select("total_internal_urls", "covered_urls", (n - covered).alias("uncovered_urls"), share.alias("coverage_percent"), "template_count", each.alias("avg_urls_per_template"))


def template_map(found: DataFrame, templates: DataFrame) -> DataFrame:
    """template_id and its URLs in order; templates without any have an empty list.

    The result holds every URL of a template in one row, as the report's format asks; use
    the rows of :func:`matches` for anything large.
    """
    listed = found.groupBy("template_id").agg(F.array_sort(F.collect_list(F.struct("seq", "canonical_url"))).alias("_u"))
    joined = templates.select("template_id", "rank").join(listed, "template_id", "left")
    return joined.select("template_id", "rank", F.coalesce(F.col("_u.canonical_url"), F.expr("cast(array() as array<string>)")).alias("urls"))


def classify_domain(domain: Column, signalled: Column, only_root: Column, deep: Column) -> Column:
    """A domain's kind from its name and from what its paths showed."""
    host = F.lower(domain)
    kind = F.when(F.lit(False), "")
    for name, hosts in DOMAIN_KINDS.items():
        kind = kind.when(host.isin(*hosts), name)
    named = F.lit(False)
    for ending in DOC_HOST_ENDINGS:
        named = named | host.endswith(ending)
    worded = F.lit(False)
    for word in DOC_HOST_SIGNALS:
        worded = worded | host.contains(word)
    kind = kind.when(named | signalled, "documentation_crossref").when(only_root, "project_homepage")
    return kind.when(worded | deep, "documentation_crossref").otherwise("unknown")


def external_domains(rows: DataFrame, observed: int = 10) -> DataFrame:
    """Domains of ``rows`` (seq, domain, path): first_seq, url_count, classification, observed_paths.

    A domain's first paths are picked per salt before they meet, so that a domain with most
    of the rows is no single task's list.
    """
    signal = F.lit(False)
    for piece in DOC_PATH_SIGNALS:
        signal = signal | F.col("path").contains(piece)
    slashes = F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("seq"), F.lit(64)))
    early = salted.withColumn("_k", F.row_number().over(Window.partitionBy("domain", "_salt").orderBy("seq"))).where(F.col("_k") <= observed)
    paths = early.groupBy("domain").agg(F.slice(F.array_sort(F.collect_list(F.struct("seq", "path"))), 1, observed).alias("_p"))
    whole = rows.groupBy("domain").agg(
        F.min("seq").alias("first_seq"), F.count("*").alias("url_count"), F.bool_or(signal).alias("_doc"),
        F.bool_and(F.col("path").isin("", "/")).alias("_root"), F.bool_or(slashes >= 2).alias("_deep"),
    )
    return whole.join(paths, "domain").select("domain", "first_seq", "url_count", classify_domain(F.col("domain"), F.col("_doc"), F.col("_root"), F.col("_deep")).alias("classification"), F.col("_p.path").alias("observed_paths"))


def top_directories(paths: DataFrame, most: int = 30) -> DataFrame:
    """The commonest directories of ``paths`` (seq, path): directory and n; ties by first seen."""
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    return heavy.top_counts(paths.select("seq", F.when(directory == "", "/").otherwise(directory).alias("directory")), "directory", most)


def top_prefixes(paths: DataFrame, most: int = 30) -> DataFrame:
    """The commonest beginnings of two segments, or ROOT."""
    own = urls.segments(F.col("path"))
    prefix = F.when(F.size(own) == 0, "ROOT").otherwise(F.concat(F.lit("/"), F.array_join(F.slice(own, 1, 2), "/")))
    return heavy.top_counts(paths.select("seq", prefix.alias("prefix")), "prefix", most)
