"""A query for each operator, over the whole ``pages`` table unless it says otherwise.

Pages are taken as one crawl: ``seq`` is page_id, and (page_id, pos) orders their links. Where
the pages lack what an operator is for (link tags, files of a site, a graph of links, paths
without a group), the query makes it from them by a rule that its SQL states too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import html, segments, urls
from ..functions.values import GENERATOR_PATHS
from ..operators import coverage, frontier, generator, grouping, relation, templates, validation, visited
from ..sources import documents, fetch, scraper, web
from ..tables import fresh_dir, materialize
from ..streaming import frontier as stream_frontier
from . import classify, extract

#: Domain that stands for the crawled site, and templates that stand for its sections.
ROOT = "example.com"
FIXED_TEMPLATES = (("t1", "/<slug>/<integer>"), ("t2", "/en/<integer>"), ("t3", "/fr/<version>"), ("t4", "/<literal>"), ("t5", "/de/..."), ("t6", "/"), ("t7", "/<filename>"))
SAMPLES = (
    "123e4567-e89b-12d3-a456-426614174000", "2024-01-31", "v2", "0.24", "3.14", "123", "deadbeef", "sklearn.linear_model.LogisticRegression", "theme.css", "index.html",
    "LogisticRegression", "linear-model", "user_guide", "plot-1.HTML", "V2", "a.b", "x", "Foo.Bar.md", "1.2.3-beta", "ABCDEF12",
)

#: More links than a page has.
LINKS = 1 << 20

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages; Python gets them in batches of so few bytes, in this session, that its memory does not grow with a task's rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _own_title(title: Column) -> Column:
    """A page's title; a null page has none, as in the SQL."""
    return F.when(F.col("html").isNotNull(), title)


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.links_of_pages(_pages(spark, sf_dir).select("page_id", "url"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all pages as link records of depth 1, in the order of page and place."""
    found = html.links(_pages(spark, sf_dir))
    return found.select((F.col("page_id") * LINKS + F.col("pos")).alias("seq"), F.col("href").alias("url"), "source_url", F.lit(1).alias("depth"), F.col("text").alias("link_text"))


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and their links in one relation; pages come first, under negative numbers."""
    pages = _urls(spark, sf_dir).withColumn("seq", F.col("seq") - F.lit(1 << 62))
    return pages.unionByName(_links(spark, sf_dir))


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(relation.with_versions(relation.canonicalised(relation.ingested(_urls(spark, sf_dir))[0])), "canonical")


def _fixed(spark: SparkSession) -> DataFrame:
    """The fixed templates, ranked by how specific they are."""
    listed = [templates.Template(i, p, "", 0) for i, p in FIXED_TEMPLATES]
    ranked = sorted(listed, key=templates.Template.specificity)
    return templates.as_table(spark, [(t.name, t) for t in ranked])


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(coverage.matches(_canonical(spark, sf_dir), _fixed(spark), F.col("path")), "matches")


def _by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical(spark, sf_dir).withColumn("version_free_path", F.col("path"))


SECTIONS = "CASE seq % 4 WHEN 0 THEN concat('/guide', path) WHEN 1 THEN concat('/api/generated', path) WHEN 2 THEN path ELSE concat('/user_guide/', seq % 7, '.html') END"
#: Some single pages at the root, and some that share their depth with no other.
SCATTERED = f"CASE WHEN seq % 11 = 0 THEN concat('/solo', seq) WHEN seq % 97 = 1 THEN concat('/lone', seq, repeat('/z', CAST(6 + floor(seq / 97) AS INT))) ELSE {SECTIONS} END"


def _sections(spark: SparkSession, sf_dir: str, made: str = SECTIONS) -> DataFrame:
    """Pages whose paths are spread over sections: a guide, an interface, user pages and the rest."""
    return materialize(_canonical(spark, sf_dir).withColumn("path", F.expr(made)).withColumn("version_free_path", F.col("path")), "sections")


def _rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages below one directory, so that all paths have a segment."""
    return _canonical(spark, sf_dir).withColumn("path", F.concat(F.lit("/site"), "path"))


@query
def url_parse(spark, sf_dir):
    u = F.col("url")
    return _urls(spark, sf_dir).select("seq", urls.scheme_of(u).alias("scheme"), urls.host_of(u).alias("host"), urls.path_of(u).alias("path"), urls.sorted_query(urls.part(u, 5)).alias("query"), urls.fragment_of(u).alias("fragment"))


@query
def url_build_parsed(spark, sf_dir):
    return relation.parsed(_urls(spark, sf_dir)).select("seq", "key", "domain", "path", "is_asset")


@query
def url_canonicalize(spark, sf_dir):
    return _urls(spark, sf_dir).select("seq", urls.canonical(F.col("url")).alias("canonical_url"))


@query
def url_normalize_frontier(spark, sf_dir):
    return _urls(spark, sf_dir).select("seq", urls.frontier_key(F.col("url")).alias("key"))


@query
def url_split_segments(spark, sf_dir):
    own = urls.segments(urls.path_of(F.col("url")))
    return _urls(spark, sf_dir).select("seq", F.size(own).alias("n"), F.array_join(own, "|").alias("segments"))


@query
def url_is_asset(spark, sf_dir):
    return _all(spark, sf_dir).select("seq", urls.is_asset(F.col("url")).alias("is_asset"))


@query
def url_extract_version(spark, sf_dir):
    found = urls.version_of(urls.path_of(F.col("url")))
    return _urls(spark, sf_dir).select("seq", found["version"].alias("version"), found["version_free_path"].alias("version_free_path"))


@query
def apply_version(spark, sf_dir):
    return _canonical(spark, sf_dir).select("seq", "canonical_url", "version", "version_free_path")


@query
def url_root_domain(spark, sf_dir):
    return _urls(spark, sf_dir).select("seq", urls.bare_host(F.col("url")).alias("root_domain"))


@query
def url_resolve(spark, sf_dir):
    return html.links(_pages(spark, sf_dir)).select("page_id", "pos", "raw", "href")


@query
def url_should_skip(spark, sf_dir):
    return _all(spark, sf_dir).select("seq", urls.should_skip(F.col("url")).alias("skip"))


@query
def url_classify_link(spark, sf_dir):
    return _all(spark, sf_dir).select("seq", F.when(urls.is_internal(F.col("url"), ROOT), "internal").otherwise("external").alias("class"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = relation.segment_table(_all(spark, sf_dir), urls.path_of(F.col("url"))).select("raw")
    return own.union(spark.createDataFrame([(s,) for s in SAMPLES], "raw string"))


@query
def seg_classify(spark, sf_dir):
    return _segments(spark, sf_dir).groupBy("raw", segments.classify(F.col("raw")).alias("kind")).agg(F.count("*").alias("n"))


@query
def seg_is_literal_like(spark, sf_dir):
    return _segments(spark, sf_dir).groupBy("raw", segments.is_literal_like(F.col("raw")).alias("literal")).agg(F.count("*").alias("n"))


@query
def seg_matches_template(spark, sf_dir):
    """All distinct segments against a short list of template segments."""
    kinds = F.array(*(F.lit(f"<{k}>") for k in ("filename", "dotted_path", "literal", "unknown", "slug", "camel_case", "version", "integer", "hash")), F.lit("INDEX.html"))
    samples = _segments(spark, sf_dir).distinct().select("raw", F.explode(kinds).alias("template"))
    return samples.select("raw", "template", segments.fits(F.col("raw"), F.col("template")).alias("fits"))


#: What tag patterns trip over, in front of every page: comments, quoted brackets, scripts, named characters, what is not closed.
AWKWARD = (
    """<!-- <a href="/no">no</a><title>no</title><meta name="generator" content="no"><link rel="canonical" href="/no"> --><a title="x > y" href="/q">E&eacute; &hearts;</a>"""
    """<script>var s = '<a href="/no">no</a>';</script><ul><li><A HREF = '/l?a=1&copy=2' rel="a\tb">one <b> two</b><li><a href=/m>m</li>out</ul><textarea><a href="/no"></textarea>"""
)


def _awkward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).withColumn("html", F.concat(F.lit(AWKWARD), "html"))


@query
def html_links(spark, sf_dir):
    return html.links(_awkward(spark, sf_dir)).select("page_id", "pos", "href", "text", "rel")


@query
def html_link_tags(spark, sf_dir):
    head = F.concat(F.lit('<head><link rel="canonical" href="/c'), "page_id", F.lit("""?a=1&amp;b"><LINK HREF='https://cdn.example.com/s.css' rel=stylesheet ><link rel="x"></head>"""))
    return html.link_tags(_awkward(spark, sf_dir).withColumn("html", F.concat(head, "html")))


@query
def html_metadata(spark, sf_dir):
    rows = _awkward(spark, sf_dir).select("page_id", "html", html.metadata(F.col("html"), F.col("url")).alias("m"))
    return rows.select("page_id", "html", "m.*").withColumn("title", _own_title(F.col("title"))).drop("html")


def _signalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of every page as a homepage; known files are made for some pages' sites."""
    pages = _pages(spark, sf_dir).withColumn("root_url", F.regexp_replace("url", "[?#].*$", ""))
    host, p = F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1), F.col("page_id")
    below = F.concat(F.regexp_replace("root_url", "/+$", ""), F.lit("/search/search_index.json"))
    made = (F.when(p % 3 == 0, F.concat(host, F.lit("/robots.txt"))), F.when(p % 5 == 0, F.concat(host, F.lit("/objects.inv"))), F.when(p % 7 == 0, F.concat(host, F.lit("/sitemap.xml"))), F.when(p % 4 == 0, below))
    known = pages.select(F.explode(F.array(*made)).alias("url")).where("url is not null")
    return fetch.site_files(pages.select("page_id", "root_url", html.signals(F.col("html")).alias("s")), known)


@query
def html_signals(spark, sf_dir):
    return _signalled(spark, sf_dir).select("page_id", "has_robots_txt", "has_objects_inv", "has_sitemap", "has_search_index", "s.*")


@query
def signals_best_guess(spark, sf_dir):
    guess = html.best_guess(F.col("s"), F.col("has_objects_inv"), F.col("has_search_index"))
    return _signalled(spark, sf_dir).select("page_id", guess.alias("g")).select("page_id", "g.tool", "g.confidence")


@query
def html_skeleton(spark, sf_dir):
    return html.with_skeleton(_pages(spark, sf_dir)).select("page_id", "skeleton")


@query
def css_extract(spark, sf_dir):
    return html.with_fields(_pages(spark, sf_dir), list(scraper.FIELDS)).select("page_id", "data")


@query
def extract_record(spark, sf_dir):
    rows = html.with_fields(_pages(spark, sf_dir), list(scraper.FIELDS))
    missing = sum((F.when(F.get_json_object("data", f"$.{f['name']}").isNull(), 1).otherwise(0) for f in scraper.FIELDS), F.lit(0))
    return rows.select("page_id", F.when(F.col("data").isNull(), "failed").otherwise("extracted").alias("status"), missing.alias("fields_missing"))


@query
def filter_assets(spark, sf_dir):
    rows = relation.parsed(_all(spark, sf_dir))
    return rows.groupBy("is_asset").agg(F.count("*").alias("n"))


@query
def filter_skip(spark, sf_dir):
    return _links(spark, sf_dir).where(~urls.should_skip(F.col("url"))).select("seq", "url")


@query
def filter_should_crawl(spark, sf_dir):
    reason = urls.should_crawl_reason(F.col("url"), F.pmod("seq", F.lit(6)), F.col("seq"), ROOT, max_internal=200)
    return _urls(spark, sf_dir).select("seq", reason.alias("reason"))


@query
def project_wide_url(spark, sf_dir):
    return _canonical(spark, sf_dir).select("seq", "canonical_url", "path", F.array_join(urls.segments(F.col("path")), "|").alias("segments"), "domain", "scheme", "depth")


@query
def dedup_ingest(spark, sf_dir):
    return relation.ingested(_all(spark, sf_dir))[0].select("seq", "key", "depth", "link_text")


@query
def dedup_canonical(spark, sf_dir):
    return relation.canonicalised(relation.ingested(_all(spark, sf_dir))[0]).select("seq", "canonical_url", "depth", "link_text")


@query
def dedup_frontier(spark, sf_dir):
    keyed = _all(spark, sf_dir).withColumn("key", urls.frontier_key(F.col("url"))).select("seq", "key", "url")
    return relation.first_seen(keyed, "key")


@query
def dedup_internal(spark, sf_dir):
    keyed = _all(spark, sf_dir).where(urls.is_internal(F.col("url"), ROOT)).withColumn("key", urls.frontier_key(F.col("url"))).select("seq", "key", "url", "depth")
    return relation.first_seen(keyed, "key")


@query
def join_url_lookup(spark, sf_dir):
    links = _links(spark, sf_dir).select("seq", urls.canonical(F.col("source_url")).alias("canonical_url"))
    return links.join(_canonical(spark, sf_dir).select("canonical_url", "domain", "depth"), "canonical_url").groupBy("domain").agg(F.count("*").alias("n"))


@query
def semi_group_members(spark, sf_dir):
    rows = _canonical(spark, sf_dir)
    return rows.join(_matches(spark, sf_dir).where("template_id = 't2'").select("seq"), "seq", "left_semi").select("seq", "canonical_url")


@query
def anti_uncovered(spark, sf_dir):
    return _canonical(spark, sf_dir).join(_matches(spark, sf_dir).select("seq"), "seq", "left_anti").select("seq", "canonical_url")


@query
def anti_unassigned(spark, sf_dir):
    rows = _sections(spark, sf_dir, SCATTERED)
    return rows.join(grouping.discover(rows).select("seq"), "seq", "left_anti").select("seq", "path")


@query
def anti_visited(spark, sf_dir):
    visited = _urls(spark, sf_dir).select(urls.frontier_key(F.col("url")).alias("key"))
    links = _links(spark, sf_dir).select("seq", urls.frontier_key(F.col("url")).alias("key"))
    return links.join(visited, "key", "left_anti").select("seq", "key")


@query
def theta_template_match(spark, sf_dir):
    return _matches(spark, sf_dir)


@query
def first_match(spark, sf_dir):
    return _matches(spark, sf_dir).groupBy("template_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


@query
def join_template_map(spark, sf_dir):
    return _fixed(spark).select("template_id", "pattern").join(_matches(spark, sf_dir), "template_id").select("template_id", "pattern", "canonical_url")


@query
def join_zip_positions(spark, sf_dir):
    """Path segments beside the parts of the template that the page matched, place by place."""
    rows = _matches(spark, sf_dir).join(_canonical(spark, sf_dir).select("seq", "path"), "seq").join(_fixed(spark).select("template_id", "pattern"), "template_id")
    zipped = F.arrays_zip(urls.segments(F.col("path")).alias("raw"), urls.segments(F.col("pattern")).alias("part"))
    rows = rows.select("template_id", F.posexplode(zipped).alias("pos", "z")).select("template_id", "pos", "z.part", segments.classify(F.col("z.raw")).alias("lexical_type"))
    return rows.groupBy("template_id", "pos", "part", "lexical_type").agg(F.count("*").alias("n"))


@query
def trie_metrics(spark, sf_dir):
    return grouping.trie_metrics(_canonical(spark, sf_dir), F.col("path"))


@query
def trie_collect_leaves(spark, sf_dir):
    """Pages below every prefix of any depth, in the order of a walk: own ones, then those of each child."""
    return grouping.leaves_below(*grouping.intervals(_canonical(spark, sf_dir), F.col("path")))


@query
def trie_print(spark, sf_dir):
    """Lines of the printed tree with their places, as text that sorts."""
    lines = grouping.printed_lines(_canonical(spark, sf_dir), F.col("path"))
    return lines.select(F.array_join(F.transform("place", lambda x: F.lpad(x.cast("string"), 3, "0")), ".").alias("place"), "text")


@query
def trie_junctions(spark, sf_dir):
    return grouping.junctions(grouping.trie_metrics(_canonical(spark, sf_dir), F.col("path")))


@query
def trie_anchors(spark, sf_dir):
    return grouping.anchors(grouping.trie_metrics(_canonical(spark, sf_dir), F.col("path"))).select("prefix", "depth", "descendant_count")


@query
def pos_frequencies(spark, sf_dir):
    return grouping.position_frequencies(_rooted(spark, sf_dir), F.col("path"))


@query
def pos_classify(spark, sf_dir):
    return grouping.position_classes(grouping.position_frequencies(_rooted(spark, sf_dir), F.col("path")))


@query
def pos_fingerprint(spark, sf_dir):
    rows = _rooted(spark, sf_dir)
    return grouping.fingerprints(rows, grouping.position_classes(grouping.position_frequencies(rows, F.col("path"))), F.col("path"))


@query
def group_discover(spark, sf_dir):
    return grouping.discover(_sections(spark, sf_dir)).select("seq", "group_prefix")


@query
def group_remaining_by_depth(spark, sf_dir):
    return grouping.discover(_sections(spark, sf_dir, SCATTERED)).where("group_order.late = 1").groupBy("group_prefix").agg(F.count("*").alias("n"))


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sections(spark, sf_dir)
    return materialize(templates.derive(rows, materialize(grouping.discover(rows), "groups")), "derived")


@query
def tpl_derive(spark, sf_dir):
    return _derived(spark, sf_dir).select("group_prefix", "pattern", "fingerprint", "member_count")


@query
def tpl_confidence(spark, sf_dir):
    return _derived(spark, sf_dir).select("group_prefix", F.round("confidence", 9).alias("confidence"))


@query
def tpl_name(spark, sf_dir):
    return _derived(spark, sf_dir).select("group_prefix", "name")


@query
def tpl_versions(spark, sf_dir):
    return _derived(spark, sf_dir).select("group_prefix", F.array_join("versions_covered", "|").alias("versions"))


@query
def topk_examples(spark, sf_dir):
    return _derived(spark, sf_dir).select("group_prefix", F.array_join("example_urls", "|").alias("examples"))


def _finalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.as_table(spark, templates.finalise(_derived(spark, sf_dir)))


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"versions_covered": F.array_join("versions_covered", "|"), "example_urls": F.array_join("example_urls", "|")})


@query
def tpl_merge(spark, sf_dir):
    return _flat(_finalised(spark, sf_dir)).select("pattern", "member_count", "versions_covered", "confidence")


def _sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All pages and links, each by its host, under paths that are spread over sections."""
    made = F.expr("regexp_replace(url, '^([a-z]+://[^/?#]*)', concat('$1', CASE seq % 3 WHEN 0 THEN '/guide' WHEN 1 THEN '/api/generated' ELSE '' END))")
    return classify.classify_sites(_all(spark, sf_dir).withColumn("url", made))


@query
def tpl_merge_sites(spark, sf_dir):
    return _flat(_sites(spark, sf_dir)[0])


@query
def coverage_by_site(spark, sf_dir):
    return _sites(spark, sf_dir)[2]


@query
def tpl_finalize(spark, sf_dir):
    return _flat(_finalised(spark, sf_dir))


@query
def sort_specificity(spark, sf_dir):
    """What templates are ranked by, for each derived one."""
    return _derived(spark, sf_dir).select("group_prefix", templates.specificity_of(F.col("pattern"), F.col("member_count")).alias("s")).select("group_prefix", "s.*")


@query
def sort_output_templates(spark, sf_dir):
    return _flat(_finalised(spark, sf_dir)).orderBy(F.desc("member_count"), "rank").select("template_id", "member_count")


@query
def coverage_report(spark, sf_dir):
    rows = _canonical(spark, sf_dir)
    return coverage.report(rows, _matches(spark, sf_dir), _fixed(spark))


@query
def coverage_template_map(spark, sf_dir):
    return coverage.template_map(_matches(spark, sf_dir), _fixed(spark)).select("template_id", F.size("urls").alias("n"), F.array_join("urls", "|").alias("urls"))


@query
def uncovered_rows(spark, sf_dir):
    return coverage.uncovered(_by_path(spark, sf_dir), _matches(spark, sf_dir))


@query
def topk_uncovered(spark, sf_dir):
    return uncovered_rows(spark, sf_dir).orderBy("seq").limit(50).select("seq", "url")


def _uncovered_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical(spark, sf_dir).join(_matches(spark, sf_dir).select("seq"), "seq", "left_anti").select("seq", "path")


@query
def uncovered_dirs(spark, sf_dir):
    return coverage.top_directories(_uncovered_paths(spark, sf_dir))


@query
def uncovered_prefix2(spark, sf_dir):
    return coverage.top_prefixes(_uncovered_paths(spark, sf_dir))


@query
def external_rollup(spark, sf_dir):
    return coverage.external_domains(_canonical(spark, sf_dir)).select("domain", "first_seq", "url_count", F.array_join("observed_paths", "|").alias("observed_paths"))


@query
def external_classify(spark, sf_dir):
    return coverage.external_domains(_canonical(spark, sf_dir)).select("domain", "classification")


@query
def cap_external_per_domain(spark, sf_dir):
    return relation.capped_external(_urls(spark, sf_dir), per_domain=3, total=100).select("seq", "url")


@query
def cap_internal(spark, sf_dir):
    """The first ten nodes of a crawl, in breadth-first order."""
    return frontier.crawl(_seed(spark), _edges(spark, sf_dir), max_depth=3, max_nodes=10).select("node", "depth")


@query
def limit_per_template(spark, sf_dir):
    return validation.limit_per_template(_matches(spark, sf_dir), 5).select("template_id", "seq")


@query
def sample_per_template(spark, sf_dir):
    rows = _matches(spark, sf_dir).dropDuplicates(["template_id", "canonical_url"])
    return validation.limit_per_template(rows, 3).select("template_id", "canonical_url")


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("/_sources"), "path")).when(F.col("seq") % 3 == 0, F.concat(F.lit("/modules/generated"), "path")).otherwise(F.col("path"))
    return _canonical(spark, sf_dir).select(made.alias("path"))


@query
def generator_path_flags(spark, sf_dir):
    """How many paths have each piece that tells a generator."""
    rows = _generated(spark, sf_dir).select(F.lower("path").alias("p"))
    counts = rows.agg(*(F.count_if(F.col("p").contains(piece)).alias(f"c{i}") for i, (_, piece, _, _) in enumerate(GENERATOR_PATHS)))
    listed = F.array(*(F.struct(F.lit(name).alias("generator"), F.lit(piece).alias("piece"), F.col(f"c{i}").alias("n")) for i, (name, piece, _, _) in enumerate(GENERATOR_PATHS)))
    return counts.select(F.explode(listed).alias("x")).select("x.*")


@query
def generator_detect(spark, sf_dir):
    return generator.from_paths(_generated(spark, sf_dir), F.col("path"))


@query
def crawl_stats(spark, sf_dir):
    inside, outside = classify.split_links(_urls(spark, sf_dir), ROOT)
    return frontier.crawl_stats(inside, outside)


@query
def crawl_enqueue(spark, sf_dir):
    return frontier.enqueue(_pages(spark, sf_dir), ROOT).select("page_id", "pos", "key", "internal")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from each page to 2p + 1, 2p + 2 and p div 3, which has cycles."""
    ids = _pages(spark, sf_dir).select("page_id")
    made = ids.select(F.col("page_id").alias("src"), F.posexplode(F.array(F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 2, F.floor(F.col("page_id") / 3))).alias("pos", "dst"))
    return made.join(ids.select(F.col("page_id").alias("dst")), "dst", "left_semi").select("src", "dst", "pos")


def _seed(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(5).cast("long").alias("node"), F.lit(0).cast("long").alias("seq"))


@query
def crawl_bfs(spark, sf_dir):
    return frontier.crawl(_seed(spark), _edges(spark, sf_dir), max_depth=3).select("node", "depth", F.coalesce("parent", F.lit(-1)).alias("parent"))


def _crawled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A crawl over the HTML of a site made of the pages: each links three others and one outside."""
    p = F.col("page_id")
    link = lambda to: F.concat(F.lit('<p><A class=x href="/p'), to.cast("string"), F.lit('/">go</a> on'))
    made = F.concat("html", F.lit('<!-- <a href="/hidden">x</a> -->'), link(p * 2 + 1), link(p * 2 + 2), link(F.floor(p / 3)), F.lit("<a href='https://out"), p % 7, F.lit(".example/"), p, F.lit("'>out"))
    site = _pages(spark, sf_dir).select("page_id", F.concat(F.lit(f"https://{ROOT}/p"), p).alias("url"), made.alias("html"))
    return frontier.crawl_pages(site, f"https://{ROOT}/p5", max_depth=3, per_domain=2, max_external=9)


@query
def crawl_pages(spark, sf_dir):
    return _crawled(spark, sf_dir)[0].select("url", "depth", "source_url")


@query
def crawl_external(spark, sf_dir):
    return _crawled(spark, sf_dir)[1].select("url", "depth", "source_url", "link_text")


@query
def anti_visited_levels(spark, sf_dir):
    """Links that no page has, by levels of visited keys with Bloom filters: pages of each remainder by 3 are a level."""
    seen = visited.Visited(spark)
    for level in range(3):
        seen.add(_urls(spark, sf_dir).where(F.pmod("seq", F.lit(3)) == level).select(urls.frontier_key(F.col("url")).alias("key")))
    return seen.unseen(_links(spark, sf_dir).select("seq", urls.frontier_key(F.col("url")).alias("key")))


@query
def frontier_stream(spark, sf_dir):
    """Links in three arrivals, each taken in by a stream that is started anew; pages count as crawled before."""
    visited = _urls(spark, sf_dir).select(urls.frontier_key(F.col("url")).alias("key"))
    links, place = materialize(_links(spark, sf_dir), "links"), fresh_dir(spark, "frontier")
    for part in range(3):
        links.where(F.pmod("seq", F.lit(3)) == part).write.mode("append").parquet(f"{place}/in")
        stream = spark.readStream.schema(links.schema).parquet(f"{place}/in")
        stream_frontier.take_in(stream_frontier.fresh_links(stream, visited), f"{place}/out", f"{place}/state")
    return spark.read.parquet(f"{place}/out").select("key")


@query
def get_next(spark, sf_dir):
    """The next twenty links in line that no page with an even number has."""
    waiting = frontier.enqueue(_pages(spark, sf_dir), ROOT).select("key", F.lit(1).alias("depth"), (F.col("page_id") * LINKS + F.col("pos")).alias("seq"))
    pages = _urls(spark, sf_dir).where("seq % 2 = 0").select(urls.frontier_key(F.col("url")).alias("key"))
    return frontier.next_urls(waiting, pages, 20)


@query
def frontier_seed(spark, sf_dir):
    first = _urls(spark, sf_dir).orderBy("seq").limit(1)
    return first.select(urls.frontier_key(F.col("url")).alias("key"), "depth")


@query
def redirect_rehome(spark, sf_dir):
    rows = _urls(spark, sf_dir).select("seq", "url", F.when(F.col("seq") % 4 == 0, F.lit("https://www.example.com:8080/moved")).otherwise(F.col("url")).alias("final_url"))
    return fetch.rehomed(rows, ROOT).select("seq", "inside")


@query
def src_http_fetch(spark, sf_dir):
    wanted = _links(spark, sf_dir).select("url").union(_urls(spark, sf_dir).select("url"))
    return fetch.from_table(wanted, _pages(spark, sf_dir)).groupBy("crawl_status", "status_code").agg(F.count("*").alias("n"))


def _answer(url: str) -> tuple[int, str]:
    """What a made service answers, by the length of the URL."""
    kind = len(url) % 6
    if kind == 4:
        raise TimeoutError
    if kind == 5:
        raise ConnectionError
    return (200, 404, 429, 503)[kind], f"page {url}"


@query
def src_unlocker(spark, sf_dir):
    return fetch.through_service(_urls(spark, sf_dir), _answer, unit=0.0)


@query
def src_http_fetch_source(spark, sf_dir):
    """Distinct URLs of all pages and links, asked for in two batches by the data source; an archive of the pages answers."""
    place, one, some = fresh_dir(spark, "fetch"), F.lit(None).cast("string"), _pages(spark, sf_dir)
    answers = some.select("url", one.alias("final_url"), F.lit(200).alias("status_code"), F.lit("text/html").alias("content_type"), "html", one.alias("error"), F.lit(None).cast("array<string>").alias("redirect_chain"))
    web.write_archive(answers, f"{place}/archive")
    wanted = _all(spark, sf_dir).select("url").distinct()
    for half in (0, 1):
        web.write_requests(wanted.where(F.pmod(F.xxhash64("url"), F.lit(2)) == half), f"{place}/requests")
    return web.fetched(spark, f"{place}/requests", f"{place}/archive").groupBy("crawl_status", "status_code").agg(F.count("*").alias("n"))


@query
def src_http_head(spark, sf_dir):
    known = _urls(spark, sf_dir).select("url")
    wanted = _all(spark, sf_dir).select("seq", F.regexp_replace("url", "#.*$", "").alias("url"))
    return fetch.exists(wanted, known).select("seq")


@query
def fetch_status_classify(spark, sf_dir):
    p = F.col("page_id")
    status = F.get(F.array(*map(F.lit, (200, 301, 404, 500, 204, 403))), (p % 6).cast("int"))
    kind = F.when(p % 5 == 0, "application/pdf").otherwise("Text/HTML; charset=utf-8")
    error = F.when(p % 13 == 0, "timeout").when(p % 17 == 0, "refused")
    return _pages(spark, sf_dir).select("page_id", frontier.status_of(status, kind, p % 3 == 0, error).alias("crawl_status"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records made from pages: a title, a signature, a description and parameters of many shapes."""
    m = html.metadata(F.col("html"), F.col("url"))
    p = F.col("page_id")
    return _pages(spark, sf_dir).select(
        "page_id", _own_title(m["title"]).alias("page_title"), F.when(p % 3 == 0, "f(x)").when(p % 3 == 1, "fit(X, y)").alias("function_signature"),
        F.when(p % 5 == 0, " N/A ").when(p % 5 == 1, "").otherwise(F.col("url")).alias("description"), F.when(p % 2 == 0, "[]").alias("parameters"),
    )


@query
def score_field(spark, sf_dir):
    rows = _records(spark, sf_dir)
    return rows.select("page_id", *(validation.score_field(F.col(c), n).alias(c) for c, n in validation.RECORD_FIELDS.items()))


@query
def validate_record(spark, sf_dir):
    rows = _records(spark, sf_dir)
    return rows.select("page_id", validation.verdict({c: F.col(c) for c in validation.RECORD_FIELDS}).alias("verdict"))


@query
def validate_schema(spark, sf_dir):
    rows = _records(spark, sf_dir)
    data = F.map_filter(F.create_map(*(x for c in validation.RECORD_FIELDS for x in (F.lit(c), F.col(c)))), lambda k, v: v.isNotNull())
    found = validation.validate_schema(data, ["page_title", "description", "parameters"], ["function_signature"])
    return rows.select("page_id", found.alias("v")).select("page_id", "v.passed", F.array_join("v.missing_required", ",").alias("missing"), F.array_join("v.empty_required", ",").alias("empty"), F.size("v.missing_optional").alias("optional"), F.round("v.score", 6).alias("score"))


@query
def template_stats(spark, sf_dir):
    rows = _records(spark, sf_dir).select((F.col("page_id") % 4).cast("string").alias("template_id"), validation.verdict({c: F.col(c) for c in validation.RECORD_FIELDS}).alias("verdict"))
    return validation.template_stats(rows)


class _Scripted:
    """An extractor whose records get better by rounds, by the page's number; template t4 gets no scraper."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._records = _records(spark, sf_dir)

    def create(self, found: DataFrame) -> DataFrame:
        return found.where("template_id <> 't4'")

    def __call__(self, found: DataFrame, turn: int) -> DataFrame:
        p = F.col("page_id")
        description = F.when((p % 2 == 0) & F.lit(turn == 0), "N/A").otherwise(F.concat(F.lit("see "), "url"))
        parameters = F.when((p % 5 != 0) | F.lit(turn == 2), "[]")
        own = self._records.select("page_id", "page_title", "function_signature")
        rows = found.join(own.withColumnRenamed("page_id", "seq").withColumn("page_id", F.col("seq")), "seq")
        return rows.select(*found.columns, F.to_json(F.struct("page_title", "function_signature", description.alias("description"), parameters.alias("parameters"))).alias("data"))


def _extraction(spark: SparkSession, sf_dir: str, accept=None):
    found = _matches(spark, sf_dir).join(_canonical(spark, sf_dir).select("seq", "url"), "seq").select("template_id", "seq", "url")
    return extract.extract(found, _Scripted(spark, sf_dir), accept=accept)


def _signed(df: DataFrame) -> DataFrame:
    """Records on the border are taken if they have a signature."""
    return df.withColumn("accepted", F.get_json_object("data", "$.function_signature").isNotNull())


@query
def heal_loop(spark, sf_dir):
    return _extraction(spark, sf_dir)[0].select("template_id", "url", "round", "verdict")


@query
def heal_selectors(spark, sf_dir):
    """Pages healed from selectors that find nothing to those of documentation pages."""
    found = _matches(spark, sf_dir).join(_canonical(spark, sf_dir).select("seq", "url"), "seq").select("template_id", "seq", "url")
    wrong = [dict(f, css_selector="nothing", fallback_selectors=[]) for f in scraper.FIELDS]
    extractor = scraper.SelectorExtractor(_pages(spark, sf_dir), [wrong, list(scraper.FIELDS)], {"t2": [list(scraper.FIELDS)]})
    return extract.extract(found, extractor, accept=_signed)[0].select("template_id", "url", "round", "verdict")


@query
def llm_escalate(spark, sf_dir):
    return _extraction(spark, sf_dir, _signed)[0].groupBy("verdict", "round").agg(F.count("*").alias("n"))


@query
def phase3_counts(spark, sf_dir):
    return _extraction(spark, sf_dir, _signed)[2]


def _written(sections: documents.Sections, label: str) -> DataFrame:
    """A document's lines, written in sections and read again."""
    spark = sections[0][1].sparkSession
    path = fresh_dir(spark, label)
    documents.write_sections(sections, path)
    return documents.document_lines(spark, path)


@query
def snk_phase3_json(spark, sf_dir):
    return _written(extract.result_sections(ROOT, *_extraction(spark, sf_dir, _signed)), "results")


def _crawl_sections(spark: SparkSession, sf_dir: str) -> documents.Sections:
    inside, outside = classify.split_links(_urls(spark, sf_dir), ROOT)
    return documents.crawl_sections("crawl_1", ROOT, [f"https://{ROOT}/"], {"has_objects_inv": "false"}, inside, relation.capped_external(outside))


@query
def snk_phase1_json(spark, sf_dir):
    return _written(_crawl_sections(spark, sf_dir), "crawl")


@query
def src_phase1_json(spark, sf_dir):
    """A crawl document written in sections, and its inner links read again with their places."""
    path = fresh_dir(spark, "crawl")
    documents.write_sections(_crawl_sections(spark, sf_dir), path)
    return documents.read_links(spark, path, "internal_urls").select("seq", "url", "depth", "link_text")


def _classification(spark: SparkSession, sf_dir: str) -> classify.Classification:
    inside, outside = classify.split_links(_urls(spark, sf_dir), ROOT)
    return classify.classify(inside, outside, {}, use_versions=False)


@query
def snk_phase2_json(spark, sf_dir):
    return _written(_classification(spark, sf_dir).sections("crawl_1", ROOT), "classification")


@query
def src_phase2_json(spark, sf_dir):
    """A classification written in sections, and the URLs of its template map read again."""
    path = fresh_dir(spark, "classification")
    documents.write_sections(_classification(spark, sf_dir).sections("crawl_1", ROOT), path)
    return documents.read_template_urls(spark, path).select("template_id", "url")


@query
def snk_txt_csv(spark, sf_dir):
    rows = _matches(spark, sf_dir).select("seq", F.col("canonical_url").alias("url"))
    return documents.url_sample(rows)


@query
def snk_summary(spark, sf_dir):
    return _classification(spark, sf_dir).summary("crawl_1", ROOT)


@query
def src_scraper_cli(spark, sf_dir):
    p = F.col("page_id")
    out = F.concat(F.lit("run\n"), F.when(p % 3 == 0, F.concat(F.lit('{"id": '), p, F.lit("}"))).when(p % 3 == 1, F.lit("[1, 2]")).otherwise(F.lit("{broken")), F.lit("\ndone"))
    return _pages(spark, sf_dir).select("page_id", scraper.parse_output(out).alias("data"))


@query
def classify_site(spark, sf_dir):
    """The flagship: all pages classified as one site, a row for each template."""
    made = classify.classify(_urls(spark, sf_dir), _links(spark, sf_dir), {}, use_versions=False)
    counts = made.matches.groupBy("template_id").agg(F.count("*").alias("urls"))
    return _flat(made.templates).join(counts, "template_id", "left").select("template_id", "name", "pattern", "member_count", F.coalesce("urls", F.lit(0)).alias("urls"), "confidence")
