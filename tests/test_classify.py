import json
import random

import pytest
from pyspark.sql import functions as F

from sitegrain.functions.segments import classify as segment_type
from sitegrain.functions import segments, urls
from sitegrain.operators import coverage, grouping, matching, relation, templates
from sitegrain.plans.classify import classify, classify_document, classify_sites

BASE = "https://scikit-learn.org"
API = [f"/stable/modules/generated/sklearn.{x}.html" for x in ("linear_model.LogisticRegression", "ensemble.RandomForestClassifier", "tree.DecisionTreeClassifier", "svm.SVC", "cluster.KMeans")]
PATHS = [*API, "/dev" + API[0][7:], *(f"/stable/user_guide/{x}.html" for x in ("linear_model", "ensemble", "clustering", "svm")),
    "/stable/auto_examples/classification/plot_classifier_comparison.html", "/stable/auto_examples/clustering/plot_kmeans_digits.html", "/stable/install.html", "/stable/index.html",
    "/stable/_static/css/theme.css", "/stable/_static/js/custom.js"]
OUTSIDE = ["https://numpy.org/doc/stable/reference/generated/numpy.array.html", "https://numpy.org/doc/stable/", "https://scipy.org/", "https://matplotlib.org/", "https://pypi.org/project/scikit-learn/"]


@pytest.fixture(scope="module")
def document(spark, tmp_path_factory):
    link = lambda u, d: {"url": u, "source_url": BASE + "/", "depth": d, "link_text": ""}
    crawl = {"crawl_id": "c1", "root_domain": "scikit-learn.org", "root_urls": [BASE], "signals": {"has_objects_inv": True, "static_dir": "_static"}, "internal_urls": [link(BASE + p, 2) for p in PATHS], "external_urls": [link(u, 3) for u in OUTSIDE]}
    path = tmp_path_factory.mktemp("crawl") / "crawl.json"
    path.write_text(json.dumps(crawl, indent=2))
    return classify_document(spark, str(path)).first()


def test_golden_site(document):
    assert (document.generator_detected, document.generator_confidence) == ("sphinx", 0.95)
    assert document.summary.asDict() == {"total_internal_urls": 14, "covered_urls": 10, "uncovered_urls": 4, "coverage_percent": 71.43, "template_count": 2, "avg_urls_per_template": 5.0}
    first, second = document.templates
    assert (first.template_id, first.name, first.pattern, first.fingerprint, first.member_count, first.versions_covered, first.confidence) == ("tpl_001", "module_overview", "/modules/generated/<filename>", "MODULES/GENERATED/filename", 6, ["dev", "stable"], 0.66)
    assert (second.template_id, second.name, second.pattern, second.member_count, second.confidence) == ("tpl_002", "user_guide", "/user_guide/<filename>", 4, 0.57)
    assert first.example_urls == [BASE + p for p in API]
    assert [u.url for u in document.uncovered_urls] == [BASE + p for p in PATHS[10:14]]
    assert document.uncovered_urls[2].reason == "no_template_match (path=/install.html)"
    assert [(d.domain, d.url_count, d.classification) for d in document.external_domains] == [("numpy.org", 2, "documentation_crossref"), ("scipy.org", 1, "project_homepage"), ("matplotlib.org", 1, "project_homepage"), ("pypi.org", 1, "package_index")]
    assert document.external_domains[0].observed_paths == ["/doc/stable/reference/generated/numpy.array.html", "/doc/stable"]
    assert document.template_map["tpl_001"] == [BASE + p for p in PATHS[:6]]


def rows_of(spark, paths):
    rows = [(i, f"https://h.com{p}", p, p, None) for i, p in enumerate(paths)]
    return spark.createDataFrame(rows, "seq long, canonical_url string, path string, version_free_path string, version string")


def brute_groups(paths, kinds):
    """Groups by walking a tree from its root; kinds: the lexical type of each segment."""
    split = [[s for s in p.split("/") if s] for p in paths]
    out, taken = [], set()

    def below(prefix):
        return [i for i, s in enumerate(split) if s[: len(prefix)] == prefix]

    def children(prefix):
        return list(dict.fromkeys(split[i][len(prefix)] for i in below(prefix) if len(split[i]) > len(prefix)))

    def ratio(prefix):
        own = children(prefix)
        return sum(c == c.lower() and "." not in c and c[0].isalpha() and all(x.isalnum() or x in "_-" for x in c) for c in own) / len(own) if own else 0.0

    def order(prefix):  # a node's own URLs, then each child's
        own = [i for i in below(prefix) if len(split[i]) == len(prefix)]
        return own + [i for c in children(prefix) for i in order(prefix + [c])]

    def visit(prefix):
        own = children(prefix)
        if not own:
            return
        named = [c for c in own if kinds[c] in ("literal", "slug") and len(below(prefix + [c])) >= 3]
        like = len(named) >= 2 and all(ratio(prefix + [c]) < 0.5 for c in named) and len({bool(children(prefix + [c])) for c in named}) == 1
        if (len(named) >= 2 and not like) or (len(named) == 1 and len(own) > 1):
            for c in own:
                visit(prefix + [c])
        else:
            members = [i for i in order(prefix) if i not in taken]
            if len(members) >= 3:
                out.append(("/" + "/".join(prefix), sorted(members)))
                taken.update(members)

    visit([])
    rest = [i for i in range(len(paths)) if i not in taken]
    for n in sorted({len(split[i]) for i in rest}):
        members = [i for i in rest if len(split[i]) == n]
        if len(members) >= 3:
            out.append((f"depth_{n}", members))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_groups_are_those_of_a_tree_walk(spark, seed):
    draw = random.Random(seed)
    words = ["a", "guide", "linear-model", "X.html", "12", "v2", "api"]
    paths = list(dict.fromkeys("/" + "/".join(draw.choice(words) for _ in range(draw.randint(0, 4))) for _ in range(draw.randint(3, 60))))
    kinds = {r.w: r.k for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", segment_type(F.col("w")).alias("k")).collect()}
    got = grouping.discover(rows_of(spark, paths)).groupBy("group_prefix", "group_order").agg(F.sort_array(F.collect_list("seq")).alias("m")).orderBy("group_order").collect()
    assert [(r.group_prefix, r.m) for r in got] == brute_groups(paths, kinds)


def test_category_variants_become_one_template(spark):
    rows = rows_of(spark, [f"/auto_examples/{d}/plot_example_{i}.html" for d in ("cluster", "svm", "tree", "text") for i in range(4)])
    found = templates.finalise(templates.derive(rows, grouping.discover(rows)))
    assert len(found) == 1 and "auto_examples" in found[0][1].pattern


def test_empty_and_tiny_sites(spark):
    for paths in ([], ["/a"], ["/a", "/b/c"]):
        rows = rows_of(spark, paths)
        found = templates.finalise(templates.derive(rows, grouping.discover(rows)))
        assert found == []
        table = templates.as_table(spark, found)
        assert coverage.report(rows, coverage.matches(rows, table), table).first().covered_urls == 0


def test_merge_keeps_literals_apart():
    make = lambda f, n: templates.Template(f, "/" + f, f, n)
    assert templates.merge_distance(make("API/slug", 1), make("GUIDE/slug", 1)) is None
    assert templates.merge_distance(make("API/slug", 1), make("API/filename", 1)) == 1
    assert templates.merge_distance(make("USER_GUIDE/x", 1), make("INDEX.HTML/x", 1)) == 1
    assert templates.merge_distance(make("USER_GUIDE/x", 1), make("INDEX.HTML/x", 1), strict=True) is None
    merged = templates.merge([make("API/slug", 1), make("API/filename", 5), make("X/y/z", 2)])
    assert [(t.fingerprint, t.member_count) for t in merged] == [("API/filename", 6), ("X/y/z", 2)]


def _loop(listed, distance, strict):
    """Pairs in greedy order, by comparing each template with all later ones."""
    while True:
        left, out = list(listed), []
        while left:
            a = left.pop(0)
            near = [(d, i) for i, b in enumerate(left) if (d := templates.merge_distance(a, b, strict)) is not None and d <= distance]
            out.append(templates.merge_pair(a, left.pop(min(near)[1])) if near else a)
        if len(out) == len(listed):
            return out
        listed = out


@pytest.mark.parametrize("seed", range(12))
def test_merging_by_keys_is_the_greedy_loop(seed):
    draw = random.Random(seed)
    parts = ["API", "GUIDE", "V2", "USER_GUIDE", "slug", "integer", "filename", "DEEPER", "x"]
    listed = [templates.Template(str(i), str(i), "/".join(draw.choice(parts) for _ in range(draw.randint(1, 4))), draw.randint(1, 9), (str(i % 3),), (f"u{i}",), i / 100) for i in range(draw.choice([5, 40, 150]))]
    for distance in (0, 1, 2):
        for strict in (False, True):
            assert templates.merge(listed, distance, strict) == _loop(listed, distance, strict)


def test_merging_of_many_templates():
    """A hundred thousand groups, among them many that are alike, take seconds."""
    draw = random.Random(0)
    kinds = ["slug", "integer", "filename", "uuid", "version"]
    listed = [templates.Template(str(i), "p", f"{'ABCDEFGH'[i % 8]}X/{draw.choice(kinds)}/N{i % 997}.Q/{draw.choice(kinds)}/DEEPER", 1 + i % 5) for i in range(100_000)]
    merged = templates.merge(listed)
    assert len(merged) < 20_000 and sum(t.member_count for t in merged) == sum(t.member_count for t in listed)


@pytest.mark.parametrize("seed", range(3))
def test_tree_of_templates(spark, seed):
    """Against all templates tried one by one; with enough of them that most edges are shared, and by joins."""
    draw = random.Random(seed)
    words = ["api", "Guide", "x.html", "12", "v2", "a-b", "CamelCase", "a.b.c", "deadbeef", "q", "2024-01-01", "<odd", "..."]
    kinds = ["literal", "slug", "integer", "version", "filename", "dotted_path", "camel_case", "hash", "unknown", "date"]
    part = lambda: draw.choice([draw.choice(words[:-1]), f"<{draw.choice(kinds)}>"])
    listed = [("/" + "/".join([*(part() for _ in range(draw.randint(0, 4))), *(["..."] if draw.random() < 0.3 else [])])) for _ in range(400)]
    table = spark.createDataFrame([(f"t{k}", p, k) for k, p in enumerate(listed)], "template_id string, pattern string, rank int")
    paths = list(dict.fromkeys("/" + "/".join(draw.choice(words[:-1]) for _ in range(draw.randint(0, 6))) for _ in range(200)))
    rows = rows_of(spark, paths)
    pairs = spark.createDataFrame([(w, f"<{k}>") for w in words for k in kinds], "s string, t string").select("s", "t", segments.fits(F.col("s"), F.col("t")).alias("f")).collect()
    fit = {(r.s, r.t): r.f for r in pairs}

    def first(path):
        own = [s for s in path.split("/") if s]
        for k, p in enumerate(listed):
            t = [s for s in p.split("/") if s]
            wild = "..." in t
            t = t[: t.index("...")] if wild else t
            if (len(own) >= len(t) if wild else len(own) == len(t)) and all(fit[s, x] if x.startswith("<") and x.endswith(">") else s.lower() == x.lower() for s, x in zip(own, t)):
                return f"t{k}"
        return None

    want = {f"https://h.com{p}": t for p in paths if (t := first(p))}
    found = coverage.matches(rows, table)
    assert {r.canonical_url: r.template_id for r in found.collect()} == want and "explode" not in found._jdf.queryExecution().toString().lower()
    own = rows.select("seq", "canonical_url", urls.segments(F.col("path")).alias("_s"))
    assert {r.canonical_url: r.template_id for r in coverage.joined(own, table).collect()} == want


def test_tree_of_many_templates(spark):
    """Twenty thousand templates: a walk meets the edges that fit, not the templates."""
    tree = matching.Tree((k, [f"s{k % 200}", "<slug>" if k % 2 else f"w{k}", "<integer>"]) for k in range(20_000))
    steps = []
    real = matching.accepted
    matching.accepted = lambda *a: steps.append(a) or real(*a)
    try:
        assert tree.first(["s7", "w20007", "3"], ["literal", "literal", "integer"]) == 7 and tree.first(["s8", "w1008", "3"], ["literal", "literal", "integer"]) == 1008
    finally:
        matching.accepted = real
    assert len(steps) < 8


def test_paths_walk_the_tree_once(spark):
    """The condition that a template was found is no second walk, in a second Python worker of each task."""
    table = templates.as_table(spark, [("t0", templates.Template("x", "/a/<integer>", "", 0))])
    found = coverage.matches(rows_of(spark, ["/a/1", "/b/1"]), table)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert [r.template_id for r in found.collect()] == ["t0"]


def test_many_sites_at_once(spark):
    """Templates, matches and coverage of each site are those of the site alone."""
    draw = random.Random(4)
    words = ["api", "guide", "linear-model", "x.html", "12", "v2", "plot.html"]
    links = []
    for site in ("a.org", "www.b.org", "c.example.net:8080", "empty.org"):
        paths = ["/"] if site == "empty.org" else ["/" + "/".join(draw.choice(words) for _ in range(draw.randint(1, 4))) for _ in range(60)]
        links += [(f"https://{site}{p}", site) for p in dict.fromkeys(paths)]
    draw.shuffle(links)
    rows = [(i, u, "https://s/", 1, "", s) for i, (u, s) in enumerate(links)]
    columns = "seq long, url string, source_url string, depth int, link_text string, s string"
    made, found, report = classify_sites(spark.createDataFrame(rows, columns).drop("s"))
    got = {}
    for r in made.collect():
        got.setdefault(r.site, []).append((r.rank, r.template_id, r.name, r.pattern, r.fingerprint, r.member_count, tuple(r.example_urls), r.confidence))
    matched = {}
    for r in found.collect():
        matched.setdefault(r.site, set()).add((r.canonical_url, r.template_id))
    counts = {r.site: (r.total_internal_urls, r.covered_urls, r.template_count, r.coverage_percent) for r in report.collect()}
    for site in ("a.org", "www.b.org", "c.example.net:8080", "empty.org"):
        own = spark.createDataFrame([r for r in rows if r[-1] == site], columns).drop("s")
        alone = classify(own, own.limit(0))
        key = site.removeprefix("www.").partition(":")[0]
        want = sorted((r.rank, r.template_id, r.name, r.pattern, r.fingerprint, r.member_count, tuple(r.example_urls), r.confidence) for r in alone.templates.collect())
        assert sorted(got.get(key, [])) == want and bool(want) == (site != "empty.org")
        assert matched.get(key, set()) == {(r.canonical_url, r.template_id) for r in alone.matches.collect()}
        total = alone.report.first()
        assert counts[key] == (total.total_internal_urls, total.covered_urls, total.template_count, total.coverage_percent)


def test_deduplication_takes_depth_then_text_then_order(spark):
    rows = [(0, "k", 2, "long text"), (1, "k", 1, "a"), (2, "k", 1, "abc"), (3, "k", 1, "xyz"), (4, "j", 0, None)]
    got = relation.deduplicated(spark.createDataFrame(rows, "seq long, key string, depth int, link_text string")).orderBy("seq").collect()
    assert [(r.seq, r.key, r.depth, r.link_text) for r in got] == [(0, "k", 1, "abc"), (4, "j", 0, None)]


def test_external_caps(spark):
    rows = [(i, f"https://{'big' if i % 3 else f's{i}'}.com/{i}") for i in range(60)]
    got = relation.capped_external(spark.createDataFrame(rows, "seq long, url string"), per_domain=4, total=12).orderBy("seq").collect()
    count, want = {}, []
    for seq, url in rows:
        host = url.split("/")[2]
        if len(want) < 12 and count.get(host, 0) < 4:
            want.append(seq)
            count[host] = count.get(host, 0) + 1
    assert [r.seq for r in got] == want
