"""HTML, records, crawls, sources, sinks and streams."""

import json
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitegrain.functions import html
from sitegrain.operators import coverage, frontier, generator, grouping, validation
from sitegrain.plans import commands, extract
from sitegrain.sources import documents, fetch, scraper
from sitegrain.streaming import links

PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title> Site &amp; more </title><meta name="Generator" content="sphinx-7.2.6">
<meta name="description" content="A page"><link rel="canonical" href="/stable/"><link rel="stylesheet" href="_static/a.css"></head><body>
<a href="modules/x.html">X <b>y</b></a><a href="#top">no</a><a href="mailto:a@b">no</a><a href='https://numpy.org/' rel="nofollow">numpy</a>
<a href="../dev/index.html">dev</a><a name="n">no</a><a href="">no</a></body></html>"""
BASE = "https://h.org/stable/index.html"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(1, BASE, PAGE), (2, "https://h.org/", None), (3, "https://h.org/x", "")], "page_id long, url string, html string")


def test_links(pages):
    got = [(r.pos, r.href, r.text, r.rel) for r in html.links(pages).orderBy("pos").collect()]
    assert got == [(0, "https://h.org/stable/modules/x.html", "Xy", ""), (3, "https://numpy.org/", "numpy", "nofollow"), (4, "https://h.org/dev/index.html", "dev", "")]
    assert [(r.href, r.rel) for r in html.link_tags(pages).orderBy("pos").collect()] == [("https://h.org/stable/", "canonical"), ("https://h.org/stable/_static/a.css", "stylesheet")]


def test_metadata_and_signals(pages):
    rows = pages.select("page_id", html.metadata(F.col("html"), F.col("url")).alias("m"), html.signals(F.col("html")).alias("s")).orderBy("page_id").collect()
    assert tuple(rows[0].m) == ("Site & more", "sphinx-7.2.6", "A page", "https://h.org/stable/", "utf-8")
    assert tuple(rows[1].m) == ("", "", "", "", "utf-8")
    assert rows[0].s.static_dir and rows[0].s.has_canonical and not rows[0].s.mkdocs_detected
    guess = pages.select(html.best_guess(html.signals(F.col("html")), F.lit(False), F.lit(False)).alias("g")).collect()
    assert tuple(guess[0].g) == ("sphinx", 0.95) and tuple(guess[1].g) == (None, 0.0)


CUT = "<title>a&amp;&amp;&amp</title><h1>a &lt;b&gt &quot;&#39;&#39 &#x26; &ampx; &amp;lt; &quo</h1><p>x &am</p><ul><li>&amp</li></ul>"


def test_fields_of_cut_references(spark):
    """References count with their semicolon, as in the SQL; texts of the tables are cut within them."""
    rows = html.with_fields(spark.createDataFrame([(1, CUT)], "page_id long, html string"), list(scraper.FIELDS)).collect()
    assert json.loads(rows[0].data) == {"page_title": "a&&&amp", "function_signature": "a <b&gt \"'&#39 & &ampx; &lt; &quo", "description": "x &am", "parameters": ["&amp"]}


def test_metadata_of_cut_references(spark):
    rows = spark.createDataFrame([(1, BASE, CUT + '<a href="/x">y&amp;&gt</a>')], "page_id long, url string, html string")
    assert rows.select(html.metadata(F.col("html"), F.col("url"))["title"]).first()[0] == "a&&&amp"
    assert [r.text for r in html.links(rows).collect()] == ["y&&gt"]


def test_pages_in_runs():
    """However many pages a batch has, Python holds the facts of a run of them; runs follow one another, and an empty batch has none."""
    page = "<title>t</title>" + "".join(f'<a href="/{i}">text {i}</a>' for i in range(50))
    peaks = []
    for n in (200, 2000):
        batch = pa.array([None, *[page] * n])
        tracemalloc.start()
        found = html._scanned(batch)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(found) == n + 1 and found[0].as_py()["anchors"] == [] and all(len(found[i]["anchors"]) == 50 for i in range(1, n + 1, 37))
    assert peaks[1] < 1.5 * peaks[0]
    assert html._scanned(pa.array([], pa.string())).to_pylist() == []


AWKWARD = [
    '<a href="/x">one<p><a href="/y">two</a>', '<a href="/open">to the  end', '<!-- <a href="/hidden">no</a> --><a href="/a">yes</a>', '<script>var a = "<a href=/s>x</a>";</script><a href=/b>b</a>',
    "<a href='/c'> two <b> 2 </b> </a>", '<A CLASS="k" HREF="/d?x=1&amp;y=2">D &eacute; &#233;&#x2014;&lt;</A>', '<a data-href="/no">no</a><a name="x">no</a><a href="/e"\n rel="next nofollow">e</a>', "<a\nhref='/f'>f<br>g</a>", "<style>a{}</style><!-- open <a href='/g'>g</a>", "<abbr href='/no'>no</abbr><a href='/h'></a>",
]


def test_links_of_awkward_pages(spark):
    """Against the tree that a parser makes, where anchors do not nest."""
    rows = html.links(spark.createDataFrame([(i, BASE, p) for i, p in enumerate(AWKWARD)], "page_id long, url string, html string")).orderBy("page_id", "pos").collect()
    got = [(r.page_id, r.raw, r.text, r.rel) for r in rows]
    want = []
    for i, page in enumerate(AWKWARD):
        texts = {}  # an anchor that goes on in another block is one
        for n in html.parse(page).walk():
            if n.tag == "a" and "href" in n.attrs:
                texts.setdefault(id(n.attrs), [n.attrs, ""])[1] += n.text()
        want += [(i, attrs["href"], text, attrs.get("rel", "")) for attrs, text in texts.values()]
    assert got == want


#: Pages and what a parser has of them: title, generator, canonical URL, charset, then anchors and link tags.
RECORDED = [
    ('<a title="x > y" href="/z">t</a><a title=\'>\' href=/q>u</a>', ("", "", "", "utf-8"), [("/z", "t", ""), ("/q", "u", "")], []),
    ('<!-- <meta name="generator" content="Old"><title>no</title><link rel=canonical href="/no"> --><title>yes</title><meta NAME=Generator content="New > 1">', ("yes", "New > 1", "", "utf-8"), [], []),
    ('<script>"<title>s</title><meta charset=x>"</script><title>&eacute;&amp;&#233;&nbsp;&hearts;</title><meta http-equiv=Content-Type content="text/html; charset=Latin-1 ">', ("é&é\xa0♥", "", "", "latin-1"), [], []),
    ('<link rel="icon  canonical" href="/c?a=1&copy=2&amp;b"><link rel=x href=" /s.css "><link href="">', ("", "", "https://h.org/c?a=1&copy=2&b", "utf-8"), [], [(0, "https://h.org/c?a=1&copy=2&b", "icon canonical"), (1, "https://h.org/s.css", "x")]),
    ('<li><a href=/a>one<li><a href=/b>two</li>out</a><p><a href=/c>three</p>out<div><a href=/d>four</span></p> five</div>out', ("", "", "", "utf-8"), [("/a", "one", ""), ("/b", "two", ""), ("/c", "three", ""), ("/d", "fourfive", "")], []),
    ('<textarea><a href="/no"></textarea><title>a</title><title>b</title><a href="/e">x<!-- y -->z</a><a href=/f', ("a", "", "", "utf-8"), [("/e", "xz", "")], []),
    ('<meta charset=""><!DOCTYPE html "<a href=/g>"><a\x0bhref=/no><A\nHREF\n=\n/h REL="a\tb">\u2003h </A>', ("", "", "", ""), [("/h", "h", "a b")], []),
]


def test_recorded_pages(spark):
    pages = spark.createDataFrame([(i, BASE, p) for i, (p, *_) in enumerate(RECORDED)], "page_id long, url string, html string")
    of = lambda rows, i: [r for r in rows if r.page_id == i]
    anchors, linked = html.links(pages).orderBy("page_id", "pos").collect(), html.link_tags(pages).orderBy("page_id", "pos").collect()
    told = {r.page_id: r.m for r in pages.select("page_id", html.metadata(F.col("html"), F.col("url")).alias("m")).collect()}
    for i, (_, (title, made_by, canonical, charset), want, want_linked) in enumerate(RECORDED):
        assert (told[i].title, told[i].generator, told[i].canonical_url, told[i].charset) == (title, made_by, canonical, charset)
        assert [(r.raw, r.text, r.rel) for r in of(anchors, i)] == want, i
        assert [(r.pos, r.href, r.rel) for r in of(linked, i)] == want_linked, i


def test_files_of_sites(spark):
    sites = spark.createDataFrame([("https://h.org/docs/", 1), ("https://h.org/docs/", 2), ("http://x.org", 3)], "root_url string, n int")
    known = spark.createDataFrame([("https://h.org/robots.txt",), ("https://h.org/docs/search/search_index.json",), ("http://x.org/objects.inv#a",), ("http://x.org/docs/sitemap.xml",)], "url string")
    rows = {r.n: (r.has_robots_txt, r.has_objects_inv, r.has_sitemap, r.has_search_index) for r in fetch.site_files(sites, known).collect()}
    assert rows == {1: (True, False, False, True), 2: (True, False, False, True), 3: (False, True, False, False)}


def test_service(spark):
    def post(url):
        if url == "late":
            raise TimeoutError
        if url == "lost":
            raise ConnectionError
        if url == "odd":
            raise KeyError
        return {"ok": 200, "gone": 404, "busy": 429, "down": 503}[url], "body"

    got = fetch.through_service(spark.createDataFrame([(u,) for u in ("ok", "gone", "busy", "down", "late", "lost", "odd")], "url string"), post, unit=0.0)
    assert {r.url: (r.html, r.requests, r.successful, r.failed, r.credits) for r in got.collect()} == {
        "ok": ("body", 1, 1, 0, 1), "gone": (None, 1, 0, 1, 0), "busy": (None, 3, 0, 1, 0), "down": (None, 3, 0, 1, 0), "late": (None, 3, 0, 1, 0), "lost": (None, 3, 0, 1, 0), "odd": (None, 1, 0, 1, 0),
    }
    assert tuple(fetch.service_counts(got).first()) == (15, 1, 6, 1)


def test_printed_tree(spark):
    paths = ["/", *[f"/a/{i}.html" for i in range(7)], "/b", "/b", "/b", "/b"]
    rows = spark.createDataFrame([(i, p, f"u{i}") for i, p in enumerate(paths)], "seq long, path string, canonical_url string")
    lines = grouping.printed(rows, F.col("path")).split("\n")
    assert lines[:3] == ["root [descendants=12, child_ratio=1.0]", "  a [descendants=7, child_ratio=0.0]", "    0.html [descendants=1, child_ratio=0.0]"]
    assert "    ... (2 more children)" in lines and lines[-6:] == ["  b [descendants=4, child_ratio=0.0]", "    → u8", "    → u9", "    → u10", "    → ... (1 more)", "  → u0"]
    assert grouping.printed(rows.limit(0), F.col("path")) == ""


def test_templates_with_wildcards_and_many_rows(spark):
    listed = [("a", "/x/<integer>/..."), ("b", "/x/..."), ("c", "/<slug>/y"), ("d", "/..."), ("e", "/x/<integer>"), ("f", "/")]
    templates = spark.createDataFrame([(i, p, k) for k, (i, p) in enumerate(listed)], "template_id string, pattern string, rank int")
    paths = {"/x/1/2/3": "a", "/X/1": "a", "/x": "b", "/x/q/r": "b", "/a-b/Y": "c", "/q/r/s": "d", "/": "d"}
    rows = spark.createDataFrame([(i, p, p) for i, p in enumerate(paths)], "seq long, canonical_url string, path string")
    assert {r.canonical_url: r.template_id for r in coverage.matches(rows, templates, F.col("path")).collect()} == paths


def test_next_urls(spark):
    waiting = spark.createDataFrame([("a", 1, 5), ("b", 0, 9), ("c", 1, 2), ("d", 2, 0)], "key string, depth int, seq long")
    assert [r.key for r in frontier.next_urls(waiting, None, 3).collect()] == ["b", "c", "a"]
    assert [r.key for r in frontier.next_urls(waiting, spark.createDataFrame([("b",), ("b",)], "key string")).collect()] == ["c"]


def test_extractors_of_templates(spark, pages):
    urls = pages.select(F.when(F.col("page_id") == 1, "t").otherwise("u").alias("template_id"), F.col("page_id").alias("seq"), "url")
    title = [{"name": "page_title", "css_selector": "title"}]
    extractor = scraper.SelectorExtractor(pages, [[{"name": "x", "css_selector": "a"}]], {"t": [title]}, frozenset({"u"}))
    assert [r.seq for r in extractor.create(urls).collect()] == [1]
    got = {r.seq: r.data for r in extractor(urls, 3).collect()}
    assert json.loads(got[1]) == {"page_title": "Site & more"} and got[2] is None and json.loads(got[3]) == {"x": None}
    done, failed, counts = extract.extract(urls, extractor)
    assert tuple(counts.first()) == (1, 1, 0, 1) and [r.seq for r in failed.collect()] == [1]


def test_skeleton_leaves_noise_out():
    assert html.skeleton("<div><script>var x=1</script></div>") == "body\n  div"
    assert html.skeleton("<div><svg><text>t</text></svg><p>a</p></div>").split("\n") == ["body", "  div", '    p "a"']
    assert html.skeleton("some <b>text</b>").split("\n") == ["body", "  p", '    b "text"']
    assert html.skeleton("") == "[document]" and html.skeleton("<html><head><title>x</title></head><p>a").split("\n") == ["body", '  p "a"']


def test_skeleton():
    page = "<body><script>x</script><div class='content random sig' id='main'><p>" + "t" * 90 + "<p>short</p></div><div style='display:none'>gone</div><div id='id-3'><span>s</span></div></body>"
    assert html.skeleton(page).split("\n") == ["body", "  div.content.sig#main", "    p [LONG_TEXT]", '    p "short"', "  div", '    span "s"']
    assert html.skeleton("<p>a" * 3000, 100).endswith("\n... [TRUNCATED]") and isinstance(html.skeleton("<<<>>&"), str) and html.skeleton(None)


@pytest.mark.parametrize("page, field, want", [
    ("<h1 class='title'>Hello World</h1>", {"css_selector": "h1.title"}, "Hello World"), ("<p>Content</p>", {"css_selector": "h1"}, None),
    ("<span class='page-title'>T</span>", {"css_selector": "h1", "fallback_selectors": [".page-title"]}, "T"),
    ("<ul><li>A</li><li>B<li>C</ul>", {"css_selector": "ul", "field_type": "LIST"}, ["A", "B", "C"]),
    ("<table><tr><th>Name</th><th>Type</th></tr><tr><td>X</td><td>int</td></tr></table>", {"css_selector": "table", "field_type": "TABLE"}, [{"Name": "X", "Type": "int"}]),
    ("<div class='highlight'><pre>print(1)</pre></div>", {"css_selector": ".highlight", "field_type": "CODE"}, ["print(1)"]),
    ("<nav><a href='/docs'>D</a><a href='/api'>A</a></nav>", {"css_selector": "nav a", "field_type": "URL"}, ["/docs", "/api"]),
])
def test_fields(page, field, want):
    assert html.extract_fields(page, [{"name": "f", **field}])["f"] == want


def test_verdicts(spark):
    ok = {"page_title": "Title", "function_signature": "fit(X, y)", "description": "long enough text", "parameters": ["x"]}
    cases = [(ok, "PASS"), ({k: v for k, v in ok.items() if k != "parameters"}, "BORDERLINE"), (ok | {"parameters": []}, "PASS"), (ok | {"page_title": "", "description": None}, "FAIL"), ([], "FAIL"), ([ok], "PASS"), ({"raw_output": "x"} | ok, "FAIL"), (ok | {"page_title": "N/A"}, "BORDERLINE"), (ok | {"description": "short"}, "BORDERLINE"), ([3], "FAIL"), (7, "FAIL")]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(99, "{broken"), (100, None)], "i int, d string")
    got = {r.i: r.v for r in df.select("i", validation.validate_json(F.col("d")).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [v for _, v in cases] and got[99] == got[100] == "FAIL"


def test_schema_validation(spark):
    df = spark.createDataFrame([(0, {"a": "x", "b": "y"}), (1, {"a": "x"}), (2, {"a": "x", "b": "[]"})], "i int, d map<string,string>")
    rows = [r.v for r in df.select("i", validation.validate_schema(F.col("d"), ["a", "b"], ["c"]).alias("v")).orderBy("i").collect()]
    assert [(v.passed, v.missing_required, v.empty_required, v.missing_optional, v.score) for v in rows] == [(True, [], [], ["c"], 1.0), (False, ["b"], [], ["c"], 0.5), (False, [], ["b"], ["c"], 0.5)]


def test_healing(spark, pages):
    urls = pages.select(F.lit("t").alias("template_id"), F.col("page_id").alias("seq"), "url")
    wrong = [{"name": "page_title", "css_selector": "nothing"}]
    right = [{"name": "page_title", "css_selector": "title"}, {"name": "function_signature", "css_selector": "a", "field_type": "TEXT"}, {"name": "description", "css_selector": "title"}, {"name": "parameters", "css_selector": "nav", "field_type": "LIST"}]
    accept = lambda df: df.withColumn("accepted", F.lit(True))
    done, failed, counts = extract.extract(urls, scraper.SelectorExtractor(pages, [wrong, right]), accept=accept)
    assert [(r.seq, r.round) for r in done.collect()] == [(1, 1)] and sorted(r.seq for r in failed.collect()) == [2, 3]
    assert counts.first().asDict() == {"total_urls": 3, "processed": 3, "healed": 1, "failed": 2}
    made = json.loads(extract.result_document("h.org", done, failed, counts).first().json)
    assert (made["total_processed"], made["total_healed"], made["failed"]) == (3, 1, 2) and made["failed_urls"] == [{"url": u, "template_id": "t"} for u in ("https://h.org/", "https://h.org/x")]
    assert [(r["url"], r["status"], r["data"]["page_title"]) for r in made["results"]["t"]] == [(BASE, "extracted", "Site & more")]
    none, _, _ = extract.extract(urls, scraper.SelectorExtractor(pages, [wrong, right]))
    assert none.count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_breadth_first_search(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randint(0, 40), draw.randint(0, 40), i) for i in range(90)]
    depth, parent, order, queue = {0: 0}, {0: None}, [0], [0]
    for node in queue:
        for src, dst, _ in edges:
            if src == node and dst not in depth and depth[node] < 3:
                depth[dst], parent[dst] = depth[node] + 1, node
                queue.append(dst)
    got = frontier.crawl(spark.createDataFrame([(0, 0)], "node long, seq long"), spark.createDataFrame(edges, "src long, dst long, pos int")).orderBy("depth", "seq").collect()
    assert [(r.node, r.depth, r.parent) for r in got] == [(n, depth[n], parent[n]) for n in queue]
    few = frontier.crawl(spark.createDataFrame([(0, 0)], "node long, seq long"), spark.createDataFrame(edges, "src long, dst long, pos int"), max_nodes=5)
    assert {r.node for r in few.collect()} == set(queue[:5])


def test_crawl_of_pages(spark):
    page = lambda *hrefs: "".join(f'<a href="{h}">t</a>' for h in hrefs)
    rows = [(1, "https://h.org/", page("/a", "/b", "https://out.org/1")), (2, "https://h.org/a", page("/c", "/", "https://out.org/2")), (3, "https://h.org/b", page("/c")), (4, "https://h.org/c", page("/d")), (5, "https://h.org/d", page("/e")), (6, "https://h.org/e", "")]
    inside, outside = frontier.crawl_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), "https://h.org/", max_depth=3)
    assert [(r.url, r.depth, r.source_url) for r in inside.orderBy("depth", "seq").collect()] == [("https://h.org/", 0, "https://h.org/"), ("https://h.org/a", 1, "https://h.org/"), ("https://h.org/b", 1, "https://h.org/"), ("https://h.org/c", 2, "https://h.org/a"), ("https://h.org/d", 3, "https://h.org/c")]
    assert [r.url for r in outside.orderBy("seq").collect()] == ["https://out.org/1", "https://out.org/2"]


def whole(spark, folder):
    """A document in sections, by its files in order and by one file made from them."""
    text = "".join(f.read_text() for f in sorted(folder.rglob("part-*"), key=lambda f: (f.parent.name, f.name)))
    documents.write_one_file(spark, str(folder), str(folder) + ".json")
    made = json.loads(text)
    assert json.loads(open(str(folder) + ".json").read()) == made
    return made


def test_from_file_to_file(spark, tmp_path):
    page = lambda i, body="": f"<title>Function {i} of the site</title><pre>fit(X{i}, y)</pre><p>A page on function {i} and its use.</p><ul><li>X</ul>{body}"
    listed = "".join(f'<a href="/api/f{i}.html">f</a>' for i in range(6)) + '<a href="/index.html">i</a>' + '<a href="https://out.org/x">o</a>'
    rows = [(0, "https://h.org/", page(0, listed)), *((i + 1, f"https://h.org/api/f{i}.html", page(i + 1) if i != 3 else "") for i in range(6)), (8, "https://h.org/index.html", page(8)), (9, "https://h.org/objects.inv", ""), (10, "https://h.org/guide/a.html", page(10))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    commands.crawl_to_file(pages, "https://h.org/", str(tmp_path / "crawl"))
    made = whole(spark, tmp_path / "crawl")
    assert [u["url"] for u in made["internal_urls"]] == ["https://h.org/", *(f"https://h.org/api/f{i}.html" for i in range(6)), "https://h.org/index.html"] and [u["url"] for u in made["external_urls"]] == ["https://out.org/x"]
    assert made["signals"]["has_objects_inv"] == "true" and made["signals"]["detected_tool"] == "sphinx" and made["root_domain"] == "h.org"
    commands.classify_file(spark, str(tmp_path / "crawl"), str(tmp_path / "classes"))
    classes = whole(spark, tmp_path / "classes")
    assert classes["generator_detected"] == "sphinx" and [t["pattern"] for t in classes["templates"]] == ["/api/<filename>"]  # a section beside another child
    assert [u["url"] for u in classes["uncovered_urls"]] == ["https://h.org/", "https://h.org/index.html"] and classes["summary"]["covered_urls"] == 6
    commands.extract_file(spark, str(tmp_path / "classes"), pages, str(tmp_path / "out"))
    out = whole(spark, tmp_path / "out")
    (template,) = out["results"]
    assert (out["domain"], out["total_processed"], out["failed"]) == ("h.org", 6, 1) and out["failed_urls"] == [{"url": "https://h.org/api/f3.html", "template_id": template}]
    assert [r["data"]["function_signature"] for r in out["results"][template]] == [f"fit(X{i + 1}, y)" for i in range(6) if i != 3]


def test_generator(spark):
    rows = lambda *paths: spark.createDataFrame([(p, None) for p in paths], "path string, version_free_path string")
    assert generator.detect(rows("/a"), {"has_objects_inv": True}) == ("sphinx", 0.95)
    assert generator.detect(rows("/a"), {"search_index_json": "true"}) == ("mkdocs", 0.95)
    assert generator.detect(rows("/a"), {"detected_tool": "hugo"}) == ("hugo", 0.90)
    assert generator.detect(rows("/_static/x", "/docusaurus"), {"detected_tool": "mkdocs_material"}) == ("sphinx", 0.70)
    assert generator.detect(rows("/index.json"), None) == ("hugo", 0.50) and generator.detect(rows("/a"), {}) == (None, 0.0)
    assert generator.detect(rows(*["/modules/generated/x"] * 11), {}) == ("sphinx", 0.60) and generator.detect(rows(*["/modules/generated/x"] * 10), {}) == (None, 0.0)


def test_documents_are_written_and_read(spark, tmp_path):
    inside = spark.createDataFrame([(0, "https://h.org/a", "https://h.org/", 1, "t", 200)], "seq long, url string, source_url string, depth int, link_text string, http_status int")
    made = documents.crawl_document("c", "h.org", ["https://h.org/"], {"x": "true"}, inside, inside.drop("http_status", "link_text"))
    documents.write_json(made, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert json.loads(text)["internal_urls"] == [{"url": "https://h.org/a", "source_url": "https://h.org/", "depth": 1, "link_text": "t", "http_status": 200}]
    assert "http_status" not in json.loads(text)["external_urls"][0]
    read = documents.read_crawl(spark, str(tmp_path / "out"))
    assert documents.links_of(read, "external_urls").first().url == "https://h.org/a" and read.first().signals == {"x": "true"}
    (tmp_path / "bad.json").write_text("{broken")
    with pytest.raises(Exception):
        documents.read_crawl(spark, str(tmp_path / "bad.json")).collect()
    with pytest.raises(Exception):
        documents.read_crawl(spark, str(tmp_path / "missing.json")).collect()
    urls = spark.createDataFrame([(i, f"u{i}") for i in range(60)], "seq long, url string")
    documents.write_url_lists(urls, str(tmp_path / "txt"), str(tmp_path / "csv"))
    assert next((tmp_path / "txt").glob("part-*")).read_text().split() == [f"u{i}" for i in range(50)]
    assert next((tmp_path / "csv").glob("part-*")).read_text().split()[:2] == ["url", "u0"]


def test_fetching(spark, pages):
    wanted = spark.createDataFrame([("https://h.org/#x",), ("https://h.org/none",)], "url string")
    assert {r.url: r.crawl_status for r in fetch.from_table(wanted, pages).collect()} == {"https://h.org/#x": "success", "https://h.org/none": "http_error"}

    def get(url):
        if url.endswith("none"):
            raise TimeoutError
        return {"status_code": 200, "content_type": "text/html", "html": "x", "redirect_chain": ["a"]}

    got = {r.url: r.crawl_status for r in fetch.from_function(wanted, get, retries=1, backoff=0.0, pause=0.0).collect()}
    assert got == {"https://h.org/#x": "redirect", "https://h.org/none": "timeout"}


def test_tool_output(spark):
    df = spark.createDataFrame([(0, 'log {"a": 1} end'), (1, "x [1] y"), (2, " nothing "), (3, "{bad}")], "i int, s string")
    got = [r[0] for r in df.select("i", scraper.parse_output(F.col("s")).alias("x")).orderBy("i").select("x").collect()]
    assert got == ['{"a": 1}', "[1]", '{"raw_output":"nothing"}', '{"raw_output":"{bad}"}']


def test_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "url string, at timestamp"
    (folder / "1.json").write_text("\n".join(json.dumps({"url": u, "at": "2024-01-01T00:00:00"}) for u in ("https://h.org/a", "https://h.org/a/", "https://h.org/b")))
    stream = links.unseen(links.read_links(spark, str(folder), schema), "at")
    query = stream.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.key for r in spark.table("seen").collect()) == ["https://h.org/a", "https://h.org/b"]
    counts = links.domain_counts(links.read_links(spark, str(folder), schema), "at")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.domain, r.n) for r in spark.table("counts").collect()] == [("h.org", 3)]
