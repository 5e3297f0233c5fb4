"""Selectors by tables, and against sets of elements taken from left to right on random trees."""

import json
import random
import re
import time

import pytest

from sitegrain.functions import html, selectors
from sitegrain.sources import scraper

PAGE = """<body id=top class="site main-page"><div class="Box a" lang="en-GB" data-x="one two"><h1 id="t.1">Head</h1><p>first</p><p class="note last">second <em>em</em></p><ul><li>1<li class=x>2<li>3<li>4<li>5</ul></div>
<div class="b"><p>third</p><span></span><a href="/docs/a.html">A</a><a href="https://x.org/B.PDF" title="x &quot;y&quot;">B</a></div><section><div><div><p>deep</p></div></div></section></body>"""

TABLE = [
    ("p", ["first", "secondem", "third", "deep"]), ("P", ["first", "secondem", "third", "deep"]), ("div > p", ["first", "secondem", "third", "deep"]), ("body > div > p", ["first", "secondem", "third"]),
    ("section p", ["deep"]), ("section > p", []), ("section>div>div>p", ["deep"]), ("h1 + p", ["first"]), ("h1 ~ p", ["first", "secondem"]), ("h1+p+p", ["secondem"]), ("p ~ h1", []),
    (".Box", None), (".box", []), ("div.Box.a > h1", ["Head"]), ("#t\\.1", ["Head"]), ("h1#t\\.1.none", []), ("#top .note", ["secondem"]), ("*.note", ["secondem"]), ("p, h1", ["Head", "first", "secondem", "third", "deep"]),
    ("a[href]", ["A", "B"]), ("a[href^='/docs']", ["A"]), ('a[href$=".pdf" i]', ["B"]), ("a[href$='.pdf']", []), ("[href*=x]", ["B"]), ("[title='x \"y\"']", ["B"]), ("[data-x~=two] > h1", ["Head"]), ("[data-x=two]", []), ("[lang|=en] h1", ["Head"]), ("[lang|=e] h1", []), ("a[href='']", []), ("a[href^='']", []),
    ("li:first-child", ["1"]), ("li:last-child", ["5"]), ("li:nth-child(2)", ["2"]), ("li:nth-child(odd)", ["1", "3", "5"]), ("li:nth-child(even)", ["2", "4"]), ("li:nth-child(-n+2)", ["1", "2"]), ("li:nth-child(3n)", ["3"]), ("li:nth-child( n + 4 )", ["4", "5"]), ("li:nth-last-child(2)", ["4"]), ("p:nth-of-type(2)", ["secondem"]), ("p:first-of-type", ["first", "third", "deep"]), ("p:only-child", ["deep"]), ("p:last-of-type", ["secondem", "third", "deep"]), ("em:only-of-type", ["em"]),
    ("p:not(.note)", ["first", "third", "deep"]), ("p:not(.note, section *)", ["first", "third"]), ("li:not(:first-child):not(.x)", ["3", "4", "5"]), (":is(h1, em)", ["Head", "em"]), ("div :where(p):not(div div p)", ["first", "secondem", "third"]), ("span:empty", [""]), (":root > div > h1", ["Head"]), ("div:not([class]) p", ["deep"]),
]


@pytest.mark.parametrize("selector,want", TABLE)
def test_table(selector, want):
    found = html.select(html.parse(PAGE), selector)
    assert len(found) == 1 if want is None else [n.text() for n in found] == want


@pytest.mark.parametrize("wrong", ["", ">", "p >", "> p", "p,,a", "p,", "a[", "a[href", "p:nth-child(x)", "p:no-such", "p:not(", "..a", "p b)", "#", "a:hover"])
def test_what_is_no_selector(wrong):
    with pytest.raises(ValueError):
        selectors.compiled(wrong)


def random_page(draw, depth=0):
    tag = draw.choice(["div", "span", "em", "b"])
    marks = "".join(f' {k}="{draw.choice(v)}"' for k, v in (("class", ["a", "b", "a b", "c"]), ("id", ["x", "y"]), ("data-k", ["1", "2 3", "2-3"])) if draw.random() < 0.5)
    inner = "".join(random_page(draw, depth + 1) for _ in range(draw.randint(0, 4))) if depth < 5 else "t"
    return f"<{tag}{marks}>{inner}</{tag}>"


def by_sets(root, selector):
    """Left to right: the elements that each compound leaves of those the combinator reaches."""
    order, above, rows = [], {}, {}

    def visit(node, parent):
        below = node.elements()
        for c in below:
            order.append(c)
            above[id(c)], rows[id(c)] = parent, below
            visit(c, c)

    visit(root, None)

    def fits(node, compound):
        for kind, value in re.findall(r"([.#\[]?)([\w*|~=\"' -]+)", compound):
            if kind == "" and value not in ("*", node.tag) or kind == "." and value not in node.classes or kind == "#" and node.attrs.get("id") != value:
                return False
            if kind == "[":
                name, op, wanted = re.match(r"([\w-]+)([~|]?=)?(.*)", value).groups()
                own = node.attrs.get(name)
                if own is None or op == "=" and own != wanted or op == "~=" and wanted not in own.split() or op == "|=" and own.split("-")[0] != wanted:
                    return False
        return True

    def reached(node, join):
        if join == ">":
            return node.elements()
        if join == " ":
            return list(node.walk())
        row = rows[id(node)]
        at = next(i for i, x in enumerate(row) if x is node)
        return row[at + 1 :][: 1 if join == "+" else None]

    found = set()
    for chain in selector.split(", "):
        parts = re.split(r"( [>+~] | )", chain)
        now = [n for n in order if fits(n, parts[0])]
        for join, compound in zip(parts[1::2], parts[2::2]):
            now = [n for n in {id(n): n for m in now for n in reached(m, join.strip() or " ")}.values() if fits(n, compound)]
        found |= {id(n) for n in now}
    return [n for n in order if id(n) in found]


@pytest.mark.parametrize("seed", range(40))
def test_random_trees(seed):
    draw = random.Random(seed)
    root = html.parse("".join(random_page(draw) for _ in range(3)))
    simple = lambda: draw.choice(["div", "span", "em", "*", ".a", ".b", "#x", "div.a", "em#y.b", "[data-k]", "b[data-k=1]", "[data-k~=2]", "[data-k|=2]"])
    chains = [simple() + "".join(draw.choice([" ", " > ", " + ", " ~ "]) + simple() for _ in range(draw.randint(0, 4))) for _ in range(30)]
    listed = tuple(dict.fromkeys([*chains, *(", ".join(draw.sample(chains, 2)) for _ in range(5))]))
    for selector, nodes in zip(listed, selectors.Finder(listed).find(root)):
        assert [id(n) for n in nodes] == [id(n) for n in by_sets(root, selector)], selector


def test_deep_and_wide_pages_take_linear_time():
    began = time.time()
    deep = html.parse("<div class=a>" * 3000 + "x" + "</div>" * 3000)
    assert len(html.select(deep, "div.a div.a div.a div.a > div.a")) == 2996
    wide = html.parse("<ul>" + "<li class=b>y</li>" * 4000 + "</ul>")
    assert len(html.select(wide, "li.b + li.b")) == 3999 and len(html.select(wide, "ul > li:first-child")) == 1
    assert time.time() - began < 60


def test_fields_of_templates_in_one_pass(spark):
    """One join and one function, however many templates; a URL keeps one row though pages repeat it."""
    pages = spark.createDataFrame([(2, "https://h.org/a#x", "<h1>late</h1>"), (1, "https://h.org/a", PAGE), (3, "https://h.org/b", PAGE)], "page_id long, url string, html string")
    rows = [("t", 1, "https://h.org/a/"), ("t", 2, "https://h.org/none"), *((f"t{i}", 10 + i, "https://h.org/b") for i in range(40)), (None, 60, "https://h.org/b")]
    urls = spark.createDataFrame(rows, "template_id string, seq long, url string")
    by = {f"t{i}": [[{"name": "f", "css_selector": f"li:nth-child({1 + i % 5})"}], [{"name": "f", "css_selector": "h1"}]] for i in range(40)}
    extractor = scraper.SelectorExtractor(pages, [[{"name": "f", "css_selector": "section > div p"}]], by)
    first, second = extractor(urls, 0), extractor(urls, 1)
    assert {r.seq: r.data and json.loads(r.data)["f"] for r in first.collect()} == {1: "deep", 2: None, 60: "deep"} | {10 + i: str(1 + i % 5) for i in range(40)}
    assert {r.seq: r.data and json.loads(r.data)["f"] for r in second.collect()} == {1: "deep", 2: None, 60: "deep"} | {10 + i: "Head" for i in range(40)}
    assert first._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    with pytest.raises(ValueError):
        html.with_fields(pages, [{"name": "f", "css_selector": "p >"}])
