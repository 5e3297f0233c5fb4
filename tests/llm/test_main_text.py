"""Main text by wrappers: planted pages, a plain reading of the tables' pages, and odd input."""

import random
import re
from html import unescape

import pytest

from sitegrain.llm import main_text as m
from sitegrain.llm import queries

SF = "/root/testdata/sf0.001"


def wrapper_of(pages):
    whole = None
    for p in pages:
        own = m._bare(m.Page(p).folded())
        whole = own if whole is None else m.merged(whole, own)
    return m.mark(whole, 1 + (len(set(pages)) > 1))


def texts(*pages):
    made = wrapper_of(pages)
    return [m.text_by(made, m.Page(p)) for p in pages]


def shape(*pages):
    return str(wrapper_of(pages))


def test_forms_of_wrappers():
    """Iterators, optional parts and slots, however pages are ordered."""
    assert shape("<ul><li>a<li>b</ul>") == "<html><ul><li>#</>+</></>"
    assert shape("<h1>a</h1><p>b</p>", "<h1>a</h1><div>x</div><p>c</p>") == "<html><h1>'</> <div>'</>? <p>#</></>"
    assert shape("<dl><dt>a<dd>b<dt>c<dd>d</dl>") == "<html><dl>(<dt>#</> <dd>#</>)+</></>"
    assert shape("<p>a<p>b", "<p>a") == "<html><p>#</>+</>"
    mixed = shape("<h2>a</h2><p>b</p><ul><li>c</ul><h2>d</h2><p>e</p><p>f</p>", "<p>g</p><h2>h</h2><p>i</p>")
    assert mixed.count("<h2>") + mixed.count("<p>") <= 4 and "|" not in mixed


@pytest.mark.parametrize("seed", range(5))
def test_wrappers_accept_their_pages_and_stay_small(seed):
    """Every text of every page has its slot; a wrapper does not grow with the number of pages."""
    draw = random.Random(seed)

    def element(depth):
        tag = draw.choice(["p", "div", "ul", "h2", "section", "table", "blockquote"])
        name = draw.choice(["", "", ' class="a"', f' class="{draw.choice("abcdefghijklmnopqrstuvwxyz") * 3}"'])
        inner = "".join(element(depth + 1) for _ in range(draw.randint(0, 4))) if depth < 3 else ""
        return f"<{tag}{name}>{draw.choice(['', 'same', str(draw.random())])}{inner}</{tag}>"

    pages = [f"<body>{''.join(element(0) for _ in range(draw.randint(1, 8)))}" for _ in range(150)]
    whole, sizes = None, []
    for p in pages:
        own = m._bare(m.Page(p).folded())
        whole = own if whole is None else m.merged(whole, own)
        sizes.append(len(str(whole)))
        stack = [whole]
        while stack:
            part = stack.pop()
            assert len({x.label for x in part.parts}) == len(part.parts)
            stack += part.parts
    assert sizes[-1] < 3 * sizes[len(sizes) // 2]


def page(body, title="T"):
    return f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a="<p>no</p>"</script></head><body>{body}</body></html>'


ARTICLE = [
    ("<nav><a href=/>Home</a></nav><header><h1>Site</h1></header><article><h1>Head &amp; tail</h1><p>One <b>two</b>&nbsp; <i>three</i>\n four.<p>Five.<br>Six</article><aside>Side</aside><footer>Foot</footer>", "Head & tail\nOne two three four.\nFive. Six"),
    ('<div class="cookie-notice">We use cookies</div><main><header><h1>Head</h1><p>by X</p></header><p>Body</p><form><label>Mail</label><input><button>Go</button></form><div id="comments"><article class="comment"><p>Reader</p></article></div></main>', "Head\nBody"),
    ('<article class="post"><h1>A</h1><p>x</p><div class="ad-slot">Buy</div><ul><li>one<li>two</ul><table><tr><td>c1<td>c2<tr><td>c3</table><pre>k\n  l</pre><aside>n</aside><footer>tags</footer></article><section class=comments><article><p>no</p></article></section>', "A\nx\none\ntwo\nc1\nc2\nc3\nk l"),
    ('<div id="wrapper" class="has-sidebar overlay"><main role=main><p>a<script>x</script>b<!-- c -->c</p><p hidden>no</p><p style="display: none">no</p></main></div>', "abc"),
    ("<article></article><p>other", ""),
    ('<section class="related"><article><p>no</p></article></section><div class="modal"><article>yes</article></div>', "yes"),
    ("<form id=all><article><p>in a form</p></article></form>", "in a form"),
    ("<article><p>&lt;b&gt; &amp;amp; &eacute;&#233;&#x1F600; a<wbr>b <select><option>no</select>c</p></article>", "<b> &amp; éé😀 ab c"),
    ("<article><div>text<div>inner</div>after</div>last", "text\ninner\nafter\nlast"),
    ('<ARTICLE><P CLASS="x">up</P></ARTICLE><DIV ROLE="navigation">no</DIV>', "up"),
]


@pytest.mark.parametrize("body,want", ARTICLE)
def test_articles(body, want):
    """Alone, and with all others as pages of one host."""
    others = [page(b) for b, _ in ARTICLE if b != body]
    assert texts(page(body)) == [want or ("other" if "other" in body else "")]
    assert texts(page(body), *others)[0] == (want or "other")


def test_pages_without_articles():
    """What differs between pages and is no list of links; alone, all that is not marked."""
    bodies = [("First words", "A long text on one thing, of some length."), ("Second words", "Another text altogether, about other things."), ("Third", "And a third one, which is shorter.")]
    links = '<div class="x"><a href="/a">Start</a> <a href="/b">More</a></div>'
    make = lambda i: page(f'<div class="top">The Daily Site</div>{links}<div class="text"><h1>{bodies[i][0]}</h1><p>{bodies[i][1]}</p><p>{bodies[i][1][::-1]}</p></div><div class="bottom">All rights reserved</div><div class="list"><a href="/q{i}">Read this {i}</a><a href="/r">and that {i}</a></div>')
    want = ["\n".join((h, t, t[::-1])) for h, t in bodies]
    assert texts(*map(make, range(3))) == want
    assert texts(make(0)) == ["The Daily Site\n" + want[0] + "\nAll rights reserved"]
    assert texts(make(0), make(0))[0] == texts(make(0))[0]
    near = [page(f"<div><h1>Same head</h1><p>The same long text on all pages of this host</p><blockquote>on day {i}</blockquote></div>") for i in range(3)]
    assert texts(*near) == [f"Same head\nThe same long text on all pages of this host\non day {i}" for i in range(3)]
    assert texts("just text", "other <b>text</b>") == ["just text", "other text"] and texts("", " <p> </p>") == ["", ""]


def plain(html):
    """Text of a page of the tables, whose articles hold h1, p, b and br alone."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    blocks = (" ".join(unescape(re.sub(r"</?b>", "", re.sub(r"<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


def test_query(spark):
    got = queries.op13_html_extraction(spark, SF)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = sorted((r.page_id, r.url, plain(r.html), len(plain(r.html))) for r in spark.read.parquet(f"{SF}/pages.parquet").collect())
    assert sorted(map(tuple, got.collect())) == want


def test_odd_pages(spark, monkeypatch):
    """Null, empty, broken, deep and very long pages, repeated rows, missing keys, clashing columns; by broadcast and by join."""
    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    pages = [None, "", "<", "<article", "plain & simple", "<article><p>x</article>", long, deep, "<article><p>x</article>", "</p></div><p>y", "<p>퟿\x00 z</p>"]
    rows = [(i if i != 3 else None, None if i == 5 else f"http://h{i % 3}.org/x" if i % 4 else f"no host {i}", p, "t", "h", 1) for i, p in enumerate(pages)] + [(8, "http://h2.org/x", pages[8], "t", "h", 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string, n_chars int").repartition(4)
    got = sorted(map(tuple, m.main_text(table).collect()), key=repr)
    assert len(got) == len(rows) and sorted((repr(r[0]), repr(r[1])) for r in got) == sorted((repr(r[0]), repr(r[1])) for r in rows)
    told = {r[0]: r[2] for r in got}
    assert told[0] == told[1] == "" and told[2] == "<" and told[4] == "plain & simple" and told[5] == told[8] == "x" and told[6] == "\n".join(["word"] * 20_000) and told[7] == "deep"
    assert all(r[3] == len(r[2]) for r in got)
    monkeypatch.setattr(m, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, m.main_text(table).collect()), key=repr) == got
    assert not m.main_text(table.limit(0)).collect()
