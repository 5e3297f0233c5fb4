"""Trees of awkward pages, recorded; and what holds for all trees on random ones."""

import random
import time

import pytest

from sitegrain.functions import tags
from sitegrain.functions.tree import Node, parse


def shown(node):
    return "".join(c if isinstance(c, str) else f"<{c.tag}{''.join(f' {k}={v}' for k, v in c.attrs.items())}>{shown(c)}</{c.tag}>" if c.tag not in tags.VOID else f"<{c.tag}>" for c in node.children)


RECORDED = [
    ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
    ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
    ("<b><p></b>x</p>y", "<b></b><p><b></b>x</p>y"),
    ("<a><p></a></p>", "<a></a><p><a></a></p>"),
    ("<p><b>one<p>two</b>three", "<p><b>one</b></p><p><b>two</b>three</p>"),
    ("<p><b><i>x<p>y</i>z", "<p><b><i>x</i></b></p><p><b><i>y</i>z</b></p>"),
    ("<table><b><tr><td>aaa</td></tr>bbb</table>ccc", "<b></b><b>bbb</b><table><tr><td>aaa</td></tr></table><b>ccc</b>"),
    ("<table>x<tr>y<td>z</table>w", "xy<table><tr><td>z</td></tr></table>w"),
    ("<table><tr><td>1<td>2<tr><th>3<table><td>4</table>5<tfoot><tr><td>6</table>", "<table><tr><td>1</td><td>2</td></tr><tr><th>3<table><td>4</td></table>5</th></tr><tfoot><tr><td>6</td></tr></tfoot></table>"),
    ("<table><caption><b>c<tr><td>d</table>", "<table><caption><b>c</b></caption><tr><td>d</td></tr></table>"),
    ("<table><thead><tr><td>h</thead><tbody><tr><td>b</tbody></table>", "<table><thead><tr><td>h</td></tr></thead><tbody><tr><td>b</td></tr></tbody></table>"),
    ("<ul><li>1<ul><li>2<li>3</ul><li>4<p>5</ul>6", "<ul><li>1<ul><li>2</li><li>3</li></ul></li><li>4<p>5</p></li></ul>6"),
    ("<dl><dt>a<dd>b<dt>c<div><dd>d</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c<div></div></dt><dd>d</dd></dl>"),
    ("<li>a<div><li>b</div>c", "<li>a<div></div></li><li>bc</li>"),
    ("<p>a<div>b</p>c</div>d", "<p>a</p><div>bc</div>d"),
    ("<h1>a<h2>b</h1>c", "<h1>a</h1><h2>b</h2>c"),
    ("<select><option>a<option>b<optgroup><option>c</select>d", "<select><option>a</option><option>b</option><optgroup><option>c</option></optgroup></select>d"),
    ("<a href=1>x<a href=2>y</a>z", "<a href=1>x</a><a href=2>y</a>z"),
    ("<a href=1>x<div>y<a href=2>z</a></div>", "<a href=1>x</a><div><a href=1>y</a><a href=2>z</a></div>"),
    ("<button>a<button>b</button>c", "<button>a</button><button>b</button>c"),
    ("</p></b>x</div>", "x"),
    ("<p>x<br>y<img>z<hr>w", "<p>x<br>y<img>z</p><hr>w"),
    ("<title>a <b>&amp;</title><script>x<b></script><p>c", "<title>a <b>&</title><script>x<b></script><p>c</p>"),
    ("<div><span>a<div>b</span>c</div>d", "<div><span>a<div>bc</div>d</span></div>"),
    ("<b>a<b>b<b>c<b>d<p>e", "<b>a<b>b<b>c<b>d<p>e</p></b></b></b></b>"),
    ("<p><b><b><b><b>x<p>y", "<p><b><b><b><b>x</b></b></b></b></p><p><b><b><b>y</b></b></b></p>"),
    ("<td>x<tr>y", "<td>x<tr>y</tr></td>"),
]


@pytest.mark.parametrize("page,want", RECORDED)
def test_recorded_trees(page, want):
    assert shown(parse(page)) == want


@pytest.mark.parametrize("seed", range(60))
def test_random_pages(seed):
    """Texts stay whole and, without tables, in order; each element has one parent; paragraphs hold no blocks, anchors no anchors."""
    draw = random.Random(seed)
    names = ["p", "b", "i", "a", "div", "ul", "li", "em", "h1", "span", "blockquote"] + (["table", "tr", "td", "tbody", "caption"] if seed % 2 else [])
    parts = [draw.choice([f"<{draw.choice(names)}>", f"</{draw.choice(names)}>", f"w{i} "]) for i in range(draw.randint(5, 120))]
    root = parse("".join(parts))
    words = [p for p in parts if p[0] == "w"]
    found = "".join(root.strings()).split()
    assert sorted(found) == sorted(w.strip() for w in words) and (seed % 2 or found == [w.strip() for w in words])
    seen = set()
    for node in [root, *root.walk()]:
        assert id(node) not in seen
        seen.add(id(node))
        for child in node.elements():
            assert child.parent is node
        if node.tag == "p":
            inner, cells = [], [n for n in node.walk() if n.tag in ("td", "caption")]
            outside = {id(x) for c in cells for x in c.walk()}
            inner = [n.tag for n in node.walk() if id(n) not in outside]
            assert seed % 2 or not {"p", "div", "ul", "h1", "blockquote"} & set(inner)


def test_time_stays_in_bounds():
    began = time.time()
    for page in ("<div>" * 20_000 + "x", "<b>" * 3000 + "<p>" * 300, "<p><b>x<br>" * 3000, "<table><tr><td>" * 300, "</b>" * 20_000, "<a>x<p>" * 400, "<li>" * 20_000):
        assert isinstance(parse(page), Node)
    assert time.time() - began < 30
