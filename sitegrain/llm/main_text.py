"""Operator 13: main text of pages by wrappers, union-free regular expressions inferred per host.

A page is a tree of block elements with text slots; inline markup is part of the text. Within a
list of siblings, a label that comes again makes an iterator: the stretches that begin with it
are aligned with each other into one repeated body. Two pages, or two wrappers, are merged by
aligning their sibling lists: what only one side has becomes optional, and a slot whose
texts differ is a variable one. So a wrapper has sequences, optional parts, repeated
parts and slots, but no alternatives, and at each level every label once. Labels are tags with their
classes; where a level would have over ``WIDE`` of them, they are tags alone, so a wrapper's size
does not grow with the pages that made it.

Merging is the same step for pages and wrappers: tasks merge the pages of each host that they
read, and only these partial wrappers are shuffled and merged, first in salted groups, then by
host. A host with a third of all pages costs its tasks no more than others. A wrapper's parts
are then marked: articles; and, for pages without one, what differs between the host's pages
and is no list of links. Every page is aligned with its host's wrapper, and gives the text of
the slots that are marked.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tags
from .runtime import hot_keys, join_hot, materialize, text_runs

# What elements are, by their names, roles and the words of their classes.
BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Not looked into; they stand in lines of text, which they do not end.
SKIPPED = frozenset("applet audio button canvas datalist embed iframe meter noscript object optgroup option output progress select svg template video".split())
UNWANTED_TAGS = frozenset("aside dialog fieldset footer head menu nav search".split())
UNWANTED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar tooltip".split())
UNWANTED_WORDS = frozenset(
    "ad ads adsense adslot advert advertisement advertising adverts breadcrumb breadcrumbs comment commentlist comments disqus footer menubar nav navbar navigation pagination promo promotion recommended related replies reply respond sidebar sponsor sponsored widget".split()
)
#: Unwanted, but for elements that an article or a page's whole text is in.
SOFT_TAGS = frozenset(("form",))
SOFT_WORDS = frozenset("banner consent cookie cookies gdpr menu modal newsletter notice notices overlay pager popup share sharing signup social subscribe subscription toolbar".split())
#: Outside an article these are unwanted; inside, all but their headings is.
HEADER_WORDS = frozenset(("header", "masthead"))
#: An article is unwanted for these words alone.
ARTICLE_WORDS = frozenset("ad ads advert advertisement adverts comment comments replies reply".split())
NEGATING_WORDS = frozenset("has is no not with without".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements whose classes and ids tell them apart.
CONTAINERS = frozenset("article aside body div dl footer form header main nav ol section table ul".split())
ENDS_PARAGRAPH = BLOCKS - frozenset("body caption col colgroup dd dt head html legend li tbody td tfoot th thead tr".split()) | frozenset(("dd", "dt", "li"))
#: What a start tag ends, up to which elements.
ENDED_BY = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)), "thead": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
}
CELLS = frozenset(("td", "th", "caption", "table"))
IN_HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())

TEXT, ELEMENT, GROUP = range(3)
MARKS = "!~^*"
#: A page's main region holds this share of its variable text, and lists of links have more than half of theirs in links.
REGION, LINKED = 0.9, 0.5
#: A sibling list with more labels than this loses their classes; elements that are nested deeper than that count as their parents.
WIDE, DEEPEST = 48, 200
#: Room for trees of that depth, with their groups.
RECURSION = 20_000
#: A task hands its partial wrappers on when it holds so many of them.
MOST_HOSTS = 2000
SLOTS = 64
#: Wrappers are broadcast up to so many bytes in all, and joined by host above.
BROADCAST_BYTES = 32 << 20
_CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Part:
    """A part of a wrapper or of a page: a text slot, an element, or a repeated group of several parts.

    ``value`` is a slot's text as a digest, or None once texts differ; ``leaves`` are a page's
    own texts in it. ``main`` and ``wanted`` are the marks of a finished wrapper.
    """

    __slots__ = ("kind", "label", "parts", "optional", "repeated", "value", "chars", "linked", "leaves", "main", "wanted")

    def __init__(self, kind: int, label: str, parts: list[Part] | None = None):
        self.kind, self.label, self.parts = kind, label, parts if parts is not None else []
        self.optional = self.repeated = self.main = self.wanted = False
        self.value, self.chars, self.linked, self.leaves = None, 0, 0, []

    def __getstate__(self) -> tuple:
        return self.kind, self.label, self.parts, self.optional, self.repeated, self.value, self.chars, self.linked, self.main, self.wanted

    def __setstate__(self, state: tuple) -> None:
        self.kind, self.label, self.parts, self.optional, self.repeated, self.value, self.chars, self.linked, self.main, self.wanted = state
        self.leaves = []

    def __str__(self) -> str:
        inner = " ".join(map(str, self.parts))
        text = ("#" if self.value is None else "'") if self.kind == TEXT else f"<{self.label}>{inner}</>" if self.kind == ELEMENT else f"({inner})"
        return text + ("*" if self.repeated and self.optional else "+" if self.repeated else "?" if self.optional else "")


def _named(own: dict[str, str], words: frozenset[str]) -> bool:
    """Whether a class or the id of an element has one of ``words``, and none that negates it."""
    for name in f"{own.get('class', '')} {own.get('id', '')}".split():
        found = {w.lower() for w in _CAMEL.findall(name)}
        if not NEGATING_WORDS & found and words & found:
            return True
    return False


def _hidden(own: dict[str, str]) -> bool:
    return "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()


def _label(tag: str, own: dict[str, str]) -> str:
    """A label: the tag, of containers the first class or the id too, and a mark.

    ! is on what is no part of an article by its name, its role or the words of its classes, ~
    on what is none unless an article is in it, ^ on headers, * on main parts.
    """
    if tag in ("body", "html"):
        return tag
    role = own.get("role", "").strip().lower()
    main = tag in ("article", "main") or role in ("main", "article") or "articlebody" in own.get("itemprop", "").lower()
    if tag in UNWANTED_TAGS or own and (role in UNWANTED_ROLES or _hidden(own) or tag != "main" and _named(own, ARTICLE_WORDS if main else UNWANTED_WORDS)):
        mark = "!"
    elif main:
        mark = "*"
    elif tag == "header" or own and _named(own, HEADER_WORDS):
        mark = "^"
    else:
        mark = "~" if tag in SOFT_TAGS or own and _named(own, SOFT_WORDS) else ""
    names = [n for n in (own.get("class", "").split()[:1] or [f"#{own.get('id', '').strip()}"]) if n != "#" and not any(c.isdigit() for c in n)] if own and mark != "*" and tag in CONTAINERS else []
    return ".".join([tag, *names]) + mark


def _coarse(label: str) -> str:
    """A label without its class."""
    tag, _, name = label.partition(".")
    return tag + name[-1] if name and name[-1] in MARKS else tag


class Page:
    """A page's tree of block elements, and its texts in page order."""

    def __init__(self, html: str | None):
        self.root = Part(ELEMENT, "html")
        self.texts: list[str] = []
        self._open, self._names = [self.root], ["html"]
        self._run: list[str] = []
        self._linked, self._link_depth, self._skipping, self._skipped = 0, 0, "", 0
        for kind, name, source in tags.scan(html or ""):
            if self._skipping:
                if kind == tags.START and name == self._skipping:
                    self._skipped += 1
                elif kind == tags.END and name == self._skipping:
                    self._skipped -= 1
                    if not self._skipped:
                        self._skipping = ""
            elif kind == tags.TEXT:
                self._add(tags.text_of(source))
            elif kind == tags.START:
                self._start(name, source)
            elif kind == tags.END:
                self._end(name)
        self._flush()

    def _add(self, text: str) -> None:
        if "head" in self._names[:3] and text.strip():
            self._pop(self._names.index("head"))
        self._run.append(text)
        if self._link_depth:
            self._linked += len(text)

    def _flush(self) -> None:
        if not self._run:
            return
        text = " ".join("".join(self._run).split())
        if text:
            slot = Part(TEXT, "#")
            slot.value, slot.chars, slot.linked = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), len(text), min(self._linked, len(text))
            slot.leaves = [len(self.texts)]
            self.texts.append(text)
            self._open[-1].parts.append(slot)
        self._run, self._linked = [], 0

    def _pop(self, at: int) -> None:
        """Close the element at place ``at`` of the open ones, and all in it."""
        self._flush()
        del self._open[at:], self._names[at:]
        if self._link_depth > len(self._open):
            self._link_depth = 0

    def _close(self, names: tuple[str, ...], stops: tuple[str, ...] | frozenset[str]) -> None:
        for i in range(len(self._names) - 1, 0, -1):
            if self._names[i] in names:
                self._pop(i)
                return
            if self._names[i] in stops:
                return

    def _start(self, name: str, source: str) -> None:
        if name not in IN_HEAD and "head" in self._names[:3]:
            self._pop(self._names.index("head"))
        if name in SKIPPED:
            if name != "embed":
                self._skipping, self._skipped = name, 1
        elif name == "br":
            self._run.append(" ")
        elif name == "a":
            self._link_depth = len(self._open)
        elif name in BLOCKS and name != "html" and not (name == "body" and "body" in self._names):
            self._flush()
            if name in ENDS_PARAGRAPH:
                self._close(("p",), CELLS)
            if name in ENDED_BY:
                self._close(*ENDED_BY[name])
            if len(self._open) < DEEPEST:
                part = Part(ELEMENT, _label(name, tags.attributes(source) if "=" in source or "hidden" in source else {}))
                self._open[-1].parts.append(part)
            else:
                part = self._open[-1]
            if name not in tags.VOID:
                self._open.append(part)
                self._names.append(name)

    def _end(self, name: str) -> None:
        if name == "a":
            self._link_depth = 0
        elif name in HEADINGS:
            self._close(tuple(HEADINGS), CELLS)
        elif name in BLOCKS and name not in ("html", "body"):
            self._close((name,), () if name in CELLS or name in ("tr", "thead", "tbody", "tfoot") else CELLS)

    def folded(self) -> Part:
        """The tree as a wrapper of this page alone."""
        return _settled(self.root)


def _settled(root: Part) -> Part:
    """Fold all sibling lists of a tree, the deepest first, without recursion over its depth."""
    order, stack = [], [root]
    while stack:
        part = stack.pop()
        order.append(part)
        stack += [p for p in part.parts if p.kind != TEXT]
    for part in reversed(order):
        part.parts = _folded(part.parts)
    return root


def _folded(parts: list[Part]) -> list[Part]:
    """A sibling list in which each label stands once: stretches from one to the next of a label become a repeated part."""
    while True:
        places: dict[str, list[int]] = {}
        for i, p in enumerate(parts):
            places.setdefault(p.label, []).append(i)
        if len(places) == len(parts):
            return parts
        label = max(places, key=lambda k: (len(places[k]), -places[k][0]))
        at = places[label]
        inner = {p.label for p in parts[at[0] : at[-1]]}
        end = at[-1] + 1
        while end < len(parts) and parts[end].label in inner:
            end += 1
        body: list[Part] | None = None
        for a, b in zip(at, [*at[1:], end]):
            stretch = _folded(parts[a:b]) if b - a > 1 else parts[a:b]
            body = stretch if body is None else _combined(body, stretch)
        if len(body) == 1:
            made = body[0]
        elif body[0].kind == GROUP and body[0].label == label:
            made = body[0]
            made.parts = _combined(made.parts, body[1:])
        else:
            made = Part(GROUP, label, body)
        made.repeated = True
        parts = [*parts[: at[0]], made, *parts[end:]]


def _pairs(a: list[Part], b: list[Part]) -> list[tuple[int, int]]:
    """Places of a longest common sequence of labels; in each list a label stands once."""
    where = {p.label: j for j, p in enumerate(b)}
    common = [(i, where[p.label]) for i, p in enumerate(a) if p.label in where]
    if all(x[1] < y[1] for x, y in zip(common, common[1:])):
        return common
    best: list[tuple[int, int]] = []  # length of the longest line that ends here, and where it came from
    for k, (_, j) in enumerate(common):
        best.append(max(((best[m][0] + 1, m) for m in range(k) if common[m][1] < j), default=(1, -1)))
    k, out = max(range(len(best)), key=lambda m: (best[m][0], -m)), []
    while k >= 0:
        out.append(common[k])
        k = best[k][1]
    return out[::-1]


def _combined(a: list[Part], b: list[Part]) -> list[Part]:
    """Two sibling lists aligned into one; what one of them lacks is optional."""
    out, i, j = [], 0, 0
    for x, y in [*_pairs(a, b), (len(a), len(b))]:
        for p in (*a[i:x], *b[j:y]):
            p.optional = True
            out.append(p)
        if x < len(a):
            out.append(merged(a[x], b[y]))
        i, j = x + 1, y + 1
    if len(out) > WIDE:
        for p in out:
            p.label = _coarse(p.label)
    return _folded(out)


def merged(a: Part, b: Part) -> Part:
    """Two parts of one label as one; ``a`` and ``b`` are used up."""
    if a.kind == TEXT and b.kind == TEXT:
        a.value = a.value if a.value == b.value else None
        a.leaves += b.leaves
    elif a.kind == b.kind:
        a.parts = _combined(a.parts, b.parts)
    else:
        if b.kind == GROUP:
            a, b = b, a
        a.parts = _combined(a.parts, [b])
    a.optional, a.repeated = a.optional or b.optional, a.repeated or b.repeated
    a.chars, a.linked = a.chars + b.chars, a.linked + b.linked
    return a


def mark(wrapper: Part, pages: int) -> Part:
    """Mark a wrapper's parts: ``main`` in articles, ``wanted`` for pages without one.

    Articles inside what is unwanted do not count, nor main parts around articles; of a header
    in an article the headings count alone. For other pages a slot is wanted in the least
    element that has most of the plain text outside of articles, unless it is in a list of links, or is the same
    on all pages while most text differs.
    """
    sums: dict[int, list] = {}  # of a part: chars, linked, plain chars, those that differ between pages, and whether a main part is in it

    def add_up(part: Part, unwanted: bool, soft: bool) -> list:
        ends = part.label[-1:]
        unwanted = unwanted or ends == "!"
        if part.kind == TEXT:
            plain = 0 if unwanted else part.chars - part.linked
            out = [part.chars, part.linked, plain, plain if part.value is None else 0, False]
        else:
            inner = [add_up(p, unwanted, soft) for p in part.parts]
            out = [*(sum(x[i] for x in inner) for i in range(4)), ends == "*" and not unwanted or any(x[4] for x in inner)]
            if ends == "*" or ends and ends in "~^" and not soft and not out[4]:
                out[2:4] = 0, 0
        sums[id(part)] = out
        return out

    whole = add_up(wrapper, False, False)
    soft = not whole[2]
    if soft:
        whole = add_up(wrapper, False, True)
    telling = pages > 1 and 2 * whole[3] >= whole[2]
    at = 3 if telling else 2
    region, around = wrapper, {id(wrapper)}
    while inner := [p for p in region.parts if p.kind != TEXT and sums[id(p)][at] >= REGION * whole[at] > 0]:
        region = inner[0]
        around.add(id(region))

    def walk(part: Part, main: bool, wanted: bool, header: bool, heading: bool) -> None:
        chars, linked, _, _, holds = sums[id(part)]
        tag, ends = _coarse(part.label).rstrip(MARKS), part.label[-1:]
        if part.kind == ELEMENT:
            heading = heading or tag in HEADINGS
            wanted = wanted or part is region
            main = main or ends == "*" and holds and not any(sums[id(p)][4] for p in part.parts)
            if ends == "^" and main:
                header = True
            elif ends == "!" or ends and ends in "~^" and not holds and id(part) not in around:
                main = wanted = False
            if tag in ("ul", "ol", "dl", "div", "section", "p", "table") and linked > LINKED * chars:
                wanted = False
        part.main = main and (not header or heading)
        part.wanted = wanted and (part.kind != TEXT or not telling or part.value is None)
        for p in part.parts:
            walk(p, main, wanted, header, heading)

    walk(wrapper, False, wrapper is region, False, False)
    return wrapper


def text_by(wrapper: Part, page: Page) -> str:
    """A page's main text: its texts in the slots of its host's wrapper that are marked.

    Parts that the wrapper has nowhere count as what is around them, unless they are unwanted
    themselves.
    """
    kept: list[tuple[bool, bool]] = [(False, False)] * len(page.texts)

    def take(part: Part, main: bool, wanted: bool) -> None:
        if part.label[-1:] and part.label[-1] in "!~^":
            main = wanted = False
        for leaf in part.leaves:
            kept[leaf] = main, wanted
        for p in part.parts:
            take(p, main, wanted)

    def walk(held: list[Part], parts: list[Part], main: bool, wanted: bool) -> None:
        named = {p.label: p for p in held}
        for part in parts:
            own = named.get(part.label) or named.get(_coarse(part.label))
            if own is None:
                inner = next((p for p in held if p.kind == GROUP and any(q.label == part.label for q in p.parts)), None)
                if inner is None:
                    take(part, main, wanted)
                else:
                    walk(inner.parts, [part], inner.main, inner.wanted)
            elif part.kind == TEXT:
                for leaf in part.leaves:
                    kept[leaf] = own.main, own.wanted
            elif own.kind == part.kind:
                walk(own.parts, part.parts, own.main, own.wanted)
            elif own.kind == GROUP:
                walk(own.parts, [part], own.main, own.wanted)
            else:
                walk([own], part.parts, main, wanted)

    walk(wrapper.parts, page.folded().parts, wrapper.main, wrapper.wanted)
    found = 0 if any(main for main, _ in kept) else 1
    return "\n".join(text for text, marks in zip(page.texts, kept) if marks[found])


def host_of(url: Column) -> Column:
    """A URL's host; an empty one where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """The marked wrapper of each host of ``pages`` (host, html): host, and the wrapper as bytes.

    Whether a host's pages are all the same is told by their least and greatest digest. The
    order of merging is that of the pages as they are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        made, task = 0, TaskContext.get().partitionId()

        def hand_on() -> pa.RecordBatch:
            nonlocal held, made
            rows = [(host, (made + i) % SLOTS, task, made + i, lo, hi, pickle.dumps(part)) for i, (host, (part, lo, hi)) in enumerate(held.items())]
            made += len(held)
            held = {}
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["host", "slot", "task", "at", "lo", "hi", "wrapper"])

        sys.setrecursionlimit(RECURSION)
        for batch in batches:
            for part in text_runs(batch, "html"):
                for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                    digest = hashlib.blake2b((html or "").encode("utf-8", "surrogatepass"), digest_size=8).digest()
                    known = held.get(host)
                    if known is None:
                        held[host] = [_bare(Page(html).folded()), digest, digest]
                    elif digest not in known[1:]:
                        held[host] = [merged(known[0], _bare(Page(html).folded())), min(known[1], digest), max(known[2], digest)]
            if len(held) >= MOST_HOSTS:
                yield hand_on()
        if held:
            yield hand_on()

    def join(group: pd.DataFrame, last: bool) -> pd.DataFrame:
        sys.setrecursionlimit(RECURSION)
        group = group.sort_values(["task", "at"], kind="stable")
        whole, lo, hi = None, group["lo"].min(), group["hi"].max()
        for held in group["wrapper"]:
            part = pickle.loads(held)
            whole = part if whole is None else merged(whole, part)
        first = group.iloc[:1].copy()
        first["lo"], first["hi"], first["wrapper"] = lo, hi, [pickle.dumps(mark(whole, 1 + (lo != hi)) if last else whole)]
        return first

    form = "host string, slot int, task int, at bigint, lo binary, hi binary, wrapper binary"
    parts = pages.select("host", "html").mapInArrow(run, form)
    salted = parts.groupBy("host", "slot").applyInPandas(lambda g: join(g, False), form)
    return salted.groupBy("host").applyInPandas(lambda g: join(g, True), form).select("host", "wrapper")


def _bare(part: Part) -> Part:
    """A page's wrapper without its texts' places."""
    stack = [part]
    while stack:
        p = stack.pop()
        p.leaves = []
        stack += p.parts
    return part


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    Blocks of text stand in page order, one a line, with characters resolved and white space
    as single spaces. A page without main text, an empty or a null page has an empty text. Pages
    without a URL or a host form a host of their own; rows that repeat a page_id are pages of
    their own; pages of any length are taken whole. A host with one page has its own form as
    wrapper. Other columns are ignored, whatever their names. An empty table gives an empty table.
    """
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    made = materialize(wrappers(rows), "wrappers")
    size = made.agg(F.sum(F.length("wrapper"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(RECURSION)
        held: tuple[bytes | None, Part | None] = (None, None)
        for batch in batches:
            for part in text_runs(batch, "html"):
                out = []
                for html, wrapper in zip(part.column("html").to_pylist(), part.column("wrapper")):
                    wrapper = wrapper.as_py()
                    if wrapper != held[0]:
                        held = wrapper, pickle.loads(wrapper)
                    out.append(text_by(held[1], Page(html)))
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(made), "host")
    else:
        counts = rows.groupBy("host").agg(F.count("*").alias("_n"))
        joined = join_hot(rows, made, ["host"], hot_keys(counts, rows.count()), F.col("page_id"))
    kind = lambda c: pages.schema[c].dataType.simpleString()
    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(run, f"page_id {kind('page_id')}, url string, text string, n_chars bigint")
