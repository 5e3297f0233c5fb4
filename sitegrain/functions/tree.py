"""Trees of pages as browsers build them.

Tags that are left out are implied by what follows; formatting that is open where a block ends
goes on in the next one; end tags that cross are taken apart so that elements nest; what stands
in a table between its rows and cells goes before the table. No element is made that the page
does not name: rows stand in their table itself where there is no tbody tag.
"""

from __future__ import annotations

from collections.abc import Iterator

from . import tags

# Kinds of elements, as the standard's tree construction has them.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
ENDS_PARAGRAPH = frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
SCOPE = frozenset("applet caption html marquee object table td template th".split())
_BUTTON_SCOPE = SCOPE | {"button"}
MARKERS = frozenset("applet caption marquee object td th template".split())
ROWS, CELLS = frozenset(("tbody", "tfoot", "thead")), frozenset(("td", "th"))
TABLE_PARTS = ROWS | CELLS | {"caption", "col", "colgroup", "tr"}
#: Where a start tag of a part of a table goes: what is open above these is closed.
TABLE_CONTEXTS = {"caption": ("table",), "colgroup": ("table",), "col": ("table", "colgroup"), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",)}
#: Formatting elements with the same attributes that stay open at most.
ALIKE = 3


class Node:
    """An element: its tag, attributes, and children, which are elements and strings."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], None

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def add(self, child: Node, before: Node | None = None) -> None:
        child.parent = self
        if before is None:
            self.children.append(child)
        else:
            self.children.insert(self._place(before), child)

    def say(self, text: str, before: Node | None = None) -> None:
        """Put text at the end or before a child; it joins text that stands there."""
        at = len(self.children) if before is None else self._place(before)
        if at and isinstance(self.children[at - 1], str):
            self.children[at - 1] += text
        else:
            self.children.insert(at, text)

    def take(self, child: Node) -> None:
        del self.children[self._place(child)]
        child.parent = None

    def _place(self, child: Node) -> int:
        for i in range(len(self.children) - 1, -1, -1):
            if self.children[i] is child:
                return i
        raise ValueError("no child")

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = self.elements()[::-1]
        while stack:
            node = stack.pop()
            yield node
            stack += node.elements()[::-1]

    def strings(self) -> Iterator[str]:
        stack: list = self.children[::-1]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            else:
                stack += item.children[::-1]

    def text(self) -> str:
        """Text below, each piece without space around it."""
        return "".join(s.strip() for s in self.strings())


class _Builder:
    def __init__(self) -> None:
        self.root = Node("", {})
        self.open = [self.root]
        self.paragraphs = False
        self.active: list[Node | None] = []  # open formatting; None is a cell's or the like's border

    # -- places

    def _target(self) -> tuple[Node, Node | None]:
        """Where the next node goes: at the end of the last open element, or before a table that it may not be in."""
        last = self.open[-1]
        if last.tag in ("table", "tr") or last.tag in ROWS:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == "table":
                    table = self.open[i]
                    return (table.parent, table) if table.parent is not None else (self.open[i - 1], None)
        return last, None

    def _put(self, node: Node, at_end: bool = False) -> Node:
        where, before = (self.open[-1], None) if at_end else self._target()
        where.add(node, before)
        return node

    def _has(self, names: frozenset[str] | tuple[str, ...], stops: frozenset[str]) -> bool:
        for node in reversed(self.open):
            if node.tag in names:
                return True
            if node.tag in stops:
                return False
        return False

    def _pop_to(self, names: frozenset[str] | tuple[str, ...]) -> None:
        while len(self.open) > 1:
            if self.open.pop().tag in names:
                return

    def _close_paragraph(self) -> None:
        if self.paragraphs:  # else none has begun since one was last looked for in vain
            if self._has(("p",), _BUTTON_SCOPE):
                self._pop_to(("p",))
            else:
                self.paragraphs = any(n.tag == "p" for n in self.open)

    # -- formatting

    def _reconstruct(self) -> None:
        """Open formatting again that was open where its block ended."""
        if not self.active or self.active[-1] is None or any(n is self.active[-1] for n in self.open):
            return
        i = len(self.active) - 1
        while i > 0 and self.active[i - 1] is not None and not any(n is self.active[i - 1] for n in self.open):
            i -= 1
        for k in range(i, len(self.active)):
            copy = self._put(Node(self.active[k].tag, self.active[k].attrs))
            self.open.append(copy)
            self.active[k] = copy

    def _remember(self, node: Node) -> None:
        alike = []
        for k in range(len(self.active) - 1, -1, -1):
            if self.active[k] is None:
                break
            if self.active[k].tag == node.tag and self.active[k].attrs == node.attrs:
                alike.append(k)
        if len(alike) >= ALIKE:
            del self.active[alike[-1]]
        self.active.append(node)

    def _clear_to_marker(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def _last_active(self, tag: str) -> Node | None:
        for node in reversed(self.active):
            if node is None:
                return None
            if node.tag == tag:
                return node
        return None

    def _drop_active(self, node: Node) -> None:
        self.active = [n for n in self.active if n is not node]

    def _adopt(self, tag: str) -> None:
        """End a formatting element: blocks that began in it are taken out, with its formatting inside them."""
        if self.open[-1].tag == tag and not any(n is self.open[-1] for n in self.active):
            self.open.pop()
            return
        for _ in range(8):
            formatting = self._last_active(tag)
            if formatting is None:
                self._end_other(tag)
                return
            at = next((i for i, n in enumerate(self.open) if n is formatting), -1)
            if at < 0:
                self._drop_active(formatting)
                return
            if any(n.tag in SCOPE for n in self.open[at + 1 :]):
                return
            block_at = next((i for i in range(at + 1, len(self.open)) if self.open[i].tag in SPECIAL), -1)
            if block_at < 0:
                del self.open[at:]
                self._drop_active(formatting)
                return
            block, above = self.open[block_at], self.open[at - 1]
            mark = next(i for i, n in enumerate(self.active) if n is formatting)
            last, i, inner = block, block_at, 0
            while True:
                inner, i = inner + 1, i - 1
                node = self.open[i]
                if node is formatting:
                    break
                place = next((k for k, n in enumerate(self.active) if n is node), -1)
                if place >= 0 and inner > 3:
                    del self.active[place]
                    mark -= place < mark
                    place = -1
                if place < 0:
                    del self.open[i]
                    continue
                copy = Node(node.tag, node.attrs)
                self.active[place] = self.open[i] = copy
                if last is block:
                    mark = place + 1
                if last.parent is not None:
                    last.parent.take(last)
                copy.add(last)
                last = copy
            if last.parent is not None:
                last.parent.take(last)
            if above.tag in ("table", "tr") or above.tag in ROWS:
                kept, self.open = self.open, self.open[:at]
                self._put(last)
                self.open = kept
            else:
                above.add(last)
            copy = Node(formatting.tag, formatting.attrs)
            for child in block.children:
                if isinstance(child, Node):
                    child.parent = copy
            copy.children, block.children = block.children, []
            block.add(copy)
            before = next(k for k, n in enumerate(self.active) if n is formatting)
            del self.active[before]
            self.active.insert(mark - (before < mark), copy)
            self.open = [n for n in self.open if n is not formatting]
            self.open.insert(next(k for k, n in enumerate(self.open) if n is block) + 1, copy)

    # -- tokens

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in TABLE_PARTS and self._has(("table",), frozenset(("html", "template"))):
            self._start_part(tag, attrs)
            return
        if tag in ENDS_PARAGRAPH:
            self._close_paragraph()
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.open.pop()
        elif tag in ("li", "dd", "dt"):
            own = ("li",) if tag == "li" else ("dd", "dt")
            for node in reversed(self.open):
                if node.tag in own:
                    self._pop_to((node.tag,))
                    break
                if node.tag in SPECIAL and node.tag not in ("address", "div", "p"):
                    break
            self._close_paragraph()
        elif tag in ("option", "optgroup"):
            if self.open[-1].tag == "option":
                self.open.pop()
            if tag == "optgroup" and self.open[-1].tag == "optgroup":
                self.open.pop()
        elif tag == "button" and self._has(("button",), SCOPE):
            self._pop_to(("button",))
        elif tag == "a" and (old := self._last_active("a")) is not None:
            self._adopt("a")
            self._drop_active(old)
            self.open = [n for n in self.open if n is not old]
        elif tag == "nobr" and self._has(("nobr",), SCOPE):
            self._adopt("nobr")
        elif tag == "body" and any(n.tag == "body" for n in self.open) or tag == "html" and any(n.tag == "html" for n in self.open):
            return
        if tag not in ENDS_PARAGRAPH and tag not in ("html", "head", "body", "title", "meta", "link", "base", "script", "style", "frameset"):
            self._reconstruct()
        node = self._put(Node(tag, attrs), at_end=tag in ("script", "style", "template", "form") and not attrs.get("type") == "hidden")
        if tag in tags.VOID:
            return
        self.open.append(node)
        self.paragraphs |= tag == "p"
        if tag in FORMATTING:
            self._remember(node)
        elif tag in MARKERS:
            self.active.append(None)

    def _start_part(self, tag: str, attrs: dict[str, str]) -> None:
        """A part of the table that is open last: what is open in it is closed as far as needed."""
        contexts = TABLE_CONTEXTS[tag]
        if tag in CELLS and not self._has(("tr",), frozenset(("table", "template"))):
            contexts = ("table", *ROWS)  # a cell without a row stands in its table
        while len(self.open) > 1 and self.open[-1].tag not in contexts and self.open[-1].tag not in ("html", "template"):
            if self.open.pop().tag in MARKERS:
                self._clear_to_marker()
        self.open[-1].add(node := Node(tag, attrs))
        if tag not in tags.VOID:
            self.open.append(node)
            if tag in MARKERS:
                self.active.append(None)

    def end(self, tag: str) -> None:
        if tag in FORMATTING:
            self._adopt(tag)
        elif tag in ("html", "body"):
            return  # what follows still belongs there
        elif tag in HEADINGS:
            if self._has(HEADINGS, SCOPE):
                self._pop_to(HEADINGS)
        elif tag == "p":
            self._close_paragraph()
        elif tag in TABLE_PARTS or tag == "table":
            if self._has((tag,), frozenset(("html", "template")) | (frozenset() if tag == "table" else {"table"})):
                while self.open[-1].tag != tag:
                    if self.open.pop().tag in MARKERS:
                        self._clear_to_marker()
                self.open.pop()
                if tag in MARKERS:
                    self._clear_to_marker()
        elif tag in MARKERS:
            if self._has((tag,), SCOPE):
                self._pop_to((tag,))
                self._clear_to_marker()
        elif tag in SPECIAL:
            if self._has((tag,), SCOPE | (frozenset(("ol", "ul")) if tag == "li" else frozenset())):
                self._pop_to((tag,))
        else:
            self._end_other(tag)

    def _end_other(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in SPECIAL:
                return

    def text(self, data: str) -> None:
        if not data.strip(" \t\n\f\r"):
            self.open[-1].say(data)  # space stays where it is
            return
        self._reconstruct()
        where, before = self._target()
        where.say(data, before)


def parse(page: str | None) -> Node:
    """A page's tree; what is not closed ends with the element around it."""
    builder = _Builder()
    for kind, name, source in tags.scan(page or ""):
        if kind == tags.TEXT:
            builder.text(tags.closed_text_of(source))
        elif kind == tags.START:
            builder.start(name, tags.attributes(source) if source else {})
        elif kind == tags.END:
            builder.end(name)
        elif source:
            builder.open[-1].say(tags.closed_text_of(source) if name in tags.ESCAPED_TEXT else source)
    return builder.root
