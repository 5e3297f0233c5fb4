"""CSS selectors, compiled, and found for many selectors in one walk over a tree.

A selector is a list of chains; a chain is compounds (tag, id, classes, attributes, places
among siblings) joined by descendant, child and sibling combinators. A walk asks at each
element only for the chains whose last compound names its id, one of its classes or its tag,
leaves those whose other compounds need an id, class or tag that no element around it has, and
checks the rest from right to left.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from typing import TYPE_CHECKING

if TYPE_CHECKING:
    from .tree import Node

_NAME = r"(?:[\w-]|[^\x00-\x7f]|\\[0-9a-fA-F]{1,6}[ \t\n]?|\\.)+"
_TOKEN = re.compile(
    rf"""(?P<space>[ \t\n\r\f]*(?P<join>[>+~,])[ \t\n\r\f]*|[ \t\n\r\f]+)|(?P<tag>\*|{_NAME})|\#(?P<id>{_NAME})|\.(?P<class>{_NAME})
    |\[[ \t\n]*(?P<attr>{_NAME})[ \t\n]*(?:(?P<op>[~|^$*]?=)[ \t\n]*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>{_NAME}))[ \t\n]*(?P<flag>[iIsS])?[ \t\n]*)?\]
    |:(?P<pseudo>{_NAME})(?P<args>\()?""",
    re.X,
)
_NTH = re.compile(r"\s*(?:(odd)|(even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*$", re.I)


@dataclass
class Spot:
    """An element on the walk: with those around it and its place among its siblings."""

    node: Node
    above: Spot | None
    place: int
    siblings: list[Node]
    known: dict[tuple[int, int], bool] = field(default_factory=dict)

    def beside(self, place: int) -> Spot:
        return Spot(self.siblings[place], self.above, place, self.siblings)


Test = Callable[[Spot], bool]


@dataclass
class Compound:
    tag: str = ""
    id: str = ""
    classes: list[str] = field(default_factory=list)
    tests: list[Test] = field(default_factory=list)

    def fits(self, spot: Spot) -> bool:
        node = spot.node
        return (
            (not self.tag or self.tag == node.tag)
            and (not self.id or node.attrs.get("id") == self.id)
            and all(c in node.classes for c in self.classes)
            and all(t(spot) for t in self.tests)
        )

    def names(self) -> list[str]:
        """What an element that fits is sure to have: #id, .classes and the tag."""
        return [*([f"#{self.id}"] if self.id else []), *(f".{c}" for c in self.classes), *([self.tag] if self.tag else [])]


@dataclass
class Chain:
    """Compounds from left to right, and the combinator before each but the first."""

    compounds: list[Compound]
    joins: list[str]

    def around(self) -> list[str]:
        """Names that elements around a match must have."""
        out = []
        for k in range(len(self.joins) - 1, -1, -1):
            if self.joins[k] in " >":
                out += self.compounds[k].names()
        return out

    def fits(self, spot: Spot, k: int | None = None) -> bool:
        """Whether the chain up to its k-th compound ends at an element; each answer is kept."""
        k = len(self.compounds) - 1 if k is None else k
        key = id(self), k
        if key not in spot.known:
            spot.known[key] = self.compounds[k].fits(spot) and (k == 0 or self._before(spot, k))
        return spot.known[key]

    def _before(self, spot: Spot, k: int) -> bool:
        join = self.joins[k - 1]
        if join == "+":
            return spot.place > 0 and self.fits(spot.beside(spot.place - 1), k - 1)
        if join == "~":
            return any(self.fits(spot.beside(i), k - 1) for i in range(spot.place - 1, -1, -1))
        at = spot.above
        while at is not None:
            if self.fits(at, k - 1):
                return True
            if join == ">":
                return False
            at = at.above
        return False


def _plain(name: str) -> str:
    """A name with its escapes resolved."""
    return re.sub(r"\\(?:([0-9a-fA-F]{1,6})[ \t\n]?|(.))", lambda m: chr(int(m[1], 16)) if m[1] else m[2], name)


def _attribute(name: str, op: str | None, value: str, fold: bool) -> Test:
    name, wanted = name.lower(), value.lower() if fold else value

    def test(spot: Spot) -> bool:
        own = spot.node.attrs.get(name)
        if own is None or op is None:
            return own is not None
        own = own.lower() if fold else own
        if op == "=":
            return own == wanted
        if op == "~=":
            return wanted in own.split() and " " not in wanted
        if op == "|=":
            return own == wanted or own.startswith(f"{wanted}-")
        return bool(wanted) and (own.startswith(wanted) if op == "^=" else own.endswith(wanted) if op == "$=" else wanted in own)

    return test


def _nth(text: str, last: bool, typed: bool) -> Test:
    found = _NTH.match(text)
    if not found:
        raise ValueError(f"no place among siblings: {text!r}")
    odd, even, step, sign, shift, only = found.groups()
    a, b = (2, 1) if odd else (2, 0) if even else (0, int(only)) if only else (int(step + "1" if step in ("", "+", "-") else step), int(f"{sign}{shift}") if shift else 0)

    def test(spot: Spot) -> bool:
        row = spot.siblings[spot.place + 1 :] if last else spot.siblings[: spot.place]
        n = 1 + (sum(x.tag == spot.node.tag for x in row) if typed else len(row))
        return n == b if a == 0 else (n - b) % a == 0 and (n - b) // a >= 0

    return test


_PLACES = {"first-child": ("1", False, False), "last-child": ("1", True, False), "first-of-type": ("1", False, True), "last-of-type": ("1", True, True)}
_COUNTED = {"nth-child": (False, False), "nth-last-child": (True, False), "nth-of-type": (False, True), "nth-last-of-type": (True, True)}


def _pseudo(name: str, argument: str | None) -> list[Test]:
    if argument is None and name in _PLACES:
        return [_nth(*_PLACES[name])]
    if argument is None and name in ("only-child", "only-of-type"):
        return [_nth("1", last, name == "only-of-type") for last in (False, True)]
    if argument is None and name == "empty":
        return [lambda s: not any(not isinstance(c, str) or c for c in s.node.children)]
    if argument is None and name == "root":
        return [lambda s: s.above is None]
    if argument is not None and name in _COUNTED:
        return [_nth(argument, *_COUNTED[name])]
    if argument is not None and name in ("not", "is", "where"):
        chains = compiled(argument)
        return [(lambda s: not any(c.fits(s) for c in chains)) if name == "not" else (lambda s: any(c.fits(s) for c in chains))]
    raise ValueError(f"unknown pseudo-class :{name}")


def _closing(text: str, at: int) -> int:
    """Place of the bracket that closes the one before ``at``."""
    depth, quote = 1, ""
    for i in range(at, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
            if not depth:
                return i
    raise ValueError(f"a bracket is not closed: {text!r}")


@lru_cache(4096)
def compiled(selector: str) -> tuple[Chain, ...]:
    """The chains of a selector list; a ValueError where it is none."""
    text, at = selector.strip(" \t\n\r\f"), 0
    chains: list[Chain] = []
    now, joins, own, begun = [], [], Compound(), False
    while at < len(text):
        found = _TOKEN.match(text, at)
        if not found or found["tag"] and begun:
            raise ValueError(f"no selector: {selector!r}")
        at = found.end()
        if found["space"] is not None:
            if not begun:
                raise ValueError(f"no selector: {selector!r}")
            now.append(own)
            own, begun = Compound(), False
            if found["join"] == ",":
                chains.append(Chain(now, joins))
                now, joins = [], []
            else:
                joins.append(found["join"] or " ")
            continue
        begun = True
        if found["tag"]:
            own.tag = "" if found["tag"] == "*" else _plain(found["tag"]).lower()
        elif found["id"]:
            if own.id and own.id != _plain(found["id"]):
                own.tests.append(lambda s: False)
            own.id = _plain(found["id"])
        elif found["class"]:
            own.classes.append(_plain(found["class"]))
        elif found["attr"]:
            value = next((found[g] for g in ("dq", "sq") if found[g] is not None), None)
            own.tests.append(_attribute(_plain(found["attr"]), found["op"], _plain(found["bare"] or "") if value is None else value, (found["flag"] or "").lower() == "i"))
        else:
            argument = None
            if found["args"]:
                end = _closing(text, at)
                argument, at = text[at:end], end + 1
            own.tests += _pseudo(found["pseudo"].lower(), argument)
    if not begun:
        raise ValueError(f"no selector: {selector!r}")
    return (*chains, Chain([*now, own], joins))


class Finder:
    """Finds the elements of many selectors in one walk."""

    def __init__(self, selectors: tuple[str, ...]):
        self.selectors = selectors
        self.lists: dict[str, list[tuple[int, Chain, list[str]]]] = {}
        for i, selector in enumerate(selectors):
            for chain in compiled(selector):
                names = chain.compounds[-1].names()
                self.lists.setdefault(names[0] if names else "", []).append((i, chain, chain.around()))

    def find(self, root: Node) -> list[list[Node]]:
        """For each selector its elements below ``root``, in document order."""
        found: list[list[Node]] = [[] for _ in self.selectors]
        around: Counter[str] = Counter()
        own = root.elements()
        stack: list[tuple[Spot, bool]] = [(Spot(n, None, i, own), False) for i, n in reversed(list(enumerate(own)))]
        while stack:
            spot, left = stack.pop()
            node = spot.node
            names = [*([f"#{node.attrs['id']}"] if node.attrs.get("id") else []), *(f".{c}" for c in dict.fromkeys(node.classes)), node.tag]
            if left:
                around.subtract(names)
                continue
            hit: set[int] = set()
            for name in (*names, ""):
                for i, chain, needed in self.lists.get(name, ()):
                    if i not in hit and all(around[n] > 0 for n in needed) and chain.fits(spot):
                        hit.add(i)
            for i in hit:
                found[i].append(node)
            below = node.elements()
            if below:
                around.update(names)
                stack.append((spot, True))
                stack += [(Spot(n, spot, i, below), False) for i, n in reversed(list(enumerate(below)))]
        return found


@lru_cache(256)
def finder(selectors: tuple[str, ...]) -> Finder:
    """A finder of these selectors; the same ones give the same finder."""
    return Finder(selectors)
