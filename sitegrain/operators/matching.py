"""A discrimination tree over path templates, walked once for each URL.

An edge is a literal segment or a type; a node knows the best rank of a template that ends
there, of one that goes on with a wildcard, and of all below it. A URL follows its literal
and the types that take its segment, and leaves every node whose best rank is no better than
what it has found. So its cost is bound by the edges that fit, not by the number of templates.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import segments, urls

#: No rank is as bad as this.
NONE = 1 << 62
#: Template types that take a segment of another lexical type too, by that type.
LOOSE = {"literal": ("slug", "camel_case"), "integer": ("version",), "version": ("integer",)}
#: Types that any segment fits, and types that any segment with a dot fits.
ANY, DOTTED = ("literal", "unknown"), ("filename", "dotted_path")


class Node:
    __slots__ = ("best", "end", "wild", "words", "types")

    def __init__(self) -> None:
        self.best = self.end = self.wild = NONE
        self.words: dict[str, Node] = {}
        self.types: dict[str, Node] = {}


def accepted(kind: str, dotted: bool) -> tuple[str, ...]:
    """Template types that take a segment of a lexical type; ``dotted``: it holds a dot."""
    return tuple(dict.fromkeys((kind, *ANY, *(DOTTED if dotted else ()), *LOOSE.get(kind, ()))))


class Tree:
    """Templates as (rank, segments in lower case); what follows a wildcard does not count."""

    def __init__(self, templates: Iterable[tuple[int, list[str]]]):
        self.root = Node()
        for rank, parts in templates:
            node, wild = self.root, "..." in parts
            node.best = min(node.best, rank)
            for part in parts[: parts.index("...")] if wild else parts:
                typed = len(part) > 1 and part[0] == "<" and part[-1] == ">"
                edges, key = (node.types, part[1:-1]) if typed else (node.words, part)
                node = edges.setdefault(key, Node())
                node.best = min(node.best, rank)
            if wild:
                node.wild = min(node.wild, rank)
            else:
                node.end = min(node.end, rank)

    def first(self, words: list[str], kinds: list[str]) -> int:
        """The best rank of a template that a path's segments fit, or ``NONE``; ``words`` are in lower case."""
        found, n = NONE, len(words)
        stack = [(self.root, 0)]
        while stack:
            node, i = stack.pop()
            if node.best >= found:
                continue
            found = min(found, node.wild, node.end if i == n else NONE)
            if i < n:
                word = words[i]
                for kind in accepted(kinds[i], "." in word) if node.types else ():
                    if (below := node.types.get(kind)) is not None:
                        stack.append((below, i + 1))
                if (below := node.words.get(word)) is not None:  # taken first: literals have the better ranks
                    stack.append((below, i + 1))
        return found


def first_template(spark: SparkSession, templates: DataFrame, parts: Column) -> Column:
    """Column function: the template_id of a path's first template in the order of ``rank``, or null.

    ``templates`` (template_id, rank, pattern, and site where paths begin with one) is collected;
    ``parts`` are a path's segments. The function counts as one that may differ from call to call,
    else a condition on its result would be pushed below it and walk every path again, in a second
    Python worker of each task.
    """
    own = urls.segments(F.col("pattern"))
    if "site" in templates.columns:
        own = F.concat(F.array("site"), own)
    rows = templates.select("template_id", "rank", F.transform(own, F.lower).alias("parts")).collect()
    shared = spark.sparkContext.broadcast((Tree((r.rank, r.parts) for r in rows), {r.rank: r.template_id for r in rows}))

    def walk(words: pa.Array, kinds: pa.Array) -> pa.Array:
        tree, names = shared.value
        return pa.array([None if w is None else names.get(tree.first(w, k)) for w, k in zip(words.to_pylist(), kinds.to_pylist())], pa.string())

    return F.arrow_udf(walk, T.StringType()).asNondeterministic()(F.transform(parts, F.lower), F.transform(parts, segments.classify))
