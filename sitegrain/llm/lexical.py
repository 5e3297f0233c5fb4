"""Operator 12: ranked lexical search with inverted treaps.

A first pass counts, in every document, its terms and how often it holds those that queries
ask for: a forward row a document. Its sums give the weights. The second pass cuts the forward
rows of a task into shards of bounded size and turns each into inverted treaps: a term's
postings are a search tree by document and a heap by impact, so that the root of any
subtree is its document of most impact. A query walks its terms' treaps together. A state is a
range of documents with each term's root in that range; its bound is the sum of what the roots
weigh. The document of the heaviest root is scored, and parts the range in two. States
whose bound cannot enter the best k so far are left, with all that is below them. The best of
a task's earlier shards are carried into the next ones, and each task gives k rows a query at
most.

Documents are never shuffled. Queries are broadcast in blocks of a bounded number of terms.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize, release, text_runs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FORWARD = "doc_id bigint, n bigint, terms array<int>, counts array<int>"
#: Stands for a missing doc_id where documents are ordered: such rows come last.
LAST = (1 << 63) - 1
#: A descent that takes longer than this, in a treap that happens to be deep, goes on by binary search.
DEEP = 64
#: States of the walk hold so many roots at once, and a walk over so many is done range by range.
STEP_ROOTS, HELD_ROOTS = 1 << 17, 1 << 22


def terms_of(texts: pa.Array) -> Iterator[list[str]]:
    """The terms of each text, A-Z lower-cased; a null text has none."""
    for text in pc.ascii_lower(texts).to_pylist():
        yield TERM.findall(text) if text else []


def asked_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """A row for each row of ``items`` with a term: q, a number of its own, item_id, and terms, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_runs(batch, "text"):
                terms = [sorted(set(t)) for t in terms_of(part.column("text"))]
                yield pa.record_batch([part.column("q"), part.column("item_id"), pa.array(terms, pa.list_(pa.string()))], names=["q", "item_id", "terms"])

    kind = items.schema[item].dataType.simpleString()
    rows = items.select(F.monotonically_increasing_id().alias("q"), F.col(item).alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"q bigint, item_id {kind}, terms array<string>").where(F.size("terms") > 0)


def forward_rows(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """A row for each document with a term: doc_id, n (its terms), and which of ``vocabulary`` it holds how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in text_runs(batch, "text"):
                rows = []
                for doc_id, terms in zip(part.column("doc_id").to_pylist(), terms_of(part.column("text"))):
                    if terms:
                        held = sorted((known[t], c) for t, c in Counter(filter(known.__contains__, terms)).items())
                        rows.append((doc_id, len(terms), [t for t, _ in held], [c for _, c in held]))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "n", "terms", "counts"])

    return docs.mapInArrow(run, FORWARD)


def statistics(forward: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, terms with repeats, and for each term of the vocabulary the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, length = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            held += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=terms)
            docs, length = docs + batch.num_rows, length + (pc.sum(batch.column("n")).as_py() or 0)
        at = np.flatnonzero(held)
        yield pa.record_batch([pa.array([-2, -1, *at.tolist()], pa.int32()), pa.array([docs, length, *held[at].tolist()], pa.int64())], names=["term", "n"])

    sums = forward.mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(sums.column("term").to_pylist(), sums.column("n").to_pylist()))
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(t, 0) for t in range(terms)], np.int64)


def weights(docs: int, held: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2 * N + 2) / (2 * df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)


def impacts(counts: np.ndarray, n: np.ndarray, sizes: np.ndarray, docs: int, length: int) -> np.ndarray:
    """(1e9 * tf) div (1000 * tf + 8 * m) of postings: documents have ``n`` terms, ``sizes`` postings, and m = 100 - 90 + ((90 * n * N) div L)."""
    m = np.array([10 + 90 * x * docs // length for x in n.tolist()], np.int64)
    counts = counts.astype(np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 8 * np.repeat(m, sizes))


def heap_children(starts: np.ndarray, priorities: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Roots, left and right children of the treaps over postings that start at ``starts``, -1 for none.

    Postings stand in the order of documents; a later one takes what is less in front of it as
    its left subtree.
    """
    rank, n = priorities.tolist(), len(priorities)
    left, right, roots = [-1] * n, [-1] * n, []
    for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), n]):
        path: list[int] = []
        for i in range(begin, end):
            own, last = rank[i], -1
            while path and rank[path[-1]] < own:
                last = path.pop()
            left[i] = last
            if path:
                right[path[-1]] = i
            path.append(i)
        roots.append(path[0])
    return np.array(roots, np.int64), np.array(left, np.int32), np.array(right, np.int32)


class Best:
    """The k best documents of a query so far, as (-score, order, missing id), the best first."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def worst(self) -> tuple[int, int]:
        """Score and order of the last; what a document must beat once there are k of them."""
        return (-self.rows[-1][0], self.rows[-1][1]) if len(self.rows) == self.k else (0, -1)

    def offer(self, scores: np.ndarray, order: np.ndarray, missing: np.ndarray) -> None:
        good = scores >= max(1, self.worst[0])
        if good.any():
            made = zip((-scores[good]).tolist(), order[good].tolist(), missing[good].tolist())
            self.rows = heapq.nsmallest(self.k, [*self.rows, *made])


class Treaps:
    """A shard's inverted treaps.

    ``order`` has the documents' ids in ascending order (a missing one is last, and told by
    ``missing``); postings hold a document's place there, and stand by term and place.
    """

    def __init__(self, ids: np.ndarray, missing: np.ndarray, docs: np.ndarray, terms: np.ndarray, impact: np.ndarray):
        sort = np.lexsort((ids, missing))
        place = np.empty(len(ids), np.int64)
        place[sort] = np.arange(len(ids))
        self.order, self.missing = ids[sort], missing[sort]
        docs = place[docs]
        by = np.lexsort((docs, terms))
        self.doc, self.impact = docs[by], impact[by]
        self.terms, self.starts = np.unique(terms[by], return_index=True)
        self.ends = np.append(self.starts[1:], len(by))
        # Equal impacts are ordered by a mix of their places, so that a run of them is no long chain.
        mixed = (self.doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)
        self.priority = (self.impact << 32) | mixed
        self.roots, self.left, self.right = heap_children(self.starts, self.priority)

    def _first(self, node: np.ndarray, above: np.ndarray, below: np.ndarray, list_of: np.ndarray) -> np.ndarray:
        """The highest node under each of ``node`` whose document lies between ``above`` and ``below``, or -1."""
        at = np.flatnonzero(node >= 0)
        for _ in range(DEEP):
            own = node[at]
            doc = self.doc[own]
            low = doc <= above[at]
            out = low | (doc >= below[at])
            at, own, low = at[out], own[out], low[out]
            if not len(at):
                return node
            node[at] = np.where(low, self.right[own], self.left[own])
            at = at[node[at] >= 0]
        for i in at.tolist():
            begin, end = int(self.starts[list_of[i]]), int(self.ends[list_of[i]])
            a, b = begin + np.searchsorted(self.doc[begin:end], (above[i], below[i] - 1), "right")
            node[i] = a + int(np.argmax(self.priority[a:b])) if b > a else -1
        return node

    def search(self, terms: np.ndarray, weight: np.ndarray, best: Best) -> None:
        """Offer ``best`` this shard's documents for a query of ``terms`` (ascending), each of some ``weight``."""
        at = np.searchsorted(self.terms, terms)
        held = (at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms) & (weight > 0) if len(self.terms) else np.zeros(len(terms), bool)
        lists, weight = at[held], weight[held]
        if not len(lists):
            return
        width = max(64, HELD_ROOTS // len(lists))
        for begin in range(0, len(self.order), width):
            self._walk(lists, weight, begin - 1, min(begin + width, len(self.order)), best)

    def _walk(self, lists: np.ndarray, weight: np.ndarray, above: int, below: int, best: Best) -> None:
        many = len(lists)
        step = max(64, STEP_ROOTS // many)
        pending: list[tuple[int, int, tuple]] = []
        made = 0

        def push(lo: np.ndarray, hi: np.ndarray, nodes: np.ndarray) -> None:
            nonlocal made
            bound = self._weighed(nodes, weight).sum(1)
            score, order = best.worst
            good = np.flatnonzero((bound > 0) & ((bound > score) | (bound == score) & (self.order[np.minimum(lo + 1, len(self.order) - 1)] <= order)))
            good = good[np.argsort(-bound[good], kind="stable")]
            size, i = 32, 0
            while i < len(good):
                part = good[i : i + size]
                heapq.heappush(pending, (-int(bound[part[0]]), made, (lo[part], hi[part], nodes[part], bound[part])))
                made, i, size = made + 1, i + size, min(step, size * 4)

        low, high = np.full(many, above), np.full(many, below)
        push(np.array([above]), np.array([below]), self._first(self.roots[lists].copy(), low, high, lists)[None])
        while pending:
            lo, hi, nodes, bound = heapq.heappop(pending)[2]
            score, order = best.worst
            good = (bound > score) | (bound == score) & (self.order[lo + 1] <= order)
            if not good.any():
                continue
            lo, hi, nodes = lo[good], hi[good], nodes[good]
            rows = len(lo)
            heaviest = self._weighed(nodes, weight).argmax(1)
            pivot = self.doc[nodes[np.arange(rows), heaviest]]
            wide = lambda x: np.repeat(x, many)
            p, l, h = wide(pivot), wide(lo), wide(hi)
            found = self._first(np.tile(nodes.reshape(-1), 3), np.concatenate([l, p, p - 1]), np.concatenate([p, h, p + 1]), np.tile(lists, rows * 3))
            left, right, own = found.reshape(3, rows, many)
            best.offer(self._weighed(own, weight).sum(1), self.order[pivot], self.missing[pivot])
            push(np.concatenate([lo, pivot]), np.concatenate([pivot, hi]), np.concatenate([left, right]))

    def _weighed(self, nodes: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.where(nodes >= 0, self.impact[nodes], 0) * weight


def _searcher(shared, k: int, docs: int, length: int, shard_postings: int, shard_docs: int):
    """Searches the forward rows of a task, shard by shard, for all queries of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, ends, terms, weight = shared.value
        best = [Best(k) for _ in numbers]
        held: list[tuple[np.ndarray, ...]] = []
        postings = rows = 0

        def flush() -> None:
            nonlocal held, postings, rows
            ids, missing, n, sizes, own, counts = (np.concatenate(x) for x in zip(*held))
            treaps = Treaps(ids, missing, np.repeat(np.arange(len(ids)), sizes), own, impacts(counts, n, sizes, docs, length))
            for q, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
                treaps.search(terms[a:b], weight[a:b], best[q])
            held, postings, rows = [], 0, 0

        for batch in batches:
            for part in _cut(batch, shard_postings, shard_docs):
                size = len(part[4])
                if held and (postings + size > shard_postings or rows + len(part[0]) > shard_docs):
                    flush()
                held.append(part)
                postings, rows = postings + size, rows + len(part[0])
        if held:
            flush()
        flat = [(q, doc if not missing else None, -score) for q, b in zip(numbers.tolist(), best) for score, doc, missing in b.rows]
        yield pa.record_batch([pa.array([r[i] for r in flat], pa.int64()) for i in range(3)], names=["q", "doc_id", "score"])

    return run


def _cut(batch: pa.RecordBatch, postings: int, docs: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Parts of a batch of forward rows as arrays: ids, whether one is missing, n, sizes, terms and counts."""
    ids = batch.column("doc_id")
    missing = pc.is_null(ids).to_numpy(zero_copy_only=False)
    ids, n = pc.fill_null(ids, LAST).to_numpy(), batch.column("n").to_numpy()
    sizes = pc.list_value_length(batch.column("terms")).to_numpy().astype(np.int64)
    terms, counts = batch.column("terms").flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
    ends, begin = np.cumsum(sizes), 0
    while begin < len(ids):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, min(begin + docs, int(np.searchsorted(ends, before + postings, "right"))))
        yield ids[begin:end], missing[begin:end], n[begin:end], sizes[begin:end], terms[before : int(ends[end - 1])], counts[before : int(ends[end - 1])]
        begin = end


def search(docs: DataFrame, items: DataFrame, k: int = 10, item: str = "item_id", item_text: str = "text", block_terms: int = 2_000_000, shard_postings: int = 1_000_000, shard_docs: int = 1 << 16) -> DataFrame:
    """The ``k`` best of all ``docs`` (doc_id, text) for every row of ``items``: item_id, rank from 1, doc_id, score.

    Equal scores go to the smaller doc_id; only scores above 0 are given, so an item may have
    fewer rows or none. Null and empty texts have no terms: such documents are not counted, and
    such items have no rows. Rows that repeat an item_id are queries of their own and each has
    its ranks; rows that repeat a doc_id are documents of their own; rows without an item_id or
    a doc_id count as any other, and a missing doc_id is the last among equal scores. Whole
    texts are taken, however long. Other columns are ignored, whatever their names. An empty
    table on either side gives an empty table.

    About ``block_terms`` terms of queries are searched at once; each further block of them is
    a pass of its own over the documents.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    asked = materialize(asked_terms(items, item, item_text), "asked")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // block_terms))
    found = []
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).select("q", "terms").toArrow()
        lists = own.column("terms").combine_chunks()
        vocabulary = {t: i for i, t in enumerate(pc.unique(lists.flatten()).to_pylist())}
        forward = materialize(forward_rows(docs, vocabulary), "forward")
        n, length, held = statistics(forward, len(vocabulary))
        weight = weights(n, held)
        numbers, sizes = own.column("q").to_numpy(), pc.list_value_length(lists).to_numpy()
        terms = [np.sort([vocabulary[t] for t in row]).astype(np.int64) for row in lists.to_pylist()]
        flat = np.concatenate(terms) if terms else np.zeros(0, np.int64)
        shared = spark.sparkContext.broadcast((numbers, np.cumsum(sizes), flat, weight[flat]))
        rows = forward.mapInArrow(_searcher(shared, k, n, length, shard_postings, shard_docs), "q bigint, doc_id bigint, score bigint")
        best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found.append(materialize(rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "ranked"))
        release(forward)
        shared.destroy()
    ranked = found[0]
    for more in found[1:]:
        ranked = ranked.unionByName(more)
    return ranked.join(asked.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
