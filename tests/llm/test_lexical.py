"""Ranked search against a loop over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from sitegrain.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked, scored = set(terms(text)), []
        for doc, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if c[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        scored.sort()
        out += [(item, i + 1, doc, -s) for i, (s, _, _, doc) in enumerate(scored[:k])]
    return out


def key(rows):
    return sorted((repr(r[0]), *(r[1:2]), repr(r[2]), r[3]) for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_agrees_with_brute_force(spark, seed):
    """Small shards and blocks, copies, ties, repeated and missing ids."""
    draw = random.Random(seed)
    vocabulary = [f"{c}{i}" for i in range(40) for c in "aÉ"]
    text = lambda n: " ".join(draw.choice(vocabulary[: draw.choice([3, 20, 80])]) for _ in range(n))
    docs = [(i, text(draw.choice([1, 5, 30, 200]))) for i in range(300)]
    docs += [(300 + i, docs[7][1]) for i in range(120)] + [docs[3], docs[4], (None, docs[7][1]), (None, text(9)), (900, None), (901, ""), (902, "-- !"), (-5, docs[7][1])]
    draw.shuffle(docs)
    items = [(i, text(draw.choice([1, 3, 12, 60]))) for i in range(25)] + [(25, docs[7][1]), (26, None), (27, "…"), (28, "unheard"), (None, "a1 a2"), (3, "É3 A4"), (3, "É3 A4")]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, rank int, score string").repartition(3)
    asked = spark.createDataFrame([(*x, 2, "y") for x in items], "item_id long, text string, doc_id int, q string")
    want = key(brute(docs, items))
    for limits in ({}, {"block_terms": 50, "shard_docs": 37}, {"shard_postings": 100}):
        got = lexical.search(frame, asked, **limits)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and key(got.collect()) == want


def test_deep_treaps(monkeypatch):
    """Impacts that rise and fall with the document make chains; small steps and ranges, and the binary search, change nothing."""
    draw = np.random.default_rng(1)
    ids = np.arange(1000) * 3
    docs, lists, impact = [], [], []
    for t, own in enumerate((np.arange(1000) + 1, 1000 - np.arange(1000), draw.integers(1, 4, 1000), np.full(1000, 7))):
        at = np.flatnonzero(draw.random(1000) < 0.7)
        docs.append(at), lists.append(np.full(len(at), t)), impact.append(own[at])
    docs, lists, impact = map(np.concatenate, (docs, lists, impact))
    for deep, step, held in ((64, 1 << 17, 1 << 22), (2, 64, 256)):
        monkeypatch.setattr(lexical, "DEEP", deep), monkeypatch.setattr(lexical, "STEP_ROOTS", step), monkeypatch.setattr(lexical, "HELD_ROOTS", held)
        shard = lexical.Treaps(ids, np.zeros(1000, bool), docs, lists, impact)
        for weight in ([1, 1, 1, 1], [0, 9, 1, 100], [5, 0, 0, 0], [3, 4, 1000, 0]):
            best, scores = lexical.Best(10), np.zeros(1000, np.int64)
            shard.search(np.arange(4), np.array(weight), best)
            np.add.at(scores, docs, impact * np.array(weight)[lists])
            want = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if s)[:10]
            assert [(s, i) for s, i, _ in best.rows] == want


def test_treaps_are_trees_and_heaps():
    draw = np.random.default_rng(2)
    docs, lists = np.repeat(np.arange(200), 3), np.tile(np.arange(3), 200)
    shard = lexical.Treaps(np.arange(200), np.zeros(200, bool), docs, lists, draw.integers(1, 9, 600))
    for root, begin, end in zip(shard.roots, shard.starts, shard.ends):
        seen, stack = [], [(int(root), -1, 200)]
        while stack:
            node, lo, hi = stack.pop()
            seen.append(node)
            assert lo < shard.doc[node] < hi
            for child, bounds in ((shard.left[node], (lo, shard.doc[node])), (shard.right[node], (shard.doc[node], hi))):
                if child >= 0:
                    assert shard.priority[child] < shard.priority[node]
                    stack.append((int(child), *bounds))
        assert sorted(seen) == list(range(begin, end))


def test_pruning_leaves_most_documents_out():
    """With one document that holds all of a query's terms often, few of the others are scored."""
    draw = np.random.default_rng(3)
    docs = np.concatenate([draw.integers(0, 20_000, 8000) for _ in range(6)])
    lists = np.repeat(np.arange(6), 8000)
    pairs = np.unique(np.stack([docs, lists]), axis=1)
    impact = draw.integers(1, 50, pairs.shape[1])
    impact[np.isin(pairs[0], pairs[0][:12])] += 1000
    shard = lexical.Treaps(np.arange(20_000), np.zeros(20_000, bool), pairs[0], pairs[1], impact)
    scored = []
    best = lexical.Best(3)
    offer = best.offer
    best.offer = lambda s, o, m: (scored.append(len(s)), offer(s, o, m))
    shard.search(np.arange(6), np.ones(6, np.int64), best)
    assert sum(scored) < 2000


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id string, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("i", "b"), ("j", None)], "item_id string, text string")
    for a, b in ((0, 0), (0, 1), (1, 0)):
        assert not lexical.search((none, some)[a][0], (none, some)[b][1]).collect()
    assert [tuple(r) for r in lexical.search(*some).collect()] == [("i", 1, 1, 287 * (10**9 // (1000 + 8 * 100)))]


def test_odd_documents(spark, odd, none):
    items = spark.createDataFrame([(1, "the thing of"), (2, "same text naïve")], "item_id long, text string")
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert key(lexical.search(odd, items).collect()) == key(brute(docs, [(1, "the thing of"), (2, "same text naïve")]))
    assert not lexical.search(none, items).collect()
