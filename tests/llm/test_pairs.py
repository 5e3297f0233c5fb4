"""Near-duplicates, repeated passages and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from sitegrain import tables
from sitegrain.llm import decontamination, near_duplicates, passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(docs):
    sets = {d: shingles(t) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a_, b_ = find(a), find(b)
                parent[max(a_, b_)] = min(a_, b_)
    return {d: (len(sets[d]), find(d)) for d in docs}


def varied(draw, words, rate, vocabulary):
    return " ".join(draw.choice(vocabulary) if draw.random() < rate else w for w in words)


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates(spark, seed):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs, n = {}, 0
    for _ in range(6):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([5, 40, 150]))]
        for _ in range(draw.choice([1, 3, 25])):
            docs[n] = varied(draw, base, draw.choice([0, 0.005, 0.01, 0.02, 0.05]), vocabulary)
            n += 1
    docs |= {n: None, n + 1: "", n + 2: "a b", n + 3: "A  B\n", n + 4: " "}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(df).collect()}
    assert got == brute_components(docs)


def test_a_line_of_near_copies_is_one_group(spark):
    words = [f"w{i}" for i in range(200)]
    docs = {i: " ".join(f"n{j}" if j < 4 * i else w for j, w in enumerate(words)) for i in range(12)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates.near_duplicates(df).collect()}
    assert got == brute_components(docs) and {c for _, c in got.values()} == {0}


def test_near_duplicates_of_odd_documents(spark, odd, none):
    rows = near_duplicates.near_duplicates(odd).collect()
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    want = brute_components(texts)
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.component_id is None and r.kept) if r.doc_id is None else ((r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id))
    assert near_duplicates.near_duplicates(none).count() == 0
    kept = near_duplicates.keep_one(odd)
    assert kept.columns == odd.columns and none.columns == near_duplicates.keep_one(none).columns


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randint(0, 150), draw.randint(0, 150)) for _ in range(120)] + [(i, i + 1) for i in range(200, 260)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a_, b_ = find(a), find(b)
        parent[max(a_, b_)] = min(a_, b_)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {r.node: r.root for r in near_duplicates.components(df).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


@pytest.mark.parametrize("n, m", [(1, 1), (10, 5), (100, 90), (2000, 1500)])
def test_super_minhash_estimates_similarity(n, m):
    draw = np.random.default_rng(n)
    errors = []
    for _ in range(30):
        all_ = draw.integers(0, 1 << 63, 2 * n - m, np.uint64)
        a, b = all_[:n], all_[n - m :]
        s = near_duplicates.super_minhash(np.concatenate([a, b]), np.array([n, n]))
        errors.append((s[0] == s[1]).mean() - m / (2 * n - m))
    assert abs(np.mean(errors)) < 0.03
    x = near_duplicates.super_minhash(a, np.array([n]))
    assert (np.sort(x[0] >> np.uint64(56)) <= near_duplicates.SLOTS).all() and (x == near_duplicates.super_minhash(a[::-1].copy(), np.array([n]))).all()


def brute_hits(docs, bench):
    words = lambda t: BENCH_WORD.findall((t or "").translate(LOWER))
    windows = defaultdict(set)
    for item, text in bench:
        w = words(text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i : i + k])].add(str(item))
    sizes, out = {len(w) for w in windows}, {}
    for d, text in docs:
        w, hit, items = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if found := windows.get(tuple(w[i : i + k])):
                    hit.update(range(i, i + k))
                    items |= found
        out[d] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block_bytes,filter_bytes,finds_bytes", [(1 << 20, 0, 0), (60, 1 << 20, 1 << 20), (60, 64, 0)])
def test_decontamination(spark, monkeypatch, block_bytes, filter_bytes, finds_bytes):
    """By a set in each worker, and by a table behind a filter; with a filter so small that much passes it, finds are verified."""
    monkeypatch.setattr(decontamination, "FILTER_BYTES", filter_bytes), monkeypatch.setattr(decontamination, "FINDS_BYTES", finds_bytes), monkeypatch.setattr(tables, "HOT_ROWS", 30)
    draw = random.Random(9)
    word = lambda: draw.choice(["a", "b", "c", "dé", "E", "9"])
    bench = [(i, " ".join(word() for _ in range(draw.choice([0, 1, 5, 13, 20, 40])))) for i in range(25)] + [(77, None)]
    docs = [(i, ", ".join([*(word() for _ in range(draw.randint(0, 40))), *(bench[i % 25][1] or "").upper().split(), "tail"])) for i in range(60)] + [(100, None), (101, "")]
    docs += [(200 + i, docs[4][1]) for i in range(50)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    rows = decontamination.digest(decontamination.find_hits(d, b, block_bytes=block_bytes)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == brute_hits(docs, bench)


def test_decontamination_of_odd_documents(spark, odd, none):
    bench = spark.createDataFrame([(1, "same text here again"), (None, "one"), (2, None)], "item_id long, text string")
    found = decontamination.find_hits(odd, bench)
    rows = decontamination.digest(found).collect()
    want = brute_hits([(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None], [(1, "same text here again")])
    assert len(rows) == odd.count() and all(tuple(r)[1:] == want[r.doc_id] for r in rows if r.doc_id is not None)
    large = decontamination.digest(decontamination.find_hits(odd, bench, block_bytes=1))
    assert Counter(map(tuple, large.collect())) == Counter(map(tuple, rows))
    assert decontamination.find_hits(none, bench).count() == 0 == decontamination.find_hits(none, bench, block_bytes=1).count()
    assert decontamination.drop_contaminated(odd, bench.limit(0)).count() == odd.count()
    kept = decontamination.drop_contaminated(odd, bench)
    assert kept.schema == odd.schema and {r.hits for r in kept.collect()} == {"a"}
    cut = decontamination.cut_spans(odd, bench)
    assert cut.columns == odd.columns and cut.count() == odd.count() and {r.hits for r in cut.collect()} == {"a"}


def test_cut_spans(spark):
    bench = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x A, b C! d é"), (2, None), (3, "a")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in decontamination.cut_spans(docs, bench).collect()} == {1: "x A, ! d é", 2: None, 3: "a"}


def test_repeated_passages(spark):
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    shared, docs = [text(60) for _ in range(5)], {}
    for i in range(80):
        passage = shared[i % 5] if i % 2 else []
        if i % 4 == 3:  # two words changed, one left out
            passage = [w if j not in (20, 40) else "changed" for j, w in enumerate(passage) if j != 30]
        docs[i] = " ".join([*text(draw.randint(0, 150)), *passage, *text(draw.randint(0, 150))])
    docs |= {100: docs[1], 101: None, 102: "", 103: "x"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    rows = passages.repeated_passages(df).collect()
    words = {d: WORD.findall((t or "").translate(LOWER)) for d, t in docs.items()}
    clean = {i for i in range(80) if not i % 2}
    assert {r.doc_id for r in rows} | {r.source_id for r in rows} == {i for i in range(80) if i % 2} | {100}
    assert not clean & {r.doc_id for r in rows}
    for r in rows:
        a, b = words[r.doc_id][r.start : r.end], words[r.source_id][r.source_start : r.source_end]
        assert len(a) == r.end - r.start and len(b) == r.source_end - r.source_start
        common = sum((Counter(a) & Counter(b)).values())
        assert 0.8 * max(len(a), len(b)) <= r.n_equal <= common
    cut = {r.doc_id: r.text for r in passages.cut_repeats(df, passages.repeated_passages(df)).collect()}
    assert cut[100].split() == [] and cut[0] == docs[0] and cut[101] is None


def test_exact_repeats_are_all_found(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = {r.doc_id: WORD.findall(r.text.translate(LOWER)) for r in df.collect()}
    held = defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - 49):
            held[tuple(w[i : i + 50])].add(d)
    later = {d for own in held.values() for d in own if d != min(own)}
    assert later and later <= {r.doc_id for r in passages.repeated_passages(df).collect()}


def test_repeated_passages_of_odd_documents(spark, odd, none):
    rows = passages.repeated_passages(odd).collect()
    assert any((r.doc_id, r.source_id) == (12, 10) for r in rows)
    assert passages.repeated_passages(none).count() == 0


def test_passages_that_many_documents_share_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(passages, "HOT_ROWS", 32)
    monkeypatch.setattr(tables, "HOT_ROWS", 32)
    draw = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    shared = text(80)
    docs = {i: " ".join([*text(40), *(shared if i % 4 else []), *text(30)]) for i in range(400)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    assert len(passages._hot_seeds(df, 6, 8)) > 10
    rows = passages.repeated_passages(df).collect()
    assert {r.doc_id for r in rows} == {i for i in range(400) if i % 4 and i > 1}
    covered = defaultdict(set)
    for r in rows:
        assert r.source_id < r.doc_id and r.n_equal >= 0.8 * (r.end - r.start)
        covered[r.doc_id].update(range(r.start, r.end))
    assert all(len(c) >= 80 for c in covered.values())
    held = Counter(r.source_id for r in rows)
    assert held[1] >= 2 and len(held) > 2  # the first of each part, and of them all


def test_passages_within_a_document(spark):
    words = lambda c, n: [f"{c}{i}" for i in range(n)]
    docs = [(1, " ".join([*words("a", 70), *words("b", 20), *words("a", 70), *words("c", 9)])), (2, " ".join(words("d", 100)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert passages.repeated_passages(df).count() == 0
    assert [tuple(r) for r in passages.repeated_passages(df, within=True).collect()] == [(1, 1, 90, 160, 0, 70, 70)]


def test_copies_and_repeated_ids(spark):
    text = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    docs = [(1, text("a", 60)), (3, text("a", 60)), (3, text("a", 60)), (7, text("a", 60)), (2, text("s", 20)), (4, text("s", 20)), (5, text("b", 90)), (6, text("b", 90)), (6, text("q", 90)), (None, text("a", 60))]
    rows = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").withColumn("source_id", F.lit("x")))
    import hashlib

    own = min((text("b", 90), text("q", 90)), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    want = [(3, 1, 0, 60, 0, 60, 60), (7, 1, 0, 60, 0, 60, 60)] + ([(6, 5, 0, 90, 0, 90, 90)] if own[0] == "b" else [])
    assert sorted(map(tuple, rows.collect())) == sorted(want)


def test_chains_keep_the_order():
    starts, sources, n = np.array([0, 10, 20, 30, 5]), np.array([100, 110, 121, 131, 400]), np.full(5, 8)
    best = passages.chain(starts, sources, n)
    assert best[0].tolist() == [0, 1, 2, 3] and best[1].tolist() == [4]


def test_a_chain_goes_on_after_a_far_one():
    starts = np.array([*range(0, 200, 8), *range(500, 560, 10)])  # two passages, 300 words apart
    chains = [starts[c].tolist() for c in passages.chain(starts, starts + 7, np.full(len(starts), 8))]
    assert chains == [list(range(0, 200, 8)), list(range(500, 560, 10))]


@pytest.mark.parametrize("seed", range(8))
def test_chains_score_as_those_of_all_pairs(seed):
    draw = random.Random(seed)
    p = sorted(draw.choice(range(900)) for _ in range(200))
    q = [max(0, x + draw.choice([0, 0, 0, 3, -5, 40, 200])) for x in p]
    n = [draw.choice([6, 6, 10, 40]) for _ in p]

    def gain(j, i):
        a, b = p[j] + n[j] - 3, q[j] + n[j] - 3
        near = p[i] // 64 - a // 64 <= 1 and q[i] // 64 - b // 64 <= 1
        return n[i] - 0.1 * (p[i] - a + q[i] - b) if a <= p[i] and b <= q[i] and near else None

    score = [float(x) for x in n]
    for i in sorted(range(len(p)), key=lambda i: (p[i], q[i])):
        for j in range(len(p)):
            if p[j] < p[i] and (g := gain(j, i)) is not None:
                score[i] = max(score[i], score[j] + g)
    chains = passages.chain(np.array(p), np.array(q), np.array(n))
    assert sorted(i for c in chains for i in c.tolist()) == list(range(len(p)))
    best = chains[0].tolist()
    got = n[best[0]] + sum(gain(j, i) for j, i in zip(best, best[1:]))
    assert got == pytest.approx(max(score))


@pytest.mark.parametrize("seed", range(6))
def test_banded_alignment_is_the_best(seed):
    draw = random.Random(seed)

    def brute(a, b):
        best = {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                ways = [(0, 0)] if not i + j else []
                if i and j:
                    s, e = best[i - 1, j - 1]
                    ways.append((s + 1, e + 1) if a[i - 1] == b[j - 1] else (s - 1, e))
                ways += [(best[at][0] - 1, best[at][1]) for at in ((i - 1, j), (i, j - 1)) if at in best]
                best[i, j] = max(ways)
        return best

    pairs = []
    for _ in range(40):
        a = [draw.randint(0, 5) for _ in range(draw.randint(0, 12))]
        b = [x if draw.random() < 0.8 else draw.randint(0, 5) for x in a for _ in range(draw.choice([1, 1, 1, 1, 0, 2]))]
        pairs.append((a, b))
    x, y = (np.array([w for pair in pairs for w in pair[side]] + [9], np.int32) for side in (0, 1))
    rows, columns = (np.array([len(pair[side]) for pair in pairs]) for side in (0, 1))
    at, source = np.cumsum(rows) - rows, np.cumsum(columns) - columns
    equal, _, _ = passages._banded(x, y, at, source, rows, columns, -30, 30)
    tables = [brute(a, b) for a, b in pairs]
    assert equal.tolist() == [t[len(a), len(b)][1] for t, (a, b) in zip(tables, pairs)]
    equal, i, j = passages._banded(x, y, at, source, rows, columns, -30, 30, 1, 1000)
    assert [t[e][0] for t, e in zip(tables, zip(i.tolist(), j.tolist()))] == [max(s for s, _ in t.values()) for t in tables]
    back = passages._banded(x[::-1].copy(), y[::-1].copy(), len(x) - 1 - at, len(y) - 1 - source, rows, columns, -30, 30, -1, 1000)
    assert all((a == b).all() for a, b in zip(back, (equal, i, j)))


def edited(draw, words, rate, kinds, vocabulary):
    out = []
    for w in words:
        kind = draw.choice(kinds) if draw.random() < rate else None
        out += [] if kind == "out" else [draw.choice(vocabulary)] if kind == "change" else [w, draw.choice(vocabulary)] if kind == "in" else [w]
    return out


@pytest.mark.parametrize("kinds", [["change"], ["change", "out", "in"]])
def test_recall_of_edited_passages(spark, kinds):
    draw = random.Random(len(kinds))
    vocabulary = [f"w{i}" for i in range(20_000)]
    text = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    rows, planted = [], {}
    for rate in (0.02, 0.05, 0.1):
        for n in (60, 100, 200):
            for _ in range(40):
                passage = text(n)
                rows.append((len(rows), " ".join([*text(60), *passage, *text(60)])))
                planted[len(rows)] = (rate, n)
                rows.append((len(rows), " ".join([*text(60), *edited(draw, passage, rate, kinds, vocabulary), *text(60)])))
    found = {(r.doc_id, r.source_id) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(d in planted and s == d - 1 for d, s in found)
    for rate in (0.02, 0.05, 0.1):
        own = [d for d, (r, _) in planted.items() if r == rate]
        assert sum((d, d - 1) in found for d in own) / len(own) >= 0.9


def test_two_edited_passages_of_one_source(spark):
    words = lambda c, n: [f"{c}{i}" for i in range(n)]
    far, near = words("a", 200), words("b", 90)
    docs = {1: [*far, *words("x", 100), *near]}
    for d in (2, 3):  # the second passage has a word too many and one left out, so that no seed reaches over 50 words
        docs[d] = [*(far if d == 2 else []), *words(f"y{d}_", 100), *near[:30], "more", *near[30:60], *near[61:]]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    rows = passages.repeated_passages(df).collect()
    for d in (2, 3):
        at = docs[d].index("b0")
        assert [(r.start, r.end) for r in rows if (r.doc_id, r.source_id) == (d, 1) and r.source_start >= 300] == [(at, at + 90)]


def test_cutting_passages_from_odd_rows(spark, odd, none):
    """Columns that clash, missing ids and texts; of rows that repeat a doc_id those are cut whose text was looked at."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(20, f"first words {passage} end", "a"), (21, f"other things {passage} more", "b"), (21, f"zz {passage}", "c"), (22, None, "d"), (None, f"x {passage}", "e")]
    docs = spark.createDataFrame([(i, t, s, "k", 1, 2) for i, t, s in rows], "doc_id long, text string, source_id string, _spans string, start int, `end` int")
    found = passages.repeated_passages(docs)
    got = passages.cut_repeats(docs, found)
    assert got.schema == docs.schema
    held = {r.source_id: r.text for r in got.collect()}
    looked_at = min("bc", key=lambda s: hashlib.md5(dict((x, t) for _, t, x in rows)[s].encode()).hexdigest())
    assert held["a"] == rows[0][1] and held["d"] is None and held["e"] == rows[4][1]
    for s, cut in (("b", "other things more"), ("c", "zz ")):
        assert held[s] == (cut if s == looked_at else dict((x, t) for _, t, x in rows)[s])
    assert {r._spans for r in got.collect()} == {"k"}
    assert passages.cut_repeats(odd, passages.repeated_passages(odd)).count() == odd.count() and passages.cut_repeats(none, passages.repeated_passages(none)).count() == 0
