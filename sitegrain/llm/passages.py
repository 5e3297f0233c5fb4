"""Operator 7: fuzzy repeated passages by collinear chaining.

Documents with equal texts form a class, which its smallest doc_id stands for; the others
repeat it whole. Seeds of the class representatives are hashes of ``k`` consecutive words,
thinned by winnowing, so that every run of ``window + k - 1`` words that two documents share
gives both a seed. Seeds meet sorted, and each is matched with its first holder (the smallest
doc_id), so that copies cost links in proportion to their number, never pairs. A document's
matches with one holder become fragments on one diagonal, and fragments are chained: Fenwick
trees, one for each block of ``max_gap`` words of both documents, give the best chain that
ends before a fragment, less the cost of the gap. Between fragments and beyond the ends
of chains, words are aligned in a band, and segments of at least ``least`` words are reported.
As a document's passage may have its first holders in several documents, its segments are
also merged into spans over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_duplicates import BROADCAST_ROWS, _mix
from .runtime import HOT_ROWS, HOT_SHARE, hot_keys, join_hot, materialize, release, spare, text_runs

U = np.uint64
MATCH = "h bigint, doc_id bigint, source_id bigint, p int, q int"
CHAIN = "doc_id bigint, source_id bigint, p array<int>, q array<int>, n array<int>"
FOUND = "doc_id bigint, source_id bigint, start int, end int, source_start int, source_end int, n_equal int"
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("source_id", pa.int64()), *((c, pa.int32()) for c in ("start", "end", "source_start", "source_end", "n_equal"))])
#: Into how many parts the holders of a hot seed are dealt.
PARTS = 64
#: A document in so many is looked at to guess which seeds are hot.
LOOKED_AT = 16


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (as in near-duplicates: A to Z lowered), and each text's end."""
    array = pc.fill_null(texts.cast(pa.large_string()), "")
    plain = pc.replace_substring_regex(pc.ascii_lower(array), "[\\t\\n\\x0b\\f\\r]", " ")
    split = pc.split_pattern(plain, " ")
    coded = split.values.cast(pa.large_binary()).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    real = np.fromiter(map(bool, distinct), bool, len(distinct))
    at = coded.indices.to_numpy()
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(array), np.int64)
    full = real[at]
    ends = np.concatenate([[0], np.cumsum(full)])[split.offsets.to_numpy()][1:]
    return known[at[np.flatnonzero(full)]], ends


def _sliding(x: np.ndarray, window: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of every ``window`` consecutive numbers."""
    done = 1
    while done < window:
        step = min(done, window - done)
        x = best(x[: len(x) - step], x[step:])
        done += step
    return x


def seeds(words: np.ndarray, ends: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowed seeds: text number, first word's place in its text, and hash.

    A seed is kept if it is the least of some ``window`` consecutive ones. Texts are set apart
    by greatest numbers, so a text's seeds do not depend on its neighbours.
    """
    starts = np.concatenate([[0], ends[:-1]])
    n = np.maximum(ends - starts - k + 1, 0)
    if not n.sum():
        empty = np.empty(0, np.int64)
        return empty, empty, np.empty(0, np.uint64)
    rolled = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        rolled = _mix(rolled * U(0x9E3779B97F4A7C15) + words[j : len(words) - k + 1 + j])
    text = np.repeat(np.arange(len(ends)), n)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    own = rolled[starts[text] + place] >> U(1)
    at = np.arange(len(text)) + (text + 1) * window
    spread = np.full(len(text) + (len(ends) + 1) * window, np.iinfo(np.uint64).max, np.uint64)
    spread[at] = own
    least = _sliding(spread, window, np.minimum)  # of the window that begins here
    least = np.where(least == np.iinfo(np.uint64).max, U(0), least)
    reach = _sliding(np.concatenate([np.zeros(window - 1, np.uint64), least]), window, np.maximum)  # of the windows that hold this one
    kept = np.flatnonzero(reach[at] == own)
    return text[kept], place[kept], own[kept]


def chain(p: np.ndarray, q: np.ndarray, n: np.ndarray, max_gap: int = 64, gap_cost: float = 0.1, overlap: int = 3) -> list[np.ndarray]:
    """Disjoint chains of fragments (places in a document and in its source, words), best first.

    A chain's fragments rise in both documents and share ``overlap`` words at most. A fragment
    is worth its words, a gap costs ``gap_cost`` for each of its words in either document. A
    fragment extends the best chain that ends in its own block of ``max_gap`` words or in the
    one before, in both documents. Every pair of blocks has a Fenwick tree of the ends in it,
    by their place in the source; trees that lie two blocks behind are let go.
    """
    order = np.lexsort((q, p)).tolist()
    starts, sources, words = p.tolist(), q.tolist(), n.tolist()
    score, before = [0.0] * len(order), [-1] * len(order)
    trees: dict[int, dict[int, list[tuple[float, int]]]] = {}
    waiting: list[tuple[int, int]] = []  # ends that the sweep has not come to
    none = (float("-inf"), -1)
    for i in order:
        start, source = starts[i], sources[i]
        while waiting and waiting[0][0] <= start:
            end, j = heappop(waiting)
            at = sources[j] + words[j] - overlap
            tree = trees.setdefault(end // max_gap, {}).setdefault(at // max_gap, [none] * (max_gap + 1))
            value, slot = (score[j] + gap_cost * (end + at), j), at % max_gap + 1
            while slot <= max_gap:
                if value > tree[slot]:
                    tree[slot] = value
                slot += slot & -slot
        row, column = start // max_gap, source // max_gap
        for old in [r for r in trees if r < row - 1]:
            del trees[old]
        best = none
        for r in (row - 1, row):
            for c in (column - 1, column):
                if (tree := trees.get(r, {}).get(c)) is not None:
                    slot = source % max_gap + 1 if c == column else max_gap
                    while slot:
                        if tree[slot] > best:
                            best = tree[slot]
                        slot -= slot & -slot
        gained = best[0] - gap_cost * (start + source)
        score[i], before[i] = (words[i] + gained, best[1]) if gained > 0 else (float(words[i]), -1)
        heappush(waiting, (start + words[i] - overlap, i))
    used, out = [False] * len(order), []
    for i in sorted(order, key=lambda i: -score[i]):
        links = []
        while i >= 0 and not used[i]:
            used[i] = True
            links.append(i)
            i = before[i]
        if links:
            out.append(np.array(links[::-1]))
    return out


#: A score and, below it, a count of equal words in one number.
ONE = 1 << 14
FAR = -(1 << 29)


def _banded(x: np.ndarray, y: np.ndarray, at: np.ndarray, source: np.ndarray, rows: np.ndarray, columns: np.ndarray, low: int, high: int, step: int = 1, drop: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Many alignments at once: equal words, and how many words of both sides they take.

    Alignment i is that of ``rows[i]`` words of ``x`` from ``at[i]`` on with ``columns[i]``
    words of ``y`` from ``source[i]`` on, forward or backward (``step``). Equal words count 1,
    others and words left out -1; the difference of the places stays from ``low`` to ``high``.
    With ``drop`` an alignment ends at its last best place before the score falls ``drop``
    below; without, it takes all words of both sides, whose difference must be in the band.
    """
    count = len(rows)
    shift = np.arange(low, high + 1)
    paid = (shift * ONE).astype(np.int32)[None, :]
    value = np.where((shift >= 0) & (shift <= columns[:, None]), -paid, FAR).astype(np.int32)
    best, taken, source_taken = np.zeros(count, np.int32), np.zeros(count, np.int64), np.zeros(count, np.int64)
    left = np.arange(count)
    if drop is None:
        done = np.flatnonzero(rows == 0)
        best[done] = value[done, (columns - rows)[done] - low]
    for i in range(1, int(rows.max(initial=0)) + 1):
        some = rows[left] >= i
        left, value = left[some], value[some]
        if not len(left):
            break
        taken_y = i + shift
        wide = (taken_y >= 0) & (taken_y <= columns[left][:, None])
        place = np.clip(source[left][:, None] + step * (taken_y - 1), 0, max(len(y) - 1, 0))
        same = (y[place] == x[at[left] + step * (i - 1)][:, None]) if len(y) else np.zeros(wide.shape, bool)
        across = np.where(wide & (taken_y >= 1), value + np.where(same, ONE + 1, -ONE).astype(np.int32), FAR)
        down = np.full(value.shape, FAR, np.int32)
        down[:, :-1] = value[:, 1:] - ONE
        value = np.where(wide, np.maximum(across, down), FAR)
        value = np.where(wide, np.maximum.accumulate(value + paid, 1) - paid, FAR).astype(np.int32)
        if drop is None:
            done = np.flatnonzero(rows[left] == i)
            best[left[done]] = value[done, (columns - rows)[left[done]] - low]
        else:
            top = value.argmax(1)
            most = value[np.arange(len(left)), top]
            better = most // ONE >= best[left] // ONE
            best[left[better]], taken[left[better]], source_taken[left[better]] = most[better], i, i + shift[top[better]]
            going = most // ONE > best[left] // ONE - drop
            left, value = left[going], value[going]
    return (best % ONE).astype(np.int64), (rows if drop is None else taken), (columns if drop is None else source_taken)


def _between(x: np.ndarray, y: np.ndarray, at: np.ndarray, source: np.ndarray, rows: np.ndarray, columns: np.ndarray, drift: int) -> np.ndarray:
    """Equal words of the gaps between fragments; none where the sides differ by over ``drift`` words."""
    equal = np.zeros(len(rows), np.int64)
    apart = columns - rows
    for low, high in ((-4, 4), (-drift, drift)):
        own = np.flatnonzero((rows > 0) & (columns > 0) & (apart >= low) & (apart <= high) & ((high == 4) | (np.abs(apart) > 4)))
        for some in np.array_split(own, -(-len(own) // 2000)) if len(own) else []:
            equal[some] = _banded(x, y, at[some], source[some], rows[some], columns[some], low - 4, high + 4)[0]
    return equal


def align(x: pa.ListArray, y: pa.ListArray, chains: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], margin: int, weak: int = 8, drift: int = 32) -> tuple[np.ndarray, ...]:
    """Aligned segments of chains: chain, start, end, source_start, source_end, equal words.

    ``x`` and ``y`` hold, for each chain, the words of both documents from ``margin`` words
    before it (as far as there are any) to ``margin`` after it; ``chains`` are its fragments:
    chain, place, source place and words, in order. Where over ``weak`` words lie between two
    fragments, and fewer than half of them are equal, the chain parts into two segments. A
    segment goes on before its first and after its last fragment, by ``margin`` words at most.
    """
    of, p, q, n = (c.copy() for c in chains)
    xs, ys, x_ends, y_ends = x.values.to_numpy(), y.values.to_numpy(), x.offsets.to_numpy().astype(np.int64), y.offsets.to_numpy().astype(np.int64)
    first = np.concatenate([[True], of[1:] != of[:-1]])
    head = np.flatnonzero(first)[np.cumsum(first) - 1]
    to_x, to_y = x_ends[of] - np.maximum(p[head] - margin, 0), y_ends[of] - np.maximum(q[head] - margin, 0)  # from places in a text to those in xs and ys
    after = np.flatnonzero(~first)
    over = np.maximum(0, np.maximum((p + n)[after - 1] - p[after], (q + n)[after - 1] - q[after]))
    p[after], q[after], n[after] = p[after] + over, q[after] + over, n[after] - over
    word = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    same = xs[np.repeat(to_x + p, n) + word] == ys[np.repeat(to_y + q, n) + word]
    own = np.add.reduceat(same.astype(np.int64), np.cumsum(n) - n)
    end, source_end = p + n, q + n
    rows, columns = p[after] - end[after - 1], q[after] - source_end[after - 1]
    inside = _between(xs, ys, (to_x[after - 1] + end[after - 1]), (to_y[after - 1] + source_end[after - 1]), rows, columns, drift)
    wide = np.maximum(rows, columns)
    parted = ((wide > weak) & (2 * inside < wide)) | (np.abs(rows - columns) > drift)
    begins = first.copy()
    begins[after[parted]] = True
    own[after[~parted]] += inside[~parted]
    a = np.flatnonzero(begins)
    b = np.append(a[1:], len(of)) - 1
    equal = np.add.reduceat(own, a)
    start, source_start, end, source_end = p[a], q[a], end[b], source_end[b]
    x_begin, y_begin, x_end, y_end = x_ends[of[a]], y_ends[of[a]], x_ends[of[a] + 1], y_ends[of[a] + 1]
    here, there = to_x[a] + start, to_y[a] + source_start
    more, back, source_back = _banded(xs, ys, here - 1, there - 1, np.minimum(here - x_begin, margin), np.minimum(there - y_begin, margin), -4, 4, -1, 6)
    here, there = to_x[a] + end, to_y[a] + source_end
    extra, ahead, source_ahead = _banded(xs, ys, here, there, np.minimum(x_end - here, margin), np.minimum(y_end - there, margin), -4, 4, 1, 6)
    return of[a], start - back, end + ahead, source_start - source_back, source_end + source_ahead, equal + more + extra


def _words_of(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Word hashes (32 bits each) of the documents whose doc_id is among ``ids`` (column ``name``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_runs(batch, "text"):
                words, ends = word_hashes(part.column("text"))
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array((words & U(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))
                yield pa.record_batch([part.column(name), listed], names=[name, "w"])

    few = ids.count() <= BROADCAST_ROWS
    own = docs.select(F.col("doc_id").alias(name), "text")
    return own.join(F.broadcast(ids) if few else ids, name, "left_semi").mapInArrow(run, f"{name} bigint, w array<int>")


def _sown(docs: DataFrame, k: int, window: int, hot: np.ndarray) -> DataFrame:
    """Seeds of all texts: h, part, doc_id, p; ``part`` is 0 but for hot seeds, whose documents are dealt out."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)  # HOT_SHARE numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for rows in text_runs(batch, "text"):
                words, ends = word_hashes(rows.column("text"))
                text, place, key = seeds(words, ends, k, window)
                doc, part = rows.column("doc_id").to_numpy()[text], np.zeros(len(key), np.int32)
                if len(known):
                    listed = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key
                    part[listed] = (1 + _mix(doc[listed].astype(U)) % U(PARTS)).astype(np.int32)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(part), pa.array(doc), pa.array(place, pa.int32())], names=["h", "part", "doc_id", "p"])

    return docs.mapInArrow(run, "h bigint, part int, doc_id bigint, p int")


def _hot_seeds(docs: DataFrame, k: int, window: int) -> np.ndarray:
    """Seeds that seem to have most rows, from a part of the documents.

    This says how work is dealt out, never what is found.
    """
    some = _sown(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(LOOKED_AT)) == 0), k, window, np.empty(0, U))
    counts = materialize(some.groupBy("h").agg(F.count("*").alias("_n")).where("_n > 1"), "often")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    most = max(HOT_ROWS // LOOKED_AT, total // HOT_SHARE)
    return np.sort(np.array([r.h for r in counts.where(F.col("_n") > most).select("h").collect()], np.int64).astype(U))  # HOT_SHARE at most


def _met(sown: DataFrame, within: bool) -> tuple[DataFrame, DataFrame]:
    """Each seed row matched with the first holder of its seed (of its part, for hot seeds), and the table behind it.

    Rows come sorted and go by one at a time, so no seed's holders are ever gathered. The first
    holders of a hot seed's parts are matched with the first of them all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first row of the seed that was last
        for batch in batches:
            if not batch.num_rows:
                continue
            h, part, doc, p = (batch.column(c).to_numpy() for c in ("h", "part", "doc_id", "p"))
            if held is not None:
                h, part, doc, p = (np.concatenate([[x], c]) for x, c in zip(held, (h, part, doc, p)))
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (part[1:] != part[:-1])])
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            keep = (doc != doc[first]) | (np.full(len(h), within) & (p != p[first]))
            ends = new & (part > 0)
            if held is not None:
                ends[0] = False  # told before
            at, of = np.flatnonzero(keep), np.flatnonzero(ends)
            none = np.zeros(len(at) + len(of), bool)
            none[len(at) :] = True
            both = np.concatenate([at, of])
            column = lambda x, mask=None, kind=pa.int64(): pa.array(x.astype(np.int64), kind, mask=mask)
            yield pa.record_batch([column(h[both], ~none), column(doc[both]), column(doc[first[both]], none), column(p[both], None, pa.int32()), column(p[first[both]], none, pa.int32())], names=["h", "doc_id", "source_id", "p", "q"])
            i = first[-1]
            held = (h[i], part[i], doc[i], p[i])

    dealt = sown.repartition("h", "part").sortWithinPartitions("h", "part", "doc_id", "p")
    out = materialize(dealt.mapInArrow(run, MATCH), "matches")
    ends = out.where("source_id is null").select("h", "doc_id", "p")
    first = ends.groupBy("h").agg(F.min(F.struct("doc_id", "p")).alias("f"))
    linked = ends.join(F.broadcast(first), "h").where("doc_id > f.doc_id")  # hot seeds alone
    columns = ("doc_id", "source_id", "p", "q")
    return out.where("source_id is not null").select(*columns).unionByName(linked.select("doc_id", F.col("f.doc_id").alias("source_id"), "p", F.col("f.p").alias("q"))), out


def _chains_of(d: np.ndarray, s: np.ndarray, p: np.ndarray, q: np.ndarray, k: int, step: int, max_gap: int) -> pa.RecordBatch:
    """Chains of whole documents' matches, which come sorted by document, source and place.

    Matches on one diagonal that follow each other within ``step`` words are one fragment. Most
    documents share one fragment with a source, which is a chain as it is.
    """
    pair = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1])])
    new = pair.copy()
    new[1:] |= (p[1:] - p[:-1] > step) | (p[1:] - q[1:] != p[:-1] - q[:-1])
    a = np.flatnonzero(new)
    n = p[np.append(a[1:], len(p)) - 1] - p[a] + k
    d, s, p, q = d[a], s[a], p[a], q[a]
    begins = np.flatnonzero(pair[a])
    sizes = np.diff(np.append(begins, len(a)))
    lone = begins[sizes == 1]
    order, counts = [lone], [np.ones(len(lone), np.int64)]
    for begin, size in zip(begins[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        own = slice(begin, begin + size)
        for links in chain(p[own], q[own], n[own], max_gap):
            order.append(links + begin)
            counts.append([len(links)])
    at, counts = np.concatenate(order), np.concatenate(counts).astype(np.int64)
    ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    heads = at[np.cumsum(counts) - counts]
    lists = [pa.ListArray.from_arrays(ends, pa.array(x[at], pa.int32())) for x in (p, q, n)]
    return pa.record_batch([pa.array(d[heads]), pa.array(s[heads]), *lists], names=["doc_id", "source_id", "p", "q", "n"])


def _linked(matches: DataFrame, k: int, step: int, max_gap: int) -> DataFrame:
    """The chains of all matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4
        for batch in batches:
            held = [np.concatenate([h, batch.column(c).to_numpy().astype(np.int64)]) for h, c in zip(held, ("doc_id", "source_id", "p", "q"))]
            d, s = held[:2]
            if not len(d) or (d[0] == d[-1] and s[0] == s[-1]):
                continue
            stop = int(np.flatnonzero((d != d[-1]) | (s != s[-1]))[-1]) + 1  # the last pair may go on
            yield _chains_of(*(h[:stop] for h in held), k, step, max_gap)
            held = [h[stop:] for h in held]
        if len(held[0]):
            yield _chains_of(*held, k, step, max_gap)

    dealt = matches.repartition("doc_id").sortWithinPartitions("doc_id", "source_id", "p", "q")
    return materialize(dealt.mapInArrow(run, CHAIN), "chains")


def _measured(sides: DataFrame, margin: int, identity: float, most: int = 1 << 19) -> DataFrame:
    """Aligned segments of all chains; ``most`` bounds the words that are aligned together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = sum(np.diff(batch.column(c).offsets.to_numpy()) for c in ("x", "y"))
            group = np.cumsum(sizes) // most
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
            for begin, stop in zip(cuts, cuts[1:]):
                if begin == stop:
                    continue
                part = batch.take(pa.array(np.arange(begin, stop)))
                lists = [part.column(c) for c in ("p", "q", "n")]
                of = np.repeat(np.arange(part.num_rows), np.diff(lists[0].offsets.to_numpy()))
                chains = (of, *(c.values.to_numpy().astype(np.int64) for c in lists))
                of, start, end, source_start, source_end, equal = align(part.column("x"), part.column("y"), chains, margin)
                good = np.flatnonzero(equal >= identity * np.maximum(end - start, source_end - source_start))
                ids = [part.column(c).to_numpy()[of[good]] for c in ("doc_id", "source_id")]
                yield pa.record_batch([pa.array(c, t) for c, t in zip([*ids, *(c[good] for c in (start, end, source_start, source_end, equal))], FOUND_ARROW.types)], schema=FOUND_ARROW)

    return materialize(sides.select("doc_id", "source_id", "p", "q", "n", "x", "y").mapInArrow(run, FOUND), "aligned")


def _long_enough(found: DataFrame, least: int) -> DataFrame:
    """Segments of ``least`` words, and those in spans that a document's segments cover together, each once."""

    def kept(rows: pa.Table) -> pa.Table:
        if rows.num_rows > 1:  # rows that repeat stand next to each other
            columns = [c.to_numpy() for c in rows.columns]
            rows = rows.filter(pa.array(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], 0)])))
        doc, start, end, source_start, source_end = (rows.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "start", "end", "source_start", "source_end"))
        number = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
        apart = int(end.max()) + 2
        reach = np.maximum.accumulate(end + number * apart)
        begins = np.concatenate([[True], (start + number * apart)[1:] > reach[:-1]])
        a = np.flatnonzero(begins)
        whole = (reach - number * apart)[np.append(a[1:], len(doc)) - 1] - start[a] >= least
        return rows.filter(pa.array(whole[np.cumsum(begins) - 1] | (np.minimum(end - start, source_end - source_start) >= least)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([], FOUND_ARROW)
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch]).cast(FOUND_ARROW)]).combine_chunks()
            doc = held.column("doc_id").to_numpy()
            if not len(doc) or doc[0] == doc[-1]:
                continue
            stop = int(np.flatnonzero(doc != doc[-1])[-1]) + 1  # the last document may go on
            yield from kept(held.slice(0, stop)).to_batches()
            held = held.slice(stop)
        if held.num_rows:
            yield from kept(held).to_batches()

    return found.repartition("doc_id").sortWithinPartitions("doc_id", "start", "end", "source_id", "source_start").mapInArrow(run, FOUND)


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Class representatives (doc_id, text), and the other documents with theirs (doc_id, source_id, text)."""
    key = F.md5(F.col("text").cast("binary"))
    keyed = materialize(docs.select("doc_id", key.alias("key")).distinct(), "texts")
    of_doc = keyed.groupBy("doc_id").agg(F.min("key").alias("key"), F.count("*").alias("_n"))
    again = materialize(of_doc.where("_n > 1").select("doc_id", "key"), "repeated")
    n = again.count()
    if n:  # rows that repeat a doc_id with different texts: one text counts
        few = F.broadcast(again) if n <= BROADCAST_ROWS else again
        wanted = few.withColumnRenamed("key", "_key")
        one = lambda df, k: df.join(wanted, "doc_id", "left").where(F.col("_key").isNull() | (F.col("_key") == k)).drop("_key")
        docs, keyed = one(docs, key), one(keyed, F.col("key"))
    groups = materialize(keyed.groupBy("key").agg(F.min("doc_id").alias("source_id"), F.count("*").alias("_n")).where("_n > 1"), "classes")
    hot = hot_keys(groups.select("key", "_n"), keyed.count())
    gone = materialize(join_hot(keyed, groups.drop("_n"), ["key"], hot, F.col("doc_id")).where("doc_id > source_id").select("doc_id", "source_id"), "copies")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(few, "doc_id", "left_anti"), docs.join(few, "doc_id")


def repeated_passages(docs: DataFrame, least: int = 50, k: int = 6, window: int = 8, max_gap: int = 64, identity: float = 0.8, within: bool = False) -> DataFrame:
    """Passages of ``docs`` (doc_id, text) that a document with a smaller doc_id holds too.

    One row per segment that counts: doc_id, source_id (the first holder of its seeds), the
    word ranges start to end and source_start to source_end (ends exclusive), and n_equal,
    the words that are equal in the alignment. A segment counts if it has ``least`` words in
    both documents, or lies within a span of ``least`` words that segments of several sources
    cover together, and if the share ``identity`` of its words is equal. A document whose text
    another one has too is one segment, of all its words, with the smallest doc_id of that
    text. ``within`` adds passages that a first holder itself repeats.

    Texts that are null, empty or shorter than ``k`` words have no seeds; very long ones are
    taken whole. Rows without a doc_id are left out; rows that repeat a doc_id with equal texts
    count once, and of different texts that of the smallest MD5 counts. Other columns are
    ignored; an empty table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    docs, copies = _classes(docs)
    matches, table = _met(_sown(docs, k, window, _hot_seeds(docs, k, window)), within)
    chains = _linked(matches, k, window + k, max_gap)
    release(table)
    doc_words = _words_of(docs, chains.select("doc_id").distinct(), "doc_id")
    source_words = _words_of(docs, chains.select("source_id").distinct(), "source_id")
    margin = least
    cut = lambda c: F.slice("w", F.greatest(F.lit(1), F.col(c)[0] - margin + 1), F.element_at(c, -1) + F.element_at("n", -1) + margin - F.greatest(F.lit(0), F.col(c)[0] - margin))
    held = chains.groupBy("source_id").agg(F.count("*").alias("_n"))
    hot = hot_keys(held, chains.count())
    sides = chains.join(doc_words, "doc_id").withColumn("x", cut("p")).drop("w")
    sides = join_hot(sides, source_words, ["source_id"], hot, F.col("doc_id")).withColumn("y", cut("q")).drop("w")
    found = _long_enough(_measured(sides, margin, identity), least)
    size = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    whole = copies.select("doc_id", "source_id", F.lit(0).alias("start"), size.alias("end"), F.lit(0).alias("source_start"), size.alias("source_end"), size.alias("n_equal")).distinct()
    return found.unionByName(whole.where(F.col("end") >= least))


def cut_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the words of every repeated passage (``found``) cut from ``text``.

    White space before a cut stays, that after it goes with the cut words. All rows and columns
    stay, whatever their names; null, empty and very long texts are those of
    :func:`repeated_passages`, rows without a doc_id are unchanged, and of rows that repeat a
    doc_id those whose text it looked at are cut. An empty table gives an empty table.
    """
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
    columns = docs.columns
    cuts_of, key = spare("_spans", columns), spare("_digest", columns)
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias(cuts_of))
    looked_at = docs.join(spans.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(digest).alias(key))
    spans = spans.join(looked_at, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, cuts in enumerate(batch.column(cuts_of).to_pylist()):
                if cuts and texts[i]:
                    gone = {j for c in cuts for j in range(c["start"], c["end"])}
                    lead = len(texts[i]) - len(texts[i].lstrip(" \t\n\x0b\f\r"))
                    texts[i] = texts[i][:lead] + "".join(m.group() for j, m in enumerate(word.finditer(texts[i])) if j not in gone)
            yield pa.record_batch([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns], names=columns)

    return docs.withColumn(key, digest).join(spans, ["doc_id", key], "left").select(*columns, cuts_of).mapInArrow(run, docs.schema)
