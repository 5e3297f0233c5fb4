"""Operator 2: near-duplicates by SuperMinHash, banding, verification and union-find grouping.

Documents with equal shingle sets form a class; one document of it stands for all. The
classes' SuperMinHash signatures are cut into bands, and classes that share a band meet in
a bucket. No bucket is expanded into pairs: a round compares each class with one hub, the
bucket-mate that shares most of its bands, on the full sets, and joins those that are
similar enough. Further rounds can draw other hubs, for classes in buckets that still hold
more than one component. What is left is settled without luck: a prefix filter
over those buckets' sets (rarest shingles first) finds every pair of different components
that can reach the similarity, and these are verified too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import held, hot_keys, join_hot, materialize, release, text_runs

WIDTH = 5
BAND_ROWS, BANDS = 5, 48
SLOTS = BAND_ROWS * BANDS
#: A side of a join is broadcast if it has at most so many rows of two or three numbers.
BROADCAST_ROWS = 250_000

U = np.uint64
SKETCH = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


def shingle_sets(texts: list[str | None] | pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct word shingles, joined, and how many each text has.

    Words are runs of characters other than space and U+0009 to U+000D, with A to Z in lower
    case. A text of fewer words than ``width``, but not none, has one shingle of them all.
    """
    array = pc.fill_null(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()), "")
    plain = pc.replace_substring_regex(pc.ascii_lower(array), "[\\t\\n\\x0b\\f\\r]", " ")
    split = pc.split_pattern(plain, " ")
    coded = split.values.cast(pa.large_binary()).dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    real = np.array([bool(w) for w in distinct], bool)
    at = coded.indices.to_numpy()
    full = real[at] if len(at) else np.empty(0, bool)
    ends = np.concatenate([[0], np.cumsum(full)])[split.offsets.to_numpy()]
    words = known[at[np.flatnonzero(full)]] if len(at) else np.empty(0, np.uint64)
    n = len(words)
    rolled = np.full(max(n - width + 1, 0), width, np.uint64)
    for j in range(width):
        rolled = _mix(rolled * U(0x9E3779B97F4A7C15) + words[j : n - width + 1 + j])
    sets = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        if b - a >= width:
            sets.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            sets.append(np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), seed=b - a)], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
    return np.concatenate(sets) if sets else np.empty(0, np.uint64), np.array([len(x) for x in sets], np.int64)


def super_minhash(elements: np.ndarray, counts: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures (sets by slots) of non-empty sets of 64-bit hashes.

    Every element has a random permutation of the slots, drawn by Fisher-Yates; at step j it
    offers slot p(j) the value j plus a random fraction, and a slot keeps the least. A set is
    done when all its slots hold values under j + 1, as later steps cannot change them. All
    sets take a step together. 256 slots at most.
    """
    n = len(counts)
    signature = np.full(n * slots, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), counts)
    places = np.empty((0, 0), np.uint8)
    for j in range(slots):
        if not len(owner):
            break
        draw = _mix(elements + U((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((draw & U(0xFFFFFFFF)) * U(slots - j) >> U(32)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            rows = np.arange(len(k))
            slot = places[rows, k].astype(np.int64)
            places[rows, k] = places[:, j]
        value = U(j) << U(56) | _mix(draw) >> U(8)
        np.minimum.at(signature, owner * slots + slot, value)
        open_sets = signature.reshape(n, slots).max(1) >= U(j + 1) << U(56)
        left = np.flatnonzero(open_sets[owner])
        if j == 0:
            places = np.tile(np.arange(slots, dtype=np.uint8), (len(left), 1))
            places[np.arange(len(left)), k[left]] = 0
        elif len(left) < len(owner):
            places = places[left]
        elements, owner = elements[left], owner[left]
    return signature.reshape(n, slots)


def _signatures(elements: np.ndarray, counts: np.ndarray, slots: int, most: int = 1 << 15) -> np.ndarray:
    """Signatures, many sets of like size at a time; an empty set's is all ones."""
    out = np.full((len(counts), slots), np.iinfo(np.uint64).max, np.uint64)
    starts = np.cumsum(counts) - counts
    order = np.argsort(counts, kind="stable")
    order = order[counts[order] > 0]
    groups = np.cumsum(counts[order]) // most
    for some in np.split(order, np.flatnonzero(np.diff(groups)) + 1) if len(order) else []:
        n = counts[some]
        at = np.repeat(starts[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out[some] = super_minhash(elements[at], n, slots)
    return out


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_shingles, two numbers that tell its shingle set, and its bands' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near_duplicates")
        for batch in batches:
            for part in text_runs(batch, "text"):
                elements, counts = shingle_sets(part.column("text"), width)
                signature = _signatures(elements, counts, bands * rows)
                key = np.arange(bands, dtype=np.uint64)[None, :] + np.zeros((len(counts), 1), np.uint64)
                for j in range(rows):
                    key = _mix(key * U(0x9E3779B97F4A7C15) + signature[:, j::rows])
                sums = []
                for seed in (0x243F6A8885A308D3, 0x13198A2E03707344):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(elements ^ U(seed)), dtype=np.uint64)])
                    ends = np.cumsum(counts)
                    sums.append((total[ends] - total[ends - counts]).view(np.int64))
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * bands), pa.array(key.view(np.int64).ravel()))
                yield pa.record_batch([part.column("doc_id"), pa.array(counts), pa.array(sums[0]), pa.array(sums[1]), listed], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SKETCH)


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """Shingle sets (c, shingles) of the documents whose doc_id is among ``ids`` (c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near_duplicates")
        for batch in batches:
            for part in text_runs(batch, "text"):
                elements, counts = shingle_sets(part.column("text"), width)
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(elements.view(np.int64)))
                yield pa.record_batch([part.column("c"), listed], names=["c", "shingles"])

    own = docs.select(F.col("doc_id").cast("long").alias("c"), F.col("text").cast("string"))
    return own.join(_bounded(ids, ids.count()), "c", "left_semi").mapInArrow(run, "c bigint, shingles array<bigint>")


def _near(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)


def _verify(pairs: DataFrame, sets: DataFrame, percent: int, label: str) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose full sets are similar enough, as a table.

    A pair's first set comes to where the second is by one shuffle on ``a``; the sets are
    compared row by row in the join, so no group of pairs is ever held, and the pairs of a hub
    that has many are dealt out. ``pairs`` is a written table.
    """
    rows = pairs.count()
    hot = hot_keys(pairs.groupBy("a").agg(F.count("*").alias("_n")), rows)
    hubs = pairs.select(F.col("a").alias("c")).distinct()
    first = sets.join(_bounded(hubs, rows), "c", "left_semi").select(F.col("c").alias("a"), F.col("shingles").alias("_x"))
    second = _bounded(pairs, rows).join(sets.select(F.col("c").alias("b"), F.col("shingles").alias("_y")), "b")
    common = F.size(F.array_intersect("_x", "_y"))
    alike = F.lit(100) * common >= F.lit(percent) * (F.size("_x") + F.size("_y") - common)
    return materialize(join_hot(second, first, ["a"], hot, F.col("b"), hint="merge").where(alike).select("a", "b"), label)


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least id of its component, for every node of ``edges`` (a, b).

    Union-find runs over each task's own edges first and leaves stars. Then large stars and
    small stars alternate (every node's larger neighbours go to its least neighbour, then the
    smaller ones do) until nothing changes; each step is a written table.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while x != root:
                parent[x], x = root, parent[x]
            return root

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        pairs = [(x, find(x)) for x in list(parent)]
        yield pa.record_batch([pa.array([x for x, r in pairs if x != r], pa.int64()), pa.array([r for x, r in pairs if x != r], pa.int64())], names=["u", "v"])

    stars = materialize(edges.where("a <> b").select("a", "b").mapInArrow(local, "u bigint, v bigint").distinct(), "stars")
    mark = None
    while True:  # steps grow with the logarithm of the nodes
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        old, stars = stars, materialize(small, "stars")
        release(old)
        now = stars.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == mark:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = now


def link_classes(docs: DataFrame, reps: DataFrame, percent: int, rounds: int, width: int) -> DataFrame:
    """node and root for all classes that are linked with another; ``reps`` has c, n and bands."""
    spark = docs.sparkSession
    bands = reps.select("c", "n", F.explode("bands").alias("key"))
    shared = materialize(bands.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1"), "shared")
    hot = hot_keys(shared, shared.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0])
    buckets = materialize(join_hot(bands, shared.select("key"), ["key"], hot, F.col("c")), "buckets")
    sets = materialize(_sets_of(docs, buckets.select("c").distinct(), width), "sets")
    links = spark.createDataFrame([], "a bigint, b bigint")
    tested, done = links, []
    roots = spark.createDataFrame([], "node bigint, root bigint")

    def placed() -> DataFrame:
        return buckets.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))

    def live(rows: DataFrame, order: Column) -> DataFrame:
        """Buckets of more than one component, each with a hub."""
        hub = F.min(F.struct(order.alias("o"), F.col("c").alias("hub"), F.col("n").alias("hub_n"), F.col("root").alias("hub_root")))
        found = rows.groupBy("key").agg(hub.alias("h"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        return found.select("key", "h.hub", "h.hub_n", "h.hub_root")

    for turn in range(rounds):
        rows = placed()
        hubs = live(rows, F.col("c") if turn == 0 else F.xxhash64("c", "key", F.lit(turn)))
        met = join_hot(rows, hubs, ["key"], hot, F.col("c")).where((F.col("root") != F.col("hub_root")) & _near(F.col("n"), F.col("hub_n"), percent))
        votes = met.groupBy(F.least("c", "hub").alias("a"), F.greatest("c", "hub").alias("b"), F.col("c").alias("own")).agg(F.count("*").alias("votes"))
        fresh = votes.join(tested, ["a", "b"], "left_anti") if turn else votes
        pairs = materialize(fresh.groupBy("own").agg(F.max_by(F.struct("a", "b"), F.struct("votes", -F.col("a"), -F.col("b"))).alias("p")).select("p.a", "p.b").distinct(), "pairs")
        found = _verify(pairs, sets, percent, "links")
        links, tested, done = links.union(found), tested.union(pairs), [*done, found, pairs]
        if found.isEmpty():
            break
        roots = components(links)
    rows = placed()
    left = join_hot(rows, live(rows, F.col("c")).select("key"), ["key"], hot, F.col("c")).select("c", "n", "root").distinct()
    left = materialize(left, "left")
    pairs = _prefix_pairs(left, sets, percent)
    found = _verify(pairs, sets, percent, "links")
    roots = roots if found.isEmpty() else components(links.union(found))
    release(*done, found, pairs, left, shared, buckets, sets)
    return roots


def _prefix_pairs(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components in ``left`` (c, n, root) that can be similar enough.

    Sets of n and m shingles that reach the similarity have a least intersection, and so share
    a shingle among the first n - least + 1 of the one and m - least + 1 of the other, in any
    common order; the order here is by how many sets hold a shingle. Shingles of one set alone
    take up places but meet nothing.
    """
    held = sets.join(_bounded(left, left.count()), "c").select("c", "n", "root", F.explode("shingles").alias("h"))
    often = materialize(held.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "often")
    hot = hot_keys(often.withColumnRenamed("df", "_n"), often.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0])
    met = materialize(join_hot(held, often, ["h"], hot, F.col("c")), "met")
    counts = met.groupBy("c").agg(F.count("*").alias("others"))
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("c").orderBy("df", "h"))).join(counts, "c")
    ranked = ranked.withColumn("place", F.col("rank") + F.col("n") - F.col("others"))
    first = materialize(ranked.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1).select("h", "c", "n", "root", "place"), "prefix")
    x, y = (first.select("h", *(F.col(k).alias(f"{k}_{side}") for k in ("c", "n", "root", "place"))) for side in "xy")
    x, y = x.withColumn("kind", F.explode(F.array(_size_class("n_x", percent), _size_class("n_x", percent) + 1))), y.withColumn("kind", _size_class("n_y", percent))
    least = F.ceil((F.col("n_x") + F.col("n_y")) * percent / F.lit(100 + percent))
    early = (F.col("n_x") - F.col("place_x") + 1 >= least) & (F.col("n_y") - F.col("place_y") + 1 >= least)
    order = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("c_x") < F.col("c_y")))
    meet = x.join(y.hint("merge"), ["h", "kind"]).where(order & _near(F.col("n_x"), F.col("n_y"), percent) & (F.col("root_x") != F.col("root_y")) & early)
    pairs = materialize(meet.select(F.least("c_x", "c_y").alias("a"), F.greatest("c_x", "c_y").alias("b")).distinct(), "pairs")
    release(first, met, often)
    return pairs


def _size_class(n: str, percent: int) -> Column:
    """A number for sizes, such that sets that can be similar enough are in one class or in two that follow.

    The small addition keeps sizes at a border away from rounding.
    """
    return F.floor(F.log(F.col(n)) / F.log(F.lit(100.0 / percent)) + 1e-9) if percent < 100 else F.col(n)


def near_duplicates(docs: DataFrame, percent: int = 75, rounds: int = 1, width: int = WIDTH, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id and kept.

    Documents are linked whose shingle sets have 100 * intersection >= percent * union;
    component_id is the smallest doc_id that links reach. At the similarity itself, a pair
    shares no band with probability (1 - (percent / 100) ** rows) ** bands, 2.3e-6 by default;
    pairs that do share one are decided exactly. A text that is null or has no words has
    no shingles and is linked with nothing. Rows that repeat a doc_id count as one document
    with the links of each. A row without doc_id has no component and is kept. Very long
    texts are taken whole, a run of texts or one of them at a time. Other columns are ignored;
    an empty table gives an empty table.
    """
    drawn = materialize(sketch(docs, bands, rows, width), "sketch")
    told = drawn.where("doc_id is not null and n_shingles > 0")
    classes = materialize(told.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("c"), F.count("*").alias("_n")), "classes")
    total, key = drawn.count(), ["set_a", "set_b"]
    hot, hot_class = hot_keys(classes.select(*key, "_n"), total), hot_keys(classes.select("c", "_n"), total)
    reps = join_hot(told, classes.select(*key, "c"), key, hot, F.col("doc_id")).where("doc_id = c").select("c", F.col("n_shingles").alias("n"), "bands")
    roots = link_classes(docs, reps, percent, rounds, width)
    empty = F.col("n_shingles") == 0  # these have one set, and no class; any key does for them
    whole = drawn.select("doc_id", "n_shingles", F.when(empty, F.xxhash64("doc_id")).otherwise(F.col("set_a")).alias("set_a"), "set_b")
    whole = join_hot(whole, classes.select(*key, "c"), key, hot, F.col("doc_id"), "left")
    whole = whole.withColumn("c", F.when(~empty, F.col("c")).otherwise(F.col("doc_id")))
    whole = join_hot(whole, roots.withColumnRenamed("node", "c"), ["c"], hot_class, F.col("doc_id"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "c"))
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are kept: of each group, the document with the smallest doc_id.

    All columns stay as they are. Null and empty texts are in no group, rows without a doc_id
    are kept, and rows that repeat one are kept or go together; see :func:`near_duplicates`.
    """
    gone = near_duplicates(docs, **how).where("not kept").select("doc_id").distinct()
    return docs.join(_bounded(gone, gone.count()), "doc_id", "left_anti").select(*docs.columns)
