"""Operator 4: benchmark decontamination by n-gram windows.

The windows of the benchmark's items are held as a hash set in every worker: words get
numbers, windows hashes of their numbers. Documents are read once, without a shuffle: the
words of a run of texts are numbered together, the hashes of windows whose words the
benchmark knows are looked up in the set, and each find is verified word by word.

Windows of a benchmark larger than ``block_bytes`` are a table instead, and what is broadcast is
a filter of ``FILTER_BYTES`` over their hashes. Documents are looked through once, whatever the
benchmark's size; windows that pass the filter, and few others do, meet the table by their
words, which verifies them. Finds are gathered by a digest of the text and joined to the
documents.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import held, hot_keys, join_hot, masked, materialize, release, spare, text_runs

#: Bytes outside words become spaces, A to Z become lower case.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD.encode())
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of the filter that is broadcast for a large benchmark, and of finds that are broadcast to the documents.
FILTER_BYTES, FINDS_BYTES = 64 << 20, 8 << 20
HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])
HITS_ARROW = pa.struct([("n_words", pa.int64()), ("hit_words", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def words(text: str | None) -> list[bytes]:
    """Words of a text in lower case (A to Z only)."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def _listed(values: pa.Array, owner: np.ndarray, n: int) -> pa.Array:
    """``values`` as a list for each of ``n`` owners; owners rise."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), pa.int32()), values)


class _Windows:
    """All windows of ``k`` words of some items, by a hash that tells them apart."""

    def __init__(self, k: int, codes: np.ndarray, starts: np.ndarray, owner: np.ndarray):
        self.k, self._codes, seed = k, codes, 0
        while True:  # another seed in the rare case that two windows have one hash
            hashes = self._hash(codes, starts, seed)
            order = np.argsort(hashes, kind="stable")
            begins = np.concatenate([[True], np.diff(hashes[order]) != 0])
            group = np.cumsum(begins) - 1
            first = starts[order][begins]
            if all((codes[starts[order] + j] == codes[first[group] + j]).all() for j in range(k)):
                break
            seed += 1
        self._seed, self._hashes, self._first = seed, hashes[order][begins], first
        pairs = np.unique(np.stack([group, owner[order]], 1), axis=0)
        self._items, self._ends = pairs[:, 1], np.cumsum(np.bincount(pairs[:, 0], minlength=len(first)))
        self._low = np.zeros(1 << 16, bool)
        self._low[self._hashes & np.uint64(0xFFFF)] = True

    def _hash(self, codes: np.ndarray, at: np.ndarray, seed: int) -> np.ndarray:
        out = np.full(len(at), seed, np.uint64)
        for j in range(self.k):
            x = codes[at + j].astype(np.uint64) + np.uint64(1)
            out = (out ^ x * _FACTOR) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
        return out

    def find(self, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the places ``at`` where a window begins, and which window."""
        hashes = self._hash(codes, at, self._seed)
        some = np.flatnonzero(self._low[hashes & np.uint64(0xFFFF)])
        at, hashes = at[some], hashes[some]
        near = np.minimum(np.searchsorted(self._hashes, hashes), len(self._hashes) - 1)
        same = self._hashes[near] == hashes
        at, near = at[same], near[same]
        real = np.ones(len(at), bool)
        for j in range(self.k):
            real &= codes[at + j] == self._codes[self._first[near] + j]
        return at[real], near[real]

    def items(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items that hold the windows, joined, and how many each window has."""
        n = np.diff(np.concatenate([[0], self._ends]))[window]
        return self._items[np.repeat(self._ends[window] - np.cumsum(n), n) + np.arange(int(n.sum()))], n


class WindowSet:
    """The windows of some items: ``n`` consecutive words, or all words of a shorter item."""

    def __init__(self, items: list[tuple[str, str | None]], n: int):
        self.names = sorted({item for item, _ in items})
        number, self._codes, flat, of = {x: i for i, x in enumerate(self.names)}, {}, [], {}
        for item, text in items:
            own = [self._codes.setdefault(w, len(self._codes)) for w in words(text)]
            if own:
                k = min(n, len(own))
                starts = np.arange(len(flat), len(flat) + len(own) - k + 1)
                of.setdefault(k, []).append((starts, np.full(len(starts), number[item])))
                flat += own
        codes = np.array(flat, np.int32)
        self._windows = [_Windows(k, codes, *(np.concatenate(x) for x in zip(*parts))) for k, parts in of.items()]

    def hits(self, texts: pa.Array) -> pa.Array:
        """For each text a struct of ``HITS``: places of hit words, and the items with windows there."""
        lists = [words(x) for x in texts.to_pylist()]
        sizes = np.array([len(x) for x in lists], np.int64)
        total, ends = int(sizes.sum()), np.cumsum(sizes)
        codes = np.fromiter((c for own in lists for c in map(self._codes.get, own, repeat(-1))), np.int32, total)
        owner = np.repeat(np.arange(len(lists)), sizes)
        #: How many known words of the same text begin at each place.
        stops = np.flatnonzero(np.concatenate([(codes < 0) | np.isin(np.arange(total), ends), [True]]))
        at = np.arange(total)
        known = np.where(codes < 0, 0, stops[np.minimum(np.searchsorted(stops, at, "right"), len(stops) - 1)] - at)
        edge, pairs = np.zeros(total + 1, np.int64), [np.empty((0, 2), np.int64)]
        for w in self._windows:
            found, window = w.find(codes, np.flatnonzero(known >= w.k))
            np.add.at(edge, found, 1)
            np.add.at(edge, found + w.k, -1)
            items, n = w.items(window)
            pairs.append(np.stack([np.repeat(owner[found], n), items], 1))
        hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        both = np.unique(np.concatenate(pairs), axis=0)
        places = _listed(pa.array(hit - (ends - sizes)[owner[hit]], pa.int32()), owner[hit], len(lists))
        named = _listed(pa.array(self.names, pa.string()).take(pa.array(both[:, 1])), both[:, 0], len(lists))
        return pa.StructArray.from_arrays([pa.array(sizes), places, named], fields=list(HITS_ARROW))


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The benchmark's items with an id and a text, and the bytes of all texts."""
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    return items, items.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _finder(items: DataFrame, n: int):
    """What makes the window set of some items, once a worker."""
    sent = items.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in items.toLocalIterator()])  # block_bytes of text
    name = f"windows-{uuid.uuid4().hex}"
    return lambda: held(name, lambda: WindowSet(sent.value, n))


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 13, block_bytes: int = 8 << 20) -> DataFrame:
    """All rows and columns of ``docs`` and a struct ``hits``: n_words, hit_words, items.

    hit_words are the places (from 0, rising) of words inside any occurrence of a window
    of ``n`` benchmark words (an item of fewer words is one window); items are the distinct
    item_ids with such windows, sorted as strings. A null or empty text has no words; very
    long texts are taken whole. A benchmark row without item_id or text has no windows;
    repeated rows count once. An own column ``hits`` of ``docs`` is replaced. Empty tables
    give no rows, or no hits.
    """
    docs = docs.drop("hits")
    items, size = _items(benchmark)
    return _hits_by_set(docs, items, n) if size <= block_bytes else _hits_by_table(docs, items, n)


def _hits_by_set(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    columns, windows = docs.columns, _finder(items, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_runs(batch, "text"):
                yield pa.record_batch([*(rows.column(c) for c in columns), windows().hits(rows.column("text"))], names=[*columns, "hits"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("hits", HITS)]))


class _WordHashes:
    """64-bit hashes of words, those of a worker's commonest kept, and of windows of words."""

    def __init__(self, most: int = 200_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def of(self, own: list[bytes]) -> np.ndarray:
        known, out = self.known, []
        for w in own:
            h = known.get(w)
            if h is None:
                h = xxhash.xxh3_64_intdigest(w)
                if len(known) < self.most:
                    known[w] = h
            out.append(h)
        return np.array(out, np.uint64)

    @staticmethod
    def windows(hashes: np.ndarray, k: int) -> np.ndarray:
        out = np.full(max(0, len(hashes) - k + 1), k, np.uint64)
        for j in range(k if len(out) else 0):
            out = (out ^ hashes[j : j + len(out)] * _FACTOR) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
        return out


class _Filter:
    """A Bloom filter of four bits a window, in pieces that tasks of their own make."""

    rounds = 4

    def __init__(self, size: int, bits: np.ndarray | None = None):
        self.size, self.bits = np.uint64(size * 8), bits

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """Places of bits, a row a round."""
        step = (hashes >> np.uint64(17)) | np.uint64(1)
        return np.stack([(hashes + np.uint64(i) * step) % self.size for i in range(self.rounds)])

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.places(hashes):
            out &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def _made_filter(windows: DataFrame, size: int, pieces: int = 64) -> _Filter:
    """The filter over all ``windows`` (column hash): each piece is made by the task that its bits are dealt to."""
    width = -(-size // pieces)
    size = width * pieces

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _Filter(size).places(batch.column("hash").to_numpy().view(np.uint64)).reshape(-1)
            yield pa.record_batch([pa.array((at // np.uint64(width * 8)).astype(np.int32)), pa.array((at % np.uint64(width * 8)).astype(np.int64))], names=["piece", "bit"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            piece, bit = batch.column("piece").to_numpy(), batch.column("bit").to_numpy()
            for p in np.unique(piece).tolist():
                own, own_bits = held.setdefault(p, np.zeros(width, np.uint8)), bit[piece == p]
                np.bitwise_or.at(own, own_bits >> 3, np.uint8(1) << (own_bits & 7).astype(np.uint8))
        for p, own in held.items():
            yield pa.record_batch([pa.array([p], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["piece", "bits"])

    rows = windows.select("hash").mapInArrow(spread, "piece int, bit bigint").repartition(pieces, "piece").mapInArrow(gather, "piece int, bits binary").collect()
    bits = np.zeros(size, np.uint8)
    for r in rows:
        bits[r.piece * width : (r.piece + 1) * width] = np.frombuffer(r.bits, np.uint8)
    return _Filter(size, bits)


def _hits_by_table(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """Windows that pass the filter meet the table of all windows; then all finds of a text, then its documents."""

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for batch in batches:
            for rows in text_runs(batch, "text"):
                for item, text in zip(rows.column("item_id").to_pylist(), rows.column("text").to_pylist()):
                    own = words(text)
                    k = min(n, len(own))
                    if k:
                        found = [b" ".join(own[i : i + k]) for i in range(len(own) - k + 1)]
                        columns = [pa.array([k] * len(found), pa.int32()), pa.array(found, pa.binary()), pa.array(hashes.windows(hashes.of(own), k).view(np.int64)), pa.array([item] * len(found))]
                        yield pa.record_batch(columns, names=["k", "window", "hash", "item"])

    windows = materialize(items.mapInArrow(windows_of, "k int, window binary, hash bigint, item string").distinct(), "windows")
    lengths = sorted(r.k for r in windows.select("k").distinct().collect())  # n at most
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((_made_filter(windows.select("hash").distinct(), FILTER_BYTES).bits, lengths))
    named_windows = materialize(windows.groupBy("k", "window").agg(F.array_sort(F.collect_set("item")).alias("items")), "window_items")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bits, lengths), hashes = shared.value, _WordHashes()
        windows = _Filter(len(bits), bits)
        for batch in batches:
            for rows in text_runs(batch, "text"):
                keys, places, ks, found = [], [], [], []
                for key, text in zip(rows.column("key").to_pylist(), rows.column("text").to_pylist()):
                    own = words(text)
                    codes = hashes.of(own)
                    for k in lengths:
                        for at in np.flatnonzero(windows.may_have(hashes.windows(codes, k))).tolist():
                            keys.append(key), places.append(at), ks.append(k), found.append(b" ".join(own[at : at + k]))
                yield pa.record_batch([pa.array(keys, pa.string()), pa.array(places, pa.int32()), pa.array(ks, pa.int32()), pa.array(found, pa.binary())], names=["key", "at", "k", "window"])

    keyed = docs.select(F.md5(F.col("text").cast("string").cast("binary")).alias("key"), F.col("text").cast("string").alias("text")).where("text is not null")
    copies = keyed.groupBy("key").agg(F.count("*").alias("_n"))
    found = materialize(keyed.mapInArrow(look, "key string, at int, k int, window binary").distinct(), "finds")
    hot = hot_keys(found.groupBy("k", "window").agg(F.count("*").alias("_n")), found.count())
    real = materialize(join_hot(found, named_windows, ["k", "window"], hot, F.struct("key", "at")).select("key", "at", "k", "items"), "verified")
    spans = F.transform(F.collect_set(F.struct("at", "k")), lambda x: F.sequence(x["at"], x["at"] + x["k"] - 1))  # of one text
    places = real.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(spans))).alias("hit_words"))
    listed = real.select("key", F.explode("items").alias("item")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    whole = materialize(places.join(listed, "key"), "hits")
    release(real, found, named_windows, windows)
    shared.destroy()
    own, named = masked(docs)
    text = F.col(own.columns[docs.columns.index("text")]).cast("string")
    key, row = spare("key", own.columns), F.struct(*own.columns[:4])
    few, own = whole.withColumnRenamed("key", key), own.withColumn(key, F.md5(text.cast("binary")))
    size = whole.agg(F.sum(F.size("hit_words") * 4 + F.size("items") * 16 + 48)).first()[0] or 0
    if size <= FINDS_BYTES:
        joined = own.join(F.broadcast(few), key, "left")
    else:
        hot = hot_keys(copies.join(whole, "key", "left_semi").select(F.col("key").alias(key), "_n"), docs.count())
        joined = join_hot(own, few, [key], hot, row, "left")
    none = lambda c, kind: F.coalesce(F.col(c), F.expr(f"cast(array() as array<{kind}>)")).alias(c)
    hits = F.struct(F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"), none("hit_words", "int"), none("items", "string"))
    return named(joined.select(*(c for c in own.columns if c != key), hits.alias("hits")), "hits")


def contaminated(ratio: int = 20) -> Column:
    """Whether at least one in ``ratio`` words of a row with ``hits`` is hit."""
    return (F.size("hits.hit_words") > 0) & (F.lit(ratio) * F.size("hits.hit_words") >= F.col("hits.n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 13, ratio: int = 20) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, unchanged, whatever their columns are called.

    Null and empty texts are clean; rows that repeat a doc_id, or have none, are each decided by
    their own text; very long ones are taken whole. Empty tables are those of :func:`find_hits`.
    """
    own, named = masked(docs, "text")
    return named(find_hits(own, benchmark, n).where(~contaminated(ratio)))


def cut_spans(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """All rows of ``docs``, with every run of hit words cut from ``text``.

    What stands before a run stays, what follows it goes on at the next word that is not hit.
    Other columns, null and empty texts are unchanged; see :func:`find_hits` for the rest.
    """
    own, named = masked(docs, "text")
    found, columns = find_hits(own, benchmark, n), own.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, hits in enumerate(batch.column("hits").to_pylist()):
                if hits["hit_words"]:
                    data, at = texts[i].encode("utf-8", "surrogatepass"), set(hits["hit_words"])
                    kept, begin, inside = [], 0, False
                    for k, m in enumerate(_WORD.finditer(data)):
                        if k in at and not inside:
                            kept.append(data[begin : m.start()])
                        inside = k in at
                        begin = m.end() if inside else begin
                    texts[i] = b"".join([*kept, data[begin:]]).decode("utf-8", "surrogatepass")
            yield pa.record_batch([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns], names=columns)

    return named(found.mapInArrow(run, own.schema))


def digest(found: DataFrame, ratio: int = 20) -> DataFrame:
    """Per row of :func:`find_hits`: the counts and the digest of its items."""
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        F.size("hits.hit_words").cast("long").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ","), 256).alias("items_sha256"),
        contaminated(ratio).alias("contaminated"),
    )
