"""Operator 5: token-id files compressed by Re-Pair grammars.

Documents are dealt out by ranges of doc_id, encoded, and written in shards of about
``shard_tokens`` ids. Per shard, frequent pairs of neighbouring ids are replaced by new
symbols (nonterminals), round by round, until no pair is frequent any more; no pair crosses
the end of a document, so every document begins on a symbol. A shard file holds the rules,
the length that each rule expands to, and a table of its documents: any document, or any
range of its ids, is decoded from its own symbols alone.

File format, little endian: the 8 bytes ``SGRPAIR2``; six int64: the first nonterminal,
rules, symbols, documents, ids, and the bytes of all expansion lengths; then rules (left and
right, packed), expansion lengths (seven bits a byte, the eighth says that more follow), per
document doc_id (int64), whether that id is null (uint8), ids (int64) and symbols (int64);
last the symbols (packed). Packed numbers take as many bits as the greatest symbol needs,
the lowest bit first.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import fresh_dir, materialize, open_uri, text_runs, write_file
from .tokens import shared_tokenizer

MAGIC = b"SGRPAIR2"
HEAD = struct.Struct("<8s6q")
U = np.uint64
MANIFEST = "partition bigint, shard int, path string, n_docs bigint, n_tokens bigint, n_symbols bigint, n_rules bigint, n_bytes bigint"
READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


#: Greater than any rank.
UNRANKED = np.int32((1 << 31) - 1)


def _frequent(left: np.ndarray, right: np.ndarray, at: np.ndarray, bits: int, place_bits: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Places of the pairs that occur ``least`` times, each place's rank, and the pairs by rank.

    Rank 0 is the most frequent pair, ties go to the smaller one. A pair's places rise.
    """
    code = left.astype(U)
    code <<= U(bits)
    code |= right
    if 2 * bits + place_bits > 64:  # a very long document
        order = np.argsort(code, kind="stable")
        code, place = code[order], at[order]
    else:
        code <<= U(place_bits)
        code |= at.astype(U)
        code.sort()
        place = (code & U((1 << place_bits) - 1)).astype(np.int64)
        code >>= U(place_bits)
    begins = np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1])
    count = np.diff(begins, append=len(code))
    often = count >= least
    if not often.any():
        return None
    place, pair, count = place[np.repeat(often, count)], code[begins[often]], count[often]
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return place, np.repeat(rank, count), pair[order]


def _every_other(twins: np.ndarray, touch: np.ndarray) -> np.ndarray:
    """Of twins, pairs of one id, the second, fourth and so on of each run that overlaps (``touch``: the one before)."""
    begins = np.concatenate([[True], ~touch])
    run = np.arange(len(twins)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
    return twins[run % 2 == 1]


class _Rules:
    """The rules made so far and what they expand to."""

    def __init__(self, first_free: int):
        self.first_free, self.parts, self.lengths = first_free, [np.empty((0, 2), np.uint32)], np.empty(0, np.uint32)

    @property
    def bits(self) -> int:
        return (self.first_free + len(self.lengths)).bit_length()

    def add(self, pairs: np.ndarray, good: np.ndarray) -> np.ndarray:
        """Make rules of the ``good`` ones of ``pairs`` (by rank); returns the symbol of each rank."""
        bits, made = U(self.bits), len(self.lengths)
        pairs = pairs[good]
        a, b = (pairs >> bits).astype(np.uint32), (pairs & ((U(1) << bits) - U(1))).astype(np.uint32)
        self.parts.append(np.stack([a, b], 1))
        self.lengths = np.concatenate([self.lengths, _length_of(a, self.lengths, self.first_free) + _length_of(b, self.lengths, self.first_free)])
        return (np.cumsum(good) - 1 + self.first_free + made).astype(np.uint32)


def _dense_rounds(seq: np.ndarray, last: np.ndarray, rules: _Rules, place_bits: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rounds over whole arrays, until two thirds of the pairs need no second look: symbols, ends, open places."""
    mark = ~last
    mark[-1:] = False
    while len(at := np.flatnonzero(mark)) * 3 > len(seq):
        twins = np.flatnonzero((seq[1:] == seq[:-1]) & mark[:-1])
        odd = _every_other(twins, twins[1:] == twins[:-1] + 1) if len(twins) else twins
        if len(odd):
            mark[odd] = False
            at = np.flatnonzero(mark)
        if (found := _frequent(seq[at], seq[at + 1], at, rules.bits, place_bits, least)) is None:
            return seq, last, at[:0]
        place, own, pairs = found
        rank = np.full(len(seq), UNRANKED, np.int32)
        rank[place] = own
        left, won = rank.copy(), np.zeros(len(seq), bool)
        for _ in range(2):  # of occurrences that overlap, that of the better rank; then among the rest
            lower, best = left[1:] < left[:-1], left != UNRANKED
            best[1:] &= lower
            best[:-1] &= ~lower
            won |= best
            left[best] = UNRANKED
            left[1:][best[:-1]] = UNRANKED
            left[:-1][best[1:]] = UNRANKED
        here = np.flatnonzero(won)
        good = np.bincount(rank[here], minlength=len(pairs)) >= least
        here = here[good[rank[here]]]
        seq[here] = rules.add(pairs, good)[rank[here]]
        last[here] = last[here + 1]
        keep = np.ones(len(seq), bool)
        keep[here + 1] = False
        mark = rank != UNRANKED
        mark[odd] = mark[here] = True
        back = here[here > 0] - 1
        mark[back - ~keep[back]] = True
        mark &= ~last
        seq, last, mark = seq[keep], last[keep], mark[keep]
        mark[-1:] = False
    return seq, last, at


def _winners(place: np.ndarray, rank: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which occurrences are replaced: of those that overlap, that of the better rank; then among the rest."""
    won, left = np.zeros(len(place), bool), np.arange(len(place))
    for _ in range(2):
        p, r = place[left], rank[left]
        touch, lower = p[1:] == after[p[:-1]], r[1:] < r[:-1]
        beaten = np.zeros(len(p), bool)
        beaten[1:] |= touch & ~lower
        beaten[:-1] |= touch & lower
        won[left[~beaten]] = True
        gone = ~beaten
        gone[1:] |= touch & ~beaten[:-1]
        gone[:-1] |= touch & ~beaten[1:]
        left = left[~gone]
        if not len(left):
            break
    return won


def _linked_rounds(seq: np.ndarray, last: np.ndarray, at: np.ndarray, rules: _Rules, place_bits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rounds over the open places alone; symbols are linked to their neighbours, as gaps stay."""
    n = len(seq)
    after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
    while len(at) >= least:
        left, right = seq[at], seq[after[at]]
        twins = at[left == right]
        odd = _every_other(twins, twins[1:] == after[twins[:-1]]) if len(twins) else twins
        if len(odd):
            rest = np.flatnonzero(~np.isin(at, odd))
            at, left, right = at[rest], left[rest], right[rest]
        if (found := _frequent(left, right, at, rules.bits, place_bits, least)) is None:
            break
        place, rank, pairs = found
        order = np.argsort(place)
        place, rank = place[order], rank[order]
        won = _winners(place, rank, after)
        here, rank = place[won], rank[won]
        good = np.bincount(rank, minlength=len(pairs)) >= least
        here, rank = here[good[rank]], rank[good[rank]]
        seq[here] = rules.add(pairs, good)[rank]
        dead = after[here]
        last[here], alive[dead] = last[dead], False
        after[here] = after[dead]
        inside = after[here] < n
        before[after[here][inside]] = here[inside]
        back = before[here]
        at = np.unique(np.concatenate([place, odd, back[back >= 0]]))
        at = at[alive[at] & ~last[at]]
    return seq[alive], last[alive]


def repair(ids: np.ndarray, last: np.ndarray, first_free: int, least: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair: symbols, their document-end flags, rules, and the length that each expands to.

    ``last`` flags the ids that end a document; a pair never spans such an end. A round takes
    all pairs that occur ``least`` times or more, the more frequent before the others where
    occurrences overlap (ties: the smaller pair), and makes a rule of each that is replaced
    ``least`` times. The most frequent pair always is, so rounds go on until no pair occurs
    ``least`` times. Only pairs with a symbol of the last round, or that waited in it, can be
    frequent in the next, so those alone are looked at again. A rule takes the room of two
    symbols and its length: pairs that occur twice would cost more than they save.
    """
    rules, place_bits = _Rules(first_free), max(1, len(ids).bit_length())
    seq, last, at = _dense_rounds(ids.astype(np.uint32), last.copy(), rules, place_bits, least)
    seq, last = _linked_rounds(seq, last, at, rules, place_bits, least)
    return seq, last, np.concatenate(rules.parts), rules.lengths


def _length_of(symbols: np.ndarray, lengths: np.ndarray, first_free: int) -> np.ndarray:
    """How many ids each symbol stands for."""
    out = np.ones(len(symbols), np.uint32)
    compound = np.flatnonzero(symbols >= first_free)
    out[compound] = lengths[symbols[compound] - np.uint32(first_free)]
    return out


def expand(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, first_free: int) -> np.ndarray:
    """The ids that symbols stand for.

    Symbols get their places from their lengths; then all compound ones are parted in two at
    once, level by level. What is held at a time is bounded by the ids.
    """
    size = _length_of(symbols, lengths, first_free)
    ends = np.cumsum(size, dtype=np.int64)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    at = ends - size
    out[at] = symbols  # compound ones are written over
    compound = np.flatnonzero(symbols >= first_free)
    at, rule = at[compound], symbols[compound] - np.uint32(first_free)
    while len(at):
        pair = rules[rule]
        left, right = pair[:, 0], pair[:, 1]
        middle = at + _length_of(left, lengths, first_free)
        out[at], out[middle] = left, right
        at, both = np.concatenate([at, middle]), np.concatenate([left, right])
        compound = np.flatnonzero(both >= first_free)
        at, rule = at[compound], both[compound] - np.uint32(first_free)
    return out


def pack(numbers: np.ndarray, bits: int) -> bytes:
    """Numbers of ``bits`` bits each, 32 at most, one after another."""
    spread = np.unpackbits(numbers.astype("<u4").view(np.uint8), bitorder="little").reshape(-1, 32)
    return np.packbits(spread[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, first: int, n: int, bits: int) -> np.ndarray:
    """``n`` numbers from bytes whose first bit is bit ``first`` % 8 of the first byte."""
    raw = np.frombuffer(data + bytes(8), np.uint8).astype(U)
    at = first % 8 + np.arange(n) * bits
    byte, out = at >> 3, np.zeros(n, U)
    for j in range((bits + 14) // 8):
        out |= raw[byte + j] << U(8 * j)
    return (out >> (at & 7).astype(U) & U((1 << bits) - 1)).astype(np.uint32)


def to_varints(numbers: np.ndarray) -> bytes:
    """Seven bits a byte, the lowest first; the eighth bit says that more follow."""
    parts = np.stack([numbers >> np.uint32(7 * j) & np.uint32(127) for j in range(5)], 1).astype(np.uint8)
    used = np.stack([np.ones(len(numbers), bool), *(numbers >> np.uint32(7 * j) > 0 for j in range(1, 5))], 1)
    parts[:, :-1][used[:, 1:]] |= 128
    return parts[used].tobytes()


def from_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint32)
    ends = np.flatnonzero(raw < 128)
    begins = np.concatenate([[0], ends[:-1] + 1])
    shift = 7 * (np.arange(len(raw)) - np.repeat(begins, ends - begins + 1))
    return np.add.reduceat((raw & 127).astype(U) << shift.astype(U), begins).astype(np.uint32)


def to_bytes(doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray, first_free: int, **how) -> tuple[bytes, int, int]:
    """A shard file, and how many symbols and rules it has. Every document has an id at least."""
    last = np.zeros(len(ids), bool)
    last[np.cumsum(counts) - 1] = True
    symbols, ends, rules, lengths = repair(ids, last, first_free, **how)
    each = np.diff(np.concatenate([[-1], np.flatnonzero(ends)]))
    bits, sizes = (first_free + len(rules)).bit_length(), to_varints(lengths)
    head = HEAD.pack(MAGIC, first_free, len(rules), len(symbols), len(counts), len(ids), len(sizes))
    known = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes()
    return b"".join([head, pack(rules.ravel(), bits), sizes, known, counts.astype("<i8").tobytes(), each.astype("<i8").tobytes(), pack(symbols, bits)]), len(symbols), len(rules)


class Shard:
    """Random access to a shard file's documents through an open random-access file."""

    def __init__(self, source):
        self._source = source
        magic, self._free, rules, self.n_symbols, docs, self.n_tokens, sizes = HEAD.unpack(source.read(HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a shard file")
        self._bits = (self._free + rules).bit_length()
        take = lambda kind, n: np.frombuffer(source.read(np.dtype(kind).itemsize * n), kind)
        self.rules = unpack(source.read((2 * rules * self._bits + 7) // 8), 0, 2 * rules, self._bits).reshape(-1, 2)
        self.lengths = from_varints(source.read(sizes))
        ids, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if gone else d for d, gone in zip(ids.tolist(), null.tolist())]
        self.counts, self._symbols = take("<i8", docs), take("<i8", docs)
        self._at = source.tell()

    def _read(self, first: int, n: int) -> np.ndarray:
        """Symbols from place ``first`` on."""
        begin, end = first * self._bits // 8, ((first + n) * self._bits + 7) // 8
        self._source.seek(self._at + begin)
        return unpack(self._source.read(end - begin), first * self._bits, n, self._bits)

    def documents(self, first: int, stop: int) -> np.ndarray:
        """Ids of the documents at places ``first`` to ``stop`` - 1, joined."""
        symbols = self._read(int(self._symbols[:first].sum()), int(self._symbols[first:stop].sum()))
        return expand(symbols, self.rules, self.lengths, self._free)

    def ids(self, document: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` - 1 of one document; only the symbols that reach into them are expanded."""
        symbols = self._read(int(self._symbols[:document].sum()), int(self._symbols[document]))
        ends = np.cumsum(_length_of(symbols, self.lengths, self._free), dtype=np.int64)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skipped = int(ends[a - 1]) if a else 0
        return expand(symbols[a:b], self.rules, self.lengths, self._free)[start - skipped : max(start, stop) - skipped]


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int = 2, shard_tokens: int = 1 << 20, **how) -> DataFrame:
    """Encode whole texts and write shard files in ascending doc_id order; returns the manifest.

    ``docs`` has doc_id and text; other columns are ignored. A null text is empty, a null
    doc_id comes first, and rows of the same doc_id are ordered by text. Each document is
    closed by ``end_id``. A shard is closed by the document that brings it to ``shard_tokens``
    ids, so a very long text makes a long shard of its own. An empty table has no files. Files
    have names of their own, so a repeated task leaves an unused file at worst; the manifest
    names the files that count: partition and shard (both in order), path, documents, ids,
    symbols, rules and bytes. ``how`` goes to :func:`repair`.
    """
    root = fresh_dir(docs.sparkSession, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, shard = shared_tokenizer(vocabulary, 600_000), TaskContext.get().partitionId(), 0
        free = max(tokenizer.size, end_id + 1)
        held = [[], np.empty(0, np.uint32), np.empty(0, np.int64)]  # doc_ids, their ids, how many each has

        def flush(stop: int) -> pa.RecordBatch:
            """Write the first ``stop`` documents held."""
            nonlocal shard
            doc_ids, ids, counts = held
            n = int(counts[:stop].sum())
            data, symbols, rules = to_bytes(doc_ids[:stop], ids[:n], counts[:stop], free, **how)
            path = f"{root}/{part:06d}-{shard:06d}-{uuid.uuid4().hex}.rp"
            write_file(path, data)
            row = [part, shard, path, stop, n, symbols, rules, len(data)]
            held[:] = [doc_ids[stop:], ids[n:].copy(), counts[stop:]]
            shard += 1
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, [pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 5])], names=["partition", "shard", "path", "n_docs", "n_tokens", "n_symbols", "n_rules", "n_bytes"])

        for batch in batches:
            for rows in text_runs(batch, "text", 6 << 20):
                ids, counts = tokenizer.encode(rows.column("text"), end_id)
                held[:] = [held[0] + rows.column("doc_id").to_pylist(), np.concatenate([held[1], ids]), np.concatenate([held[2], counts])]
                while (stop := int(np.searchsorted(np.cumsum(held[2]), shard_tokens)) + 1) <= len(held[2]):
                    yield flush(stop)
        if held[0]:
            yield flush(len(held[0]))

    ranged = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ranged.mapInArrow(run, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame, files_a_task: int = 4) -> DataFrame:
    """Decode every file of a manifest: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before; it is summed first over partitions
    (one row each), then within a partition, so no window holds all files. Documents come as
    they were written: null and empty texts have the end id alone, rows that repeat a doc_id
    are documents of their own, and one without a doc_id comes with none. A manifest without
    files gives an empty table.
    """
    whole = manifest.groupBy("partition").agg(F.sum("n_tokens").alias("_n"))
    whole = whole.select("partition", (F.sum("_n").over(Window.orderBy("partition")) - F.col("_n")).alias("_base"))
    placed = manifest.join(whole, "partition").withColumn("_start", F.col("_base") + F.sum("n_tokens").over(Window.partitionBy("partition").orderBy("shard")) - F.col("n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("_start").to_pylist()):
                fs, at = open_uri(path)
                with fs.open_input_file(at) as source:
                    shard = Shard(source)
                    data = memoryview(shard.documents(0, len(shard.doc_ids)).astype("<u4").tobytes())
                ends = np.cumsum(shard.counts)
                begins = ends - shard.counts
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.record_batch([pa.array(shard.doc_ids, pa.int64()), pa.array(start + begins), pa.array(shard.counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, -(-manifest.count() // files_a_task))
    return placed.select("path", "_start").repartition(tasks, "path").mapInArrow(run, READ)
