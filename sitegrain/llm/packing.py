"""Operator 3: best-fit packing by minimum bin slack.

The lengths that are left form a histogram of at most ``capacity`` numbers whatever the
input's size, so the plan is made on it: per bin, the longest length left opens the bin
and a bitset subset-sum programme over the other lengths finds the fullest combination
that still fits. The same combination is the answer for the following bins too until one
of its lengths runs out, so it is taken as often as it can be. Pieces then find their
place from their rank among the pieces of the same length; the ranks come from a window
over (length, salt) with offsets per salt, so no length's pieces meet in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import materialize, spare, text_runs
from .tokens import shared_tokenizer

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def split_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts and cut those longer than ``capacity`` into pieces.

    ``docs`` has doc_id and text; other columns are ignored. A null text is empty and
    becomes one piece that holds the end id alone. Rows that repeat a doc_id or have none
    each give their own pieces. A very long text is taken whole, and its task holds its ids
    at once. An empty table gives an empty table. ``with_ids`` adds each piece's ids (array).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared_tokenizer(vocabulary, 300_000)
        for batch in batches:
            for rows in text_runs(batch, "text", 1 << 20):
                ids, counts = tokenizer.encode(rows.column("text"), end_id)
                data, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(counts)
                n = -(-counts // capacity)
                row = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                length = np.minimum(counts[row] - piece * capacity, capacity)
                first = (ends - counts)[row] + piece * capacity
                crc = [zlib.crc32(data[4 * a : 4 * (a + k)]) for a, k in zip(first.tolist(), length.tolist())]
                columns = [rows.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:  # pieces stand in the order of the ids, without gaps
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.record_batch(columns, schema=PIECE_SCHEMA.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else PIECE_SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES + ", ids array<int>" if with_ids else PIECES)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The combination of available lengths with the greatest sum up to ``room``.

    ``lengths`` are in falling order. A bitset holds the sums that are reachable; a bit
    that a length adds first is remembered by the sums before it, which is what tracing
    back needs. Longer lengths come first, so of equal sums the one of longer pieces wins.
    """
    mask, reach, seen = (1 << (room + 1)) - 1, 1, []
    for length in lengths:
        if length > room or not counts[length]:
            continue
        before, step, left = reach, 1, min(counts[length], room // length)
        while left > 0:
            take = min(step, left)
            reach |= (reach << (length * take)) & mask
            left, step = left - take, step * 2
        if reach != before:
            seen.append((length, before))
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, before in reversed(seen):
        used = 0
        while not before >> total & 1:
            total, used = total - length, used + 1
        if used:
            chosen.append((length, used))
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """(combination, how many bins take it) for every piece of ``histogram``."""
    counts = {int(k): int(n) for k, n in histogram.items() if n > 0}
    lengths, plan = sorted(counts, reverse=True), []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        rest = fullest(lengths, counts, capacity - first)
        counts[first] += 1
        chosen = dict(rest)
        chosen[first] = chosen.get(first, 0) + 1
        bins = min(counts[k] // m for k, m in chosen.items())
        for k, m in chosen.items():
            counts[k] -= m * bins
        plan.append((sorted(chosen.items(), reverse=True), bins))
        if any(not counts[k] for k in chosen):
            lengths = [k for k in lengths if counts[k]]
    return plan


def _slots(plan) -> dict[int, np.ndarray]:
    """By length: rows (first rank, pieces a bin, first sequence, offset in it), ranks rising."""
    slots, ranks, sequence = {}, {}, 0
    for chosen, bins in plan:
        offset = 0
        for length, m in chosen:
            slots.setdefault(length, []).append((ranks.get(length, 0), m, sequence, offset))
            ranks[length] = ranks.get(length, 0) + m * bins
            offset += m * length
        sequence += bins
    return {k: np.array(v, np.int64) for k, v in slots.items()}


def pack(pieces: DataFrame, capacity: int = 2048, rows_per_salt: int = 200_000) -> DataFrame:
    """Give each piece a sequence and a place in it.

    ``pieces`` has ``length`` (1 to ``capacity``), doc_id and piece; its other columns
    stay, but for the names sequence_id and offset. It is read three times, so it should
    be a written table. Ties of doc_id and piece may fall either way; every row gets a
    place of its own. An empty table gives an empty table.
    """
    pieces = pieces.drop("sequence_id", "offset")
    columns = pieces.columns
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    sizes = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    if any(not 1 <= k <= capacity for k in sizes):
        raise ValueError("a piece is empty or longer than the capacity")
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(plan_bins(sizes, capacity)))  # bounded as the histogram is
    salt, n, start, rank = (spare(c, columns) for c in ("_salt", "_n", "_before", "_rank"))
    salts = max(256, -(-sum(sizes.values()) // rows_per_salt))
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = salted.groupBy("length", salt).agg(F.count("*").alias(n))
    before = before.select("length", salt, (F.sum(n).over(Window.partitionBy("length").orderBy(salt)) - F.col(n)).alias(start))
    ranked = salted.withColumn(rank, F.row_number().over(Window.partitionBy("length", salt).orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(before, ["length", salt]).withColumn(rank, (F.col(rank) + F.col(start)).cast("long")).select(*columns, rank)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for batch in batches:
            length, at_rank = batch.column("length").to_numpy(), batch.column(rank).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                k = int(length[at[0]])
                own = table[k]
                first, m, base, begin = own[np.searchsorted(own[:, 0], at_rank[at], "right") - 1].T
                sequence[at] = base + (at_rank[at] - first) // m
                offset[at] = begin + (at_rank[at] - first) % m * k
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenise, cut and pack whole documents, of any length; see :func:`split_pieces` and :func:`pack`."""
    return pack(materialize(split_pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)


def sequences(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array), documents (array of ids in place order).

    Ids travel with their pieces, so rows that repeat a doc_id, or have none, keep their own.
    A sequence holds ``capacity`` ids at most, so its group is bounded. Null texts, very long
    ones and empty tables are those of :func:`split_pieces`.
    """
    packed = pack(materialize(split_pieces(docs, vocabulary, capacity, end_id, with_ids=True), "pieces"), capacity)
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("documents"))
