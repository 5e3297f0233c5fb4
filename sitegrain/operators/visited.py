"""What a crawl has visited, as levels of keys with Bloom filters beside them.

Keys are dealt out by their hash into parts; a level is a table of keys and, for each part, a
file of bits. Candidates go to their part once, as hashes, and are held against the bits of all
levels there. What no level can have is new for certain; the rest alone meets the keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import fresh_dir, hot_keys, join_hot, materialize


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:/", "file:///", 1))


class Bits:
    """A Bloom filter over pairs of hashes: ``rounds`` bits a key, at h1 + i * h2."""

    def __init__(self, words: np.ndarray, rounds: int):
        self.words, self.rounds = words, rounds

    @classmethod
    def of(cls, keys: int, bits_each: int = 12) -> Bits:
        return cls(np.zeros(max(1, -(-keys * bits_each // 64)), np.uint64), max(1, round(bits_each * 0.69)))

    def _places(self, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first, second, size = first.astype(np.uint64), second.astype(np.uint64) | np.uint64(1), np.uint64(len(self.words) * 64)
        for i in range(self.rounds):
            at = (first + np.uint64(i) * second) % size
            yield at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))

    def add(self, first: np.ndarray, second: np.ndarray) -> None:
        for word, bit in self._places(first, second):
            np.bitwise_or.at(self.words, word.astype(np.int64), bit)

    def may_have(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.ones(len(first), bool)
        for word, bit in self._places(first, second):
            out &= (self.words[word.astype(np.int64)] & bit) != 0
        return out


class Visited:
    """Visited keys in a folder of the shared store, a level for each :meth:`add`."""

    def __init__(self, spark: SparkSession, folder: str | None = None, parts: int = 64, bits_each: int = 12):
        self.spark, self.folder, self.parts, self.bits_each = spark, folder or fresh_dir(spark, "visited"), parts, bits_each
        self.levels: list[str] = []

    def _dealt(self, keys: DataFrame) -> DataFrame:
        """With two hashes and the part; a part's rows stand together in one task."""
        hashed = keys.withColumns({"_h1": F.xxhash64("key"), "_h2": F.xxhash64(F.lit("2"), "key")})
        return hashed.withColumn("_part", F.pmod(F.col("_h1"), F.lit(self.parts)).cast("int"))

    def add(self, keys: DataFrame) -> None:
        """Add a level: the distinct keys (column key) that are not null; they need not be new."""
        path, bits_each = f"{self.folder}/level-{len(self.levels):04d}", self.bits_each
        self._dealt(keys.select("key").where("key is not null").distinct()).write.partitionBy("_part").parquet(f"{path}/keys")
        table = self._level(path)
        sizes = {r._part: r.n for r in table.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row for each part

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, Bits] = {}
            for batch in batches:
                part, first, second = (batch.column(c).to_numpy() for c in ("_part", "_h1", "_h2"))
                for p in np.unique(part).tolist():
                    at = part == p
                    held.setdefault(p, Bits.of(sizes[p], bits_each)).add(first[at].view(np.uint64), second[at].view(np.uint64))
            store, root = _open(f"{path}/bits")
            store.create_dir(root, recursive=True)
            for p, bits in held.items():
                own = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(own) as out:
                    np.save(out, bits.words)
                store.move(own, f"{root}/{p}.npy")
            yield pa.record_batch([pa.array([len(held)], pa.int64())], names=["n"])

        table.repartition(self.parts, "_part").select("_part", "_h1", "_h2").mapInArrow(run, "n bigint").write.format("noop").mode("overwrite").save()
        self.levels.append(path)

    def _level(self, path: str) -> DataFrame:
        return self.spark.read.schema("key string, _h1 bigint, _h2 bigint, _part int").parquet(f"{path}/keys")

    def tested(self, candidates: DataFrame, hot: DataFrame) -> DataFrame:
        """``candidates`` (with a column key) and ``maybe``: whether a level may have the key. Null keys never are.

        Rows of ``hot`` keys (key, _parts) are dealt out to several tasks, each with the part's bits.
        """
        levels, rounds = list(self.levels), Bits.of(1, self.bits_each).rounds
        salted = candidates.where("key is not null").withColumn("_row", F.monotonically_increasing_id()).join(hot, "key", "left")
        salted = self._dealt(salted).withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("_row"), F.col("_parts")), F.lit(0)).cast("int"))
        dealt = salted.repartition(self.parts, "_part", "_salt").sortWithinPartitions("_part")
        columns = [*candidates.columns, "_row"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held = None, []
            for batch in batches:
                part, first, second = (batch.column(c).to_numpy() for c in ("_part", "_h1", "_h2"))
                maybe = np.zeros(len(part), bool)
                for p in np.unique(part).tolist():
                    if p != at:  # one part's bits at a time
                        at, held = p, []
                        for path in levels:
                            store, root = _open(f"{path}/bits")
                            if store.get_file_info(f"{root}/{p}.npy").type != fs.FileType.NotFound:
                                with store.open_input_file(f"{root}/{p}.npy") as source:
                                    held.append(Bits(np.load(source), rounds))
                    own = part == p
                    for bits in held:
                        maybe[own] |= bits.may_have(first[own].view(np.uint64), second[own].view(np.uint64))
                yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(maybe)], names=[*columns, "maybe"])

        schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema), "_row bigint, maybe boolean"])
        return dealt.mapInArrow(run, schema)

    def unseen(self, candidates: DataFrame) -> DataFrame:
        """Rows of ``candidates`` whose key no level has, in any number of copies; rows without a key are all kept."""
        if not self.levels:
            return candidates
        counts = candidates.where("key is not null").groupBy("key").agg(F.count("*").alias("_n"))
        hot = materialize(hot_keys(counts, candidates.count()), "hot")
        tested = materialize(self.tested(candidates, F.broadcast(hot)), "tested")
        known = self._level(self.levels[0])
        for path in self.levels[1:]:
            known = known.unionByName(self._level(path))
        checked = join_hot(tested.where("maybe"), known.select("key").distinct(), ["key"], F.broadcast(hot), F.col("_row"), "left_anti")
        return tested.where("not maybe").unionByName(checked).select(*candidates.columns).unionByName(candidates.where("key is null"))
