"""What the operators share: the shared folder, written tables and batching of texts."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import HOT_ROWS, HOT_SHARE, delete_folder, fresh_dir, hot_keys, join_hot, materialize, release, shared_root  # noqa: F401


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Hand texts to Python in batches of so many rows, in this session.

    Whole documents are long: at Spark's default of 10,000 rows a batch, and copies of it in
    the JVM's own buffers, take hundreds of MB.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def spare(name: str, taken: Iterable[str]) -> str:
    """``name``, or a longer one that no column of ``taken`` has, letter case aside."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def masked(docs: DataFrame, *keep: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with all columns but ``keep`` under numbers, and what gives them their names back.

    Operators that add columns for a while can then meet no column of the same name. What
    gives names back takes the names of further columns to keep.
    """
    names = {c: c if c in keep else f"_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*(F.col(c).alias(n) for c, n in names.items())), lambda df, *more: df.select(*(F.col(n).alias(c) for c, n in names.items()), *more)


def open_uri(uri: str):
    """File system and path for a folder of the shared store, on driver or executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def write_file(uri: str, data: bytes) -> None:
    """Write one file; folders are made as needed."""
    fs, path = open_uri(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(data)


def text_runs(batch: pa.RecordBatch, text: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of ``batch`` that hold about ``limit`` bytes of text each, one row at least.

    Word lists take many times the room of their text, so memory is bounded by the
    part or by the longest single text. Parts are copies: kernels that split strings do not
    all heed the offset of a slice. After the last part, memory that is free goes back to the
    system, as idle workers keep what they hold.
    """
    size, bounds = 0, [0]
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()):
        if size and size + n > limit:
            bounds.append(i)
            size = 0
        size += n
    for a, b in zip(bounds, [*bounds[1:], batch.num_rows]):
        if b > a:
            yield batch.take(pa.array(range(a, b), pa.int32()))
    give_back()


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], object] = lambda: None) -> object:
    """This worker's object under ``key``, made once; tasks that follow find it as it was left.

    A worker runs tasks of one operator after another. It holds the last operator's object
    alone: one with a key of its own lets go of what was there, so memos never add up.
    """
    if key not in _HELD:
        _HELD.clear()
        give_back()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Return free memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
