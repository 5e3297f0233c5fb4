"""Operator 1: WARC archives, and the normaliser for monolithic gzip.

An archive that is one gzip stream from end to end gives no access to a record but by
inflating all before it. The normaliser inflates such a file once, rewrites each record as
a gzip member of its own, header and block as they stand, and writes a sidecar index of the
members' offsets; readers then seek. Files are taken one a task and a chunk at a time, so
that very long records need no more memory than short ones; files have names of their own,
so a task that is repeated harms nothing, and only the manifest says which files count.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import chain
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import delete_folder, fresh_dir, hot_keys, join_hot, materialize, open_uri, release, text_runs

#: Digests that repeat are broadcast up to so many, of some 60 bytes each.
BROADCAST_DIGESTS = 100_000
VERSION = b"WARC/1.1"
RECORDS = "page_id bigint, url string, payload binary, digest string, length bigint, refers_to bigint, revisit boolean"
MEMBERS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, uri string, block binary"
CHUNK = 1 << 20
GZIP = 16 + zlib.MAX_WBITS
HTTP = "application/http"
_PAGES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:sitegrain:pages")


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """A record's id: the same for a page and payload always, and one of its own without a page_id."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(_PAGES, f'{page_id} {digest}')}>"


def format_record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None, revisit: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record, or a revisit with the head of the response alone.

    The HTTP head states the payload's full length in both. White space and control characters
    in a URL are percent-encoded. A page's number stands in an
    extension field, as ids are UUIDs.
    """
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page_id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]|\s", lambda m: quote(m[0]), (url or "").strip()) or None,
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Page-ID": page_id,
        "Content-Type": f"{HTTP}; msgtype=response",
    }
    if revisit:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = record_id(refers_to, digest)
        fields["Refers-To-Page-ID"] = refers_to
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + f"Content-Length: {len(block)}\r\n"
    return b"".join([VERSION, b"\r\n", head.encode(), b"\r\n", block, b"\r\n\r\n"])


def read_head(stream: BinaryIO) -> tuple[bytes, dict[str, list[str]]] | None:
    """The header of the record that starts here, as it stands, and its fields' values in order.

    Names are in lower case. A line that begins with white space goes on with the one before.
    None at the end of the stream.
    """
    first = stream.readline()
    while first in (b"\r\n", b"\n"):
        first = stream.readline()
    if not first:
        return None
    if not first.startswith(b"WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    lines, fields, name = [first], {}, ""
    while (row := stream.readline()) not in (b"\r\n", b"\n"):
        if not row:
            raise ValueError("a record ends within its header")
        lines.append(row)
        text = row.decode("utf-8", "replace")
        if text[0] in " \t" and name:
            fields[name][-1] += f" {text.strip()}"
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        fields.setdefault(name, []).append(value.strip())
    if "content-length" not in fields:
        raise ValueError("a record has no length")
    return b"".join([*lines, row]), fields


def blocks(stream: BinaryIO, n: int) -> Iterator[bytes]:
    """The ``n`` bytes that follow, in chunks."""
    while n:
        data = stream.read(min(n, CHUNK))
        if not data:
            raise ValueError("a record ends within its block")
        n -= len(data)
        yield data


def read_records(stream: BinaryIO) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Header fields and block of every record of an inflated stream."""
    while (head := read_head(stream)) is not None:
        yield head[1], b"".join(blocks(stream, int(head[1]["content-length"][0])))


class Inflated(io.RawIOBase):
    """The bytes of a gzip file of one or more members, inflated as they are read."""

    def __init__(self, source: BinaryIO):
        self._source, self._left, self._z = source, b"", zlib.decompressobj(GZIP)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            data = self._left or self._source.read(CHUNK)
            if self._z.eof:
                if not data:
                    return 0
                self._z = zlib.decompressobj(GZIP)
            out = self._z.decompress(data, len(into))
            self._left = self._z.unused_data if self._z.eof else self._z.unconsumed_tail
            if out:
                into[: len(out)] = out
                return len(out)
            if not data and not self._z.eof:
                raise ValueError("a gzip member is cut off")


def write_monolithic(records: DataFrame, level: int = 6, file_bytes: int = 64 << 20, date: str | None = None) -> DataFrame:
    """Write archives of one gzip stream each; returns a table of their paths (path, records).

    ``records`` has the columns of ``RECORDS``. A task starts a new file after ``file_bytes``
    of inflated records, so a very long payload makes a long file. ``date`` is what records
    say (default: now). An empty table has no files.
    """
    root = fresh_dir(records.sparkSession, "warc")
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    columns = ["page_id", "url", "payload", "digest", "length", "refers_to", "revisit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = z = None
        path, n, size = "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for part in text_runs(batch, "payload", 8 << 20):
                for row in zip(*(part.column(c).to_pylist() for c in columns)):
                    if out is None:
                        path, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        fs, at = open_uri(path)
                        fs.create_dir(at.rpartition("/")[0], recursive=True)
                        out, z = fs.open_output_stream(at, compression=None), zlib.compressobj(level, zlib.DEFLATED, GZIP)
                    data = format_record(*row, date)
                    out.write(z.compress(data))
                    n, size = n + 1, size + len(data)
                    if size >= file_bytes:
                        out.write(z.flush())
                        out.close()
                        done.append((path, n))
                        out = None
        if out is not None:
            out.write(z.flush())
            out.close()
            done.append((path, n))
        yield pa.record_batch([pa.array([p for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["path", "records"])

    return materialize(records.select(*columns).mapInArrow(run, "path string, records bigint"), "archives")


def normalise(archives: DataFrame, level: int = 6) -> DataFrame:
    """Rewrite archives (column path), each record a member; returns a row per rewritten file.

    Headers stay as they are, byte by byte, whatever their version and fields. Next to each
    new file ``X.warc.gz`` stands ``X.idx``, a JSON line for each record: offset and length of
    its member, record id and type. Columns: source, path, index, records. Paths that repeat
    are rewritten once each; null paths are left out.
    """
    root = fresh_dir(archives.sparkSession, "members")

    def rewrite(stream: BinaryIO, out, index) -> int:
        offset = n = 0
        while (head := read_head(stream)) is not None:
            raw, fields = head
            z, size = zlib.compressobj(level, zlib.DEFLATED, GZIP), 0
            for data in chain([raw], blocks(stream, int(fields["content-length"][0])), [b"\r\n\r\n"]):
                packed = z.compress(data)
                out.write(packed)
                size += len(packed)
            packed = z.flush()
            out.write(packed)
            size += len(packed)
            first = lambda name: fields.get(name, [None])[0]
            index.write((json.dumps({"offset": offset, "length": size, "id": first("warc-record-id"), "type": first("warc-type")}) + "\n").encode())
            offset, n = offset + size, n + 1
        return n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("path").to_pylist():
                fs, at = open_uri(source)
                name = f"{root}/{uuid.uuid4().hex}"
                to, place = open_uri(name)
                to.create_dir(place.rpartition("/")[0], recursive=True)
                with fs.open_input_stream(at, compression=None) as raw, to.open_output_stream(f"{place}.warc.gz", compression=None) as out, to.open_output_stream(f"{place}.idx", compression=None) as index:
                    n = rewrite(io.BufferedReader(Inflated(raw), CHUNK), out, index)
                yield pa.record_batch([pa.array([source]), pa.array([f"{name}.warc.gz"]), pa.array([f"{name}.idx"]), pa.array([n], pa.int64())], names=["source", "path", "index", "records"])

    paths = archives.select("path").where("path is not null")
    return materialize(paths.repartition(max(1, paths.count()), "path").mapInArrow(run, "source string, path string, index string, records bigint"), "normalised")


def _row(fields: dict[str, list[str]], block: bytes, with_block: bool) -> tuple:
    """A record as a row of ``MEMBERS``; an error where a response does not have the digest that it states."""
    first = lambda name: fields.get(name, [None])[0]
    number = lambda name: int(first(name)) if first(name) else None
    kind, stated = first("warc-type"), first("warc-payload-digest")
    head, payload = b"", block
    if (first("content-type") or "").replace(" ", "").lower().startswith(HTTP):
        head, _, payload = block.partition(b"\r\n\r\n")
    digest = payload_digest(payload) if kind != "revisit" else None
    if digest and stated and stated.startswith("sha1:") and stated[5:] != digest and kind == "response":
        raise ValueError(f"record {first('warc-record-id')} is damaged")
    size = len(payload)
    if kind == "revisit":
        said = re.search(rb"(?im)^content-length:\s*(\d+)", head)
        digest, size = stated.partition(":")[2] if stated else None, int(said[1]) if said else None
    return number("page-id"), size, digest, kind, number("refers-to-page-id"), first("warc-target-uri"), payload if with_block else None


def read_members(normalised: DataFrame, files_a_task: int = 1, with_block: bool = False) -> DataFrame:
    """Every record of normalised archives, by its index entry: the columns of ``MEMBERS``.

    ``block`` is the payload, null unless ``with_block``. A response's digest is computed from
    its payload and must equal the one in its header. Records that others wrote are read too:
    what they do not state (page_id, refers_to, a revisit's length) is null.
    """
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist()):
                fs, at = open_uri(path)
                with fs.open_input_stream(open_uri(index)[1], compression=None) as lines:
                    entries = [json.loads(x) for x in lines.read().splitlines()]
                rows, size = [], 0
                with fs.open_input_file(at) as source:
                    for e in entries:
                        source.seek(e["offset"])
                        data = zlib.decompress(source.read(e["length"]), GZIP)
                        ((fields, block),) = read_records(io.BytesIO(data))
                        rows.append(_row(fields, block, with_block))
                        size += len(block) if with_block else 64
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    tasks = max(1, -(-normalised.count() // files_a_task))
    return normalised.select("path", "index").repartition(tasks, "path").mapInArrow(run, MEMBERS)


def records_of(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """WARC records for ``pages`` (page_id, url, html): the columns of ``RECORDS``.

    The payload is the html in UTF-8, empty where null. Of records with equal payloads of at
    least ``least_bytes``, that with the largest page_id is the response and the others
    revisit it. Rows that tie for the largest are all responses; a null page_id is smaller
    than any. Digests that repeat are found without payloads; the rows of a digest that many
    pages have (all that are empty, say) are dealt over many tasks. Other columns of ``pages``
    are ignored; an empty table gives an empty table.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("payload")).withColumn("hex", F.sha1("payload"))
    again = materialize(rows.groupBy("hex").agg(F.max("page_id").alias("top"), F.count("*").alias("_n")).where("_n > 1"), "digests")
    if again.count() <= BROADCAST_DIGESTS:  # so no payload is shuffled
        joined = rows.join(F.broadcast(again.drop("_n")), "hex", "left")
    else:
        joined = join_hot(rows, again.drop("_n"), ["hex"], hot_keys(again.select("hex", "_n"), pages.count()), F.struct("page_id", "url"), "left")
    length = F.octet_length("payload").cast("long")
    revisit = (length >= least_bytes) & F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    # Base32 of the 40 hex digits: every 5 of them are 20 bits, or 4 characters.
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    bits = lambda i, shift: F.shiftright(F.conv(F.substr(F.col("hex"), i * 5 + 1, F.lit(5)), 16, 10).cast("int"), shift).bitwiseAND(31)
    char = lambda i, shift: F.substr(alphabet, bits(i, shift) + 1, F.lit(1))
    digest = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(*(char(i, s) for s in (15, 10, 5, 0)))), "")
    return joined.select("page_id", "url", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), digest.alias("digest"), length.alias("length"), F.when(revisit, F.col("top")).alias("refers_to"), revisit.alias("revisit"))


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as monolithic archives, normalise these, and read every record back.

    The monolithic archives are deleted once they are rewritten.
    """
    whole = write_monolithic(records_of(pages, least_bytes))
    members = normalise(whole)
    for folder in {r.folder for r in whole.select(F.regexp_extract("path", "^(.*)/", 1).alias("folder")).distinct().collect()}:  # one
        delete_folder(pages.sparkSession, folder)
    release(whole)
    return read_members(members)
