"""WARC archives of pages with a two-level index of captures.

``write_archives`` puts every page into a gzip member of an archive file in the shared folder: a ``response`` record, or a ``revisit`` of the
record with the same payload and the smallest page id. ``build_index`` sorts the captures by their
key (host reversed, then port, path and query, then page id) and writes shards of compressed blocks of
``BLOCK_LINES`` lines; each shard ends in its sparse directory, the first key and place of every block.
``look_up`` finds captures by binary search in the list of shards, then in a shard's directory, reads
one block by range, searches it, reads the record by range, and takes the payload apart again.

Which record a payload belongs to is one aggregation by digest and a join of page ids, so a payload
that a third of all pages share is neither gathered nor paired up, and pages are dealt out by
their own id when written. The list of shards has ``MOST_SHARDS`` entries at most; it alone is
broadcast. Tasks write under names of their own attempt, and only files named in the table of captures,
which is written once, are read; a repeated task leaves an unused file and no wrong row.

Edge cases: NULL html is an empty payload, a NULL url has an empty key. Rows with the smallest page id of a payload are all
responses, so repeated rows come out alike; a payload of which all ids are NULL is always a response. Rows with equal
key get its captures in turn. Files are reached by ``pyarrow.fs``; other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import scratch_path
from .store import count_of, stored

ARCHIVE_BYTES = 256 << 20
BLOCK_LINES = 256
SHARD_LINES = 200_000
MOST_SHARDS = 4096
DATE = "2024-01-01T00:00:00Z"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
_CAPTURE = "key string, file string, at bigint, size bigint"


def capture_key(url: str | None, page_id: int | None) -> str:
    """The sort key of a capture: ``com,example,www)/path?query`` and the page id."""
    rest = (url or "").strip().partition("#")[0]
    _, found, behind = rest.partition("://")
    rest = behind if found else rest
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:]
    name, _, port = host.partition(":")
    reverse = ",".join(reversed(name.split("."))) + (f":{port}" if port not in ("", "80", "443") else "")
    path = path if path.startswith("/") else "/" + path
    key = f"{reverse}){path} {'-' if page_id is None else page_id}"
    return key.replace("\t", "%09").replace("\n", "%0A").replace("\r", "%0D")


def _files(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Writes the archives under ``folder``; returns the table of captures: ``key, file, at, size``."""
    plain = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha1(F.col("html").cast("binary"))
    ids = plain.select("page_id", digest.alias("digest"), F.octet_length("html").alias("n"))
    first = ids.where(F.col("n") >= least_bytes).groupBy("digest", "n").agg(F.min("page_id").alias("first"))
    told = ids.join(first, ["digest", "n"], "left").select(F.col("page_id").alias("id"), F.col("digest").alias("of"), "first").distinct()
    both = plain.withColumn("digest", digest).join(told, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")))
    later = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = both.select("page_id", "url", "html", "digest", later.alias("refers"))
    return stored(rows.mapInArrow(partial(_write, folder=folder), _CAPTURE), "captures")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One WARC record; a revisit has the headers of the response, not its payload."""
    block = _HTTP.format(len(payload)).encode() + (payload if refers is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        head[4:4] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers of a record, headers of its HTTP message, and the message's body."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return fields, http, body


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _write(rows: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    disk, root = _files(folder)
    disk.create_dir(root, recursive=True)
    task, made, out, at, name = TaskContext.get(), 0, None, 0, ""
    try:
        for part in rows:
            lines = []
            for page_id, url, html, digest, refers in zip(*(part.column(i) for i in range(5))):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at, made = f"pages-{task.partitionId()}-{task.taskAttemptId()}-{made}.warc.gz", 0, made + 1
                    out = disk.open_output_stream(f"{root}/{name}", compression=None)
                page_id, url, refers = page_id.as_py(), url.as_py(), refers.as_py()
                base32 = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                data = _gzip(record(page_id, url, html.as_buffer().to_pybytes(), base32, refers))
                out.write(data)
                lines.append((capture_key(url, page_id), name, at, len(data)))
                at += len(data)
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*lines)], names=["key", "file", "at", "size"])
    finally:
        if out is not None:
            out.close()


def build_index(captures: DataFrame, folder: str) -> list[tuple[str, str]]:
    """Writes the sorted index under ``folder``; returns first key and file of each shard, in order."""
    (n,) = count_of(captures, F.count("*"))
    shards = min(MOST_SHARDS, max(1, -(-n // SHARD_LINES)))
    dealt = captures.repartitionByRange(shards, "key").sortWithinPartitions("key", "file", "at")
    made = stored(dealt.mapInArrow(partial(_index, folder=folder), "first string, file string"), "index-shards")
    return sorted((r["first"], r["file"]) for r in made.toLocalIterator())


def _index(rows: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    disk, root = _files(folder)
    task, held, out, at, directory = TaskContext.get(), [], None, 0, []
    name = f"index-{task.partitionId()}-{task.taskAttemptId()}"

    def flush() -> None:
        nonlocal at, held
        data = zlib.compress("\n".join(held).encode())
        directory.append(f"{at}\t{len(data)}\t{held[0].split('\t', 1)[0]}")
        out.write(data)
        at, held = at + len(data), []

    for part in rows:
        for key, file, start, size in zip(*(part.column(i).to_pylist() for i in range(4))):
            if out is None:
                disk.create_dir(root, recursive=True)
                out = disk.open_output_stream(f"{root}/{name}", compression=None)
            held.append(f"{key}\t{file}\t{start}\t{size}")
            if len(held) == BLOCK_LINES:
                flush()
    if out is not None:
        if held:
            flush()
        data = zlib.compress("\n".join(directory).encode())
        out.write(data + len(data).to_bytes(8, "little"))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([directory[0].split("\t", 2)[2]]), pa.array([name])], names=["first", "file"])


class Captures:
    """Looks captures up by key, with range reads only."""

    def __init__(self, shards: list[tuple[str, str]], index: str, archives: str):
        self.firsts, self.names = [a for a, _ in shards], [b for _, b in shards]
        self.index, self.archives = _files(index), _files(archives)
        self.open: OrderedDict[str, pa.NativeFile] = OrderedDict()
        self.shard, self.directory = "", ([], [])
        self.block, self.lines = ("", -1), ([], [])

    def _read(self, where: tuple[fs.FileSystem, str], name: str, at: int, size: int) -> bytes:
        """``size`` bytes from ``at``; from the end if that is negative."""
        path = f"{where[1]}/{name}"
        if path not in self.open:
            if len(self.open) >= 32:
                self.open.popitem(last=False)[1].close()
            self.open[path] = where[0].open_input_file(path)
        self.open.move_to_end(path)
        file = self.open[path]
        return file.read_at(size, at if at >= 0 else file.size() + at)

    def _blocks(self, shard: str) -> tuple[list[str], list[tuple[int, int]]]:
        if shard != self.shard:
            size = int.from_bytes(self._read(self.index, shard, -8, 8), "little")
            lines = zlib.decompress(self._read(self.index, shard, -8 - size, size)).decode().split("\n")
            parts = [line.split("\t", 2) for line in lines]
            self.shard, self.directory = shard, ([p[2] for p in parts], [(int(p[0]), int(p[1])) for p in parts])
        return self.directory

    def _lines(self, shard: str, number: int, place: tuple[int, int]) -> tuple[list[str], list[str]]:
        if (shard, number) != self.block:
            lines = zlib.decompress(self._read(self.index, shard, *place)).decode().split("\n")
            self.block, self.lines = (shard, number), ([line.split("\t", 1)[0] for line in lines], lines)
        return self.lines

    def find(self, key: str, nth: int = 0) -> bytes | None:
        """The record of the ``nth`` capture with this key."""
        at = bisect_right(self.firsts, key) - 1
        if at < 0:
            return None
        firsts, places = self._blocks(self.names[at])
        for number in range(max(0, bisect_left(firsts, key) - 1), len(firsts)):
            if firsts[number] > key:
                return None
            keys, lines = self._lines(self.names[at], number, places[number])
            low, high = bisect_left(keys, key), bisect_right(keys, key)
            if nth < high - low:
                _, file, start, size = lines[low + nth].split("\t")
                return zlib.decompress(self._read(self.archives, file, int(start), int(size)), 31)
            nth -= high - low
        return None


def look_up(wanted: DataFrame, shards: list[tuple[str, str]], index: str, archives: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every row of ``wanted`` (``page_id, url``)
    that has a capture.
    """
    asked = wanted.select(F.col("page_id").cast("bigint").alias("page_id"), "url").mapInArrow(_keys, "page_id bigint, key string")
    asked = asked.repartitionByRange("key").sortWithinPartitions("key")
    shared = wanted.sparkSession.sparkContext.broadcast(shards)
    kind = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return asked.mapInArrow(partial(_look_up, shards=shared, index=index, archives=archives), kind)


def _keys(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in rows:
        keys = [capture_key(url, i) for i, url in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.string())], names=["page_id", "key"])


def _look_up(rows: Iterator[pa.RecordBatch], shards, index: str, archives: str) -> Iterator[pa.RecordBatch]:
    captures, last, nth = Captures(shards.value, index, archives), None, 0
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for part in rows:
        out = []
        for page_id, key in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            last, nth = key, nth + 1 if key == last else 0
            if (data := captures.find(key, nth)) is None:
                continue
            fields, http, body = parsed(data)
            digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
            refers = fields.get("WARC-Refers-To")
            if refers is None and base32_sha1(body) != digest:
                raise ValueError(f"the payload of page {page_id} does not have its digest")
            size = len(body) if refers is None else int(http.decode().rpartition("Content-Length: ")[2].split("\r\n")[0])
            own = int(refers.removeprefix("<urn:page:").removesuffix(">")) if refers else None
            out.append((page_id, size, digest, fields["WARC-Type"], own))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, types)], names=names)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Writes archives and index of all pages in the shared scratch folder, and looks every page up."""
    folder = scratch_path(pages.sparkSession, "archives")
    captures = write_archives(pages, f"{folder}/warc")
    shards = build_index(captures, f"{folder}/index")
    return look_up(pages, shards, f"{folder}/index", f"{folder}/warc")
