"""Crawl archives as a data source of Spark's: `spark.read.format("warc")` and `df.write.format("warc")`.

Reading. A file is cut at every `splitBytes`. A task seeks to its cut, looks for
the first gzip member from there on that opens with a WARC record, and reads the
members that begin before the next cut, one at a time, so that no file is ever
whole in memory and a large one is many tasks'. Plain files have no such marks:
each is one task's, read record by record. Only the columns of the schema given
are made; equality with a record type is pushed down.

Writing. Each task writes one file below `_temporary`, a gzip member for each
record, and the commit moves them; a failed job leaves nothing behind.

Defined results: a block may be empty; a head that cannot be read ends its member;
headers that are missing are null. Null payloads are written as empty ones.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, InputPartition, WriterCommitMessage

SCHEMA = "path string, position long, type string, uri string, date string, id string, refers_to string, digest string, length long, block binary"
#: Columns that are a header's value.
HEADERS = {"type": "warc-type", "uri": "warc-target-uri", "date": "warc-date", "id": "warc-record-id", "refers_to": "warc-refers-to", "digest": "warc-payload-digest"}
SPLIT_BYTES, READ_BYTES, BATCH_BYTES = 64 << 20, 1 << 20, 4 << 20
GZIP = b"\x1f\x8b\x08"


def store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the archives at a file or below a folder."""
    from pyarrow import fs

    system, inner = store(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    hidden = lambda name: any(p[:1] in "._" for p in name[len(inner) :].split("/") if p)
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.size and not hidden(f.path))


@dataclass
class Piece(InputPartition):
    """The members of a file that begin in [start, end)."""

    file: str
    start: int
    end: int


def head_of(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def member(f, at: int) -> tuple[bytes, int] | None:
    """The content of the gzip member that begins at a place and where it ends; None if it is none or is cut off."""
    f.seek(at)
    d, out = zlib.decompressobj(31), []
    while not d.eof:
        raw = f.read(READ_BYTES)
        if not raw:
            return None
        try:
            out.append(d.decompress(raw))
        except zlib.error:
            return None
    return b"".join(out), f.tell() - len(d.unused_data)


def opens_record(f, at: int) -> bool:
    """Whether a gzip member with a WARC record begins at a place."""
    f.seek(at)
    try:
        return zlib.decompressobj(31).decompress(f.read(4096), 5) == b"WARC/"
    except zlib.error:
        return False


def first_member(f, start: int, end: int) -> int | None:
    """The first place in [start, end) where a record's member begins."""
    at = start
    while at < end:
        f.seek(at)
        raw = f.read(min(READ_BYTES, end - at) + len(GZIP) - 1)
        k = raw.find(GZIP)
        while k >= 0:
            if opens_record(f, at + k):
                return at + k
            k = raw.find(GZIP, k + 1)
        at += READ_BYTES
    return None


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Heads and blocks of what one member holds, most often one record."""
    at = content.find(b"WARC/")
    while at >= 0:
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = head_of(content[at:end])
        size = int(head.get("content-length") or 0)
        yield head, content[end + 4 : end + 4 + size]
        at = content.find(b"WARC/", end + 4 + size)


def plain_records(f) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Places, heads and blocks of a file that is not compressed."""
    at = 0
    while True:
        f.seek(at)
        head = b""
        while b"\r\n\r\n" not in head.lstrip(b"\r\n") and (raw := f.read(1 << 14)):
            head += raw
        skipped = len(head) - len(head.lstrip(b"\r\n"))
        end = head.find(b"\r\n\r\n", skipped)
        if not head[skipped:].startswith(b"WARC/") or end < 0:
            return
        found = head_of(head[skipped:end])
        size = int(found.get("content-length") or 0)
        f.seek(at + end + 4)
        yield at + skipped, found, f.read(size)
        at += end + 4 + size


class WarcReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.split, self.schema, self.only = options["path"], int(options.get("splitBytes", SPLIT_BYTES)), schema, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("type",):
                self.only = f.value
            else:
                yield f

    def partitions(self):
        out = []
        for name, size in files_of(self.path):
            with store(self.path)[0].open_input_file(name) as f:
                step = self.split if f.read(2) == GZIP[:2] else size
            out += [Piece(name, at, min(at + step, size)) for at in range(0, size, step)]
        return out or [Piece("", 0, 0)]

    def found(self, piece: Piece) -> Iterator[tuple[int, dict[str, str], bytes]]:
        if not piece.file:
            return
        with store(self.path)[0].open_input_file(piece.file) as f:
            if f.read(2) != GZIP[:2]:
                yield from plain_records(f)
                return
            at = first_member(f, piece.start, piece.end)
            while at is not None and at < piece.end:
                got = member(f, at)
                if got is None:
                    at = first_member(f, at + 1, piece.end)  # a broken member: go on at the next that opens a record
                    continue
                for head, block in records(got[0]):
                    yield at, head, block
                at = got[1]

    def read(self, piece):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.schema)
        rows, size = {f.name: [] for f in arrow}, 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in arrow], schema=arrow)
        own = {"path": lambda at, h, b: piece.file, "position": lambda at, h, b: at, "length": lambda at, h, b: len(b), "block": lambda at, h, b: b}
        makers = {n: own.get(n) or (lambda at, h, b, k=HEADERS[n]: h.get(k)) for n in rows}
        n = 0
        for at, head, block in self.found(piece):
            if self.only is not None and head.get("warc-type") != self.only:
                continue
            for name, make in makers.items():
                rows[name].append(make(at, head, block))
            n, size = n + 1, size + 200 + len(block) * ("block" in rows)
            if size >= BATCH_BYTES:
                yield batch()
                rows, size = {k: [] for k in rows}, 0
        if size:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    n: int


def record(row: dict) -> bytes:
    """One record: its head, its block and two line ends. Ids follow from type, address and payload, so reruns agree."""
    block = bytes(row.get("block") or b"")
    digest = "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
    name = row.get("id") or f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row.get("type")} {row.get("uri")} {digest}')}>"
    head = {"WARC-Type": row.get("type") or "resource", "WARC-Record-ID": name, "WARC-Date": row.get("date") or "1970-01-01T00:00:00Z", "WARC-Target-URI": row.get("uri"), "WARC-Refers-To": row.get("refers_to"), "WARC-Payload-Digest": row.get("digest") or digest, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


class WarcWriter(DataSourceWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex

    def inner(self, *parts: str) -> str:
        return "/".join([store(self.path)[1].rstrip("/"), *parts])

    def write(self, iterator):
        from pyspark import TaskContext

        system, context = store(self.path)[0], TaskContext.get()
        name, n = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz", 0
        folder, out = self.inner("_temporary", self.job), None
        for row in iterator:
            if out is None:
                system.create_dir(folder, recursive=True)
                out = system.open_output_stream(f"{folder}/{name}", compression=None)
            deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
            out.write(deflate.compress(record(row.asDict())) + deflate.flush())
            n += 1
        if out is not None:
            out.close()
        return Written(name if n else None, n)

    def commit(self, messages):
        from pyarrow import fs

        system = store(self.path)[0]
        system.create_dir(self.inner(), recursive=True)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(self.inner())):
                if f.type == fs.FileType.File and f.base_name.startswith("part-"):
                    system.delete_file(f.path)
        for m in messages:
            if m and m.file:
                system.move(self.inner("_temporary", self.job, m.file), self.inner(f"{m.file.rsplit('-', 1)[0]}-{self.job}.warc.gz"))
        self._clear(system)
        with system.open_output_stream(self.inner("_SUCCESS")):
            pass

    def abort(self, messages):
        self._clear(store(self.path)[0])

    def _clear(self, system) -> None:
        from pyarrow import fs

        for folder in (self.inner("_temporary", self.job),):
            if system.get_file_info(folder).type == fs.FileType.Directory:
                system.delete_dir(folder)


class WarcSource(DataSource):
    """Options: path, and for reading splitBytes. Any part of SCHEMA may be asked for or written."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options, schema)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of a file or folder; `columns` is the part of SCHEMA to be made."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").schema(columns).option("splitBytes", split_bytes).load(path)


def write_warc(records: DataFrame, path: str, mode: str = "append") -> None:
    """Rows with any columns of SCHEMA (type, uri, date, id, refers_to, digest, block) as one archive a task."""
    records.sparkSession.dataSource.register(WarcSource)
    records.write.format("warc").mode(mode).save(path)
