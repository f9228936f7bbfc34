"""Operator 7: a deterministic sharded WARC writer, and its reader.

Records are range-sorted by id into shards of about `shard_bytes`, or of a
`MAX_SHARDS`th of the table if that is more. Their bounds come from a histogram of
ids with four cells a shard, so that reruns cut alike. A task writes one shard after the
other, one gzip member a record, and rolls to a new file once the compressed
size passes `roll_bytes`. A file is written under a temporary name of its own
attempt and renamed when complete; the manifest, written last, names the files
that count. A lost executor's task runs again and makes the same files.

Dates, record ids, lengths and digests are regenerated: ids are UUID 5 of row
and payload, the date is a parameter. Equal payloads of `revisit_from` bytes or
more become revisits of the row with the largest id.

Defined results: null html is an empty payload; a null id has no id header and
comes back as null; repeated rows are written each; if several rows tie for the
largest id, all of them are responses; a null url has no target header; line
breaks in urls are percent-encoded; an empty table gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lexloom.llm.common import checkpoint_dir, frugal, written

#: Shards at most (a task each), and cells of the id histogram at least; there are four cells a shard.
MAX_SHARDS, CELLS = 100_000, 4096
#: Parts that a cell with too many bytes is split into, and how often.
SPLIT, DEPTH = 64, 8
#: Digests of repeated payloads (about 80 bytes each) that are broadcast at most; more are joined by shuffle.
BROADCAST_DIGESTS = 200_000
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's name space for URLs


def cells_of(sized: DataFrame, shard_bytes: int) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """(cell, shard), and a function that adds `cell` to rows with an id.

    Cells are equal ranges of the ids; one with more than a shard's bytes is split
    again between its own least and largest id, until none is too large or of several
    ids, so that a few far ids don't crowd the others into one cell. Shards are runs
    of whole cells in the order of ids, null ids last.
    """
    lo, hi, total = sized.agg(F.min("id"), F.max("id"), F.sum("n")).first()
    lo, hi, size = lo or 0, hi or 0, max(shard_bytes, (total or 0) // MAX_SHARDS)
    cells, steps = max(CELLS, 4 * ((total or 0) // size + 1)), []
    place = lambda low, high, k: F.least(F.floor((F.col("id").cast("double") - low) * (k / (high - low + 1))), F.lit(k - 1)).cast("long")

    def located(df: DataFrame) -> DataFrame:
        whole = F.when(F.col("id").isNull(), F.array(F.lit(cells).cast("long"))).otherwise(F.array(place(F.lit(float(lo)), F.lit(float(hi)), cells)))
        df = df.withColumn("cell", whole)
        for heavy in steps:
            finer = F.concat("cell", F.array(place(F.col("low"), F.col("high"), SPLIT)))
            df = df.join(F.broadcast(heavy), "cell", "left").withColumn("cell", F.when(F.col("low").isNull(), F.col("cell")).otherwise(finer)).drop("low", "high")
        return df

    while True:
        stats = written(located(sized.select("id", "n")).groupBy("cell").agg(F.sum("n").alias("n"), F.min("id").alias("least"), F.max("id").alias("most")), "warc-cells")
        heavy = stats.where((F.col("n") > size) & (F.col("least") < F.col("most"))).select("cell", F.col("least").cast("double").alias("low"), F.col("most").cast("double").alias("high"))
        # ids that a double does not tell apart stay together
        heavy = written(heavy.where("low < high"), "warc-heavy")
        if heavy.isEmpty() or len(steps) == DEPTH:
            break
        steps.append(heavy)
    order = Window.orderBy(F.asc_nulls_last("least"))  # one row a cell
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = stats.select("cell", F.floor(before / size).alias("at"))
    return written(cuts.select("cell", (F.dense_rank().over(Window.orderBy("at")) - 1).alias("shard")), "warc-shards"), located


def planned(pages: DataFrame, shard_bytes: int, revisit_from: int, key: str, url: str, html: str) -> tuple[DataFrame, int]:
    """key, url, payload, digest, target (null for responses), shard; and the number of shards."""
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.coalesce(F.encode(html, "UTF-8"), F.lit(b"")).alias("payload"))
    sized = rows.select("id", F.length("payload").cast("long").alias("n"), F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("same"))
    first = sized.where(F.col("n") >= revisit_from).groupBy("same").agg(F.max("id").alias("last"), F.count("*").alias("copies")).where("copies > 1 and last is not null").drop("copies")
    first = written(first, "warc-copies")
    side = F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first
    if not isinstance(pages.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} is to be an integer, as shards are ranges of it")
    cuts, located = cells_of(sized, shard_bytes)
    shards = (cuts.agg(F.max("shard")).first()[0] or 0) + 1
    out = rows.withColumn("digest", F.sha1("payload")).withColumn("same", F.sha2("payload", 256)).join(side, "same", "left")
    target = F.when((F.length("payload") >= revisit_from) & (F.col("id") < F.col("last")), F.col("last"))
    # a null id cannot be the largest: it revisits, too
    target = F.when((F.length("payload") >= revisit_from) & F.col("id").isNull(), F.col("last")).otherwise(target)
    out = located(out.select("id", "url", "payload", "digest", target.alias("target"))).join(F.broadcast(cuts), "cell")
    return out.drop("cell"), shards


def record(row: dict, date: str) -> bytes:
    """One record; the block of a response is its HTTP message, a revisit has the header part only."""
    payload, target = row["payload"], row["target"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if target is not None else http + payload
    name = lambda i: f"<urn:uuid:{uuid.uuid5(SPACE, f'{i}:{row['digest']}')}>"
    b32 = lambda hexed: "sha1:" + base64.b32encode(bytes.fromhex(hexed)).decode()
    head = [
        ("WARC-Type", "response" if target is None else "revisit"), ("WARC-Record-ID", name(row["id"])), ("WARC-Date", date),
        ("WARC-Target-URI", row["url"] and row["url"].replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", b32(row["digest"])), ("WARC-Block-Digest", b32(hashlib.sha1(block).hexdigest())),
        ("X-Page-Id", row["id"]), ("X-Payload-Length", len(payload)),
    ]
    if target is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(target)), ("X-Refers-To-Page", target)]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head if v is not None).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, folder: str, shard_bytes: int = 32 << 20, roll_bytes: int = 8 << 20, revisit_from: int = 1000, date: str = "2024-01-01T00:00:00Z", key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archives below `folder` (a URI that pyarrow's file systems open) and the manifest; returns the manifest."""
    rows, shards = planned(pages, shard_bytes, revisit_from, key, url, html)
    # Tasks get whole shards by number, so no hash deals two large shards to one task by chance.
    dealt = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("id").asc_nulls_last(), "digest", "url")

    def save(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(f"{root}/data", recursive=True)
        mine, done, state = uuid.uuid4().hex, [], {"shard": None}

        def close():
            if state.get("out"):
                state["out"].close()
                store.move(state["temp"], f"{root}/data/{state['name']}")
                done.append((state["name"], state["n"], state["bytes"], state["sha"].hexdigest()))
                state["out"] = None

        def start(shard, seq):
            name = f"part-{shard:06d}-{seq:05d}.warc.gz"
            temp = f"{root}/data/.{name}.{mine}.tmp"
            state.update(shard=shard, seq=seq, name=name, temp=temp, out=store.open_output_stream(temp), n=0, bytes=0, sha=hashlib.sha256())
            put(member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(SPACE, name)}>\r\nWARC-Date: {date}\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode()))

        def put(data):
            state["out"].write(data)
            state["sha"].update(data)
            state["bytes"] += len(data)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in batch.slice(at, 64).to_pylist():
                    if row["shard"] != state["shard"]:
                        close()
                        start(row["shard"], 0)
                    elif state["bytes"] >= roll_bytes:
                        close()
                        start(row["shard"], state["seq"] + 1)
                    put(member(record(row, date)))
                    state["n"] += 1
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["file", "records", "bytes", "sha256"])

    dealt.mapInArrow(frugal(save), "file string, records long, bytes long, sha256 string").write.mode("overwrite").parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema("file string, records long, bytes long, sha256 string").parquet(f"{folder}/manifest")


def records(data: bytes):
    """(headers, block) of each record, one gzip member at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof and at < len(view):
            piece = view[at : at + (1 << 16)]
            parts.append(z.decompress(piece))
            at += len(piece) - len(z.unused_data)
        raw = b"".join(parts)
        head, _, block = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, block[: int(fields["Content-Length"])]


def parsed(data: bytes):
    for head, block in records(data):
        if head["WARC-Type"] not in ("response", "revisit"):
            continue
        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        n = int(head["X-Payload-Length"])
        if head["WARC-Type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if len(payload) != n or hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"record {head['WARC-Record-ID']} does not match its digest")
        number = lambda k: int(head[k]) if k in head else None
        yield number("X-Page-Id"), n, digest, head["WARC-Type"], number("X-Refers-To-Page")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records in files of the manifest; digests are verified."""
    manifest = spark.read.schema("file string, records long, bytes long, sha256 string").parquet(f"{folder}/manifest")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.gz").load(f"{folder}/data") if not manifest.isEmpty() else None
    names = "page_id payload_bytes payload_digest record_type refers_to".split()
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if files is None:
        return spark.createDataFrame([], schema)

    def parse(batches):
        import pyarrow as pa

        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(parsed(batch.column(1)[i].as_py()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(manifest.select("file"), "file", "left_semi")
    return files.mapInArrow(frugal(parse), schema)


def archive(pages: DataFrame, **options) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    folder = f"{checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, **options)
    return read(pages.sparkSession, folder)
