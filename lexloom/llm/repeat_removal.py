"""Operator 2: suffix-array removal of repeated byte strings across documents.

Every byte covered by a `LENGTH`-byte string that also starts in a document of
a smaller id goes. Shards for the suffix arrays are made by content: each
LENGTH-byte window has an anchor, its leftmost K-byte string of smallest hash,
and consecutive windows of one anchor form a block. Equal windows have equal
anchors, so only blocks under one anchor hash can hold equal windows.

1. Blocks (anchor hash, block hash, id, place) are dealt by ranges of the anchor
   hash, in blobs of byte planes. Of equal blocks only the smallest id's goes on;
   the others are covered whole. Within a slice of texts this happens before the
   shuffle, so a block that a third of all documents share costs one row a slice.
   An anchor that still has many different blocks in one slice is hot: that slice's
   go by their block hash, and a mark tells the anchor's range that all its blocks
   are for step 3. An anchor of one document only is dropped.
2. Blocks that differ under a common anchor are cut from their texts, laid end
   to end in shards, and a suffix array is induced for each shard; permuted
   common prefixes of LENGTH or more delimit the runs of equal windows, and each
   window above its run's smallest id is covered.
3. Hot anchors, and those with more than `HOT_BLOCKS` blocks, are split by the
   window itself and joined exactly, without a group in one task.
4. Covered stretches are united per document, cut out, and the rest is hashed.

Anchors are told apart by 32 bits within their range; anchors that meet there are
compared by their blocks' bytes, so only work grows. Block hashes are 56 bits next
to these, so two unequal blocks of one range are taken for equal with a chance
near 2^-88 a pair. Rows are known by two 64-bit hashes of id and text.

Defined results: null and empty texts have no bytes and nothing removed; a null
id counts as the largest; rows of one id never cover each other, repeated rows
get the same result each; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import freed, frugal, narrowed, written
from lexloom.llm.suffix_arrays import permuted_prefixes, suffix_array

LENGTH, K = 50, 20
#: Text bytes handled at a time; a longer text is cut into overlapping pieces of this size.
SLICE = 1 << 19
#: Bytes of blobs that one reducing task is to hold, and of blocks in one suffix array.
BLOB_BYTES, SHARD_BYTES = 6 << 20, 1 << 20
#: Blocks under one anchor that go to one shard at most.
HOT_BLOCKS = 4096
#: Different blocks of one anchor that a slice sends to the anchor's range at most, and that all slices together are to send.
HOT_IN_SLICE, RANGE_BLOCKS = 64, 2_000_000
LAST = (1 << 63) - 1

U = np.uint64
P, P_INVERSE = U(0xD6E8FEB86659FD93), U(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class Rolling:
    """Hashes of substrings of one array, from prefix sums with the powers divided out."""

    size, down, up = 0, None, None
    bytes_ = mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))

    def __init__(self, b: np.ndarray):
        if Rolling.size <= len(b):
            Rolling.size = max(len(b) + 1, SLICE + (1 << 12))
            with np.errstate(over="ignore"):
                Rolling.down = np.cumprod(np.r_[U(1), np.full(Rolling.size, P_INVERSE)], dtype=U)
                Rolling.up = np.cumprod(np.r_[U(1), np.full(Rolling.size, P)], dtype=U)
        self.sums = np.zeros(len(b) + 1, U)
        np.cumsum(self.bytes_[b] * self.down[: len(b)], dtype=U, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(U))


def blocks(b: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, block hash, owner, start, windows) of the blocks of texts laid end to end; owner says whose each byte is."""
    n = len(b) - length + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none.astype(U), none.astype(U), none, none, none
    roll = Rolling(b)
    at = np.arange(len(b) - K + 1)
    h = roll.of(at, at + K)
    low = U((1 << 22) - 1)  # the place breaks ties: the leftmost
    v = (h & ~low) | at.astype(U)
    width, have = length - K + 1, 1
    while have * 2 <= width:
        v = np.minimum(v[:-have], v[have:])
        have *= 2
    if have < width:
        v = np.minimum(v[: n], v[width - have : width - have + n])
    anchor = (v & low).astype(np.int64)
    start = np.arange(n)
    whole = owner[:n] == owner[length - 1 :]
    start, anchor = start[whole], anchor[whole]
    if not len(start):
        return h[:0], h[:0], start, start, start
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)])
    a, anchor = start[first], anchor[first]
    windows = np.diff(np.r_[first, len(start)])
    # an anchor's hash is the least of many: mixed again, its ranges are even
    return mixed(h[anchor] + U(1)), roll.of(a, a + windows + (length - 1)) ^ mixed((anchor - a).astype(U) + U(1)), owner[a], a, windows


def slices(batches, length: int, limit: int):
    """(bytes, owner row of each byte, begins, ids, uids, offsets) of texts, about `limit` bytes at a time; long texts overlap by length - 1.

    A row that its slice has already is left out: results are by uid.
    """
    held, total, names = [], 0, set()

    def laid():
        b = np.frombuffer(b"".join(x for x, *_ in held), np.uint8)
        owner = np.repeat(np.arange(len(held)), [len(x) for x, *_ in held])
        begins = np.cumsum([0, *(len(x) for x, *_ in held)])[:-1]
        return b, owner, begins, np.array([x[1] for x in held], np.int64), np.array([x[2] for x in held], np.int64), np.array([x[3] for x in held], np.int64)

    for batch in batches:
        for i in range(batch.num_rows):
            raw = (batch.column(3)[i].as_py() or "").encode("utf-8", "replace")
            id_, uid = batch.column(0)[i].as_py(), (batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
            for at in range(0, max(1, len(raw) - length + 1), limit - length + 1):
                piece = raw[at : at + limit]
                if len(piece) < length or (uid, at) in names:
                    continue
                if held and total + len(piece) > limit:
                    yield laid()
                    held.clear()
                    names.clear()
                    total = 0
                held.append((piece, id_, uid, at))
                names.add((uid, at))
                total += len(piece)
    if held:
        yield laid()


def packed(x: np.ndarray) -> bytes:
    """Whole numbers as byte planes, as many as the largest needs."""
    x = np.ascontiguousarray(x).astype(U, copy=False)
    return x.view(np.uint8).reshape(-1, 8)[:, : max(1, -(-int(x.max(initial=0)).bit_length() // 8))].T.tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : len(raw) // n] = np.frombuffer(raw, np.uint8).reshape(-1, n).T
    return out.view(U).ravel()


#: Bits of an anchor hash within its range, that a block hash loses, and rows of a blob table: blocks, blocks of a slice's hot anchors, marks of hot anchors, and a slice's rows with what it covered itself.
ANCHOR, LOST = U(32), U(8)
BLOCKS, HOT, MARKS, ROWS = range(4)
BLOB = "part int, slice long, kind int, base long, ids binary, who binary, h binary, f binary, at binary, windows binary"


def ranged(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part whose range a hash is in, and its next bits there."""
    scaled = (h >> U(32)) * U(parts)
    return scaled >> U(32), scaled & U(0xFFFFFFFF)


def dealt(docs: DataFrame, length: int, parts: int, most: int) -> DataFrame:
    """Blobs of blocks by part of the anchor hash's range."""
    limit = SLICE  # the driver's value goes to the workers

    def blobs(part, kind, slice_, ids, who, h, f, at, windows):
        order = np.argsort(part, kind="stable")
        part, ids, who, h, f, at, windows = (x[order] for x in (part, ids, who, h, f, at, windows))
        cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else part
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            base = int(ids[a:z].min())
            yield (int(part[a]), slice_, kind, base, packed(ids[a:z].view(U) - np.array(base).view(U)), packed(who[a:z]), packed(h[a:z]), packed(f[a:z] >> LOST), packed(at[a:z]), windows[a:z].astype(np.uint8).tobytes())

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 6]
        first_slice = TaskContext.get().partitionId() << 32
        for number, (b, owner, begins, ids, uids, offsets) in enumerate(slices(batches, length, limit)):
            slice_ = first_slice + number
            h, f, who, at, windows = blocks(b, owner, length)
            if not len(h):
                continue
            at = at - begins[who] + offsets[who]
            # within the slice: of equal blocks all but those of the smallest id are covered
            order = np.lexsort((ids[who], f, h))
            h, f, who, at, windows = (x[order] for x in (h, f, who, at, windows))
            new_h = np.r_[True, h[1:] != h[:-1]]
            new = new_h | np.r_[True, f[1:] != f[:-1]]
            covered = ids[who] > ids[who[np.flatnonzero(new)]][np.cumsum(new) - 1]
            # what is covered here: neighbouring blocks as one stretch
            w, a, n = who[covered], at[covered], windows[covered]
            order = np.lexsort((a, w))
            w, a, n = w[order], a[order], n[order]
            ends = np.r_[True, (w[1:] != w[:-1]) | (a[1:] != a[:-1] + n[:-1])] if len(w) else np.empty(0, bool)
            starts = np.flatnonzero(ends)
            sizes = np.add.reduceat(n, starts) + (length - 1) if len(w) else n
            rows = [(((slice_ >> 32) + number) % parts, slice_, ROWS, len(starts), uids[:, 0].tobytes(), packed(w[starts]), uids[:, 1].tobytes(), b"", packed(a[starts]), packed(sizes))]
            different = np.add.reduceat((new & ~covered).astype(np.int64), np.flatnonzero(new_h))
            hot = (different > most)[np.cumsum(new_h) - 1] & ~covered
            part, short = ranged(h, parts)
            name = part << ANCHOR | short
            cold = ~covered & ~hot
            values = lambda x: (ids[who[x]], who[x])  # noqa: B023, E731
            rows += blobs(part[cold], BLOCKS, slice_, *values(cold), short[cold], f[cold], at[cold], windows[cold])
            rows += blobs(ranged(f[hot], parts)[0], HOT, slice_, *values(hot), name[hot], f[hot], at[hot], windows[hot])
            marks = np.unique(name[hot])
            rows += [(int(m >> ANCHOR), slice_, MARKS, int(m), *[b""] * 6) for m in marks]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=[c.split()[0] for c in BLOB.split(", ")])

    return docs.select("id", "uid", "uid2", "text").mapInArrow(frugal(run), BLOB)


def settled(blobs: DataFrame, length: int, parts: int) -> DataFrame:
    """(slice, who) with uid and uid2: the rows of the slices; with at and size: covered stretches; with h, id and hot, too: blocks that differ under a common anchor."""

    def run(batches):
        import pyarrow as pa

        types = {"slice": pa.int64(), "who": pa.int32(), "uid": pa.int64(), "uid2": pa.int64(), "at": pa.int64(), "size": pa.int64(), "h": pa.int64(), "id": pa.int64(), "hot": pa.bool_()}

        def made(n: int, **columns):
            return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in types.items()], names=list(types))

        got, marks = {k: [] for k in "slice who h f id at windows hot".split()}, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == MARKS:
                    marks.append(r["base"])
                elif r["kind"] == ROWS:
                    uid = np.frombuffer(r["ids"], np.int64)
                    yield made(len(uid), slice=np.full(len(uid), r["slice"]), who=np.arange(len(uid)), uid=uid, uid2=np.frombuffer(r["h"], np.int64))
                    if n := r["base"]:
                        yield made(n, slice=np.full(n, r["slice"]), who=unpacked(r["who"], n).astype(np.int32), at=unpacked(r["at"], n).astype(np.int64), size=unpacked(r["windows"], n).astype(np.int64))
                else:
                    n, hot = len(r["windows"]), r["kind"] == HOT
                    got["slice"].append(np.full(n, r["slice"]))
                    got["who"].append(unpacked(r["who"], n).astype(np.uint32))
                    got["h"].append(unpacked(r["h"], n) | (U(0) if hot else U(r["part"]) << ANCHOR))
                    got["f"].append(unpacked(r["f"], n))
                    got["id"].append((unpacked(r["ids"], n) + np.array(r["base"]).view(U)).view(np.int64))
                    got["at"].append(unpacked(r["at"], n).astype(np.int64))
                    got["windows"].append(np.frombuffer(r["windows"], np.uint8))
                    got["hot"].append(np.full(n, hot))
        if not got["h"]:
            return
        c = {}
        for k in list(got):
            c[k] = np.concatenate(got.pop(k))
        order = np.lexsort((c["id"], c["f"], c["h"]))
        c = {k: x[order] for k, x in c.items()}
        new_h = np.r_[True, c["h"][1:] != c["h"][:-1]]
        new_f = new_h | np.r_[True, c["f"][1:] != c["f"][:-1]]
        of_h, of_f = np.cumsum(new_h) - 1, np.cumsum(new_f) - 1
        start_h, start_f = np.flatnonzero(new_h), np.flatnonzero(new_f)
        covered = c["id"] > c["id"][start_f][of_f]
        lo, hi = np.minimum.reduceat(c["id"], start_h), np.maximum.reduceat(c["id"], start_h)
        several = np.add.reduceat(new_f.astype(np.int64), start_h) > 1
        hot = c["hot"] | np.isin(c["h"], np.array(marks, np.int64).astype(U))
        # the block of the smallest id of all under the anchor has nothing smaller to meet, but others meet it
        open_ = ~covered & (hot | (several & (lo < hi))[of_h])
        some = np.flatnonzero(covered | open_)
        for at in range(0, len(some), 100_000):
            x = some[at : at + 100_000]
            null = covered[x]
            of_open = lambda v: pa.array(v, mask=null)  # noqa: B023, E731
            yield made(len(x), slice=c["slice"][x], who=c["who"][x].astype(np.int32), at=c["at"][x], size=c["windows"][x].astype(np.int64) + (length - 1), h=of_open(c["h"][x].astype(np.int64)), id=of_open(c["id"][x]), hot=of_open(hot[x]))

    return blobs.repartitionById(parts, F.col("part")).mapInArrow(frugal(run), "slice long, who int, uid long, uid2 long, at long, size long, h long, id long, hot boolean")


#: Steps of the extensions that blocks which may share a window are told by.
STEPS = 4


def promising(b: np.ndarray, begin: np.ndarray, size: np.ndarray, h: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """Blocks that can share a window with another id's under their anchor.

    In a shared window the anchor has l bytes before and r after it, l + r = length - K,
    in both blocks. So both have the same l' <= l bytes before and r' <= r bytes after
    it for one of a few steps of l', and only blocks that meet there go on.
    """
    reach = length - K
    roll, anchor = Rolling(b), np.empty(len(begin), np.int64)
    at = np.arange(len(b) - K + 1)
    hashes = roll.of(at, at + K) & ~U((1 << 22) - 1)
    for x in range(0, len(begin), 10_000):  # the leftmost of the least, as in `blocks`
        places = np.minimum(begin[x : x + 10_000, None] + np.arange(reach + 1), len(at) - 1)
        anchor[x : x + 10_000] = begin[x : x + 10_000] + np.argmin(hashes[places], 1)
    out = np.zeros(len(begin), bool)
    edges = [-(-k * reach // STEPS) for k in range(STEPS + 1)]
    for left, right in [*((a, reach - z + 1) for a, z in zip(edges, edges[1:], strict=False)), (reach, 0)]:
        lo, hi = anchor - left, anchor + K + right
        whole = np.flatnonzero((lo >= begin) & (hi <= begin + size))
        if not len(whole):
            continue
        key = roll.of(lo[whole], hi[whole])
        order = np.lexsort((ids[whole], key, h[whole]))
        x = whole[order]
        first = np.flatnonzero(np.r_[True, (h[x][1:] != h[x][:-1]) | (key[order][1:] != key[order][:-1])])
        several = ids[x[first]] < np.maximum.reduceat(ids[x], first)
        out[x] |= np.repeat(several, np.diff(np.r_[first, len(x)]))
    return out


def compared(blocks_: DataFrame, length: int) -> DataFrame:
    """blocks (h, id, uid, uid2, at, b) -> (uid, uid2, at, size): covered stretches, by the suffix arrays of shards of whole anchors."""
    shards, limit = blocks_.repartition("h").sortWithinPartitions("h"), SHARD_BYTES

    def shard(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
        """rows: (id, uid, uid2, at, bytes, h)."""
        sizes = np.array([len(r[4]) for r in rows])
        some = promising(np.frombuffer(b"\0".join(r[4] for r in rows), np.uint8), np.cumsum(np.r_[0, sizes[:-1] + 1]), sizes, np.array([r[5] for r in rows]), np.array([r[0] for r in rows]), length)
        if not some.any():
            return []
        rows = [rows[k] for k in np.flatnonzero(some)]
        sizes = sizes[some]
        begin = np.cumsum(np.r_[0, sizes[:-1] + 1])
        s = np.frombuffer(b"\0".join(r[4] for r in rows), np.uint8).astype(np.int64) + 2
        s = np.append(s, 0)
        s[begin[1:] - 1] = 1  # between blocks
        owner = np.repeat(np.arange(len(rows)), sizes + 1)
        sa = suffix_array(s)
        shared = permuted_prefixes(s, sa)[sa] >= length
        ends = (begin + sizes)[owner]
        whole = (ends - np.arange(len(s)))[sa] >= length  # the window ends inside its block
        group = np.cumsum(~shared) - 1
        sa, group = sa[whole], group[whole]
        if not len(sa):
            return []
        ids = np.array([r[0] for r in rows])[owner[sa]]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        least = np.repeat(np.minimum.reduceat(ids, first), np.diff(np.r_[first, len(group)]))
        bad = np.sort(sa[ids > least])
        if not len(bad):
            return []
        cut = np.flatnonzero(np.r_[True, (bad[1:] != bad[:-1] + 1) | (owner[bad[1:]] != owner[bad[:-1]])])
        out = []
        for a, z in zip(bad[cut], bad[np.r_[cut[1:], len(bad)] - 1], strict=True):
            r = owner[a]
            out.append((rows[r][1], rows[r][2], rows[r][3] + int(a - begin[r]), int(z - a) + length))
        return out

    def run(batches):
        import pyarrow as pa

        held, size, last = [], 0, None

        def made():
            found = shard(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(4)], names=["uid", "uid2", "at", "size"])

        for batch in batches:
            for h, id_, uid, uid2, at, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if h != last and size >= limit:
                    yield made()
                    size = 0
                last = h
                held.append((id_, uid, uid2, at, b, h))
                size += len(b) + 1
        if held:
            yield made()

    return shards.select("h", "id", "uid", "uid2", "at", "b").mapInArrow(frugal(run), "uid long, uid2 long, at long, size long")


def split_by_window(blocks_: DataFrame, length: int) -> DataFrame:
    """The same for anchors of very many blocks, by the windows themselves; combined before the shuffle."""
    windows = blocks_.select("id", "uid", "uid2", "at", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("b") - (length - 1)), lambda i: F.substring("b", i, F.lit(length)))).alias("k", "w"))
    least = windows.groupBy("w").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most")
    return windows.join(least, "w").where("id > least").select("uid", "uid2", (F.col("at") + F.col("k")).alias("at"), F.lit(length).cast("long").alias("size"))


UID = ["uid", "uid2"]


def covered(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs (id, uid, uid2, text) -> (uid, uid2, at, size): stretches of bytes that a smaller document also has; they overlap."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # blocks are about 21 bytes for every 16 of text
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * 21 / 16 / BLOB_BYTES) + 1)
    most = min(HOT_IN_SLICE, max(8, RANGE_BLOCKS * SLICE // max(1, total)))
    rows = written(settled(dealt(docs, length, parts, most), length, parts), "blocks")
    names = rows.where("uid is not null").select("slice", "who", *UID)
    spots = written(rows.where("uid is null").drop(*UID).join(names, ["slice", "who"]).drop("slice", "who"), "spots")
    freed(rows)
    mine = written(spots.where("h is not null").groupBy(*UID).agg(F.collect_set(F.struct("h", "id", "at", "size", "hot")).alias("x")), "open")
    texts = narrowed(docs.select(*UID, "text"), mine.select(*UID), UID).dropDuplicates(UID)
    cut = texts.join(mine, UID).withColumn("t", F.encode("text", "UTF-8")).select(*UID, "t", F.explode("x").alias("x"))
    # the text is carried to its blocks by reference and never leaves the stage
    cut = written(cut.select("x.h", "x.id", *UID, "x.at", "x.hot", F.expr("substring(t, cast(x.at + 1 as int), cast(x.size as int))").alias("b")), "cut")
    freed(mine)
    hot = written(cut.groupBy("h").agg(F.count("*").alias("n"), F.max("hot").alias("hot")).where(F.col("hot") | (F.col("n") > HOT_BLOCKS)).select("h"), "hot")
    found = compared(narrowed(cut, hot, "h", "left_anti"), length)
    if not hot.isEmpty():
        found = found.union(split_by_window(narrowed(cut, hot, "h"), length))
    found = written(found, "stretches")
    freed(cut, hot)
    out = written(spots.where("h is null").select(*UID, "at", "size").union(found), "covered")
    freed(spots, found)
    return out


def without_repeats(df: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256."""
    hashes = F.xxhash64(key, text).alias("uid"), F.xxhash64(text, key).alias("uid2")
    raw = df.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"), *hashes, F.coalesce(text, F.lit("")).alias("text"))
    spans = covered(raw.select("id", *UID, "text"), length)
    per = spans.groupBy(*UID).agg(F.collect_list(F.struct("at", "size")).alias("spans"))
    names = written(spans.select(*UID).distinct(), "touched")
    plain = narrowed(raw, names, UID, "left_anti").select(
        "key", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"),
    )
    touched = narrowed(raw, names, UID).join(per, UID).select("key", "text", F.col("spans.at").alias("at"), F.col("spans.size").alias("size"))
    kind = df.schema[key].dataType.simpleString()

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for t, at, size in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                b = t.as_py().encode("utf-8", "replace")
                a, n = np.asarray(at.values), np.asarray(size.values)
                edge = np.bincount(a, minlength=len(b) + 1) - np.bincount(a + n, minlength=len(b) + 1)
                gone = np.cumsum(edge[: len(b)]) > 0
                kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
                out.append((len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    done = touched.mapInArrow(frugal(cut), f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return plain.union(done).withColumnRenamed("key", key)
