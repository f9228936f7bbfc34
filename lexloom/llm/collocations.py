"""Operator 11: phrase collocations.

First pass: every batch of texts hashes the phrases of one to four words and
counts them in a count-min sketch of two rows. Counts stop at MIN_COUNT, which
loses no decision, so a cell is a byte. A batch sends each range of cells as one
blob of gaps and counts; blobs of a range are summed in one task, and of the sum
only the bits of cells that reach MIN_COUNT are kept. A cell never has less than
any of its phrases, so no frequent phrase can fail. The number of cells follows
the bytes of the corpus, and blobs of a range hold as many cells at any size.

Second pass: phrases whose cells both passed are counted exactly, by their words.
The bits are broadcast up to BROADCAST_BYTES; larger ones are folded to that size
first: cells that agree in their lower digits become one, which passes if any of
them does. So again no frequent phrase can fail, and the exact counts drop what
passes besides. Phrases that cannot be frequent are never shuffled.

Then every candidate is cut at each place and looks its two parts up, which are
frequent as well, and phrases inside a longer one that has most of their count
are dropped. All this is joins on (lang, phrase).

Hot phrases are summed in a batch before they are shuffled, and a phrase is one
row in all joins but those on parts, which Spark splits when they are skewed.

Defined results: null text is empty; null lang is `und`, together with rows that
say so. Rows that repeat count as often as they occur. Empty tables give no rows.
Ids and other columns are ignored. A text of any length is one batch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import freed, frugal, written

MIN_COUNT, LONGEST, TOP = 30, 4, 2000
#: A longer phrase absorbs a shorter one inside it that has at most 100 / ABSORBED of its count.
ABSORBED, SCORE_UNIT = 80, 2_000_000
#: Bytes of text (about half as many phrases of one to four words) for each cell of a row of the sketch.
BYTES_A_CELL = 16
FEWEST_CELLS_LOG2, RANGE_LOG2 = 20, 20
#: Bits of passing cells that are sent to every executor at most; more are folded to that.
BROADCAST_BYTES = 64 << 20
#: Text that is hashed at once (sixteen times as much memory), and cells that are counted together.
BATCH_BYTES, CELLS_AT_ONCE = 2 << 20, 4 << 20
ROWS = 2

#: Fixed value: lower-case A-Z, and of the separators one byte each: a newline between pieces, a blank between words.
_FROM = bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r\t"
BYTES = bytes.maketrans(_FROM, bytes(range(97, 123)) + b"\n" * 9 + b" ")
_rng = np.random.Generator(np.random.PCG64(11))
#: A number for each byte and an odd one for each place in a word; words over 65,536 bytes use them again.
OF_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64)
OF_PLACE = _rng.integers(1, 1 << 62, 1 << 16, np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = _rng.integers(1, 1 << 62, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * FACTORS[6]
    return (x ^ (x >> np.uint64(29))) * FACTORS[7]


def normal(texts: list[str]) -> bytes:
    """The texts in one: pieces end with a newline, words are a single blank apart."""
    x = "\n".join(texts).encode().translate(BYTES)
    while b"  " in x:
        x = x.replace(b"  ", b" ")
    return x


def phrases(x: bytes, lang: str) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """starts and ends of words; for each length from 1 the first words of the phrases and their hashes."""
    b = np.frombuffer(x, np.uint8)
    inside = (b != 10) & (b != 32)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, [(starts, starts.astype(np.uint64))] * LONGEST
    at = np.flatnonzero(inside)
    first = np.cumsum(ends - starts) - (ends - starts)
    place = np.arange(len(at)) - np.repeat(first, ends - starts)
    salt = np.frombuffer(lang.encode(), np.uint8)
    seed = (OF_BYTE[salt] * OF_PLACE[np.arange(len(salt)) & 0xFFFF]).sum(dtype=np.uint64)
    word = mixed(np.add.reduceat(OF_BYTE[b[at]] * OF_PLACE[place & 0xFFFF], first) + seed)
    piece = np.cumsum(b == 10)[starts]
    out = [(np.arange(len(starts)), word)]
    for k in range(2, LONGEST + 1):
        i, h = out[-1]
        i, h = i[: np.searchsorted(i, len(starts) - k + 1)], h
        h = h[: len(i)]
        same = piece[i] == piece[i + k - 1]
        i, h = i[same], h[same]
        out.append((i, mixed(h * FACTORS[k] + word[i + k - 1])))
    return starts, ends, out


def cell(h: np.ndarray, row: int, cells_log2: int) -> np.ndarray:
    return (h * FACTORS[row]) >> np.uint64(64 - cells_log2)


def batches_of(batches) -> Iterator[dict[str, list[str]]]:
    """Texts by language, BATCH_BYTES of them (or one longer text) at a time."""
    found, size = {}, 0
    for b in batches:
        for lang, text in zip(b.column("lang"), b.column("text"), strict=True):
            text = text.as_py()
            if text:
                found.setdefault(lang.as_py(), []).append(text)
                size += len(text)
                if size >= BATCH_BYTES:
                    yield found
                    found, size = {}, 0
    yield found


def deflated(a: np.ndarray) -> bytes:
    """Numbers by planes of their bytes: planes of zeros cost nothing."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def inflated(raw: bytes, kind) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def blobs(cells: np.ndarray, row: int, range_log2: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(row, range, gaps, counts) of cells that were met, in any order and with repeats."""
    cells = np.sort(cells)
    first = np.flatnonzero(np.diff(cells, prepend=~cells[:1]))
    met, n = cells[first], np.diff(first, append=len(cells))
    part = met >> np.uint64(range_log2)
    cut = np.flatnonzero(np.diff(part, prepend=~part[:1]))
    for a, b in zip(cut, [*cut[1:], len(met)], strict=True):
        inner = (met[a:b] & np.uint64((1 << range_log2) - 1)).astype(np.uint32)
        yield row, int(part[a]), deflated(np.diff(inner, prepend=np.uint32(0))), deflated(np.minimum(n[a:b], MIN_COUNT).astype(np.uint8))


def sketch(rows: DataFrame, cells_log2: int, range_log2: int) -> DataFrame:
    """row, range, bits: of every range of cells that was met, which reach MIN_COUNT."""
    import pyarrow as pa

    schema = pa.schema([("row", pa.int32()), ("range", pa.int64()), ("gaps", pa.binary()), ("counts", pa.binary())])

    def out(held):
        for row in range(ROWS):
            found = list(blobs(np.concatenate([cell(h, row, cells_log2) for h in held]), row, range_log2))
            for at in range(0, len(found), 512):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[at : at + 512], strict=True), schema, strict=True)], schema=schema)

    def count(batches):
        held, n = [], 0
        for found in batches_of(batches):
            for lang, texts in found.items():
                hashes = [h for _, h in phrases(normal(texts), lang)[2]]
                held += hashes
                n += sum(map(len, hashes))
            if n >= CELLS_AT_ONCE:
                yield from out(held)
                held, n = [], 0
        if n:
            yield from out(held)

    def merge(frame):
        import pandas as pd

        total = np.zeros(1 << range_log2, np.int32)
        for gaps, counts in zip(frame.gaps, frame.counts, strict=True):
            total[np.cumsum(inflated(gaps, np.uint32), dtype=np.int64)] += inflated(counts, np.uint8)
        return pd.DataFrame({"row": frame.row.iloc[:1].to_numpy(), "range": frame.range.iloc[:1].to_numpy(), "bits": [np.packbits(total >= MIN_COUNT, bitorder="little").tobytes()]})

    sent = rows.mapInArrow(frugal(count), "row int, range long, gaps binary, counts binary")
    return sent.groupBy("row", "range").applyInPandas(merge, "row int, range long, bits binary")


PARTIAL = "lang string, phrase string, k int, n long"


def folded(bits: DataFrame, cells_log2: int, range_log2: int, to_log2: int) -> tuple[DataFrame, int]:
    """row, range, bits of 2^to_log2 cells a row, and the size of their ranges: a cell passes if one that agrees with it in the lower to_log2 digits does."""
    if to_log2 >= cells_log2:
        return bits, range_log2
    inner = min(range_log2, to_log2)

    def united(frame):
        import pandas as pd

        total = np.zeros(1 << inner - 3, np.uint8)
        for raw in frame.bits:
            total |= np.bitwise_or.reduce(np.frombuffer(raw, np.uint8).reshape(-1, len(total)), axis=0)
        return pd.DataFrame({"row": frame.row.iloc[:1].to_numpy(), "range": frame.range.iloc[:1].to_numpy(), "bits": [total.tobytes()]})

    dealt = bits.withColumn("range", F.col("range").bitwiseAND(F.lit((1 << to_log2 - inner) - 1).cast("long")))
    return dealt.groupBy("row", "range").applyInPandas(united, "row int, range long, bits binary"), inner


def exact(rows: DataFrame, bits: DataFrame, cells_log2: int, range_log2: int, at_most: int) -> DataFrame:
    """lang, phrase, k, n: exact counts of all phrases that occur MIN_COUNT times; and, as k = 0, of a language's words."""
    import pyarrow as pa

    to_log2 = min(cells_log2, max(3, (at_most * 8 // ROWS).bit_length() - 1))
    bits, inner = folded(bits, cells_log2, range_log2, to_log2)
    whole, width = np.zeros((ROWS, 1 << (to_log2 - 3)), np.uint8), 1 << (inner - 3)
    for r in bits.toLocalIterator():
        whole[r.row, r.range * width : (r.range + 1) * width] = np.frombuffer(bytes(r.bits), np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(whole)
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("n", pa.int64())])

    def passes(h):
        held = np.ones(len(h), bool)
        for row in range(ROWS):
            c = cell(h, row, cells_log2) & np.uint64((1 << to_log2) - 1)
            held &= (shared.value[row][c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return held

    def count(batches):
        for found in batches_of(batches):
            for lang, texts in found.items():
                x = normal(texts)
                starts, ends, by_length = phrases(x, lang)
                for k, (i, h) in enumerate(by_length, 1):
                    held = passes(h)
                    i = i[held]
                    n = Counter([x[a:b] for a, b in zip(starts[i].tolist(), ends[i + k - 1].tolist(), strict=True)])
                    words = list(n)
                    for at in range(0, len(words), 20_000):
                        some = slice(at, at + 20_000)
                        m = len(words[some])
                        values = [[lang] * m, [w.decode() for w in words[some]], [k] * m, list(n.values())[some]]
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema, strict=True)], schema=schema)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip([[lang], [""], [0], [len(starts)]], schema, strict=True)], schema=schema)

    met = rows.mapInArrow(frugal(count), PARTIAL)
    return met.groupBy("lang", "phrase", "k").agg(F.sum("n").alias("n")).where((F.col("n") >= MIN_COUNT) | (F.col("k") == 0))


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", at_most: int = BROADCAST_BYTES) -> DataFrame:
    """lang, phrase, k, n of all phrases of up to LONGEST words that occur MIN_COUNT times in a language; k = 0: all its words."""
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    cells_log2 = max(FEWEST_CELLS_LOG2, (size // BYTES_A_CELL).bit_length())
    range_log2 = min(cells_log2, max(RANGE_LOG2, cells_log2 - 12))
    bits = written(sketch(rows, cells_log2, range_log2), "sketch")
    out = written(exact(rows, bits, cells_log2, range_log2, at_most), "phrases")
    freed(bits)
    return out


def part(words: str, first, length) -> F.Column:
    return F.array_join(F.slice(words, first, length), " ")


def scored(known: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of every candidate: its lowest-scoring cut, of equals the first."""
    found = known.where("k >= 2").withColumn("w", F.split("phrase", " "))
    cuts = found.select("lang", "phrase", F.col("n").alias("a"), "k", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part("w", F.lit(1), F.col("cut")).alias("left"), part("w", F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    ones = known.where("k >= 1")
    cuts = cuts.join(ones.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(ones.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    score = F.expr(f"cast((cast(a as decimal(20, 0)) * {SCORE_UNIT}BD) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0))) as bigint)")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def absorbed(known: DataFrame) -> DataFrame:
    """lang, phrase, most: the count of the most frequent longer candidate around a phrase."""
    longer = known.where("k >= 3").withColumn("w", F.split("phrase", " "))
    lengths = longer.select("lang", "n", "k", "w", F.explode(F.expr("sequence(2, k - 1)")).alias("m"))
    inner = lengths.select("lang", "n", "m", "w", F.explode(F.expr("sequence(1, k - m + 1)")).alias("i")).select("lang", "n", part("w", F.col("i"), F.col("m")).alias("phrase"))
    return inner.groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def collocations(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best `top` phrases of each language."""
    known = frequent(docs, **options)
    large = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by)
    kept = scored(known).join(absorbed(known), ["lang", "phrase"], "left").where(F.col("most").isNull() | (large("most", 100) < large("a", ABSORBED))).drop("most")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")  # Spark keeps the first of each task before it shuffles them
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = known.where("k = 0").select("lang", "n")
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
