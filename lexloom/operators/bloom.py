"""A blocked Bloom filter as a table: which of many hashes a corpus may hold.

Ten bits an element; an element sets seven bits of one block of 512, so a probe
looks at one cache line of one shard. Tasks send their distinct hashes, shard by
shard, sorted and compressed, which is less than the bits that they set; a shard's
bits are set, or its probes tested, in one task, shard after shard. Shards are ranges
of blocks, and repeats go before the shuffle, so no shard gets more than its share.
Nothing of the filter ever passes the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import held, words
from lexloom.operators.shared import written

BITS_AN_ELEMENT, PROBES, BLOCK_LOG2 = 10, 7, 9
SHARD_LOG2, MOST_SHARDS_LOG2, LARGEST_SHARD_LOG2 = 20, 12, 26
#: Hashes that a task sends at once, and those whose bits are looked at together.
HASHES_AT_ONCE, POSITIONS_AT_ONCE = 2_000_000, 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)  # the golden ratio's bits, odd


@dataclass
class Filter:
    """The filter's table (shard, bits) and its shape."""

    table: DataFrame
    blocks: int
    shard_log2: int


def shape(n: int) -> tuple[int, int]:
    """Blocks and the size of a shard, as a power of two of bits, for n elements; under 2^31 blocks, so 10^11 elements."""
    blocks = max(1, -(-n * BITS_AN_ELEMENT >> BLOCK_LOG2))
    if blocks >= 1 << 31:
        raise ValueError("more elements than one filter takes: build one for each part of the corpus")
    return blocks, min(LARGEST_SHARD_LOG2, max(SHARD_LOG2, (blocks << BLOCK_LOG2).bit_length() - MOST_SHARDS_LOG2))


def block_of(h: Column, blocks: int) -> Column:
    """The block of a 64-bit hash by its upper half; the same number as `positions` has."""
    return F.shiftright(F.shiftrightunsigned(h, 32) * F.lit(blocks).cast("long"), 32)


def positions(h: np.ndarray, blocks: int) -> np.ndarray:
    """(n, PROBES) bit numbers in the whole filter of hashes as uint64."""
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    x = (h ^ (h >> np.uint64(29))) * MIX
    x = (x ^ (x >> np.uint64(32))) * MIX
    inner = [(x >> np.uint64(1 + BLOCK_LOG2 * i)) & np.uint64((1 << BLOCK_LOG2) - 1) for i in range(PROBES)]
    return (block << np.uint64(BLOCK_LOG2))[:, None] | np.stack(inner, axis=1)


def squeezed(sorted_hashes: np.ndarray) -> bytes:
    """Sorted numbers as the byte planes of their gaps."""
    import zstandard

    gaps = np.diff(sorted_hashes, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes())


def loosened(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def sent(hashes: DataFrame, blocks: int, shard_log2: int) -> DataFrame:
    """shard, hs: the distinct hashes of each HASHES_AT_ONCE of a frame with one column, an array of 64-bit hashes a row."""
    (column,) = hashes.columns

    def run(batches):
        import pyarrow as pa

        def out(found):
            h = np.unique(np.concatenate(found))  # the order of hashes is the order of blocks
            shard = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32 + shard_log2 - BLOCK_LOG2)
            cut = np.flatnonzero(np.diff(shard, prepend=~shard[:1]))
            for lo in range(0, len(cut), 256):
                some = list(zip(cut[lo : lo + 256], [*cut[1:], len(h)][lo : lo + 256], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([int(shard[a]) for a, _ in some], pa.int64()), pa.array([squeezed(h[a:b]) for a, b in some], pa.binary())], ["shard", "hs"])

        found, m = [], 0
        for b in batches:
            h = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for at in range(0, len(h), HASHES_AT_ONCE):
                found.append(h[at : at + HASHES_AT_ONCE])
                m += len(found[-1])
                if m >= HASHES_AT_ONCE:
                    yield from out(found)
                    found, m = [], 0
        if m:
            yield from out(found)

    return hashes.where(F.col(column).isNotNull()).mapInArrow(run, "shard long, hs binary")


def build(hashes: DataFrame, n: int) -> Filter:
    """The filter of a frame with one column, an array of 64-bit hashes a row, for about n elements."""
    blocks, shard_log2 = shape(n)

    def united(frame):
        import pandas as pd

        bits = np.zeros(1 << shard_log2, np.uint8)
        for raw in frame["hs"]:
            h = loosened(raw)
            for lo in range(0, len(h), POSITIONS_AT_ONCE):
                bits[(positions(h[lo : lo + POSITIONS_AT_ONCE], blocks) & np.uint64((1 << shard_log2) - 1)).astype(np.int64)] = 1
        return pd.DataFrame({"shard": frame["shard"].iloc[:1].to_numpy(), "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    return Filter(written(sent(hashes, blocks, shard_log2).groupBy("shard").applyInPandas(united, "shard long, bits binary")), blocks, shard_log2)


def _tested(f: Filter, hashes: DataFrame, result, schema: str) -> DataFrame:
    """`result` of the distinct hashes of each shard and whether the filter may hold them; one shard at a time meets its bits."""
    blocks, shard_log2 = f.blocks, f.shard_log2

    def test(asked, table):
        import pandas as pd

        h = np.unique(np.concatenate([loosened(raw) for raw in asked["hs"]])) if len(asked) else np.zeros(0, np.uint64)
        held = np.zeros(len(h), bool)
        if len(h) and len(table):
            bits = np.frombuffer(table["bits"].iloc[0], np.uint8)
            for lo in range(0, len(h), POSITIONS_AT_ONCE):
                at = (positions(h[lo : lo + POSITIONS_AT_ONCE], blocks) & np.uint64((1 << shard_log2) - 1)).astype(np.int64)
                held[lo : lo + POSITIONS_AT_ONCE] = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
        return pd.DataFrame(result(h.view(np.int64), held))

    return sent(hashes, blocks, shard_log2).groupBy("shard").cogroup(f.table.groupBy("shard")).applyInPandas(test, schema)


def maybe(f: Filter, probes: DataFrame, h: str = "h") -> DataFrame:
    """The distinct hashes of a column that the filter may hold: all that were put in, and about one of a hundred others."""
    asked = probes.where(F.col(h).isNotNull()).select(F.array(h).alias("hs"))
    return _tested(f, asked, lambda x, held: {"h": x[held]}, "h long")


def counted(f: Filter, hashes: DataFrame) -> DataFrame:
    """n, n_held, one row: how many distinct hashes a column of arrays has, and how many of them the filter may hold."""
    by_shard = _tested(f, hashes, lambda x, held: {"n": [len(x)], "n_held": [int(held.sum())]}, "n long, n_held long")
    return by_shard.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n_held")))


def ngram_hashes(df: DataFrame, n: int, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, hs: the hashes of a text's n-grams, with repeats; none for a text of fewer words or null."""
    w = held(df.select(*keep, F.col(text).alias("__t")), "w", words(F.col("__t"))).where(F.size("w") >= n)
    return w.select(*keep, _hashes(n).alias("hs"))


def _hashes(n: int) -> Column:
    """Hashes of the n-grams of the words `w`; the case guards against filters that Spark moves behind it."""
    each = F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.xxhash64(F.slice("w", i, F.lit(n))))
    return F.when(F.size("w") >= n, each).otherwise(F.array().cast("array<bigint>"))


def ngram_filter(docs: DataFrame, n: int, text: str = "text") -> Filter:
    """The filter of a corpus' n-grams, sized for all their occurrences, so that repeats only make it sparser."""
    total = docs.agg(F.sum(F.greatest(F.size(words(F.col(text))) - (n - 1), F.lit(0))).alias("n")).first().n or 0
    return build(ngram_hashes(docs, n, text), total)


def items_met(docs: DataFrame, items: DataFrame, n: int, item: str = "item_id", text: str = "text") -> DataFrame:
    """item, n_grams: distinct n-grams of each item that the corpus holds. The filter clears most; what passes is looked up as text."""
    from lexloom.operators.contamination import grams
    from lexloom.operators.shared import small

    own = written(grams(items, item, n, text).withColumn("h", F.xxhash64(F.split("g", " "))))
    passing = own.join(maybe(ngram_filter(docs, n, text), own), "h", "left_semi")
    sought = small(written(passing.select("h", "g").distinct()))
    occurs = ngram_hashes_and_texts(docs, n, text).join(sought.select("h"), "h", "left_semi").select("g").distinct()
    return passing.join(occurs, "g", "left_semi").groupBy(item).agg(F.count("*").alias("n_grams"))


def ngram_hashes_and_texts(docs: DataFrame, n: int, text: str = "text") -> DataFrame:
    """h, g: each occurrence of an n-gram with its words; the words are only put together where the hash is asked for."""
    w = held(docs.select(F.col(text).alias("__t")), "w", words(F.col("__t"))).where(F.size("w") >= n)
    at = w.select("w", F.posexplode(_hashes(n)).alias("i", "h"))
    return at.select("h", F.array_join(F.slice("w", F.col("i") + 1, F.lit(n)), " ").alias("g"))
